"""Personal data in free text: finding it and putting typed placeholders in its place."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package

KINDS = ("email", "address", "id_number", "phone", "name")

# ---- e-mail -------------------------------------------------------------------------------------------------------
_DOT = r"(?:\.| dot |\(dot\)|\[dot\]|\{dot\}| \(dot\) | \[dot\] )"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_LOCAL = rf"[\w+%-]+(?:{_DOT}[\w+%-]+)*"
_DOT_BACK = r"(?:\.| tod |\)tod\(|\]tod\[|\}tod\{| \)tod\( | \]tod\[ )"
#: What is before the sign, read backwards from it, and what stands before that without a gap; the sign itself and what
#: follows it, plainly written or in words.
LOCAL_BACK = re.compile(rf"(?i)[\w+%-]+(?:{_DOT_BACK}[\w+%-]+)*")
TOKEN_BACK = re.compile(r"[^\s\"'<>()\[\]{},;@]*")
AT_BRACKET = re.compile(rf"(?i) ?[\[({{<]at[\])}}>] ?({_LABEL}(?:{_DOT}{_LABEL})+)")
AT_WORD = re.compile(rf"(?i) at ({_LABEL}(?:(?: dot |\(dot\)|\[dot\]){_LABEL})+)")
AT_SIGN = re.compile(rf"(?i)@({_LABEL}(?:\.{_LABEL})+)")
_TOP = re.compile(r"(?i)[^\W\d_]{2,}\Z")
_LAST_DOT = re.compile(rf"(?i){_DOT}")

# ---- numbers ------------------------------------------------------------------------------------------------------
NUMBER = re.compile(
    r"(?P<intl>\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,5}(?!\w))"
    r"|(?P<area>\(0?\d{2,4}\)[ .-]?\d{3,5}[ .-]?\d{3,5}(?!\w))"
    r"|(?P<tail>\d{3}\.\d{3}\.\d{3}-\d{2}(?!\w))"
    r"|(?P<born>\d{8}-\d{4}(?![\w-]))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-])|\d{3} \d{2} \d{4}(?!\w))"
    r"|(?P<trunk>0\d(?:[ .-]\d{2}){4}(?![\w-])|0\d{2,4}[ .-]\d{3,6}(?:[ .-]\d{2,4}){0,2}(?![\w-]))"
    r"|(?P<plain>\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])|\d{3} \d{3} \d{4}(?!\w))"
    r"|(?P<check>\d{7,8}-?[A-Z](?!\w))"
    r"|(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]))"
    r"|(?P<pairs>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w))"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<letter>[A-Z]{1,2}\d{6,9}(?!\w))"
)
#: What every number of these forms holds.
LONG_DIGITS = re.compile(r"\d[\d .()-]{4,}\d")
LABELLED = re.compile(r"[A-Z]{0,3}\d[\dA-Z]*(?:[-./]\d[\dA-Z]*){0,5}")
_LABELS = (
    r"ssn|social security|social insurance|passport|travel document|nino|ni|national insurance|insurance|tax(?:payer)?(?: id)?|tin|vat id|"
    r"national id(?:entity)?|id card|identity(?: card)?|civic|personal|personnummer|person number|citizen(?: id)?|resident(?: id)?|"
    r"driver'?s? licen[cs]e|driving licen[cs]e|health card|medicare|nhs|cpf|dni|nie|nif|bsn|pesel|aadhaar|iban"
)
#: How each of the labels begins; there is none without one of these.
LABEL_CUES = (
    "ssn", "social ", "passport", "travel document", "ni", "national i", "insurance", "tax", "tin", "vat id", "id card", "identity", "civic", "person", "citizen",
    "resident", "driver", "driving ", "health card", "medicare", "nhs", "cpf", "dni", "nie", "nif", "bsn", "pesel", "aadhaar", "iban",
)
#: The most characters that a label with what follows it, or one that introduces a name, can have, and the most of a number.
LABEL_REACH, NUMBER_REACH = 48, 64
#: A label right before a number, and words that say what else it numbers.
PERSON_LABEL = re.compile(rf"(?i)(?<![^\W_])(?:{_LABELS})(?: card)?[ _-]?(?:no|nr|num|number|id|code)?\.?[\s:=#\"']{{0,4}}\Z")
OTHER_LABEL = re.compile(
    r"(?i)(?<![^\W_])(?:ticket|part|order|build|rev|revision|version|ver|uuid|guid|ip|port|magic|offset|epoch|issue|bug|invoice|sku|serial|"
    r"model|rfc|section|line|lane|rack|page|hash|commit|pr|case|job|batch|item|lot|tracking|isbn|bytes|timestamp|zoom|tiles)"
    r"(?:[ _-]?(?:no|nr|num|number|id))?\.?[\s:=#]{0,3}\Z"
)
PHONE_LABEL = re.compile(r"(?i)(?:tel|phone|call|mobile|cell|fax|desk|escalation|reached at|contact|whatsapp|sms|ring|/)[\s:.=]{0,3}\Z")
#: A piece counts from this score on. Forms start with the scores below; a person's label adds two to numbers, a fitting
#: check digit one or two; a word that says what else it numbers takes three, a failed check of VETO all.
LEAST = 2
WEIGHT = {"tail": 1, "pairs": 1, "born": 1, "check": 0, "ssn": 0, "letter": 0, "card": 0, "iban": 0}
PHONE_WEIGHT = {"intl": 2, "area": 2, "trunk": 2, "plain": 2}
#: Forms whose numbers nobody issues with a wrong check digit, whatever the label says.
VETO = ("iban", "card")

# ---- addresses ----------------------------------------------------------------------------------------------------
_TOWN = r"[^\W\d_a-z][\w'’]+(?:[ -](?:(?:sur|am|an|der|an der|upon|on|le|la|de|in|under|bei)[ -])?[^\W\d_a-z][\w'’]+){0,3}"
_POST = r"(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?|\d{4,6}(?:-\d{3,4})?)(?!\w)"
_TAIL = rf",? (?:{_POST},? {_TOWN}|{_TOWN}(?:,? {_POST})?)"
_UNIT = r"(?:(?i:unit|apt\.?|apartment|flat|suite|ste\.?|room|floor|c/o) ?[\w-]{1,6}, )?"
_STREET = (
    r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|boulevard|blvd|way|close|place|pl|square|sq|terrace|crescent|row|hill|"
    r"gardens|grove|walk|mews|parade|highway|alley|quay"
)
_ROMANCE = r"rue|avenue|boulevard|place|chemin|allée|quai|impasse|via|viale|calle|rua|avenida|piazza|plaza|route"
_GERMAN = r"weg|gasse|straße|strasse|allee|platz|ring|damm|ufer|str\."
ADDRESS = re.compile(
    rf"{_UNIT}(?:\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})? (?:[^\W\d_a-z][\w'’-]+ ){{1,3}}(?i:{_STREET})\.?"
    rf"|\d{{1,5}}(?: ?(?:bis|ter))?,? (?i:{_ROMANCE}) (?:(?:du|des|del|della|dei|do|da|de la|de l['’]|de los|de|d['’]) ?)?[^\W\d_a-z][\w'’-]+"
    rf"|[^\W\d_a-z][\w-]*(?i:{_GERMAN}) \d{{1,5}}[a-z]?(?!\w)"
    rf"|(?i:p\. ?o\. ?box|po box|post office box|postfach|apartado|boîte postale) \d{{1,6}}){_TAIL}"
)
#: All that an address can be made of, in a row.
ADDRESS_RUN, ADDRESS_RUN_BACK = re.compile(r"[\w ,.'’/-]*"), re.compile(r"[\w ,.'’/-]*")
#: Words that an address must hold, and whether a letter before them must be a capital, or a digit stand beside them.
ADDRESS_CUES = {
    **{f" {w}{e}": "capital" for w in _STREET.split("|") for e in (",", ".,", " ")},
    **{f" {w} ": "any" for w in ("rue", "chemin", "allée", "quai", "via", "viale", "calle", "rua", "avenida", "piazza", "plaza", "impasse")},
    **{f"{w} ": "number" for w in [*_GERMAN.replace("\\", "").split("|"), "box", "postfach", "apartado", "postale"]},
}

# ---- names --------------------------------------------------------------------------------------------------------
_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|ter|ten|zu|zur)"
_PARTICLES = r"(?:(?i:van|von|der|den|de|del|della|di|da|dos|du|la|le|ter|ten|zu|zur|al|el|bin|ibn|st\.?) )*"
PARTICLE_END = re.compile(rf"(?i)(?<!\w){_PARTICLE} \Z")
_CUE_BEFORE = re.compile(
    r"(?i)(?:author|signed-off-by|reviewed[ -]by|tested-by|acked-by|co-authored-by|thanks to|written by|copyright \(c\) \d{4}|maintainer|"
    r"customer|user|patient|note for|contact|ask|name)[\s:=]{1,3}\Z"
)
#: Of these, the ones after which two capitalised words are a name though neither is on the list, and what stands between.
INTRODUCTIONS = ("author", "signed-off-by", "reviewed by", "reviewed-by", "tested-by", "acked-by", "co-authored-by", "thanks to", "written by", "maintainer", "patient")
_THEN = re.compile(r"[\s:=]{1,3}")
_COMPANY = re.compile(r"(?i)\b(?:systems|labs?|inc|ltd|llc|gmbh|group|software|foundation|project|corp|works|partners|filter|release|company|co)\b")


_PART = r"[^\W\d_]+"
_GIVEN = rf"(?P<g1>{_PART})(?:-(?P<g2>{_PART}))?(?: [^\W\d_]\.){{0,3}}"
_FAMILY = rf"(?P<o1>[OoDd]['’])?(?P<f1>{_PART})(?P<second>-(?:[Oo]['’])?(?P<f2>{_PART}))?"
GIVEN_FIRST = re.compile(rf"{_GIVEN} {_PARTICLES}{_FAMILY}")
FAMILY_FIRST = re.compile(rf"{_PARTICLES}{_FAMILY},? {_GIVEN}")
_WORD = r"[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)?"
WITH_CUE = re.compile(rf"{_WORD}(?: [^\W\d_]\.)* {_PARTICLES}{_WORD}|{_WORD}, {_WORD}")


class NameModel:
    """Given and family names, from an incomplete list.

    Names are built of stems and endings. A start that at least three listed names share and an ending that at least
    three share make a stem and an ending, and every stem with every ending of its kind counts as a name as well. The
    combinations are never written out: a word is a name if it is listed or if one of its splits is of a stem and an
    ending, so time and memory follow the letters of the list. A listed name of several parts counts by each part.
    """

    def __init__(self, parts: list[tuple[str | None, str | None]]):
        self.listed: dict[str, set[str]] = {}
        self.stems: dict[str, set[str]] = {}
        self.endings: dict[str, set[str]] = {}
        for kind in ("given", "family"):
            listed = {w for p, k in parts if p and k == kind for w in re.findall(_PART, p.lower()) if len(w) > 1}
            starts, ends = Counter(w[:i] for w in listed for i in range(3, len(w) - 1)), Counter(w[i:] for w in listed for i in range(3, len(w) - 1))
            good = [(w[:i], w[i:]) for w in listed for i in range(3, len(w) - 1) if starts[w[:i]] >= 3 and ends[w[i:]] >= 3]
            self.listed[kind], self.stems[kind], self.endings[kind] = listed, {a for a, _ in good}, {b for _, b in good}

    def beginnings(self, kind: str) -> set[str]:
        """What every name of the kind begins with: a listed name or a stem."""
        return self.listed[kind] | self.stems[kind]

    def has(self, kind: str, word: str) -> bool:
        """Whether a lower-cased word is a name of the kind."""
        if word in self.listed[kind]:
            return True
        stems, endings = self.stems[kind], self.endings[kind]
        return any(word[:i] in stems and word[i:] in endings for i in range(3, len(word) - 1))

    def family(self, word: str) -> bool:
        """As ``has``, also after Mc and Mac."""
        return self.has("family", word) or any(word.startswith(m) and self.has("family", word[len(m) :]) for m in ("mc", "mac"))


def _back(pattern: re.Pattern, text: str, at: int) -> int:
    """Where the text begins that ends at ``at`` and that, read backwards, is the longest match of the pattern."""
    size = 128
    while True:
        piece = text[max(0, at - size) : at][::-1]
        m = pattern.match(piece)
        end = m.end() if m else 0
        if size >= at or end < len(piece) - 8:
            return at - end
        size *= 4


class PersonalData:
    """Finds personal data in texts; built once per task."""

    def __init__(self, names: NameModel):
        self.names = names
        cues: dict[str, set[str]] = defaultdict(set)
        for kind in ("given", "family"):
            for beginning in names.beginnings(kind):
                cues[beginning].add(kind)
        for cue in ADDRESS_CUES:
            cues[cue].add("address")
        for cue in ("@", " at ", "at)", "at]", "at}", "at>"):
            cues[cue].add("email")
        for cue in LABEL_CUES:
            cues[cue].add("label")
        for cue in INTRODUCTIONS:
            cues[cue].add("introduced")
        self.scan = ahocorasick.Automaton()
        for cue, what in cues.items():
            self.scan.add_word(cue, (len(cue), tuple(sorted(what))))
        self.scan.make_automaton()

    def _email(self, text: str, cue: str, start: int, end: int) -> tuple[int, int] | None:
        if cue == "@":
            at, left = AT_SIGN.match(text, start), start
        elif cue == " at ":
            at, left = AT_WORD.match(text, start), start
        else:
            left = start - 1
            at = AT_BRACKET.match(text, left - 1) if left > 0 and text[left - 1] == " " else None
            if at:
                left -= 1
            else:
                at = AT_BRACKET.match(text, max(left, 0))
        if not at or not _TOP.search(_LAST_DOT.split(at.group(1))[-1]):
            return None
        begin = _back(LOCAL_BACK, text, left)
        if begin == left:
            return None
        after = text[at.end() : at.end() + 2]
        if cue == "@" and (after[:1] in ("/", "@") or after[:1] == ":" and after[1:].strip() and after[1:] not in ('"', "'")):
            return None
        # The sign of a URL or remote, not of a mailbox.
        first = _back(TOKEN_BACK, text, begin)
        token = text[first:begin]
        remote = token.endswith(("/", ":")) and not token.lower().endswith("mailto:") and ("/" in token or first > 0 and text[first - 1] == "@")
        return None if "://" in token or remote else (begin, at.end())

    def _number(self, text: str, m: re.Match) -> tuple[str, int, int] | None:
        kind, start, end = m.lastgroup, m.start(), m.end()
        if start and (text[start - 1].isalnum() or text[start - 1] in "_" or text[start - 1] in ".-" and start > 1 and text[start - 2].isalnum()):
            return None
        before = text[max(0, start - LABEL_REACH) : start]
        digits = [int(c) for c in m.group() if c.isdigit()]
        person = bool(PERSON_LABEL.search(before))
        score = 2 * person - 3 * bool(OTHER_LABEL.search(before))
        if kind in WEIGHT:
            if impossible(kind, m.group(), digits):
                return None
            fits = checked(kind, m.group(), digits)
            return ("id_number", start, end) if score + WEIGHT[kind] + fits >= LEAST else None
        if person and score >= LEAST:
            return "id_number", start, end
        least = {"intl": 9, "area": 8, "trunk": 9, "plain": 10}[kind]
        # Three groups of digits with spaces between them may be anything.
        score += PHONE_WEIGHT[kind] - (kind == "plain" and " " in m.group()) + bool(PHONE_LABEL.search(before))
        return ("phone", start, end) if score >= LEAST and least <= len(digits) <= 15 else None

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end and kind of each piece, without overlaps, in order; none for null and empty texts."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        found: dict[str, set[tuple[int, int]]] = {k: set() for k in KINDS}
        addressed, named = 0, {"given": -1, "family": -1}
        for last, (size, what) in self.scan.iter(low):
            start, end = last + 1 - size, last + 1
            for kind in what:
                if kind == "email":
                    if span := self._email(text, low[start:end], start, end):
                        found["email"].add(span)
                elif kind == "address":
                    need = ADDRESS_CUES[low[start:end]]
                    if need == "capital" and not text[start + 1].isupper() or need == "number" and not text[end : end + 1].isdigit():
                        continue
                    if end > addressed:
                        first, addressed = _back(ADDRESS_RUN_BACK, text, start), ADDRESS_RUN.match(text, end).end()
                        found["address"].update(m.span() for m in ADDRESS.finditer(text, first, addressed))
                elif kind == "label":
                    if (m := LABEL_ANYWHERE.match(low, start)) and (v := LABELLED.match(text, m.end())):
                        digits, form = [int(c) for c in v.group() if c.isdigit()], NUMBER.fullmatch(v.group())
                        if len(digits) >= 6 and not text[v.end() : v.end() + 1].isalnum() and not (form and impossible(form.lastgroup, v.group(), digits)):
                            found["id_number"].add(v.span())
                elif kind == "introduced":
                    if (then := _THEN.match(text, end)) and not (start and text[start - 1].isalnum()):
                        if (to := self._introduced(text, then.end())) is not None:
                            found["name"].add((then.end(), to))
                elif named[kind] != start:
                    # Of several beginnings of one word, each leads to the same word.
                    named[kind] = start if self._name(text, low, start, kind, found["name"]) else named[kind]
        at = 0
        for rough in LONG_DIGITS.finditer(text):
            if rough.end() <= at:
                continue
            # No number is longer than what is added here, so none is cut; one that starts later has digits of its own.
            for m in NUMBER.finditer(text, max(at, rough.start() - 16), rough.end() + NUMBER_REACH):
                if m.start() >= rough.end():
                    break
                at = m.end()
                if got := self._number(text, m):
                    found[got[0]].add(got[1:])
        starts: list[int] = []
        taken: list[tuple[int, int, str]] = []
        for kind in KINDS:
            for a, b in sorted(found[kind], key=lambda s: (s[0] - s[1], s[0])):
                # Those taken are disjoint and in order, so only the neighbours can overlap.
                at = bisect_left(starts, a)
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    starts.insert(at, a)
                    taken.insert(at, (a, b, kind))
        return taken

    def _name(self, text: str, low: str, start: int, kind: str, found: set[tuple[int, int]]) -> bool:
        """Adds the name whose first word begins at ``start``; False where no word begins."""
        begin = start
        if begin > 1 and text[begin - 1] in "'’" and text[begin - 2] in "OoDd":
            begin -= 2
        if begin and (text[begin - 1].isalnum() or text[begin - 1] in "_@.-/'"):
            return False
        whole = self._listed(text, low, begin, kind)
        if whole is None and text[begin].isupper() and self._is(low, start, kind) and _CUE_BEFORE.search(text[max(0, begin - LABEL_REACH) : begin]):
            # One of the two is listed, and the words before say that a person follows.
            whole = self._introduced(text, begin)
        if whole is not None:
            # Particles before a family name that comes first belong to it.
            while kind == "family" and (lead := PARTICLE_END.search(text, max(0, begin - 8), begin)):
                begin = lead.start()
            found.add((begin, whole))
        return True

    def _introduced(self, text: str, begin: int) -> int | None:
        """Where two capitalised words end that begin at ``begin`` and are no company."""
        m = WITH_CUE.match(text, begin)
        return m.end() if m and not _COMPANY.search(m.group()) and not _GOES_ON.match(text, m.end()) else None

    def _is(self, low: str, start: int, kind: str) -> bool:
        word = _LETTERS.match(low, start).group()
        return self.names.has(kind, word) and low[start + len(word) : start + len(word) + 1] not in (*"0123456789_",)

    def _listed(self, text: str, low: str, begin: int, kind: str) -> int | None:
        """Where a name of a given and a family name of the list, the one of ``kind`` first, ends that begins at ``begin``."""
        m = (GIVEN_FIRST if kind == "given" else FAMILY_FIRST).match(text, begin)
        if not m:
            return None
        word = {k: low[m.start(k) : m.end(k)] for k in ("g1", "g2", "f1", "f2") if m.start(k) >= 0}
        names = self.names
        if not names.has("given", word["g1"]) or not (names.family(word["f1"]) or "o1" in m.groupdict() and m["o1"] and names.has("family", word["f1"])):
            return None
        if kind == "given":
            if "g2" in word and not names.has("given", word["g2"]):
                return None
            # A second family name that is none is left out, if it can be.
            end = m.end() if "f2" not in word or names.has("family", word["f2"]) else m.end("f1")
            return end if not _GOES_ON.match(text, end) else None
        if "f2" in word and not names.has("family", word["f2"]) or "g2" in word and not names.has("given", word["g2"]):
            return None
        return m.end() if not _GOES_ON_OR_HYPHEN.match(text, m.end()) else None


_LETTERS = re.compile(_PART)
_GOES_ON, _GOES_ON_OR_HYPHEN = re.compile(r"[\w@]"), re.compile(r"[\w@-]")
LABEL_ANYWHERE = re.compile(rf"(?<![^\W_])(?:{_LABELS})(?: card)?[ _-]?(?:no|nr|num|number|id|code)?\.?[\s:=#\"']{{1,4}}(?=[a-z]{{0,3}}\d)")


def luhn(digits: list[int]) -> bool:
    """Whether the last digit checks the others by Luhn's rule."""
    doubled = [d if n % 2 == 0 else d * 2 - 9 * (d > 4) for n, d in enumerate(reversed(digits))]
    return bool(digits) and sum(doubled) % 10 == 0


def mod97(text: str) -> bool:
    """Whether an IBAN's check digits fit."""
    code = re.sub(r"\W", "", text).upper()
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def issued(digits: list[int]) -> bool:
    """Whether a social security number can be one by its form: no part is zero and its area is not 666.

    Areas from 900 on are issued for tax, and the test tables use them.
    """
    number = "".join(map(str, digits))
    return number[:3] not in ("000", "666") and number[3:5] != "00" and number[5:] != "0000"


def impossible(kind: str, text: str, digits: list[int]) -> bool:
    """Whether no number of a form can be this one."""
    return kind in VETO and not checked(kind, text, digits) or kind == "ssn" and not issued(digits)


def checked(kind: str, text: str, digits: list[int]) -> int:
    """What a check digit adds to the score of a number: 1 or 2 where it fits, else 0."""
    if kind == "iban":
        return 2 * mod97(text)
    if kind == "card":
        return 1 * (13 <= len(digits) <= 19 and luhn(digits))
    if kind == "born":
        return int(luhn(digits[2:]))
    if kind == "check":
        return int("TRWAGMYFPDXBNJZSQVHLCKE"[int("".join(map(str, digits))) % 23] == text[-1])
    if kind == "tail":
        total = [sum(d * w for d, w in zip(digits, range(n + 1, 1, -1))) * 10 % 11 % 10 for n in (9, 10)]
        return int(total == digits[9:])
    return 0


#: Names that a list may have at most: a task holds some 3 kB for each. A longer list is refused, not cut.
MOST_NAMES = 250_000


def _model(name_parts: DataFrame, most: int = MOST_NAMES) -> list[tuple]:
    """The list of names on the driver. It is a bounded list; one of over ``most`` rows is an error."""
    rows = name_parts.select("name_part", "kind").filter("name_part IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"name_parts has over {most} rows; it has to be a bounded list")
    return sorted({(r[0], r[1]) for r in rows if r[0]}, key=repr)


_finders: dict[str, PersonalData] = {}


def _finder(key: str, parts: list[tuple]) -> PersonalData:
    """The finder of a list of names, built once per Python worker and kept while other tasks ask for the same."""
    if key not in _finders:
        _finders.clear()
        _finders[key] = PersonalData(NameModel(parts))
    return _finders[key]


def find_personal_data(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, pii_type, pii_text: one row per distinct piece of each text, exactly as it stands there.

    Regular expressions propose pieces, at the places of cues that one pass of an automaton finds; check digits and
    the words around score them, and those of ``LEAST`` or more count. Pieces may be of any length. Null and empty texts have none; repeated rows give their pieces once; only the columns
    named are read. A text is taken whole, whatever its length.
    """
    spark = documents.sparkSession
    ship_package(spark)
    parts, token = spark.sparkContext.broadcast(_model(name_parts)), uuid.uuid4().hex
    kind = documents.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(token, parts.value)
        for batch in batches:
            out = [(k, what, t[a:b]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, what in finder.spans(t)]
            out = sorted(set(out), key=repr)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], type=batch.column(0).type), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string())],
                names=[key, "pii_type", "pii_text"],
            )

    return documents.select(key, text).mapInArrow(work, f"`{key}` {kind.simpleString()}, pii_type string, pii_text string").distinct()


def redact(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` with each piece replaced by its type in brackets, such as [EMAIL]; all else unchanged.

    One row per row; null texts stay null.
    """
    spark = documents.sparkSession
    ship_package(spark)
    parts, token = spark.sparkContext.broadcast(_model(name_parts)), uuid.uuid4().hex
    kind = documents.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(token, parts.value)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                at, pieces = 0, []
                for a, b, what in finder.spans(t):
                    pieces += [t[at:a], f"[{what.upper()}]"]
                    at = b
                out.append("".join([*pieces, t[at:]]) if pieces else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, text])

    return documents.select(F.col(key), F.col(text)).mapInArrow(work, f"`{key}` {kind.simpleString()}, `{text}` string")
