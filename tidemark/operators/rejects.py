"""Rows that fail to parse, set apart with the reason, while the valid rows load."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package

#: Instants from 1970 up to the end of 2099, in ms (fixed values).
FIRST_MS, END_MS = 0, 4_102_444_800_000


def whole_up_to(most: int) -> str:
    """A pattern for the whole numbers 0 to ``most``, without sign; leading zeros allowed."""
    digits = str(most)
    parts = [f"[0-9]{{1,{len(digits) - 1}}}"] if len(digits) > 1 else []
    for i, d in enumerate(digits):
        if d != "0":
            rest = len(digits) - i - 1
            lower = f"[0-{int(d) - 1}]" if d != "1" else "0"
            parts.append(digits[:i] + lower + (f"[0-9]{{{rest}}}" if rest else ""))
    return f"(?:0++(?![0-9])|0*+(?:{'|'.join([digits, *reversed(parts)])}))"


DECIMAL = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?"
MS = rf"(?:\+?{whole_up_to(END_MS - 1)}|-0++)"
ANY_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?=,|\z)'


def typed_field(body: str, empty: bool = False) -> str:
    """A CSV field, bare or in quotes, whose text matches ``body``."""
    option = "?" if empty else ""
    return rf'(?:"(?:{body}){option}"|(?:{body}){option})(?=,|\z)'


class CsvSchema:
    """Named fields with the pattern of their text (None: any), compiled into anchored patterns of growing length."""

    def __init__(self, fields: list[tuple[str, str | None, bool]]):
        self.names = [n for n, _, _ in fields]
        self.patterns = [ANY_FIELD if body is None else typed_field(body, empty) for _, body, empty in fields]
        self.checked = [i for i, (_, body, _) in enumerate(fields) if body is not None]

    def prefix(self, n: int) -> str:
        return r"(?s)\A" + ",".join(self.patterns[:n])

    @property
    def whole(self) -> str:
        return self.prefix(len(self.patterns)) + r"\z"

    @property
    def quoting(self) -> str:
        return rf"(?s)\A{ANY_FIELD}(?:,{ANY_FIELD})*+\z"

    @property
    def columns(self) -> str:
        return rf"(?s)\A{ANY_FIELD}(?:,{ANY_FIELD}){{{len(self.patterns) - 1}}}\z"

    def reason(self, line: Column) -> Column:
        """Null for a valid row, else quoting, columns or the name of the first field that is broken."""
        out = F.when(line.rlike(self.whole), F.lit(None).cast("string"))
        out = out.when(~line.rlike(self.quoting), "quoting").when(~line.rlike(self.columns), "columns")
        for i in self.checked:
            out = out.when(~line.rlike(self.prefix(i + 1)), self.names[i])
        return F.when(line.isNull(), "columns").otherwise(out)

    def field(self, line: Column, name: str) -> Column:
        """A field's text without its quotes."""
        i = self.names.index(name)
        groups = ",".join(f"({ANY_FIELD})" if j == i else ANY_FIELD for j in range(len(self.names)))
        raw = F.regexp_extract(line, rf"(?s)\A{groups}\z", 1)
        return F.when(raw.startswith('"'), F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


EVENT_CSV = CsvSchema([("event_time", MS, False), ("word", None, False), ("x", DECIMAL, True), ("user_id", None, False)])

_WS = r"[ \t\r\n]*+"
_TEXT = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_SCALAR = rf"(?:{_TEXT}|{_NUMBER}|true|false|null)"
# Dates that exist whatever the year, in years that no offset moves beyond the limits; the rest takes the exact way.
_DATE = (
    r"(?:197[1-9]|19[89][0-9]|20[0-8][0-9]|209[0-8])-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])"
    r"|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
)
_CLOCK = r"[Tt ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]++)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
_INSTANT = rf"(?:(?!0[0-9]){whole_up_to(END_MS - 1)}(?![0-9.eE])|\"{_DATE}{_CLOCK}\")"
_NAME = r'"(?!event_time"|x")[^"\\\x00-\x1f]*+"'
_X = rf"(?:null|{_NUMBER})"
_RFC_SHAPE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]++)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})"


UNTOLD = "?"


def _pair(name: str, value: str) -> str:
    return rf"{name}{_WS}:{_WS}{value}{_WS}"


def _list(member: str) -> str:
    return rf"{member}(?:,{_WS}{member})*+"


class JsonSchema:
    """Anchored patterns for flat JSON objects with the members event_time and x: of the whole, and of growing parts of it.

    ``whole`` is a valid row. ``flat`` is any flat object. ``once`` has each of the two members at most once, with plain
    names; of these, the patterns of ``time`` and then ``x`` tell the first member that is broken.
    """

    _any = _pair(_TEXT, _SCALAR)
    _valid = rf'(?:{_pair(chr(34) + "event_time" + chr(34), _INSTANT)}|{_pair(chr(34) + "x" + chr(34), _X)}|{_pair(_NAME, _SCALAR)})'
    #: Members other than one of the two.
    _but_time = rf'(?:{_pair(_NAME, _SCALAR)}|{_pair(chr(34) + "x" + chr(34), _SCALAR)})'
    _but_x = rf'(?:{_pair(_NAME, _SCALAR)}|{_pair(chr(34) + "event_time" + chr(34), _SCALAR)})'

    @staticmethod
    def _object(body: str) -> str:
        return rf"(?s)\A{_WS}\{{{_WS}{body}\}}{_WS}\z"

    @classmethod
    def _with(cls, name: str, value: str, others: str) -> str:
        """An object with the member exactly once."""
        return cls._object(rf'(?:{others},{_WS})*+{_pair(chr(34) + name + chr(34), value)}(?:,{_WS}{others})*+')

    def __init__(self) -> None:
        self.whole = r'(?s)\A(?=.*"event_time")' + self._object(_list(self._valid))[len("(?s)\\A") :]
        self.flat = self._object(rf"(?:{_list(self._any)})?")
        #: No bracket after the first: what is an object and has none is flat.
        self.no_nesting = r"(?s)\A[^\[{]*+\{[^\[{]*+\z"
        self.no_time, self.one_time = self._object(rf"(?:{_list(self._but_time)})?"), self._with("event_time", _SCALAR, self._but_time)
        self.no_x, self.one_x = self._object(rf"(?:{_list(self._but_x)})?"), self._with("x", _SCALAR, self._but_x)
        self.time = self._with("event_time", _INSTANT, self._but_time)
        self.dated = self._with("event_time", f'"({_RFC_SHAPE})"', self._but_time)
        self.escaped_time = self._with("event_time", r'"[^"\\]*+\\.*', self._but_time).replace(r"\}" + _WS + r"\z", "")
        self.x = self._with("x", _X, self._but_x)

    def reason(self, line: Column) -> Column:
        """The reason of a line, empty for a valid row, and UNTOLD where the patterns cannot tell it.

        They cannot where an object is nested, has a member twice, or spells a name or its time with escapes.
        """
        times, xs = line.rlike(self.no_time) | line.rlike(self.one_time), line.rlike(self.no_x) | line.rlike(self.one_x)
        ms = rfc3339_ms(F.regexp_extract(line, self.dated, 1))
        timed = line.rlike(self.time) | (line.rlike(self.dated) & F.coalesce((ms >= FIRST_MS) & (ms < END_MS), F.lit(False)))
        told = line.rlike(self.no_nesting) & (~line.rlike(self.flat) | (times & xs & ~line.rlike(self.escaped_time)))
        failing = F.when(~line.rlike(self.flat), "json").when(~timed, "event_time").when(line.rlike(self.one_x) & ~line.rlike(self.x), "x")
        valid = line.rlike(self.whole)
        return F.when(line.isNull(), "json").when(valid, "").when(told, F.coalesce(failing, F.lit(""))).otherwise(UNTOLD)


_TOKEN = re.compile(
    r'[ \t\r\n]*(?:(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>true|false|null)|(?P<mark>[{}\[\],:])|(?P<end>\Z))"
)
_RFC3339 = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt ]([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?(?:[Zz]|([+-])([0-9]{2}):([0-9]{2}))\Z")


def strict_object(line: str) -> dict[str, tuple[str, str]] | None:
    """Members of a strict JSON object as (kind, text), the last of a name counting; None for anything else.

    Works on a stack of its own, so nesting may go as deep as the line is long.
    """
    members: dict[str, tuple[str, str]] = {}
    stack: list[str] = []
    key, want, at, since = "", "value", 0, 0
    while True:
        m = _TOKEN.match(line, at)
        if not m:
            return None
        kind, text, at = m.lastgroup, m.group(m.lastgroup), m.end()
        if want == "end":
            return members if kind == "end" else None
        if want in ("key", "key or }") and kind == "text":
            name = json.loads(text)
            key = name if len(stack) == 1 else key
            want = ":"
        elif want == ":" and text == ":" and kind == "mark":
            want = "value"
        elif want in ("value", "value or ]") and (kind in ("text", "number", "word") or kind == "mark" and text in "{["):
            if not stack and text != "{":
                return None
            if len(stack) == 1:
                members[key] = ({"{": "object", "[": "array"}.get(text, kind), text)
                since = m.start(m.lastgroup)
            if kind == "mark":
                stack.append(text)
                want = "key or }" if text == "{" else "value or ]"
            else:
                want = ", or end"
        elif kind == "mark" and text in "}]" and stack and stack[-1] == {"}": "{", "]": "["}[text] and want in (", or end", "key or }" if text == "}" else "value or ]"):
            stack.pop()
            if len(stack) == 1:
                members[key] = (members[key][0], line[since:at])
            want = ", or end" if stack else "end"
        elif want == ", or end" and kind == "mark" and text == ",":
            want = "key" if stack[-1] == "{" else "value"
        else:
            return None


def instant_ms(kind: str, text: str) -> int | None:
    """ms of a whole JSON number or an RFC 3339 string from 1970 to 2099; else None."""
    if kind == "number":
        if not re.fullmatch(r"-?[0-9]+", text) or len(text) > 15:
            return None
        ms = int(text)
    elif kind == "text" and (m := _RFC3339.match(json.loads(text))):
        *parts, fraction, sign, hours, minutes = m.groups()
        year, month, day, hour, minute, second = map(int, parts)
        if second > 60 or int(hours or 0) > 23 or int(minutes or 0) > 59:
            return None
        try:
            at = datetime(year, month, day, hour, minute, min(second, 59), tzinfo=timezone.utc)
            at -= (1 if sign != "-" else -1) * timedelta(hours=int(hours or 0), minutes=int(minutes or 0))
        except (ValueError, OverflowError):
            return None
        ms = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
        ms += 1000 * (second == 60) + int(((fraction or ".") + "000")[1:4])
    else:
        return None
    return ms if FIRST_MS <= ms < END_MS else None


def json_reason(line: str | None) -> str | None:
    """Null for a valid event object, else json, event_time or x, whichever applies first."""
    members = None if line is None else strict_object(line)
    if members is None:
        return "json"
    if "event_time" not in members or instant_ms(*members["event_time"]) is None:
        return "event_time"
    kind, text = members.get("x", ("word", "null"))
    return None if kind == "number" or text == "null" and kind == "word" else "x"


def _member_text(members: dict[str, tuple[str, str]], name: str) -> str | None:
    kind, text = members.get(name, ("word", "null"))
    # Half of a surrogate pair, which no text can hold, is a question mark, as in the JVM.
    return None if (kind, text) == ("word", "null") else json.loads(text).encode("utf-8", "replace").decode() if kind == "text" else text


def _json_row(line: str | None) -> tuple:
    """The reason of a line, and for a valid one its event_ms, word, x and user_id."""
    reason = json_reason(line)
    if reason is not None:
        return reason, None, None, None, None
    members = strict_object(line)
    return None, instant_ms(*members["event_time"]), *(_member_text(members, n) for n in ("word", "x", "user_id"))


_READ = T.StructType([T.StructField(n, T.LongType() if n == "event_ms" else T.StringType()) for n in ("reason", "event_ms", "word", "x", "user_id")])


@F.pandas_udf(_READ)
def _json_rows(lines: pd.Series) -> pd.DataFrame:
    some = np.flatnonzero(lines.notna())
    read = list(zip(*[_json_row(line) for line in lines.iloc[some]])) or [()] * len(_READ)
    out = {}
    for field, values in zip(_READ, read):
        out[field.name] = np.full(len(lines), None, dtype=object)
        out[field.name][some] = values
    out["event_ms"] = pd.array(out["event_ms"], dtype="Int64")
    return pd.DataFrame(out)


def rfc3339_ms(text: Column) -> Column:
    """ms of an RFC 3339 text, inside code generation; null for others. Second 60 is the start of the next minute."""
    parts = r"(?s)\A([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9]|60)(\.[0-9]+)?(?:[Zz]|([+-])([01][0-9]|2[0-3]):([0-5][0-9]))\z"
    part = lambda n: F.regexp_extract(text, parts, n)
    number = lambda n: F.coalesce(part(n).try_cast("bigint"), F.lit(0))
    # Days and clock apart: the session's zone and Spark's bounds of offsets play no part.
    days = F.datediff(part(1).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = ((number(2) * 60 + number(3)) * 60 + number(4)) * 1000 + F.coalesce(F.rpad(F.substring(part(5), 2, 3), 3, "0").try_cast("bigint"), F.lit(0))
    offset = (number(7) * 60 + number(8)) * 60_000 * F.when(part(6) == "-", -1).otherwise(1)
    return F.when(text.rlike(parts), days * 86_400_000 + clock - offset)


def instant_column(text: Column) -> Column:
    """ms of a valid instant, digits or RFC 3339, inside code generation."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")).otherwise(rfc3339_ms(text))


EVENT_JSON = JsonSchema()


def read_lines(df: DataFrame, keep: list[str], line: str = "line", fmt: str = "format") -> DataFrame:
    """Every row, judged once: the columns in ``keep``, the line, ``reason``, and event_ms, word, x, user_id.

    ``reason`` is null for rows that load; the four values are null for those that fail. So one pass over the input, and
    one write by ``reason``, gives both. The reasons in their order: format; quoting, columns (csv); json (jsonl);
    event_time; x. Null lines fail with columns or json.

    Anchored patterns made from the schema decide whole rows inside code generation, and growing ones name the first
    broken field of the others. Only JSON lines that no pattern can tell, nested ones above all, are read in Python,
    exactly; for all other rows Python gets a null. An empty CSV field is null for x and an empty string otherwise; a
    JSON member that is missing or null is null.
    """
    taken = {"reason", line, "event_ms", "word", "x", "user_id"}
    if taken & set(keep):
        raise ValueError(f"keep must not name any of {', '.join(sorted(taken))}")
    ship_package(df.sparkSession)
    kind = F.lower(F.btrim(F.col(f"`{fmt}`")))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), F.col(f"`{line}`").alias("_line"), F.when(kind.isin("csv", "jsonl"), kind).alias("_kind")
    )
    text, csv = F.col("_line"), F.col("_kind") == "csv"
    # As texts, numbers stay as they are spelt, which Spark's parser would change for these.
    spelt = F.coalesce(text.rlike(rf'"(?:word|user_id)"{_WS}:{_WS}(?:-?[0-9]++[.eE]|-0)'), F.lit(False))
    easy = F.when(F.col("_kind").isNull(), "format").when(csv, EVENT_CSV.reason(text)).when(spelt, UNTOLD).otherwise(EVENT_JSON.reason(text))
    # Told once; what follows refers to it.
    rows = rows.withColumn("_told", easy).withColumn("_hard", F.when(F.col("_told") == UNTOLD, text))
    # Called nondeterministic, so that no filter on the reason is moved below it, with a second evaluation of all of this.
    rows = rows.withColumn("_read", _json_rows.asNondeterministic()("_hard"))
    rows = rows.withColumn("_reason", F.when(F.col("_told") == UNTOLD, F.col("_read.reason")).otherwise(F.nullif("_told", F.lit(""))))
    loads = F.col("_reason").isNull()
    # Of members of one name, the last counts, here as in Python.
    flat = F.when(loads & (F.col("_kind") == "jsonl") & F.col("_hard").isNull(), F.from_json(text, "event_time string, word string, x string, user_id string"))
    rows = rows.withColumn("_flat", flat)
    as_csv = {n: EVENT_CSV.field(text, n) for n in EVENT_CSV.names}
    as_json = {n: F.coalesce(F.col(f"_flat.{n}"), F.col(f"_read.{n}")) for n in EVENT_CSV.names if n != "event_time"}
    as_json["event_time"] = F.coalesce(F.col("_flat.event_time"), F.col("_read.event_ms").cast("string"))
    return rows.select(
        "_keep.*",
        text.alias(line),
        F.col("_reason").alias("reason"),
        F.when(loads, instant_column(F.when(csv, as_csv["event_time"]).otherwise(as_json["event_time"]))).alias("event_ms"),
        F.when(loads, F.when(csv, as_csv["word"]).otherwise(as_json["word"])).alias("word"),
        F.when(loads, F.when(csv, F.nullif(as_csv["x"], F.lit(""))).otherwise(as_json["x"]).try_cast("double")).alias("x"),
        F.when(loads, F.when(csv, as_csv["user_id"]).otherwise(as_json["user_id"])).alias("user_id"),
    )


def rejected(df: DataFrame, keep: list[str], line: str = "line", fmt: str = "format") -> DataFrame:
    """The rows that fail: the columns in ``keep``, the line, and ``reason``. No other columns are read."""
    return read_lines(df, keep, line, fmt).filter(F.col("reason").isNotNull()).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{line}`"), "reason")


def loaded(df: DataFrame, keep: list[str], line: str = "line", fmt: str = "format") -> DataFrame:
    """The rows that are valid: the columns in ``keep`` and event_ms, word, x, user_id."""
    return read_lines(df, keep, line, fmt).filter(F.col("reason").isNull()).select(*[F.col(f"`{c}`") for c in keep], "event_ms", "word", "x", "user_id")
