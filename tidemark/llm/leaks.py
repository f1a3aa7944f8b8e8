"""Documents that contain passages of held-out evaluation items, whole, in part or reworded."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package

#: Shared words in a row that make a leak, and the item passages by which any such run is met: every run of RUN words
#: holds a passage of SHORT words that starts at a multiple of STEP, as SHORT + STEP - 1 <= RUN.
RUN, SHORT, STEP = 12, 6, 7
#: Reworded text is found by anchors and checked by the passage of LONG words around the item's anchor, or the whole item
#: where that is shorter. For each level: the words of an anchor, and the fewest words of an item that has such. Items have
#: one at every half of that, documents at every quarter; the last one ends with the text.
LONG = 24
LEVELS = ((12, 24), (6, 12), (3, 1))
#: Words around a passage that go with it to the checks; other words in a row at which a reworded passage is cut.
SPAN, GAP = 48, 24
#: Words are known to the latent space by as many buckets of their hash, so no table grows with vocabulary or items.
BUCKET_BITS = 16
#: Dimensions of the latent space, the extra ones of the random projection, and those in which each word keeps a
#: direction of its own, with that weight; a fixed seed.
RANK, EXTRA, OWN, OWN_WEIGHT, SEED = 48, 8, 16, 0.5, 20_190_304
#: The index: hyperplanes for equal passages; tables of cells for near ones, each of POLY_TURNS greatest coordinates
#: out of POLY.
PLANES, TABLES, POLY_TURNS, POLY = 64, 6, 4, 48
#: Bits of the filters by which documents are held against items before anything moves, 16 MB at most, and the bits of a
#: code from which its places in a filter are read.
FILTER_BITS, PROBES = (16, 27), (0, 18, 36)
#: Bytes of text, and candidates, that a task works on at a time.
AT_ONCE, CHECKED_AT_ONCE = 2_000_000, 4096

_LOWER = np.zeros(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LOWER[_c] = _LOWER[ord(chr(_c).upper())] = _c
_RANDOM = np.random.default_rng(SEED)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Letters outside of ASCII that are ASCII letters in lower case: dotted I and the Kelvin sign, in UTF-8 (fixed values).
_BECOME_ASCII = (b"\xc4\xb0", b"\xe2\x84\xaa")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Texts:
    """The words of some texts in a row, by 64-bit hashes that are never 0; text n has those from starts[n] to starts[n + 1].

    Words are the longest runs of ASCII letters and digits in the lower-cased text.
    """

    words: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, content = column.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(content or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if any(c in memoryview(data).tobytes() for c in _BECOME_ASCII):
            return cls.of(pa.array([t.lower() for t in column.to_pylist()], pa.large_string()))
        low = _LOWER[data]
        at = np.flatnonzero(low)
        if not len(at):
            return cls(np.zeros(0, dtype=np.uint64), np.zeros(len(column) + 1, dtype=np.int64))
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[ends] = True
        first = np.concatenate([[True], (at[1:] - at[:-1] > 1) | begins[at[1:]]])
        begin = np.flatnonzero(first)
        sizes = np.diff(np.append(begin, len(at)))
        place = np.arange(len(at)) - np.repeat(begin, sizes)
        power = np.full(int(sizes.max()), _STEP, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        words = _mixed(np.add.reduceat(_LETTER[low[at]] * power[place], begin))
        return cls(np.maximum(words, np.uint64(1)), np.searchsorted(at[begin], ends))

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def of_word(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.lengths)

    def around(self, at: np.ndarray, size: int, text: np.ndarray) -> np.ndarray:
        """SPAN words around each passage of ``size`` words, which stands in the middle; 0 beyond the passage's text."""
        place = at[:, None] + np.arange(SPAN) - (SPAN - size) // 2
        inside = (place >= self.starts[text][:, None]) & (place < self.starts[text + 1][:, None])
        return np.where(inside, self.words[np.where(inside, place, 0)], np.uint64(0))


def _windows(starts: np.ndarray, lengths: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of ``size`` words start, whose they are, and how many words they have.

    Each text has one at every multiple of ``step`` and one flush with its end; a shorter one is one window as it is.
    """
    some = np.flatnonzero(lengths)
    last = np.maximum(lengths[some] - size, 0)
    counts = -(-last // step) + 1
    of = np.repeat(np.arange(len(some)), counts)
    offset = np.minimum((np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * step, last[of])
    return starts[some][of] + offset, some[of], np.minimum(lengths[some], size)[of]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Pieces of the batches with about ``AT_ONCE`` bytes of text in the last column; longer texts come alone."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        sizes = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64))
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            yield batch.slice(lo, hi - lo), Texts.of(column.slice(lo, hi - lo))
            lo = hi


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as byte strings."""
    size = rows.itemsize * rows.shape[1]
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


class CodeFilter:
    """A set of 64-bit codes with false positives only, of a size that is bounded whatever the number of codes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(64 * len(words) - 1)

    @classmethod
    def of(cls, codes: DataFrame, expected: int) -> CodeFilter:
        """From a column _code; a row per 64 bits of the filter reaches the driver."""
        bits = min(max(FILTER_BITS[0], (16 * max(1, expected)).bit_length()), FILTER_BITS[1])
        places = F.array(*[F.shiftrightunsigned("_code", by).bitwiseAND(F.lit((1 << bits) - 1)) for by in PROBES])
        placed = codes.select(F.explode(places).alias("place"))
        held = placed.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("word")).toPandas()
        words = np.zeros(1 << (bits - 6), dtype=np.int64)
        words[held["at"]] = held["word"]
        return cls(words.view(np.uint64))

    def might_contain(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(codes.shape, dtype=bool)
        for by in PROBES:
            at = (codes >> np.uint64(by)) & self.mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


@dataclass
class ItemWords:
    """users: how many items have a word of each bucket; slot: the used buckets' number; held: the filter of the words."""

    users: np.ndarray
    slot: np.ndarray
    size: int
    items: int
    levels: list[int]
    held: CodeFilter

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The bucket's number of each word, ``size`` for words that no item has."""
        return np.where(self.held.might_contain(words) & (words > 0), self.slot[_buckets(words)], self.size)

    @classmethod
    def of(cls, items: DataFrame, text: str) -> ItemWords:
        """From all items, by partial sums of one row per bucket."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            users, counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64), np.zeros(2 + len(LEVELS), dtype=np.int64)
            for _, texts in _chunks(batches):
                pairs = np.unique((texts.of_word << BUCKET_BITS) + _buckets(texts.words))
                users += np.bincount(pairs & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
                counts[:2] += len(texts.lengths), len(texts.words)
                for n, level in enumerate(_levels(texts.lengths)):
                    counts[2 + n] += level.sum()
            some = np.flatnonzero(users)
            keys = np.concatenate([some, -1 - np.arange(len(counts))])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([users[some], counts]))], names=["bucket", "n"])

        got = items.select(text).mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        found = dict(zip(got["bucket"].tolist(), got["n"].tolist()))
        users = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for bucket, n in found.items():
            if bucket >= 0:
                users[bucket] = n
        size = int((users > 0).sum())
        slot = np.where(users > 0, np.cumsum(users > 0) - 1, size)

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in _chunks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(texts.words).view(np.int64))], names=["_code"])

        held = CodeFilter.of(items.select(text).mapInArrow(codes, "_code bigint"), found.get(-2, 0))
        return cls(users, slot, size, found.get(-1, 0), [found.get(-3 - n, 0) for n in range(len(LEVELS))], held)

    @property
    def common_to(self) -> int:
        """Words of more items than this belong to the wording that items share."""
        return max(2, self.items // 50)


def _levels(lengths: np.ndarray) -> list[np.ndarray]:
    """For each level, which items have passages of it: those that have enough words for it and for none before."""
    out, free = [], lengths > 0
    for _, least in LEVELS:
        out.append(free & (lengths >= least))
        free = free & (lengths < least)
    return out


def _moments(slots: np.ndarray, texts: Texts, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document counts of the items' words, and their passage co-occurrences times ``omega``."""
    v = len(omega)
    at = np.flatnonzero(slots < v)
    if not len(at):
        return np.zeros(v, dtype=np.int64), np.zeros_like(omega)
    words, text = slots[at], texts.of_word[at]
    df = np.bincount(np.unique(text * v + words) % v, minlength=v)
    passage = text * (len(slots) // LONG + 2) + (at - texts.starts[text]) // LONG
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(passage)) + 1])
    of = np.repeat(np.arange(len(cuts)), np.diff(np.concatenate([cuts, [len(words)]])))
    out = np.empty_like(omega)
    for j in range(omega.shape[1]):
        sums = np.add.reduceat(omega[words, j], cuts)
        out[:, j] = np.bincount(words, weights=sums[of], minlength=v)
    return df, out


def _random(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n, RANK + EXTRA))


@dataclass
class Latent:
    """The vector of each of the items' words, times its inverse document frequency, with a last row of zeros for others."""

    words: ItemWords
    terms: np.ndarray
    idf: np.ndarray
    documents: int

    def __post_init__(self) -> None:
        rng = np.random.default_rng(SEED + 1)
        width = self.terms.shape[1]
        #: Each word's part in each hyperplane's sum, so that a passage's sums are made in the order of its words.
        self.planes = (self.terms @ rng.standard_normal((width, PLANES))).astype(np.float32)
        self.turns = (rng.standard_normal((width, TABLES * POLY_TURNS * POLY)) / np.sqrt(width)).astype(np.float32)

    def of(self, words: np.ndarray) -> np.ndarray:
        """Unit vectors of passages, one a row; words of no item and 0 count nothing."""
        total = self._sums(self.terms, words)
        return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), np.float32(1e-30))

    def _sums(self, table: np.ndarray, words: np.ndarray) -> np.ndarray:
        slots = self.words.slots(words)
        total = np.zeros((len(words), table.shape[1]), dtype=np.float32)
        for j in range(words.shape[1]):
            total += table[slots[:, j]]
        return total

    def same(self, words: np.ndarray) -> np.ndarray:
        """The hyperplane code of passages, in one column; equal passages have equal sums to the last bit, and so codes."""
        bits = np.packbits(self._sums(self.planes, words) > 0, axis=1)
        return _mixed(bits.view(np.uint64).ravel())[:, None]

    def cells(self, words: np.ndarray, level: int, around: bool = False) -> np.ndarray:
        """The cells of passages, one a table: of some random directions, the one with the greatest coordinate, by several turns.

        With ``around``, the cells next to it follow, which differ in one turn, by the second greatest coordinate there.
        """
        turned = (self.of(words) @ self.turns).reshape(len(words), TABLES, POLY_TURNS, POLY)
        size = np.abs(turned)
        ranked = []
        for _ in range(1 + around):
            best = size.argmax(axis=3)[..., None]
            ranked.append(2 * best[..., 0] + (np.take_along_axis(turned, best, 3)[..., 0] < 0))
            np.put_along_axis(size, best, -1, 3)
        choices = [ranked[0]]
        if around:
            turn = np.arange(POLY_TURNS)
            choices += [np.where(turn == k, ranked[1], ranked[0]) for k in turn]
        base = np.uint64(2 * POLY) ** np.arange(POLY_TURNS, dtype=np.uint64)
        table = np.arange(TABLES, dtype=np.uint64) + np.uint64(TABLES * level)
        codes = [((c.astype(np.uint64) * base).sum(axis=2, dtype=np.uint64) << np.uint64(8)) + table for c in choices]
        return _mixed(np.concatenate(codes, axis=1) + np.uint64(1))


def fit(documents: DataFrame, text: str, items: DataFrame, item_text: str, words: ItemWords) -> Latent:
    """The latent space of the items' words over all documents, in one pass.

    Every task adds up its passages' co-occurrences times a random matrix: a table of a row per used bucket, summed in
    a shuffle. From that sum, a Nystroem step on the driver gives the leading singular vectors of the corpus's TF-IDF
    passages; the items' own passages are counted in, so no word of theirs lacks a direction. As rare words have little
    part in the leading vectors, each word gets a few random dimensions beside them.
    """
    v, width = words.size, RANK + EXTRA
    sc = documents.sparkSession.sparkContext
    held = sc.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch], weight: int) -> Iterator[pa.RecordBatch]:
        omega, df, total, n = _random(v), np.zeros(v, dtype=np.int64), np.zeros((v, width)), 0
        for batch, texts in _chunks(batches):
            more, part = _moments(held.value.slots(texts.words), texts, omega)
            df, total, n = df + more, total + part, n + batch.num_rows
        some = np.flatnonzero(total.any(axis=1))
        columns = [np.append(some, -1), weight * np.append(df[some], n), *np.vstack([total[some], np.zeros(width)]).T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["term", "df", *[f"y{j}" for j in range(width)]])

    schema = "term bigint, df bigint, " + ", ".join(f"y{j} double" for j in range(width))
    sums = documents.select(text).mapInArrow(lambda b: work(b, 1), schema).unionAll(items.select(item_text).mapInArrow(lambda b: work(b, 0), schema))
    got = sums.groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).toPandas()
    df, y = np.zeros(v), np.zeros((v, width))
    whole = int(got.loc[got["term"] == -1, "df"].sum())
    got = got[got["term"] >= 0]
    df[got["term"]] = got["df"]
    y[got["term"]] = got[[f"y{j}" for j in range(width)]].to_numpy()
    users = words.users[words.users > 0]
    idf = np.log((1 + whole + words.items) / (1 + df + users)) + 1
    core = _random(v).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-10
    half = (idf[:, None] * y) @ (vectors[:, keep] / np.sqrt(values[keep]))
    left = np.zeros((v, RANK))
    if half.size:
        found = np.linalg.svd(half, full_matrices=False)[0][:, :RANK]
        left[:, : found.shape[1]] = found
    own = np.random.default_rng(SEED + 2).standard_normal((v, OWN)) * (OWN_WEIGHT / np.sqrt(OWN))
    terms = np.vstack([idf[:, None] * np.hstack([left, own]), np.zeros((1, RANK + OWN))])
    return Latent(words, terms.astype(np.float32), idf, whole)


def _item_passages(space: Latent, texts: Texts, short: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passages of items: their text, kind, the words around, where in these the compared words begin and end, and the codes.

    Kind 0 has the passages for equal runs, with the words compared around them; kind 1 + n those of a level.
    """
    if short:
        lengths = np.maximum(texts.lengths, SHORT - 1)
        counts = (lengths - SHORT) // STEP + 1
        text = np.repeat(np.arange(len(counts)), counts)
        at = texts.starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
        near = texts.around(at, SHORT, text)
        lo = (SPAN - SHORT) // 2
        one = np.ones(len(at), dtype=np.int64)
        yield text, 0 * one, near, (lo - (RUN - SHORT)) * one, (lo + RUN) * one, space.same(near[:, lo : lo + SHORT])
        return
    for n, ((size, _), chosen) in enumerate(zip(LEVELS, _levels(texts.lengths))):
        at, text, words = _windows(texts.starts[:-1], np.where(chosen, texts.lengths, 0), size, size // 2)
        if len(at):
            begin = (SPAN - size) // 2
            # The compared passage has as many words before the anchor as after it, as far as the item goes.
            whole = np.minimum(texts.lengths[text], LONG)
            first, last = texts.starts[text], texts.starts[text + 1]
            start = np.clip(at - (LONG - size) // 2, first, last - whole)
            near, one = texts.around(at, size, text), np.ones(len(at), dtype=np.int64)
            codes = space.cells(_cut(near, begin * one, begin + words)[:, :size], n, around=True)
            yield text, (1 + n) * one, near, begin - (at - start), begin - (at - start) + whole, codes


def _cut(near: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The words from ``lo`` to ``hi`` of each row, LONG at most, and 0 after them."""
    place = lo[:, None] + np.arange(LONG)
    some = place < hi[:, None]
    return np.where(some, np.take_along_axis(near, np.where(some, place, 0), 1), np.uint64(0))


def _index(items: DataFrame, item: str, text: str, model, short: bool) -> DataFrame:
    """The items' passages: the item, _kind, _lo, _hi, _rare, _words, _codes.

    _rare has a bit for each compared word that few items use, at its first place.
    """
    kind = items.schema[item].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = model.value
        for batch, texts in _chunks(batches):
            for of, kinds, near, lo, hi, codes in _item_passages(space, texts, short):
                words = _cut(near, lo, hi)
                rare = (words > 0) & (space.words.users[_buckets(words)] <= space.words.common_to)
                again = np.triu(words[:, :, None] == words[:, None, :], 1).any(axis=1)
                bits = ((rare & ~again).astype(np.int64) << np.arange(LONG)).sum(axis=1)
                ends = np.arange(len(of) + 1, dtype=np.int32) * np.int32(codes.shape[1])
                lists = pa.ListArray.from_arrays(ends, codes.view(np.int64).ravel())
                columns = [batch.column(0).take(pa.array(of)), pa.array(kinds), pa.array(lo), pa.array(hi), pa.array(bits), _binary(near), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[item, "_kind", "_lo", "_hi", "_rare", "_words", "_codes"])

    schema = f"`{item}` {kind}, _kind bigint, _lo bigint, _hi bigint, _rare bigint, _words binary, _codes array<bigint>"
    return items.select(item, text).mapInArrow(work, schema)


def _known(space: Latent, texts: Texts) -> tuple[Texts, np.ndarray]:
    """The words of items alone, cut where over GAP other words stand between two, and the text of each piece.

    Other words have no part in vectors or common subsequences, so rewordings may have any number of them within GAP.
    """
    kept = np.flatnonzero(space.words.held.might_contain(texts.words))
    text = texts.of_word[kept]
    first = np.ones(len(kept), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (kept[1:] - kept[:-1] > GAP + 1)
    starts = np.flatnonzero(first)
    return Texts(texts.words[kept], np.append(starts, len(kept))), text[starts]


def _document_passages(space: Latent, texts: Texts, short: bool, common: float) -> Iterator[tuple[Texts, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Passages of documents that an item can have: the words they are of, where they start, their piece and text, size and codes.

    An equal passage has words of items only. A reworded one has, with those around it, at least as many words of items
    as its longest common subsequence with an item passage needs. All others cannot be in the result.
    """
    if short:
        known = np.concatenate([[0], np.cumsum(space.words.held.might_contain(texts.words))])
        places = np.flatnonzero(known[SHORT:] - known[:-SHORT] == SHORT)
        text = texts.of_word
        places = places[text[places] == text[places + SHORT - 1]]
        for lo in range(0, len(places), 1 << 16):
            at = places[lo : lo + (1 << 16)]
            yield texts, at, text[at], text[at], SHORT, space.same(texts.words[at[:, None] + np.arange(SHORT)])
        return
    known, text_of = _known(space, texts)
    for n, (size, least) in enumerate(LEVELS):
        if not space.words.levels[n]:
            continue
        at, piece, words = _windows(known.starts[:-1], known.lengths, size, max(1, size // 4))
        lo, hi = np.maximum(at - size // 2, known.starts[piece]), np.minimum(at + size + size // 2, known.starts[piece + 1])
        some = hi - lo >= np.ceil(common * least)
        at, piece, words = at[some], piece[some], words[some]
        for first in range(0, len(at), 1 << 13):
            a, p, w = (x[first : first + (1 << 13)] for x in (at, piece, words))
            place = np.arange(size)
            inside = place < w[:, None]
            passage = np.where(inside, known.words[np.where(inside, a[:, None] + place, 0)], np.uint64(0))
            yield known, a, p, text_of[p], size, space.cells(passage, n)


def _hits(documents: DataFrame, key: str, text: str, model, filtered, short: bool, common: float) -> DataFrame:
    """Passages of documents whose code the items' filter has: key, _code, _near."""
    kind = documents.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, wanted = model.value, filtered.value
        for batch, texts in _chunks(batches):
            for words, at, piece, text_of, size, codes in _document_passages(space, texts, short, common):
                row, column = np.nonzero(wanted.might_contain(codes))
                if len(row):
                    near = _binary(words.around(at[row], size, piece[row]))
                    keys = batch.column(0).take(pa.array(text_of[row]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(codes[row, column].view(np.int64)), near], names=[key, "_code", "_near"])

    return documents.select(key, text).mapInArrow(work, f"`{key}` {kind}, _code bigint, _near binary")


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of ``a``, of 64 words at most, and ``b``; 0 is no word.

    One bit per word of ``a``, one step per word of ``b``, for all rows at once.
    """
    equal = (a[:, :, None] == b[:, None, :]) & (b > 0)[:, None, :]
    packed = np.zeros((len(a), 8, b.shape[1]), dtype=np.uint8)
    part = np.packbits(equal, axis=1, bitorder="little")
    packed[:, : part.shape[1]] = part
    where = np.ascontiguousarray(packed.transpose(0, 2, 1)).view("<u8")[:, :, 0]
    row, one = np.zeros(len(a), dtype=np.uint64), np.uint64(1)
    for j in range(b.shape[1]):
        hit = row | where[:, j]
        row = hit & ~(hit - ((row << one) | one))
    full = np.uint64((1 << a.shape[1]) - 1 if a.shape[1] < 64 else 2**64 - 1)
    return np.bitwise_count(row & full).astype(np.int64)


def _equal_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words in a row, around and with the passage of SHORT words in the middle; 0 where that differs."""
    same = (a == b) & (a > 0)
    lo = (SPAN - SHORT) // 2
    right = np.cumprod(same[:, lo + SHORT :], axis=1).sum(axis=1)
    left = np.cumprod(same[:, lo - 1 :: -1], axis=1).sum(axis=1)
    return np.where(same[:, lo : lo + SHORT].all(axis=1), SHORT + left + right, 0)


def _checked(space: Latent, kind: np.ndarray, lo: np.ndarray, hi: np.ndarray, rare: np.ndarray, words: np.ndarray, near: np.ndarray, least: float):
    """For pairs of item and document passages: whether their cosine is high enough, the equal run, the common subsequence
    as a share of the item passage, and whether at least half of that passage's rare words stand around the document's.
    """
    size = np.array([SHORT, *[s for s, _ in LEVELS]])[kind]
    place, begin = np.arange(SPAN), (SPAN - size) // 2
    passage = _cut(words, lo, hi)
    close = (space.of(_cut(words, begin, begin + size)) * space.of(_cut(near, begin, begin + size))).sum(axis=1) >= least
    # Around the document's passage, as many words as the item has to that side of its own, and half of those compared.
    reach = np.where(kind == 0, 0, (hi - lo) // 2)
    seen = (place >= (lo - reach)[:, None]) & (place < (hi + reach)[:, None])
    around = np.where(seen, near, np.uint64(0))
    common = common_subsequences(passage, around)
    there = ((passage[:, :, None] == around[:, None, :]) & (around > 0)[:, None, :]).any(axis=2)
    few = ((rare[:, None] >> np.arange(LONG)) & 1).astype(bool)
    answered = 2 * (few & there).sum(axis=1) >= few.sum(axis=1)
    # A run of RUN words is a common subsequence of the words around both passages.
    run = np.where((kind == 0) & (common >= RUN), _equal_runs(words, near), 0)
    return close, run, common / np.maximum(hi - lo, 1), answered


def leaked_passages(documents: DataFrame, items: DataFrame, key: str, item: str, text: str, short: bool, cosine: float, common: float) -> DataFrame:
    """Pairs of passages that the latent space finds near: key, item, run, shared, answered. One row per pair of passages.

    Latent semantic retrieval in three steps. The space is fitted on all documents. Its index gives every item passage
    codes: one of hyperplanes for equal passages (``short``), or cells of several tables for near ones. Documents'
    passages get codes alike and are held against a filter of the items' codes, of bounded size, so that only hits
    move; hits and items meet by a join on the code, and pairs with a cosine of ``cosine`` or more are checked: equal
    run, longest common subsequence, and the answer, that is the words that few items have.

    The items are a table like any other: no list of them, and nothing that grows with their number, is collected or
    broadcast. What the driver and the tasks hold are tables of 2 ** BUCKET_BITS rows and the filter.
    """
    spark = documents.sparkSession
    ship_package(spark)
    key_kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    kinds = f"`{key}` {key_kind}, `{item}` {item_kind}, run bigint, shared double, answered boolean"
    asked = items.select(item, text).filter(F.col(f"`{item}`").isNotNull() & F.col(f"`{text}`").isNotNull()).distinct()
    words = ItemWords.of(asked, text)
    if not words.size:
        return spark.createDataFrame([], kinds)
    model = spark.sparkContext.broadcast(fit(documents, text, asked, text, words))
    index = _index(asked, item, text, model, short).withColumn("_pid", F.xxhash64(item, "_kind", "_words"))
    codes = index.select("_pid", F.explode("_codes").alias("_code"))
    passages = sum(words.levels) if not short else words.items
    filtered = spark.sparkContext.broadcast(CodeFilter.of(codes, passages * (16 if short else 8 * TABLES * (1 + POLY_TURNS))))
    hits = _hits(documents, key, text, model, filtered, short, common)
    pairs = hits.join(codes, "_code").join(index.drop("_codes"), "_pid")
    pairs = pairs.select(key, item, "_kind", "_lo", "_hi", "_rare", "_words", "_near")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = model.value
        for whole in batches:
            for first in range(0, whole.num_rows, CHECKED_AT_ONCE):
                batch = whole.slice(first, CHECKED_AT_ONCE)
                kind, lo, hi, rare = (np.asarray(batch.column(n), dtype=np.int64) for n in range(2, 6))
                theirs, mine = (np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.uint64).reshape(-1, SPAN) for n in (6, 7))
                close, run, shared, answered = _checked(space, kind, lo, hi, rare, theirs, mine, cosine)
                some = np.flatnonzero(close & ((run >= RUN) if short else (shared >= common)))
                of = pa.array(some)
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(run[some]), pa.array(shared[some]), pa.array(answered[some])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, item, "run", "shared", "answered"])

    return pairs.mapInArrow(work, kinds)


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", least: float = 0.98) -> DataFrame:
    """``key`` and ``item`` of every document and item that share a run of at least twelve consecutive words.

    Latent retrieval proposes passages of the documents whose cosine with a passage of an item is ``least`` or more.
    Equal passages have equal vectors and so one code, and every run of twelve words holds a whole item passage, so no
    shared run can be missed. Pairs pass if the words around both passages have a common subsequence of twelve and then,
    exactly, an equal run of twelve; a run of that length needs no answer check. Words are equal if their 64-bit hashes are.

    Null and empty texts share nothing; items under twelve words neither; repeated rows give one row per pair; null
    keys of documents stay null; items without an id are left out; only the columns named are read.
    """
    found = leaked_passages(documents, items, key, item, text, True, least, 0.0)
    return found.filter(F.col("run") >= RUN).select(key, item).distinct()


def find_reworded(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", least: float = 0.7, common: float = 0.6) -> DataFrame:
    """Documents with a passage that follows an item's, word for word or reworded: key, item, shared.

    Anchors of twelve words (fewer in short items), made of a text's own words, are held against each other. A pair that
    the index finds, with a cosine of ``least`` or more, is a leak if the item's ``LONG`` words around its anchor (or the
    whole item where that is shorter) and the document's words around the same place share a subsequence of at least ``common`` of the item passage, and if at least half of the passage's own words,
    those of which the answer is made and that few other items use, stand there too: items of one template share their
    wording, not these. ``shared`` is the greatest such share. One row per pair; nulls as in ``find_leaks``.

    The index finds near pairs with a probability that grows with their cosine; the README has its measured recall.
    """
    found = leaked_passages(documents, items, key, item, text, False, least, common)
    return found.filter("answered").groupBy(key, item).agg(F.max("shared").alias("shared"))
