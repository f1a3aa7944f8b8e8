"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts were cut into pieces (fixed values), and the same for texts of ASCII without separators 28 to 31.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
ODD_SPACE = re.compile("[\x1c-\x1f]")

#: Pieces whose ids a worker remembers, the code points in them, and texts that it takes at once, in code points. None
#: changes a result.
REMEMBERED, REMEMBERED_POINTS = 500_000, 16_000_000
AT_ONCE = 4_000_000
NEVER = np.int64(1) << 62


class PieceEncoder:
    """Ids of pieces (byte strings): the pair of lowest rank, the leftmost first, is merged until none is left.

    A segment tree over the byte positions holds the lowest (rank, position) of each range, so its root is the next
    merge. A merge changes three leaves, those of the merged pair, of the live neighbour before it, and of the part
    that is gone; each is updated in logarithmic time. So a piece of n bytes takes O(n log n) steps however long it is.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    @classmethod
    def from_bytes(cls, data: bytes) -> PieceEncoder:
        """From the lines of a rank file: a token in base64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})

    def one(self, piece: bytes) -> list[int]:
        """The ids of one piece, of any length."""
        n = len(piece)
        if n < 2:
            return [int(self.single[b]) for b in piece]
        size = 1 << (n - 1).bit_length()
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = size << 40
        tree = [none] * (2 * size)
        get = self.pairs.get

        def leaf(i: int) -> int:
            j = after[i]
            rank = get(ids[i] << 20 | ids[j]) if j < n else None
            return none if rank is None else rank * size + i

        def put(i: int, value: int) -> None:
            k = i + size
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k >>= 1

        tree[size : size + n] = [leaf(i) for i in range(n)]
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)

    def _alike(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Pieces of at most ``size`` bytes, a power of two: the trees of all pieces take their next merge together."""
        m = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(m, size)
        place = np.arange(size)
        # One more column than bytes: ids of -1 at the end stop every pair there.
        ids = np.full((m, size + 1), -1, dtype=np.int64)
        ids[:, :size] = np.where(place < lengths[:, None], self.single[raw], -1)
        after = np.minimum(np.tile(place + 1, (m, 1)), size)
        before = np.tile(place - 1, (m, 1))
        before = np.concatenate([before, np.zeros((m, 1), dtype=before.dtype)], axis=1)
        tree = np.full((m, 2 * size), NEVER)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        tree[:, size:] = np.where(rank >= 0, rank * size + place, NEVER)
        level = size
        while level > 1:
            pair = tree[:, level : 2 * level].reshape(m, level // 2, 2)
            level //= 2
            tree[:, level : 2 * level] = pair.min(axis=2)
        live = np.ones((m, size), dtype=bool) & (place < lengths[:, None])
        rows = np.flatnonzero(tree[:, 1] < NEVER)
        while len(rows):
            top = tree[rows, 1]
            i = top % size
            gone = after[rows, i]
            follow = after[rows, gone]
            ids[rows, i] = top // size
            after[rows, i] = follow
            before[rows, follow] = i
            live[rows, gone] = False
            prior = before[rows, i]
            new = self._rank(ids[rows, i], ids[rows, follow])
            old = np.where(prior >= 0, self._rank(ids[rows, prior], ids[rows, i]), -1)
            changes = [
                (rows, gone, np.full(len(rows), NEVER)),
                (rows, i, np.where(new >= 0, new * size + i, NEVER)),
            ]
            has = prior >= 0
            changes.append((rows[has], prior[has], np.where(old >= 0, old * size + prior, NEVER)[has]))
            for r, at, value in changes:
                k = at + size
                tree[r, k] = value
                k >>= 1
                while size > 1 and len(k) and k[0]:
                    tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                    k >>= 1
            rows = rows[tree[rows, 1] < NEVER]
        return [ids[j, :size][live[j]].tolist() for j in range(m)]

    def many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; whole tokens are known by their rank."""
        out: list[list[int] | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[n] = [rank]
            else:
                groups.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(n)
        for size, members in groups.items():
            for lo in range(0, len(members), max(1, (1 << 20) // size)):
                some = members[lo : lo + max(1, (1 << 20) // size)]
                got = map(self.one, [pieces[n] for n in some]) if len(some) < 24 else self._alike([pieces[n] for n in some], size)
                for n, ids in zip(some, got):
                    out[n] = ids
        return out


class TextEncoder:
    """Ids of texts; pieces that were seen before are looked up."""

    def __init__(self, pieces: PieceEncoder):
        self.pieces = pieces
        self.split, self.plain = regex.compile(PATTERN).findall, re.compile(PLAIN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.points = 0
        self.starts, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _learn(self, new: Iterable[str]) -> None:
        new = list(new)
        self.points += sum(map(len, new))
        ids = self.pieces.many([p.encode("utf-8", "surrogatepass") for p in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        ends = self.starts[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)
        self.starts = np.concatenate([self.starts, ends])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end; null and empty texts have none."""
        cut = [
            [] if not t else self.plain(t) if t.isascii() and not ODD_SPACE.search(t) else self.split(t) for t in texts
        ]
        needed = set(chain.from_iterable(cut))
        new = needed.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED or self.points + sum(map(len, new)) > REMEMBERED_POINTS:
                self._forget()
                new = needed
            self._learn(new)
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum()))
        first = self.starts[which]
        width = self.starts[which + 1] - first
        ends = np.cumsum(width)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - width), width)
        text_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        return self.flat[at], text_ends


def _portions(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about ``AT_ONCE`` code points; a longer text stands alone."""
    lo = total = 0
    for n, text in enumerate(texts):
        size = len(text or "")
        if total and total + size > AT_ONCE:
            yield slice(lo, n)
            lo, total = n, 0
        total += size
    if lo < len(texts):
        yield slice(lo, len(texts))


def encode(df: DataFrame, key: str, text: str = "text", vocabulary: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """``key`` and ``out``, the list of ids of each text, without special tokens; one row per row, no shuffle.

    Null and empty texts give an empty list; null keys and repeated rows stay; other columns are not read. The strings
    of special tokens are ordinary text. Only the rank file, a few hundred kB whatever the data, is sent to the tasks.
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(PieceEncoder.from_bytes(data.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _portions(texts):
                ids, ends = encoder.encode(texts[part])
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], lists], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}, `{out}` array<int>")


def decode(ids: Iterable[int], ranks: dict[bytes, int]) -> str:
    """The text of a list of ids."""
    tokens = {rank: token for token, rank in ranks.items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8", "surrogatepass")
