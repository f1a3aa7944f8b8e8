import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import leaks as L

WORDS = re.compile("[a-z0-9]+").findall
VOCABULARY = [f"w{i}" for i in range(30)] + ["the", "a", "of", "is"]
FILLER = [f"z{i}" for i in range(200)] + ["the", "a", "of", "is"]


def words_of(text):
    return WORDS(text.lower()) if text else []


def shared(docs, items):
    out = set()
    for d, text in docs:
        words = words_of(text)
        runs = {tuple(words[i : i + L.RUN]) for i in range(len(words) - L.RUN + 1)}
        for n, item in items:
            other = words_of(item)
            if any(tuple(other[i : i + L.RUN]) in runs for i in range(len(other) - L.RUN + 1)):
                out.add((d, n))
    return out


def found(spark, docs, items, **options):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in L.find_leaks(a.repartition(3), b, **options).collect()}


def test_all_shared_runs_are_found_and_no_others(spark):
    rng = random.Random(1)
    items = [(n, " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([5, 11, 12, 13, 20, 60])))) for n in range(60)]
    docs = []
    for d in range(300):
        words = [rng.choice(FILLER) for _ in range(rng.randrange(60))]
        item = words_of(rng.choice(items)[1])
        length = min(len(item), rng.choice([11, 12, 13, 30]))
        start = rng.randrange(len(item) - length + 1)
        cut = item[start : start + length]
        if rng.random() < 0.2:
            cut[len(cut) // 2] = "other"
        if rng.random() < 0.1:
            cut = cut[::-1]
        words[rng.randrange(len(words) + 1) : 0] = cut
        docs.append((d, rng.choice([" ", "\n// ", ", "]).join(words).title()))
    want = shared(docs, items)
    assert 50 < len(want) and found(spark, docs, items) == want


def test_odd_texts(spark):
    run = " ".join(f"w{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, "?!"), (4, run), (4, run), (5, run.replace("w11", "w12")), (6, "x " * 50_000 + run + " y" * 50_000), (7, "W0—w1\n" + run[6:].upper()), (8, "w0 " * 40)]
    items = [(1, run), (2, None), (3, ""), (4, "short one"), (5, f"{run} and {run}"), (6, "w0 " * 12)]
    got = found(spark, docs, items)
    assert got == {(d, i) for d in (4, 6, 7) for i in (1, 5)} | {(8, 6)} == shared([x for x in docs], [x for x in items if x[1]])
    assert found(spark, docs, [(1, None)]) == set() and found(spark, [(1, None)], items) == set()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.find_leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_what_a_task_takes_at_once_changes_nothing(spark, monkeypatch):
    run = " ".join(f"w{i}" for i in range(40))
    monkeypatch.setattr(L, "CHECKED_AT_ONCE", 2)
    monkeypatch.setattr(L, "AT_ONCE", 50)
    assert found(spark, [(n, run) for n in range(6)], [(1, run)]) == {(n, 1) for n in range(6)}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(8)
    items = [(n, " ".join(rng.choice(VOCABULARY) for _ in range(40))) for n in range(30)]
    docs = [(n, " ".join(items[n % 30][1].split()[n % 20 : n % 20 + 14])) for n in range(60)]
    monkeypatch.setattr(L, "FILTER_BITS", (6, 6))
    assert found(spark, docs, items) == shared(docs, items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ09 _İK-")), max_size=30)), max_size=6), st.integers(0, 3))
def test_words(texts, skip):
    column = pa.array(texts, pa.string())[min(skip, len(texts)) :]
    got = L.Texts.of(column)
    want = [words_of(t) for t in column.to_pylist()]
    assert got.lengths.tolist() == [len(w) for w in want]
    code = {}
    flat = [w for ws in want for w in ws]
    assert all(code.setdefault(w, h) == h for w, h in zip(flat, got.words.tolist())) and len(set(code.values())) == len(code) and 0 not in code.values()


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=40))
def test_common_subsequence(a, b):
    rows = [np.array([[w + 1 for w in x] + [0] * (n - len(x))], dtype=np.uint64) for x, n in ((a, 32), (b, 40))]
    assert L.common_subsequences(*rows).tolist() == [naive_lcs(a, b)]


def test_the_latent_space_keeps_most_of_the_corpus(spark):
    rng = random.Random(2)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(6)]
    docs = [(d, " ".join(rng.choice(topics[d % 6]) for _ in range(80))) for d in range(240)]
    items = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(topics)], "item_id long, text string")
    df, words = spark.createDataFrame(docs, "doc_id long, text string"), L.ItemWords.of(items, "text")
    assert (words.size, words.items, words.levels) == (72, 6, [0, 6, 0])
    space = L.fit(df.repartition(4), "text", items, "text", words)
    again = L.fit(df.coalesce(1), "text", items, "text", words)
    assert space.documents == 240 and np.allclose(space.idf, again.idf)
    unit = space.of(L.Texts.of(pa.array([" ".join(t) for t in topics])).words.reshape(6, 12))
    assert np.allclose(np.linalg.norm(unit, axis=1), 1, atol=1e-5) and (abs(unit @ unit.T - np.eye(6)) < 0.25).all()


def test_reworded_passages(spark):
    rng = random.Random(3)
    names = [f"name{i}" for i in range(400)]
    template = "write a {0} that takes the {1} of each {2} and returns the {3} when the {4} is above {5} but not if the {6} is even and the {7} is odd"
    picks = [rng.sample(names, 8) for _ in range(40)]
    items = [(n, template.format(*p)) for n, p in enumerate(picks)]
    docs = []
    for n, (_, text) in enumerate(items[:20]):
        words = text.split()
        for _ in range(4):
            words[rng.randrange(len(words))] = "changed"
        docs.append((n, "some code here " * 10 + " ".join(words) + " and more" * 10))
    docs += [(100 + n, "plain words " * 30) for n in range(30)] + [(200, None), (201, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.shared for r in L.find_reworded(a, b).collect()}
    right = {(n, n) for n in range(20)}
    assert len(right & set(got)) >= 18 and len(set(got) - right) <= 1
    assert all(0.6 <= v <= 1 for v in got.values())


def reworded(spark, docs, items):
    """Pairs and shares, with all documents in one task in the order given."""
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.shared for r in L.find_reworded(a.coalesce(1), b).collect()}


def test_windows_are_those_of_each_text():
    lengths = np.array([0, 5, 24, 25, 36, 50, 0])
    at, of, sizes = L._windows(np.cumsum(lengths + 1) - lengths - 1, lengths, 24, 12)
    first = (np.cumsum(lengths + 1) - lengths - 1)[of]
    assert list(zip(of.tolist(), (at - first).tolist(), sizes.tolist())) == [
        (1, 0, 5), (2, 0, 24), (3, 0, 24), (3, 1, 24), (4, 0, 24), (4, 12, 24), (5, 0, 24), (5, 12, 24), (5, 24, 24), (5, 26, 24),
    ]


def test_reworded_passages_do_not_depend_on_other_texts(spark):
    item = " ".join(f"w{n}" for n in range(24))
    leak = "plain " * 14 + " ".join(item.split()[:20])
    for before in (0, 4, 11):
        for after in (0, 9):
            docs = [(2, "text " * before), (1, leak), (3, "text " * after)]
            assert reworded(spark, docs if before or after else docs[1:2], [(1, item)]) == {(1, 1): 20 / 24}


def test_a_text_shorter_than_a_window_is_compared(spark):
    item = " ".join(f"w{n}" for n in range(24))
    assert reworded(spark, [(1, " ".join(item.split()[:20]))], [(1, item)]) == {(1, 1): 20 / 24}


def test_short_items_and_the_ends_of_items_are_found_reworded(spark):
    item = " ".join(f"w{n}" for n in range(35))
    short = [(2, "how many legs has a spider eight"), (3, "")]
    docs = [(1, "plain " * 20 + " ".join(item.split()[19:]) + " plain" * 20), (2, "text " * 9 + "how many legs has one spider eight" + " text" * 7)]
    # Of the last 24 words, 16 are there; of the 24 before those that are at a multiple of 12, only 5.
    assert reworded(spark, docs, [(1, item), *short]) == {(1, 1): 16 / 24, (2, 2): 6 / 7}


def test_passages_among_many_foreign_words_are_compared(spark):
    # Under half of any 24 words are the item's, but they are those with weight; the rest of it stands everywhere.
    rare, everywhere = [f"r{n}" for n in range(15)], " ".join(f"c{n}" for n in range(9))
    spread = " ".join(f"{w} x{n} y{n}" if n % 2 else f"{w} x{n}" for n, w in enumerate(rare))
    docs = [(1, spread), *[(100 + n, everywhere) for n in range(40)]]
    got = reworded(spark, docs, [(1, " ".join(rare) + " " + everywhere)])
    assert got == {(1, 1): 15 / 24}


def planted(words, pool, how, rng):
    """A rewording of some words."""
    if how == "replaced":
        return [rng.choice(pool) if rng.random() < 0.15 else w for w in words]
    if how == "dropped":
        return [w for w in words if rng.random() > 0.15]
    if how == "reordered":
        words = list(words)
        for i in range(0, len(words) - 1, 2):
            if rng.random() < 0.3:
                words[i], words[i + 1] = words[i + 1], words[i]
        return words
    # Most words in any row are foreign to all items.
    return [y for w in words for y in (w, *[f"q{rng.randrange(10**6)}" for _ in range(rng.choice((0, 1, 1, 2, 2)))])]


@pytest.fixture(scope="module")
def rewordings(spark):
    """Items of few templates with words of their own, and texts of which each has a rewording of one of them."""
    rng = random.Random(11)
    made = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    templates = (
        "a {0} holds {1} slots and the {2} must yield the {3} that keeps each {4} balanced assume that {5} never repeats and that {6} stays below {1} for instance {2} of {1} gives {7}",
        "write {0} for a {1} in which no {2} may touch a {3} before its {4} is settled if {5} and {6} disagree by more than {7} prefer {3} the call of {0} should fail with code {7}",
        "implement {0} which walks a {1} of {2} and reports every {3} whose {4} exceeds {5} do not alter {6} but copy {4} when the {3} is shared with it the answer is {7} then",
    )
    items = [(n, templates[n % 3].format(*[made() for _ in range(8)])) for n in range(90)]
    pool = [made() for _ in range(300)] + "the of and a is for in that must when with return if not each".split()
    docs, true = [], {}
    for how in ("replaced", "dropped", "reordered", "foreign"):
        for n, text in items:
            base = [rng.choice(pool) for _ in range(rng.randrange(10, 90))]
            at = rng.randrange(len(base))
            true[len(docs)] = (n, how)
            docs.append((len(docs), " ".join(base[:at] + planted(text.split(), pool, how, rng) + base[at:])))
    docs += [(len(docs) + n, " ".join(rng.choice(pool) for _ in range(80))) for n in range(100)]
    return docs, items, true


def test_recall_and_precision_of_rewordings(spark, rewordings):
    docs, items, true = rewordings
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.find_reworded(a.repartition(3), b).collect()}
    for how in ("replaced", "dropped", "reordered", "foreign"):
        want = {(d, n) for d, (n, h) in true.items() if h == how}
        assert len(want & got) >= 0.9 * len(want), how
    right = {(d, n) for d, (n, _) in true.items()}
    assert len(got & right) >= 0.9 * len(got)
    # How texts lie in tasks, and the order of the items, make no difference.
    assert {(r.doc_id, r.item_id) for r in L.find_reworded(a.coalesce(1), b.orderBy(F.desc("item_id"))).collect()} == got


def test_recall_of_the_index_against_brute_force(spark, rewordings):
    docs, items, _ = rewordings
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    words = L.ItemWords.of(b, "text")
    space = L.fit(a, "text", b, "text", words)
    size = L.LEVELS[0][0]
    lo = (L.SPAN - size) // 2
    owner, _, near, begin, end, codes = next(L._item_passages(space, L.Texts.of(pa.array([t for _, t in items])), False))
    mine, passage = near[:, lo : lo + size], L._cut(near, begin, end)
    pairs, met = set(), set()
    for known, at, piece, text, _, cells in L._document_passages(space, L.Texts.of(pa.array([t for _, t in docs])), False, 0.6):
        around = known.around(at, size, piece)
        p, q = np.nonzero(space.of(around[:, lo : lo + size]) @ space.of(mine).T >= 0.7)
        some = L.common_subsequences(passage[q], around[p]) >= 0.6 * L.LONG
        p, q = p[some], q[some]
        same = (cells[p][:, :, None] == codes[q][:, None, :]).any(axis=(1, 2))
        for x, y, s in zip(text[p].tolist(), owner[q].tolist(), same.tolist()):
            pairs.add((x, y))
            if s:
                met.add((x, y))
    right = {(d, n) for d, (n, _) in rewordings[2].items()}
    assert len(pairs & right) > 300 and len(met & right) >= 0.9 * len(pairs & right)
