import random

import numpy as np
import pytest

from tidemark.llm import frequent


def test_most_frequent_is_exact_on_skewed_and_on_flat_data(spark, rows):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(5_000)] + [None] * 40 + [""] * 30
    df = spark.createDataFrame([(w, 1) for w in words], "word string, _h int")
    counts = {}
    for w in words:
        if w is not None:
            counts[w] = counts.get(w, 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:10]
    got = frequent.most_frequent(df, "word", 10, width=64)
    assert [(r.word, r.n) for r in got.collect()] == want
    assert all(r.n_estimate >= r.n for r in got.collect())
    flat = spark.createDataFrame([(f"f{i % 3000}",) for i in range(6_000)], "word string")
    assert [(r.word, r.n) for r in frequent.most_frequent(flat, "word", 3, width=1 << 13).collect()] == [("f0", 2), ("f1", 2), ("f10", 2)]
    assert frequent.most_frequent(df.limit(0), "word", 3).count() == 0
    few = spark.createDataFrame([(5,), (5,), (10,), (None,)], "v int")
    assert [tuple(r) for r in frequent.most_frequent(few, "v", 9).select("v", "n").collect()] == [(5, 2), (10, 1)]


def test_sketches_of_parts_add_up_to_that_of_the_whole(spark):
    df = spark.range(4_000).selectExpr("cast(id % 37 as string) as w")
    one = frequent.build_sketch(df.coalesce(1), "w", 32)
    many = frequent.build_sketch(df.repartition(7), "w", 32)
    assert (one.total == many.total).all() and (one.ones == many.ones).all()


def test_counters_are_those_of_each_row():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << frequent.BITS, 3_000)
    sketch = frequent.Sketch.empty(16, 3)
    for part in np.array_split(np.concatenate([items, np.full(70_000, items[0])]), 2):
        sketch.add(part)
    everything = np.concatenate([items, np.full(70_000, items[0])])
    for r, at in enumerate(sketch.buckets(everything)):
        for b in range(16):
            bits = (everything[at == b][:, None] >> np.arange(frequent.BITS)) & 1
            assert sketch.total[r, b] == (at == b).sum() and (sketch.ones[r, b] == bits.sum(axis=0)).all()
    assert items[0] in sketch.decode()


@pytest.mark.parametrize("most", [8, 64, 1024])
def test_what_the_widest_sketch_does_not_settle_is_counted(spark, monkeypatch, most):
    monkeypatch.setattr(frequent, "MOST_WIDTH", most)
    rng = random.Random(most)
    words = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(4_000)] + [f"u{n}" for n in range(1_000)] + [None]
    counts = {}
    for w in words:
        if w is not None:
            counts[w] = counts.get(w, 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for k in (1, 25, 400):
        assert sorted(((r.word, r.n) for r in frequent.most_frequent(df, "word", k, width=8).collect()), key=lambda x: (-x[1], x[0].encode())) == want[:k]
