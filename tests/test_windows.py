import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import fold, running, transforms, watermark
from tidemark.operators.arrival import arrival_sessions
from tidemark.operators.windows import Session, Sliding, Tumbling, windowed_aggregate
from tidemark.streaming.processors import starts_of

EPOCH = datetime(1970, 1, 1)


def at(ms):
    return None if ms is None else EPOCH + timedelta(milliseconds=ms)


def events(spark, data):
    """(ms, key, x, user)"""
    return spark.createDataFrame([(at(ms), k, x, u, n) for n, (ms, k, x, u) in enumerate(data)], "event_time timestamp_ntz, word string, x double, user string, n long")


SIMPLE = [(1704067200000, "a", 1.0, "u1"), (1704067220000, "a", 2.0, "u1"), (1704067240000, "b", 3.0, "u2")]


def test_simple_goldens(spark, rows):
    df = events(spark, SIMPLE)
    t = 1704067200000
    assert rows(windowed_aggregate(df, Tumbling(60_000), "word")) == [(t, t + 60_000, "a", 2), (t, t + 60_000, "b", 1)]
    assert rows(windowed_aggregate(df, Tumbling(60_000), "word", "sum", "x"), "key", "sum") == [("a", 3.0), ("b", 3.0)]
    assert rows(windowed_aggregate(df, Tumbling(60_000), "word", "avg", "x"), "key", "avg") == [("a", 1.5), ("b", 3.0)]
    assert rows(windowed_aggregate(df, Tumbling(60_000), "word", "distinct", "user"), "key", "distinct_count") == [("a", 1), ("b", 1)]
    assert len(rows(windowed_aggregate(df, Sliding(60_000, 15_000), "word"))) == 9
    assert rows(windowed_aggregate(df, Session(30_000), "word")) == [(t, t + 50_000, "a", 2), (t + 40_000, t + 70_000, "b", 1)]


def test_records_and_averages(spark, rows):
    assert rows(windowed_aggregate(events(spark, [(1000, "hi", 0.0, ""), (1010, "hi", 0.0, "")]), Tumbling(60_000), "word"), "count") == [(2,)]
    df = events(spark, [(0, "k", 1.0, "a"), (1, "k", 3.0, "a"), (2, "k", None, "b"), (3, "k", None, None)])
    assert rows(windowed_aggregate(df, Tumbling(10), "word", "avg", "x"), "avg") == [(1.0,)]
    assert rows(windowed_aggregate(df, Tumbling(10), "word", "distinct", "user"), "distinct_count") == [(3,)]


def test_sums_that_are_not_finite_are_null(spark, rows):
    df = events(spark, [(0, "a", float("inf"), ""), (0, "b", float("nan"), ""), (0, "c", 1.0, "")])
    for window in (Tumbling(10), Sliding(10, 5), Session(5)):
        assert {r.key: r.sum for r in windowed_aggregate(df, window, "word", "sum", "x").collect() if r.window_start_ms == 0} == {"a": None, "b": None, "c": 1.0}


def brute(data, window, agg):
    groups = {}
    if isinstance(window, Session):
        by = {}
        for row in data:
            if row[0] is not None:
                by.setdefault(row[1], []).append(row)
        for key, some in by.items():
            some.sort(key=lambda r: r[0])
            run = [some[0]]
            for row in some[1:]:
                if row[0] - run[-1][0] > window.gap_ms:
                    groups[run[0][0], run[-1][0] + window.gap_ms, key] = run
                    run = []
                run.append(row)
            groups[run[0][0], run[-1][0] + window.gap_ms, key] = run
    else:
        for row in data:
            for s in starts_of(row[0], window) if row[0] is not None else []:
                groups.setdefault((s, s + window.size_ms, row[1]), []).append(row)
    fn = {
        "count": len, "sum": lambda g: sum(r[2] or 0.0 for r in g), "avg": lambda g: sum(r[2] or 0.0 for r in g) / len(g),
        "distinct": lambda g: len({"null" if r[3] is None else r[3] for r in g}),
    }[agg]
    return sorted(((*k, fn(g)) for k, g in groups.items()), key=repr)


ROW = st.tuples(st.one_of(st.none(), st.integers(-200, 200)), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-8, 8).map(lambda x: x / 4)), st.sampled_from(["u", "v", "null", None]))
KINDS = [Tumbling(60), Sliding(60, 20), Sliding(60, 60), Sliding(60, 25), Sliding(20, 60), Session(7)]


@settings(max_examples=2, deadline=None)
@given(st.lists(ROW, max_size=60))
def test_windows_equal_the_model(spark, rows, data):
    df = events(spark, data)
    for window in KINDS:
        for agg, field in (("count", None), ("sum", "x"), ("avg", "x"), ("distinct", "user")):
            got = [(*r[:3], round(r[3], 9)) for r in rows(windowed_aggregate(df, window, "word", agg, field))]
            assert sorted(got, key=repr) == sorted([(*r[:3], round(r[3], 9)) for r in brute(data, window, agg)], key=repr), (window, agg)


def test_what_is_refused(spark):
    df = events(spark, SIMPLE)
    for bad in (lambda: Tumbling(0), lambda: Sliding(1, 0), lambda: Session(-1), lambda: windowed_aggregate(df, Tumbling(1), "word", "sum"), lambda: windowed_aggregate(df, Tumbling(1), "word", "max", "x")):
        with pytest.raises(ValueError):
            bad()


def test_extra_columns_may_clash_and_tables_may_be_empty(spark, rows):
    df = events(spark, SIMPLE).withColumn("_k", F.lit(1)).withColumn("_ms", F.lit("x")).withColumn("key", F.lit(0)).withColumn("window_start_ms", F.lit(0))
    for window in KINDS:
        assert rows(windowed_aggregate(df, window, "word")) == rows(windowed_aggregate(events(spark, SIMPLE), window, "word"))
        assert windowed_aggregate(df.limit(0), window, "word", "distinct", "x").count() == 0


@pytest.mark.parametrize("kind", ["double", "boolean", "struct<a: int>", "bigint"])
def test_keys_of_any_kind(spark, rows, kind):
    values = {"double": "double('nan')", "boolean": "true", "struct<a: int>": "named_struct('a', 1)", "bigint": "7L"}
    df = spark.sql(f"select timestamp_ntz'2024-01-01 00:00:00' as event_time, {values[kind]} as k, 1.5 as x union all select timestamp_ntz'2024-01-01 00:00:01', cast(null as {kind}), 2.5")
    for window in (Tumbling(60_000), Sliding(60_000, 60_000), Session(500)):
        got = windowed_aggregate(df, window, "k", "sum", "x").collect()
        assert sorted(r["sum"] for r in got) == [1.5, 2.5] and sorted(r.key is None for r in got) == [False, True]


def test_panes_count_each_row_once(spark):
    plan = windowed_aggregate(events(spark, SIMPLE), Sliding(60_000, 15_000), "word")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate [_k") if "Aggregate [_k" in plan else plan.count("Aggregate") == 2


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_running_count(spark, rows, block):
    data = [(i * 900, ["a", None, "b"][i % 3], 0.0, "") for i in range(150)] + [(None, "a", 0.0, "")]
    got = running.running_count(events(spark, data), "word", F.col("n"), block=block)
    seen, want = {}, []
    for n, (ms, k, *_) in enumerate(data):
        if ms is not None:
            seen[k, ms // 60_000] = seen.get((k, ms // 60_000), 0) + 1
            want.append((n, ms, ms // 60_000 * 60_000, k, seen[k, ms // 60_000]))
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_watermark_never_goes_back(spark, block):
    df = events(spark, [(1700000000000, "", 0.0, ""), (1700000030000, "", 0.0, ""), (1699999900000, "", 0.0, ""), (None, "", 0.0, "")]).withColumn("_ms", F.lit("kept"))
    got = watermark.with_watermark_ms(df, F.col("n"), lateness_ms=10_000, block=block).orderBy("n").collect()
    assert [r.watermark_ms for r in got] == [1699999990000, 1700000020000, 1700000020000, 1700000020000]
    assert [r.prior_ms for r in got] == [None, 1699999990000, 1700000020000, 1700000020000] and got[0]["_ms"] == "kept"
    assert [r.n for r in watermark.on_time(df, F.col("n"), lateness_ms=10_000).orderBy("n").collect()] == [0, 1, 3]
    assert watermark.end_watermark(df.limit(0)).first()[0] is None
    assert watermark.end_watermark(events(spark, SIMPLE)).first()[0].date().isoformat() == "2123-12-08"


def test_fold(spark, rows):
    base = 1700000000000
    data = [(base, "", 1.0, ""), (base + 10_000, "", 2.0, ""), (base + 70_000, "", 5.0, "")]
    got = rows(fold.fold(events(spark, data), Tumbling(60_000), F.lit(0.0), lambda a, v: a + v, "x", "n"), "state")
    assert got == [(3.0,), (5.0,)]
    one = events(spark, [(base + 30_000, "", 1.0, "")])
    assert rows(fold.fold_merge(one, Sliding(60_000, 15_000), F.sum("x")), "state") == [(1.0,)] * 4
    order = fold.fold_python(events(spark, data), Tumbling(60_000), lambda p: "".join(str(int(x)) for x in p["x"]), "string", "n")
    assert rows(order, "state") == [("12",), ("5",)]
    assert rows(fold.fold(events(spark, data), Tumbling(10**12), F.lit(1.0), lambda a, v: a * 10 + v, "x", "n"), "state") == [(1125.0,)]


def test_sessions_by_arrival(spark, rows):
    df = events(spark, [(50_000, "k", 0.0, ""), (0, "k", 0.0, ""), (25_000, "k", 0.0, "")])
    assert rows(arrival_sessions(df, 30_000, "word", F.col("n"))) == [(50_000, 55_000, "k", 3)]
    assert rows(windowed_aggregate(df, Session(30_000), "word")) == [(0, 80_000, "k", 3)]


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_sessions_by_arrival_equal_the_model(spark, rows, block):
    rng = random.Random(block)
    data = [(rng.choice([None, rng.randrange(0, 2_000)]), rng.choice(["a", "b", None]), 0.0, "") for _ in range(120)]
    data += [(i * 10, "a", 0.0, "") for i in range(30)]
    held, want = {}, []
    for ms, key, *_ in data:
        if ms is None:
            continue
        key = "null" if key is None else key
        if key in held and ms - held[key][1] <= 300:
            held[key] = (held[key][0], ms, held[key][2] + 1)
        else:
            want += [(held[key][0], held[key][1] + 300, key, held[key][2])] if key in held else []
            held[key] = (ms, ms, 1)
    want += [(a, b + 300, k, n) for k, (a, b, n) in held.items()]
    assert rows(arrival_sessions(events(spark, data), 300, "word", F.col("n"), block=block)) == sorted(want, key=repr)


def test_transforms(spark, rows):
    df = events(spark, SIMPLE)
    assert rows(transforms.key_by(df, "word"), "key") == [("a",), ("a",), ("b",)]
    assert rows(transforms.key_by(df, "absent"), "key") == [(None,)] * 3
    assert rows(transforms.filter_rows(df, F.col("x") > 1), "x") == [(2.0,), (3.0,)]
    assert rows(transforms.filter_python(df, lambda r: r["word"] == "b"), "x") == [(3.0,)]
    doubled = transforms.map_python(df, lambda r: [{"w": r["word"], "i": i} for i in range(int(r["x"]) - 1)], "w string, i long")
    assert rows(doubled) == [("a", 0), ("b", 0), ("b", 1)]
    assert rows(transforms.map_columns(df, {"y": F.col("x") * 2}), "y") == [(2.0,), (4.0,), (6.0,)]
    text = spark.createDataFrame([(at(0), "The  the\tCat"), (at(1), None)], "event_time timestamp_ntz, text string")
    assert rows(transforms.split_words(text, "text"), "word") == [("cat",), ("the",), ("the",)]
    keyed = transforms.key_by_payload(spark.createDataFrame([('{"k": 1}',), ('{"k": "1"}',), ("[]",)], "payload string"), "k")
    assert rows(keyed, "key") == [('"1"',), ("1",), (None,)]


def test_starts_truncate_toward_zero():
    assert starts_of(-1, Tumbling(60)) == [0] and starts_of(-61, Tumbling(60)) == [-60] and starts_of(59, Tumbling(60)) == [0]
    assert starts_of(50_001, Sliding(60_000, 25_000)) == [50_000, 25_000] and starts_of(5, Sliding(10, 20)) == []
    assert datetime.fromtimestamp(0, timezone.utc).year == 1970


def test_distinct_values_of_sessions_over_many_buckets(spark):
    hour = 3_600_000
    times = [(k, n * 500_000) for k in ("a", None) for n in range(40)] + [("a", 40 * hour), ("a", 40 * hour), ("b", -1), ("b", 1)]
    rows_ = [(k, ms, n % 7 if n % 5 else None) for n, (k, ms) in enumerate(times)]
    df = spark.createDataFrame(rows_, "k string, ms long, v long").selectExpr("k", "timestamp_millis(ms) AS event_time", "v")
    out = windowed_aggregate(df, Session(600_000), "k", "distinct", "v")
    want, open_ = [], {}
    for k, ms, v in sorted(rows_, key=lambda r: r[1]):
        if k not in open_ or ms - open_[k][1] > 600_000:
            open_[k] = [ms, ms, set()]
            want.append((k, open_[k]))
        open_[k][1] = ms
        open_[k][2].add(v)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(a, b + 600_000, k, len(v)) for k, (a, b, v) in want], key=repr)
    # No task merges all sessions of a key.
    assert "session_window" not in out._jdf.queryExecution().toString()
