"""Data preparation operators against brute force, on small rows with the odd cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import clean_path, directory, epoch_ms, usable_ms, word_key
from tidemark.operators import archive, dedup, late, rejects, skew
from tidemark.operators.sessionize import sessionize

EPOCH = datetime(1970, 1, 1)


def at(ms):
    return None if ms is None else EPOCH + timedelta(milliseconds=ms)


# ---- shared columns

def test_word_key_and_paths(spark):
    df = spark.createDataFrame([(" \tAck\r\n", "./a//b/./c"), ("  ", "a/./b"), (None, None), ("É ", "x"), ("", ".//./a/b")], "w string, p string")
    got = df.select(word_key(F.col("w")), clean_path(F.col("p")), directory(clean_path(F.col("p")))).collect()
    assert [tuple(r) for r in got] == [("ack", "a/b/c", "a/b"), (None, "a/b", "a"), (None, None, None), ("é", "x", ""), (None, "a/b", "a")]


def test_times_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(datetime(2019, 3, 31, 1, 30, 0, 999),), (datetime(1969, 12, 31, 23, 59, 59, 999500),), (EPOCH,), (None,)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [tuple(r) for r in df.select(epoch_ms(df, "t"), usable_ms(df, "t")).collect()] == [
                (1553995800000, 1553995800000), (-1, -1), (0, None), (None, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# ---- sessions

def brute_sessions(data, gap):
    by = {}
    for k, ms in data:
        if k is not None and ms is not None:
            by.setdefault(k, []).append(ms)
    out = []
    for k, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((k, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [1, 7, 100, 10_000])
def test_sessions_equal_brute_force_for_any_bucket(spark, rows, bucket):
    rng = random.Random(bucket)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-300, 300)])) for _ in range(400)] + [("hot", 5)] * 300
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in data], "k string, t long, _ms int, n_rows string")
    for gap in (0, 3, 30):
        assert rows(sessionize(df, {"k": F.col("k")}, F.col("t"), gap, bucket)) == brute_sessions(data, gap)


def test_sessions_sum_values_and_take_empty_tables(spark, rows):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 50, 1.5)], "k string, t long, v double")
    out = sessionize(df, {"k": F.col("k")}, F.col("t"), 10, 20, value=F.coalesce("v", F.lit(0.0)))
    assert rows(out) == [("a", 1, 2, 2, 2.0), ("a", 50, 50, 1, 1.5)]
    assert rows(sessionize(df.limit(0), {"k": F.col("k")}, F.col("t"), 10)) == []


# ---- late records

KAFKA = "event_time timestamp_ntz, payload string, _topic string, _partition int, _offset long, batch_id long, received_at timestamp_ntz, topic string"


def kafka(spark, data):
    return spark.createDataFrame([(at(ms), p, t, part, off, b, at(r), "clash") for ms, p, t, part, off, b, r in data], KAFKA)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_late_messages_equal_brute_force(spark, rows, block):
    rng = random.Random(1)
    data = []
    for part in (0, 1):
        for off in range(60):
            ms = rng.choice([None, 0, 100_000 + off * 700 - rng.choice([0, 0, 5_000, 30_000])])
            data += [(ms, "{}", "t", part, off, 0, 5)] * rng.choice([1, 1, 2])
    data += [(1, "[1]", None, 0, 3, 0, 5), (10**6, "{}", "t", None, 1, 0, 5)]
    want = []
    for part in (0, 1):
        top = None
        for off, ms in sorted({(o, ms) for ms, _, t, p, o, *_ in data if t == "t" and p == part and ms}):
            if top is not None and top - ms > 10_000:
                want.append(("t", part, off))
            top = ms if top is None else max(top, ms)
    judged = late.judged(late.messages(kafka(spark, data)), 10_000, block=block)
    assert rows(judged.filter("beyond"), "topic", "part", "off") == sorted(want, key=repr)
    assert judged.count() == len({(p, o) for ms, _, t, p, o, *_ in data if t == "t" and p is not None and ms})


def test_identifier_comes_from_the_payload_where_columns_are_null(spark, rows):
    data = [
        (1, '{"_topic": "a", "_partition": "3", "_offset": 9}', None, None, None, 0, 1),
        (1, '{"_topic": "a", "_partition": 3.5, "_offset": "x"}', None, None, None, 0, 1),
        (1, '["_topic"]', None, 1, 1, 0, 1),
        (1, None, "b", 1, 2, 0, 1),
    ]
    assert rows(late.messages(kafka(spark, data)), "topic", "part", "off") == sorted([("a", 3, 9), ("a", None, None), (None, 1, 1), ("b", 1, 2)], key=repr)


def test_revisions_add_up_and_leave_out_what_is_beyond(spark, rows):
    data = [(1_000, "{}", "t", 0, 1, 0, 1_000), (2_000, "{}", "t", 0, 2, 0, 70_000), (90_000, "{}", "t", 0, 3, 0, 90_000), (3_000, "{}", "t", 0, 4, 0, 95_000), (61_000, "{}", "t", 0, 5, 0, None)]
    out = late.revisions(late.judged(late.messages(kafka(spark, data)), 30_000))
    assert rows(out) == [("t", 0, 0, 1, 1, 1, 1_000), ("t", 0, 60_000, 2, 1, 2, 2_000), ("t", 60_000, 60_000, 1, 1, 1, 90_000)]
    assert late.revisions(late.judged(late.messages(kafka(spark, data).limit(0)), 1)).count() == 0


# ---- skew

def test_eager_aggregation_equals_the_join(spark, rows):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), rng.choice([1.0, 2.5, None])) for _ in range(80)], "k string, g string, v double")
    right = spark.createDataFrame([(rng.choice(["a", "b", None, "z"]), rng.choice([10.0, None])) for _ in range(50)], "k string, w double")
    a = skew.key_states(left, {"k": F.col("k"), "g": F.col("g")}, F.col("v"))
    b = skew.key_states(right, {"k": F.col("k")}, F.col("w"))
    got = skew.eager_join_aggregate(a, b, ["k"], ["g"]).select("g", "pairs", "left_total", "right_total")
    want = left.join(right, "k").groupBy("g").agg(F.count("*"), F.sum("v"), F.sum("w"))
    assert rows(got) == rows(want)


def test_heavy_keys_count_all_rows_and_ties(spark, rows):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)] * 1, "word string").withColumn("n", F.lit(1))
    assert rows(skew.heavy_keys(df, F.col("word"), 2)) == [("a", 5, 10)]
    assert rows(skew.heavy_keys(df.limit(0), F.col("word"), 2)) == []


# ---- redelivery

@pytest.mark.parametrize("bucket", [10, 1_000, 10**9])
def test_one_copy_of_each_identifier_remains(spark, rows, bucket):
    rng = random.Random(3)
    data = []
    for i in range(3_000):
        data.append((1, "{}", "t", rng.randrange(3), rng.randrange(700), i // 500, rng.randrange(2_000)))
    data += [(1, "{}", "t", 9, 9, 0, 5)] * 500 + [(1, "true", None, None, None, 0, 5)] * 3
    df = kafka(spark, data)
    ids = {c: F.col(c) for c in ("_topic", "_partition", "_offset")}
    ms = epoch_ms(df, "received_at")
    seen = {}
    for _, _, t, p, o, b, r in data:
        if t is not None:
            seen.setdefault((t, p, o), []).append((r, b))
    assert rows(dedup.redelivered(df, ids, ms, bucket)) == sorted((k for k, v in seen.items() if len(v) > 1), key=repr)
    once = dedup.deduplicate(df, ids, ms, [F.col("received_at"), F.col("batch_id")], bucket, ["batch_id", "received_at"])
    assert rows(once) == sorted(((*k, min(v)[1], at(min(v)[0])) for k, v in seen.items()), key=repr)
    assert dedup.redelivered(df.limit(0), ids, ms, bucket).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives():
    import numpy as np

    rng = np.random.default_rng(4)
    ids, others = (rng.integers(-(2**63), 2**63 - 1, 50_000) for _ in range(2))
    bloom = dedup.BloomFilter(len(ids))
    bloom.add(ids)
    assert bloom.might_contain(ids).all()
    assert bloom.might_contain(others).mean() < 0.02


def test_few_false_positives_within_a_shard():
    import numpy as np

    shards = 4096
    rng = np.random.default_rng(5)
    ids, others = (rng.integers(0, 1 << 50, 519 if n == 0 else 200_000) * shards + 77 for n in range(2))
    bloom = dedup.BloomFilter(len(ids))
    bloom.add(ids)
    assert len(bloom.words) * 64 <= 11 * len(ids) and bloom.might_contain(ids).all()
    assert bloom.might_contain(others).mean() < 0.015


def test_screen_finds_repeats_over_many_buckets():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    n = 3_000  # more buckets than two levels of summaries cover
    hashes = rng.sample(range(1 << 62), n)
    names = [f"n{i}" for i in range(n)]
    for i in (3, 40, 99, 2_999):
        hashes[i], names[i] = 7 << 55, "again"
    for i in (50, 2_000):  # of one hash, but different
        hashes[i] = 5 << 50
    table = pa.table({"_bucket": pa.array(range(n), pa.int64()), "_hash": pa.array(hashes, pa.int64()), "id": names})
    got = pa.Table.from_batches(dedup._screened(iter(table.to_batches(max_chunksize=7)), 1))
    assert got.column_names == ["_bucket", "_hash", "id", "_again"]
    assert np.flatnonzero(np.asarray(got.column("_again"))).tolist() == [40, 99, 2_999]


# ---- rejects

CASES = [
    ("tsv", "1,a,2,u", "format"), (None, "1,a,2,u", "format"), ("", "{}", "format"),
    (" CSV ", "1,a,2,u", None), ("csv", '+1,"a ""b"", c",1e3,', None), ("csv", '"5",,,"u"', None), ("csv", '1,"two\nlines",.5,u', None),
    ("csv", '1,5" disk,2,u', "quoting"), ("csv", '1,"a"x,2,u', "quoting"), ("csv", '1,"open,2,u', "quoting"), ("csv", '1,a"', "quoting"),
    ("csv", "1,a,2", "columns"), ("csv", "1,a,2,u,", "columns"), ("csv", "", "columns"), ("csv", None, "columns"),
    ("csv", "1.0,a,2,u", "event_time"), ("csv", " 1,a,2,u", "event_time"), ("csv", "-1,a,x,u", "event_time"), ("csv", "4102444800000,a,2,u", "event_time"),
    ("csv", "4102444799999,a,2,u", None), ("csv", "0,a,2,u", None), ("jsonl", '{"event_time": 0}', None), ("jsonl", '{"event_time": 00}', "json"), ("csv", "-0,a,,u", None), ("csv", "000000000000000000000000001,a,,u", None), ("csv", "99999999999999999999,a,,u", "event_time"),
    ("csv", "1,a,1_000,u", "x"), ("csv", "1,a,0x1F,u", "x"), ("csv", '1,a,"3,5",u', "x"), ("csv", "1,a, 2,u", "x"), ("csv", "1,a,1.,u", None), ("csv", "1,a,nan,u", "x"),
    ("jsonl", None, "json"), ("jsonl", "", "json"), ("jsonl", "[1]", "json"), ("jsonl", "1", "json"), ("jsonl", '{"event_time": 1}}', "json"), ("jsonl", '{"event_time": 1,}', "json"),
    ("jsonl", '{"event_time": 1, "x": NaN}', "json"), ("jsonl", '{"event_time": 01}', "json"), ("jsonl", '{"event_time": 1, "w": "a\tb"}', "json"), ("jsonl", "{'event_time': 1}", "json"),
    ("jsonl", '﻿{"event_time": 1}', "json"), ("jsonl", '{"event_time": 1} x', "json"), ("jsonl", '{"event_time": 1, "w": "\\q"}', "json"),
    ("jsonl", '{"event_time": 1}', None), ("JSONL", ' { "event_time" : 1 , "x" : null } ', None), ("jsonl", '{"event_time": 5, "deep": {"a": [1, {"b": null}]}, "x": -1.5e3}', None),
    ("jsonl", '{"x": 1}', "event_time"), ("jsonl", '{"event_time": 1.5}', "event_time"), ("jsonl", '{"event_time": "1"}', "event_time"), ("jsonl", '{"event_time": true}', "event_time"),
    ("jsonl", '{"event_time": 1e3}', "event_time"), ("jsonl", '{"event_time": -1}', "event_time"), ("jsonl", '{"event_time": "2019-03-04"}', "event_time"),
    ("jsonl", '{"event_time": "2019-02-29T00:00:00Z"}', "event_time"), ("jsonl", '{"event_time": "2020-02-29T00:00:00Z"}', None), ("jsonl", '{"event_time": "2019-03-04T24:00:00Z"}', "event_time"),
    ("jsonl", '{"event_time": "1970-01-01T00:30:00+01:00"}', "event_time"), ("jsonl", '{"event_time": "1969-12-31T23:30:00-01:00"}', None), ("jsonl", '{"event_time": "2100-01-01T00:30:00+01:00"}', None),
    ("jsonl", '{"event_time": "2019-03-04t05:06:07.123456+05:30"}', None), ("jsonl", '{"event_time": "2019-03-04T05:06:07"}', "event_time"),
    ("jsonl", '{"event_time": 1, "x": "2"}', "x"), ("jsonl", '{"event_time": 1, "x": {"v": 1}}', "x"), ("jsonl", '{"event_time": 1, "x": false}', "x"), ("jsonl", '{"event_time": 1, "\\u0078": "2"}', "x"),
    ("jsonl", '{"event_time": "a", "event_time": 1}', None), ("jsonl", '{"event_time": 1, "event_time": "a"}', "event_time"),
]


def raw(spark, cases):
    return spark.createDataFrame([(i, f, line, "clash", 1) for i, (f, line, *_) in enumerate(cases)], "raw_id long, format string, line string, _kind string, reason int")


def test_each_reason(spark):
    got = {r.raw_id: r.reason for r in rejects.rejected(raw(spark, CASES), ["raw_id"]).collect()}
    wrong = [(c, got.get(i)) for i, c in enumerate(CASES) if got.get(i) != c[2]]
    assert not wrong
    assert {r.raw_id for r in rejects.loaded(raw(spark, CASES), ["raw_id"]).collect()} == {i for i, c in enumerate(CASES) if c[2] is None}


def test_loaded_values(spark, rows):
    cases = [
        ("csv", '+12,"a ""b"", c",1e3,'), ("csv", "5,w,,u"), ("jsonl", '{"event_time": "2019-03-04T05:36:07.123456+05:30", "word": "d\\u00e9j\\u00e0", "x": 2}'),
        ("jsonl", '{"event_time": "2016-12-31T23:59:60Z", "word": null}'), ("jsonl", '{"event_time": 7, "user_id": "u", "o": {}}'),
    ]
    want = [(0, 12, 'a "b", c', 1000.0, ""), (1, 5, "w", None, "u"), (2, 1551657967123, "déjà", 2.0, None), (3, 1483228800000, None, None, None), (4, 7, None, None, "u")]
    assert rows(rejects.loaded(raw(spark, cases), ["raw_id"])) == want


def test_very_long_and_deep_lines(spark):
    cases = [
        ("csv", "1," + '"' + '""' * 300_000 + '",2,u', None), ("csv", "1," + "a" * 500_000 + '",2,u', "quoting"),
        ("jsonl", '{"event_time": 1, "w": "' + "\\n" * 300_000 + '"}', None), ("jsonl", '{"event_time": 1, "w": ' + "[" * 50_000 + "]" * 50_000 + "}", None),
        ("jsonl", '{"event_time": 1, "w": ' + "[" * 50_000 + "]" * 49_999 + "}", "json"), ("jsonl", "{" + ",".join(f'"k{i}": {i}' for i in range(30_000)) + ', "event_time": 1}', None),
    ]
    got = {r.raw_id: r.reason for r in rejects.rejected(raw(spark, cases), ["raw_id"]).collect()}
    assert [got.get(i) for i in range(len(cases))] == [c[2] for c in cases]
    assert rejects.rejected(raw(spark, cases).limit(0), ["raw_id"]).count() == 0


def test_json_patterns_agree_with_the_exact_way(spark):
    rng = random.Random(12)
    times = ["1", "0", "-1", "01", "1.0", "1e3", "4102444800000", "4102444799999", "null", "true", '"2019-03-04T05:06:07Z"', '"2020-02-29t23:59:60.9999+23:59"', '"2019-02-29T00:00:00Z"', '"2099-12-31T23:59:59-00:01"',
             '"1970-01-01 00:00:00.5-18:30"', '"2019-03-04T05:06:07+24:00"', '"20\\u00319-03-04T05:06:07Z"', '"x"', '""', "{}", "[1]"]
    values = ["1", "-0.5e-3", "null", "true", '"a"', '"a\\"b"', '"\\ud83d"', "{}", '{"x": 1}', "[]", '"[{"', "NaN", "+1", ".5", '"é😀"']
    names = ['"event_time"', '"x"', '"word"', '"user_id"', '"event_time "', '"\\u0078"', '"event_tim\\u0065"', '""']
    space = lambda: "\u00a0" if rng.random() < 0.01 else rng.choice(["", "", "", " ", "\t\n"])
    lines = []
    for _ in range(6_000):
        members = [(n, rng.choice(times if "time" in n else values)) for n in rng.choices(names, (5, 4, 3, 2, 1, 1, 1, 1), k=rng.randrange(5))]
        line = space() + "{" + ",".join(f"{space()}{n}{space()}:{space()}{v}{space()}" for n, v in members) + "}" + space()
        if rng.random() < 0.2:
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", ",", '"', "}", "\\", "{", ":"]) + line[at + rng.randrange(2) :]
        lines.append(("jsonl", line))
    got = {r.raw_id: r.reason for r in rejects.rejected(raw(spark, lines), ["raw_id"]).collect()}
    wrong = [(line, got.get(i), rejects.json_reason(line)) for i, (_, line) in enumerate(lines) if got.get(i) != rejects.json_reason(line)]
    assert not wrong, wrong[:5]
    read = rejects.loaded(raw(spark, lines), ["raw_id"]).collect()
    assert len(read) == len(lines) - len(got) > 200
    for r in read:
        _, at, word, x, user = rejects._json_row(lines[r.raw_id][1])
        assert (r.event_ms, r.word, r.x, r.user_id) == (at, word, None if x is None else float(x), user), lines[r.raw_id]
    flat = spark.createDataFrame([("{}",), ('{"event_time": 5, "x": "a"}',), ('{"event_time": "2019-02-29T00:00:00Z"',)], "l string")
    assert [r[0] for r in flat.select(rejects.EVENT_JSON.reason(F.col("l"))).collect()] == ["event_time", "x", "json"]


def test_number_pattern_is_exact():
    import re

    for most in (0, 7, 10, 109, 4102, 4_102_444_799_999):
        pattern = re.compile(rejects.whole_up_to(most) + r"\Z")
        for n in {0, 1, 9, 10, most - 1, most, most + 1, most * 10, most // 10, *(random.Random(most).randrange(2 * most + 2) for _ in range(300))}:
            if n >= 0:
                assert bool(pattern.match(str(n))) == (n <= most), (most, n)
                assert bool(pattern.match("00" + str(n))) == (n <= most)


# ---- archives

def listing(spark, data):
    schema = "listing_id long, path string, approx_bytes long, closed_at timestamp_ntz, listed_at timestamp_ntz, dir string"
    return spark.createDataFrame([(i, p, b, at(c), at(t), "clash") for i, (p, b, c, t) in enumerate(data)], schema)


def test_small_files_by_their_latest_listing(spark, rows):
    data = [
        ("d/a", 10, 1, 5), ("./d//b", 10, 1, 5), ("d/./b", 9_999, 1, 4), ("d/c", 10, None, 5), ("d/e", 5_000, 1, 5), ("e/x", 1, 1, 1), ("e/y", 1, 1, 1), ("e/y", 4_096, 1, 2),
        (None, 1, 1, 1), ("f/n", None, 1, 1), ("f/m", 1, 1, None), ("f/o", 1, 1, 1),
    ]
    assert rows(archive.small_files(listing(spark, data)), "path") == [("d/a",), ("d/b",), ("f/m",), ("f/o",)]
    assert archive.small_files(listing(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize("target", [1, 200, 1 << 20])
def test_archives_give_back_every_record_once(spark, rows, target):
    rng = random.Random(6)
    files = [(f"d{i % 3}/f{i}", 10, 1, 1) for i in range(30)]
    recs = [(n, rng.choice([f"./d{i % 3}//f{i}" for i in range(30)] + ["other/z", None]), rng.choice([at(5), None]), rng.choice(['{"k":null}', "", None, "é\nü", "x" * 3_000])) for n in range(400)]
    recs += [recs[0], (None, "d0/f0", at(1), "no id")]
    df = spark.createDataFrame([(*r, b"") for r in recs], "record_id long, path string, event_time timestamp_ntz, payload string, data binary")
    blocks = archive.pack(archive.small_files(listing(spark, files)), df, target).cache()
    small = {p for p, *_ in files}
    clean = lambda p: None if p is None else p.replace("./", "", 1).replace("//", "/")
    want = sorted(((i, clean(p), None if t is None else (t - EPOCH) // timedelta(microseconds=1), v) for i, p, t, v in recs if clean(p) in small), key=repr)
    assert rows(archive.unpack(blocks)) == want
    assert rows(archive.unpack(blocks, "d1/f1")) == [w for w in want if w[1] == "d1/f1"]
    if target > 1_000:
        assert blocks.count() == 3
    assert blocks.filter(F.length("content") > target).filter(F.size("entries") > 1).count() == 0


def test_damage_is_noticed(spark):
    files = listing(spark, [("d/a", 1, 1, 1), ("d/b", 1, 1, 1)])
    df = spark.createDataFrame([(1, "d/a", at(1), "p"), (2, "d/b", at(1), "q")], "record_id long, path string, event_time timestamp_ntz, payload string")
    blocks = archive.pack(archive.small_files(files), df)
    broken = blocks.withColumn("content", F.encode(F.translate(F.decode("content", "UTF-8"), "p", "z"), "UTF-8"))
    with pytest.raises(Exception, match="checksum"):
        archive.unpack(broken).collect()


def test_archives_on_disk(spark, rows, tmp_path):
    files = listing(spark, [("d/dt=1/a", 1, 1, 1), ("d/dt=1/b", 1, 1, 1), ("d/dt=1/none", 0, 1, 1)])
    df = spark.createDataFrame([(1, "d/dt=1/a", at(1), "p"), (2, "d/dt=1/b", None, None)], "record_id long, path string, event_time timestamp_ntz, payload string")
    archive.write_archives(archive.pack(archive.small_files(files), df), str(tmp_path / "out"))
    back = archive.unpack(spark.read.parquet(str(tmp_path / "out" / "blocks")))
    assert rows(back) == [(1, "d/dt=1/a", 1000, "p"), (2, "d/dt=1/b", None, None)]
    assert archive.lookup(spark, str(tmp_path / "out"), "d/dt=1/b") == b'{"id":2,"us":null,"p":null}\n'
    assert archive.lookup(spark, str(tmp_path / "out"), "d/dt=1/none") == b"" and archive.lookup(spark, str(tmp_path / "out"), "d/dt=1/z") is None


@pytest.mark.parametrize("target", [1, 500, 1 << 20])
def test_real_files_come_back_byte_for_byte(spark, tmp_path, monkeypatch, target):
    monkeypatch.setattr(archive, "LANE_FILES", 10)
    rng = random.Random(target)
    made = {}
    for n in range(60):
        path = tmp_path / "in" / f"dt={n % 3}" / f"part {n}.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        made[f"file:{path}"] = rng.randbytes(rng.choice([0, 1, 37, 300, 2_000]))
        path.write_bytes(made[f"file:{path}"])
    blocks = archive.pack_files(spark, str(tmp_path / "in"), target)
    archive.write_archives(blocks, str(tmp_path / "out"))
    entries = archive.index(spark.read.parquet(str(tmp_path / "out" / "blocks"))).collect()
    assert {e.path for e in entries} == set(made)
    back: dict[str, bytes] = {}
    for r in archive.contents(spark.read.parquet(str(tmp_path / "out" / "blocks"))).orderBy("path", "part").collect():
        back[r.path] = back.get(r.path, b"") + bytes(r.data)
    assert back == made
    for some in rng.sample(entries, 3):
        assert archive.lookup(spark, str(tmp_path / "out"), some.path) == made[some.path]
    # Blocks end at the target, and there are far fewer than files where that is large.
    sizes = {}
    for e in entries:
        sizes.setdefault((e.dir, e.container, e.block), []).append(e.length)
    assert all(sum(s) <= target or sum(1 for x in s if x) == 1 for s in sizes.values())
    assert archive.pack_files(spark, str(tmp_path / "in"), target, below_bytes=300).select(F.explode("entries.path")).count() == sum(len(d) < 300 for d in made.values())
