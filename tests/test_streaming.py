import json
import os
import time
from datetime import datetime, timedelta

import pytest
from tidemark.operators.running import MINUTE_MS
from tidemark.operators.windows import Session, Sliding, Tumbling, windowed_aggregate
from tidemark.sinks.files import ParquetSink
from tidemark.sources.files import read_jsonl
from tidemark.streaming.checkpoints import Progress
from tidemark.streaming.metrics import Metrics, ProgressListener
from tidemark.streaming.processors import arrival_sessions, running_counts, strict_windows

SCHEMA = "event_time timestamp_ntz, word string, x double, n long"


class Feed:
    """A folder in which each call of ``add`` makes one micro-batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        path.mkdir()
        self.df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path))

    def add(self, *rows):
        lines = []
        for ms, word, x in rows:
            t = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
            lines.append(json.dumps({"event_time": t.isoformat(timespec="milliseconds"), "word": word, "x": x, "n": self.n}))
            self.n += 1
        path = self.path / f"{self.n:06d}.json"
        # Named so that no reader sees it before it has its time, which sets the order of the batches.
        (hidden := self.path / "_new").write_text("\n".join(lines))
        os.utime(hidden, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        hidden.rename(path)


@pytest.fixture
def run(spark, tmp_path):
    queries = []

    def start(df, name, mode="append", checkpoint=None):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint or tmp_path / f"cp-{name}")).start()
        queries.append(query)
        return query

    yield start
    for q in queries:
        q.stop()


def shown(spark, name):
    return sorted((tuple(r) for r in spark.table(name).collect()), key=repr)


def test_windows_close_behind_the_watermark(spark, tmp_path, run):
    feed = Feed(spark, tmp_path / "in")
    query = run(windowed_aggregate(feed.df, Tumbling(60_000), "word", lateness_ms=30_000), "tumbling")
    feed.add((10_000, "a", 1.0), (20_000, "a", 1.0))
    feed.add((89_000, "b", 1.0))
    query.processAllAvailable()
    assert shown(spark, "tumbling") == []
    feed.add((91_000, "b", 1.0))
    feed.add((91_000, "b", 1.0))
    query.processAllAvailable()
    assert shown(spark, "tumbling") == [(0, 60_000, "a", 2)]
    progress = Progress.of(query)
    assert progress.watermark_ms == 61_000 and Progress.from_json(progress.to_json()) == progress


def test_streams_give_what_batches_give(spark, tmp_path, run):
    feed = Feed(spark, tmp_path / "in")
    rows = [(i * 7_000, "ab"[i % 2], float(i)) for i in range(40)]
    kinds = {"s_tumbling": Tumbling(60_000), "s_sliding": Sliding(60_000, 20_000), "s_odd": Sliding(60_000, 25_000), "s_session": Session(10_000)}
    running = []
    for name, window in kinds.items():
        agg, field = ("distinct", "x") if name == "s_tumbling" else ("avg", "x")
        running.append(run(windowed_aggregate(feed.df, window, "word", agg, field), name))
    feed.add(*rows)
    feed.add((10_000_000, "z", 0.0))
    feed.add((10_000_000, "z", 0.0))
    for q in running:
        q.processAllAvailable()
    batch = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    for name, window in kinds.items():
        agg, field = ("distinct", "x") if name == "s_tumbling" else ("avg", "x")
        want = windowed_aggregate(batch, window, "word", agg, field).filter("key <> 'z'")
        got = [r for r in shown(spark, name) if r[2] != "z"]
        assert [(*r[:3], round(r[3], 6)) for r in got] == sorted(((*r[:3], round(r[3], 6)) for r in map(tuple, want.collect())), key=repr), name


def test_records_behind_the_watermark_are_dropped_one_by_one(spark, tmp_path, run):
    feed = Feed(spark, tmp_path / "in")
    strict = run(strict_windows(feed.df, Tumbling(60_000), "word", 0.0, lambda a, v: a + v, "double", value="x", order="n"), "strict")
    loose = run(windowed_aggregate(feed.df, Tumbling(60_000), "word", "sum", "x"), "loose")
    feed.add((100_000, "a", 1.0))
    feed.add((70_000, "a", 5.0), (101_000, "a", 2.0))
    feed.add((500_000, "z", 0.0))
    feed.add((500_000, "z", 0.0))
    for q in (strict, loose):
        q.processAllAvailable()
    assert (60_000, 120_000, "a", 3.0) in shown(spark, "strict")
    assert (60_000, 120_000, "a", 8.0) in shown(spark, "loose")


def test_sessions_by_arrival(spark, tmp_path, run):
    feed = Feed(spark, tmp_path / "in")
    query = run(arrival_sessions(feed.df, 30_000, "word", lateness_ms=60_000, order="n"), "arrival")
    feed.add((50_000, "k", 0.0), (1, "k", 0.0), (25_000, "k", 0.0))
    feed.add((900_000, "z", 0.0))
    feed.add((900_000, "z", 0.0))
    query.processAllAvailable()
    assert shown(spark, "arrival") == [(50_000, 55_000, "k", 3)]


def test_many_rows_of_a_key_in_a_batch_are_taken_by_arrival(spark, tmp_path, run):
    # More rows than one Arrow batch holds, and they come in the opposite order.
    feed = Feed(spark, tmp_path / "in")
    query = run(arrival_sessions(feed.df, 10, "word", lateness_ms=10_000_000, order="n"), "many")
    n = 50_000
    lines = [json.dumps({"event_time": (datetime(1970, 1, 1) + timedelta(milliseconds=1 + i + 20 * (i >= n // 2))).isoformat(timespec="milliseconds"), "word": "k", "x": 0.0, "n": i}) for i in range(n)]
    (tmp_path / "a.json").write_text("\n".join(reversed(lines)))
    os.utime(tmp_path / "a.json", (1_700_000_000, 1_700_000_000))
    (tmp_path / "a.json").rename(tmp_path / "in" / "a.json")
    query.processAllAvailable()
    feed.add((100_000_000, "z", 0.0))
    feed.add((100_000_000, "z", 0.0))
    query.processAllAvailable()
    assert shown(spark, "many") == [(1, n // 2 + 10, "k", n // 2), (n // 2 + 21, n + 20 + 10, "k", n // 2)]


def test_count_at_every_row_survives_a_restart(spark, tmp_path, run):
    feed = Feed(spark, tmp_path / "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def start():
        return running_counts(feed.df, "word", size_ms=MINUTE_MS, order="n").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()

    query = start()
    feed.add((1, "a", 0.0), (2, "a", 0.0), (3, "b", 0.0))
    query.processAllAvailable()
    query.stop()
    feed.add((4, "a", 0.0), (70_000, "a", 0.0))
    query = start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("window_start_ms", "key", "count").collect())
    assert got == [(0, "a", 1), (0, "a", 2), (0, "a", 3), (0, "b", 1), (60_000, "a", 1)]


def test_lines_to_parquet_with_metrics(spark, tmp_path):
    metrics = Metrics()
    listener = ProgressListener(metrics)
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.jsonl").write_text('{"event_time":1700000000000,"word":"a"}\n')
        df = read_jsonl(spark, str(tmp_path / "in"), "event_time", stream=True)
        query = ParquetSink(str(tmp_path / "out"), max_age_ms=100).start(df, str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
        assert [p.name for p in (tmp_path / "out").glob("dt=*")] == ["dt=2023-11-14"]
        for _ in range(50):
            if "tidemark_bytes_written_total{" in metrics.render():
                break
            time.sleep(0.1)
        text = metrics.render()
        assert "tidemark_operator_rows_total{" in text and "tidemark_queue_depth{" in text
        written = sum(float(line.split()[-1]) for line in text.splitlines() if line.startswith("tidemark_bytes_written_total{"))
        assert written == len('{"event_time":1700000000000,"word":"a"}')
    finally:
        spark.streams.removeListener(listener)
