import json
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.windows import Tumbling
from tidemark.plans.config import ConfigError, PipelineConfig
from tidemark.plans.pipeline import Pipeline, build, plan
from tidemark.sinks.files import ByDate, ByField, ParquetSink, write_json_lines
from tidemark.sinks.kafka import messages
from tidemark.sources.files import read_csv, read_jsonl, read_parquet
from tidemark.sources.kafka import decode_messages, starting_offsets
from tidemark.streaming.metrics import SERIES, Metrics, serve

LINES = [
    '{"event_time":"2024-01-01T00:00:00Z","word":"a","x":1,"user":"u1"}',
    '{"event_time":"2024-01-01T00:00:20Z","word":"a","x":2,"user":"u1"}',
    '{"event_time":"2024-01-01T00:00:40Z","word":"b","x":3,"user":"u2"}',
]
CSV = "event_time,word\n1704067200000,a\n1704067220000,a\n1704067240000,b\n"


def toml(path, window='type = "tumbling"\nsize = "60s"', ops='count_by = "word"', sink='kind = "parquet"\nout_dir = "OUT"', source="", lateness="0s"):
    return f"""
[source]
kind = "file"
path = "{path}"
time_field = "event_time"
{source}
[time]
allowed_lateness = "{lateness}"
[window]
{window}
[ops]
{ops}
[sink]
{sink}
"""


@pytest.fixture
def jsonl(tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join(LINES) + "\n")
    return p


def written(spark, tmp_path, text):
    out = tmp_path / "out"
    build(spark, PipelineConfig.parse(text.replace("OUT", str(out)))).run()
    return spark.read.parquet(str(out))


@pytest.mark.parametrize("window, n", [('type = "tumbling"\nsize = "60s"', 2), ('type = "session"\nsize = "0s"\ngap = "30s"', 2), ('type = "sliding"\nsize = "60s"\nslide = "15s"', 9)])
def test_windows_to_parquet(spark, tmp_path, jsonl, window, n):
    got = written(spark, tmp_path, toml(jsonl, window))
    assert got.count() == n and set(got.columns) == {"event_time", "payload", "dt"}
    assert {str(r.dt) for r in got.select("dt").distinct().collect()} == {"2123-12-08"}
    row = json.loads(got.first().payload)
    assert sorted(row) == ["count", "key", "window_end_ms", "window_start_ms"]


@pytest.mark.parametrize("ops, name, want", [
    ('count_by = "word"', "count", {"a": 2, "b": 1}),
    ('count_by = "word"\nagg = "sum"\nagg_field = "x"', "sum", {"a": 3.0, "b": 3.0}),
    ('count_by = "word"\nagg = "avg"\nagg_field = "x"', "avg", {"a": 1.5, "b": 3.0}),
    ('count_by = "word"\nagg = "distinct"\nagg_field = "user"', "distinct_count", {"a": 1, "b": 1}),
    ('count_by = "absent"', "count", {None: 3}),
])
def test_aggregates_to_lines(spark, tmp_path, jsonl, ops, name, want):
    out = tmp_path / "lines"
    build(spark, PipelineConfig.parse(toml(jsonl, ops=ops, sink=f'kind = "file"\npath = "{out}"'))).run()
    rows = [json.loads(line) for p in out.glob("part-*") for line in p.read_text().splitlines()]
    assert {r["key"]: r[name] for r in rows} == want
    build(spark, PipelineConfig.parse(toml(jsonl, ops=ops, sink=f'kind = "file"\npath = "{out}"'))).run()
    assert sum(len(p.read_text().splitlines()) for p in out.glob("part-*")) == 2 * len(want)


def test_csv_counts(spark, tmp_path, capsys):
    p = tmp_path / "in.csv"
    p.write_text(CSV)
    build(spark, PipelineConfig.parse(toml(p, source='format = "csv"', sink='kind = "file"'))).run()
    shown = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert {r["key"]: r["count"] for r in shown} == {"a": 2, "b": 1}
    timed = plan(spark, PipelineConfig.parse(toml(p, source='format = "csv"', ops='count_by = "event_time"', sink='kind = "file"')))
    assert {r.key for r in timed.collect()} == {'"1704067200000"', '"1704067220000"', '"1704067240000"'}


def test_keys_of_different_kinds_stay_apart(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"event_time":1,"word":1}\n{"event_time":2,"word":"1"}\n{"event_time":3,"word":true}\n{"event_time":4,"word":null}\n5\n')
    got = plan(spark, PipelineConfig.parse(toml(p))).collect()
    assert {r.key: r["count"] for r in got} == {"1": 1, '"1"': 1, "true": 1, "null": 1, None: 1} or {r.key: r["count"] for r in got} == {"1": 1, '"1"': 1, "true": 1, None: 2}


def test_partitions_by_window_end_and_by_field(spark, tmp_path, jsonl):
    out = tmp_path / "ends"
    build(spark, PipelineConfig.parse(toml(jsonl).replace("OUT", str(out))), emit_time="window_end").run()
    assert [p.name for p in out.glob("dt=*")] == ["dt=2024-01-01"]
    out = tmp_path / "keys"
    build(spark, PipelineConfig.parse(toml(jsonl, sink='kind = "parquet"\nout_dir = "OUT"\npartition_field = "key"\ncompression = "zstd"').replace("OUT", str(out)))).run()
    assert sorted(p.name for p in out.glob("dt=*")) == ["dt=a", "dt=b"]


@pytest.mark.parametrize("change, message", [
    (("[ops]", "[nothing]"), "ops"), (('count_by = "word"', ""), "count_by"), (('kind = "file"', 'kind = "disk"'), "source.kind"), (('"60s"', '"0s"'), "positive"),
    (('"60s"', '"x"'), "duration"), (('type = "tumbling"', 'type = "hop"'), "window.type"), (('type = "tumbling"', 'type = "sliding"'), "slide"), (('type = "tumbling"', 'type = "session"'), "gap"),
    (('count_by = "word"', 'count_by = "word"\nagg = "max"'), "agg"), (('count_by = "word"', 'count_by = "word"\nagg = "sum"'), "agg_field"), (('kind = "parquet"', 'kind = "orc"'), "sink.kind"),
    (('time_field = "event_time"', "time_field = 3"), "string"), (("[time]", "[time"), "."), (('out_dir = "OUT"', ""), "out_dir"), (('kind = "file"', 'kind = "kafka"'), "bootstrap_servers"),
])
def test_configurations_that_are_refused(change, message):
    text = toml("p").replace(*change)
    with pytest.raises(ConfigError, match=message):
        PipelineConfig.parse(text).validate()


def test_configurations_that_are_taken():
    PipelineConfig.parse(toml("p")).validate()
    kafka = toml("p", source='bootstrap_servers = "b:1"\ntopic = "t"\ngroup_id = "g"', sink='kind = "kafka"\nbootstrap_servers = "b:1"\ntopic = "o"').replace('kind = "file"', 'kind = "kafka"', 1)
    cfg = PipelineConfig.parse(kafka + "\n[extra]\n")
    cfg.validate()
    assert PipelineConfig.parse(toml("p", source="colour = 1")).ignored == ["source.colour"]


def test_jsonl_source(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"event_time":1704067200000,"text":"x"}\n{"event_time":"2024-01-01T00:00:00Z","text":"y"}\n')
    df = read_jsonl(spark, str(p), "event_time")
    assert [r[0] for r in df.select(F.unix_millis("event_time")).collect()] == [1704067200000] * 2
    p.write_text('{"event_time":1,"event_time":2}\n')
    assert read_jsonl(spark, str(p), "event_time").select(F.unix_millis("event_time")).first()[0] == 2
    for bad in ("", "{]", '{"a":1}}'):
        p.write_text(f'{{"event_time":1}}\n{bad}\n{{"event_time":2}}\n')
        with pytest.raises(Exception, match="not a JSON line"):
            read_jsonl(spark, str(p), "event_time").select("event_time").collect()


def test_csv_source(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('event_time,text\n5,"two\nlines, ""quoted"""\nx,\n')
    got = read_csv(spark, str(p), "event_time").select(F.unix_millis("event_time"), "text").collect()
    assert sorted(tuple(r) for r in got) == [(0, ""), (5, 'two\nlines, "quoted"')]
    p.write_text("event_time,text\n5,a\n6,b\n")
    assert read_csv(spark, str(p), "event_time", multi_line=False).count() == 2
    p.write_text("event_time,text\n5,a\n6,a,b\n")
    with pytest.raises(Exception):
        read_csv(spark, str(p), "event_time").collect()


def test_parquet_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1700000000000, n, "s") for n in range(3)], "ms long, n long, s string").select(F.timestamp_millis("ms").alias("event_time"), "n", "s")
    ParquetSink(str(tmp_path / "p"), ByDate(), max_rows=1, max_bytes=10).write(df)
    assert [p.name for p in (tmp_path / "p").glob("dt=*")] == ["dt=2023-11-14"]
    assert len(list((tmp_path / "p").rglob("part-*.parquet"))) == 3
    back = read_parquet(spark, str(tmp_path / "p"), "event_time")
    assert sorted(json.loads(r.payload)["n"] for r in back.collect()) == [0, 1, 2]
    ParquetSink(str(tmp_path / "q"), ByField("n")).write(df)
    assert sorted(p.name for p in (tmp_path / "q").glob("dt=*")) == ["dt=0", "dt=1", "dt=2"]
    shown = ParquetSink("", ByDate(field="n")).layout(df).select("dt").distinct().collect()
    assert [r.dt for r in shown] == [""]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_dates_of_partitions_are_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(1700000000000,)], "ms long").select(F.timestamp_millis("ms").alias("event_time"), "ms")
        plain = spark.sql("select timestamp_ntz'2023-11-14 22:13:20' as event_time, 1 as ms")
        assert [ParquetSink("", ByDate(fmt="%Y-%m-%dT%H:%M")).layout(d).first().dt for d in (df, plain)] == ["2023-11-14T22:13"] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_json_lines_drop_the_event_time(spark, tmp_path):
    df = spark.createDataFrame([(None, 2)], "b string, a int").withColumn("event_time", F.current_timestamp())
    write_json_lines(df, str(tmp_path / "l"))
    assert [p.read_text() for p in Path(tmp_path / "l").glob("part-*") if p.stat().st_size] == ['{"a":2,"b":null}\n']


def test_kafka_messages_in_and_out(spark):
    raw = [(b'{"event_time":5,"n":1}', "t", 0, 7), (b"hello", "t", 0, 8), (b'{"_offset":99,"event_time":"x"}', "t", 1, 9), (b"{}", "t", 1, 10), (None, "t", 1, 11)]
    df = spark.createDataFrame(raw, "value binary, topic string, partition int, offset long")
    got = decode_messages(df, "event_time").orderBy("_offset").collect()
    assert json.loads(got[0].payload) == {"event_time": 5, "n": 1, "_topic": "t", "_partition": 0, "_offset": 7}
    assert got[1].payload == '{"bytes":"hello"}' or json.loads(got[1].payload)["bytes"] == "hello"
    assert json.loads(got[2].payload)["_offset"] == 9 and got[2].payload.count("_offset") == 1
    assert json.loads(got[3].payload) == {"_topic": "t", "_partition": 1, "_offset": 10} and got[4].payload is None
    assert starting_offsets("earliest") == "earliest" and starting_offsets("none") == "latest"
    out = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "k string, v int").withColumn("event_time", F.current_timestamp())
    keys = messages(out, "k").collect()
    assert [r.key for r in keys] == ["a", None, None] and json.loads(keys[0].value) == {"k": "a", "v": 1}
    assert messages(out, "v").first().key is None


def test_fluent_pipeline(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "ms long, w string").select(F.timestamp_millis("ms").alias("event_time"), "w")
    seen = []
    Pipeline(spark).source(df).filter(F.col("w") == "a").key_by("w").window(Tumbling(10)).sink(lambda out: seen.extend(out.collect())).run()
    assert [(r.key, r["count"]) for r in seen] == [("a", 1)]
    with pytest.raises(ValueError, match="source"):
        Pipeline(spark).sink(print).run()
    with pytest.raises(ValueError, match="sink"):
        Pipeline(spark).source(df).run()


def test_rows_are_counted_as_they_pass(spark):
    df = spark.range(7).select(F.timestamp_millis("id").alias("event_time"), "id")
    m = Metrics()
    Pipeline(spark).source(df).measure(m, "in").filter(F.col("id") > 2).measure(m, "out").sink(lambda out: out.collect()).run()
    assert 'rows_total{operator="in"} 7' in m.render() and 'rows_total{operator="out"} 4' in m.render()


def test_examples(spark, tmp_path):
    import runpy

    p = tmp_path / "in.jsonl"
    p.write_text('{"event_time":0,"text":"A b a","device":"d","value":2}\n{"event_time":70000,"text":"a","device":"d","value":"4"}\n')
    counts = runpy.run_path("examples/wordcount.py")["counts"](spark, str(p)).collect()
    assert sorted((r.window_start_ms, r.key, r["count"]) for r in counts) == [(0, "a", 1), (0, "a", 2), (0, "b", 1), (60000, "a", 1)]
    averages = runpy.run_path("examples/sliding_avg.py")["averages"](spark, str(p)).collect()
    assert {r.window_start_ms: r.avg for r in averages}[0] == 3.0 and len(averages) == 6


def test_metrics_over_http():
    m = Metrics()
    m.add("tidemark_operator_rows_total", 3, operator="map")
    m.observe("tidemark_sink_latency_ms", 7, sink="file")
    server = serve(m, 0)
    text = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics", timeout=5).read().decode()
    server.shutdown()
    assert all(name in text for name in SERIES)
    assert 'tidemark_operator_rows_total{operator="map"} 3' in text
    assert 'tidemark_sink_latency_ms_bucket{sink="file",le="5"} 0' in text and 'tidemark_sink_latency_ms_bucket{sink="file",le="10"} 1' in text


def test_command_line(tmp_path, jsonl, spark, capsys, monkeypatch):
    from tidemark import __main__ as cli

    monkeypatch.setattr(cli, "build_session", lambda master: spark)
    cfg = tmp_path / "p.toml"
    cfg.write_text(toml(jsonl, sink='kind = "file"'))
    assert cli.main(["run", "--config", str(cfg), "--http-port", "0"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    cfg.write_text(toml(jsonl, ops=""))
    assert cli.main(["run", "--config", str(cfg)]) == 2
