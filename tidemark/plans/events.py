"""Queries of the windowing operators over the test tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import epoch_ms
from tidemark.functions.payload import decode_bytes, json_event_time, member_text, text_number
from tidemark.operators import arrival, fold, running, transforms, watermark
from tidemark.operators.windows import Session, Sliding, Tumbling, bucket_start, windowed_aggregate
from tidemark.plans.pipeline import Pipeline
from tidemark.session import new_folder, table
from tidemark.sinks.files import ByDate, ByField, ParquetSink, write_json_lines
from tidemark.sources.files import read_csv, read_jsonl
from tidemark.sources.kafka import decode_messages

HOUR, MINUTE = 3_600_000, 60_000
WINDOWS = {"tumbling": Tumbling(HOUR), "sliding": Sliding(HOUR, HOUR // 4), "session": Session(10 * MINUTE)}
FIELDS = {"count": None, "sum": "value", "avg": "value", "distinct": "user_id"}
ROUNDED = {"sum": "sum", "avg": "avg"}


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumnRenamed("ts", "event_time")


def _shown(df: DataFrame, agg: str) -> DataFrame:
    return df.withColumn(agg, F.round(agg, 6)) if agg in ROUNDED else df


def _windowed(kind: str, agg: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _shown(windowed_aggregate(_events(spark, d), WINDOWS[kind], "event_type", agg, FIELDS[agg]), agg)

    return query


def sliding_nondivisible(spark: SparkSession, d: str) -> DataFrame:
    return windowed_aggregate(_events(spark, d), Sliding(HOUR, 25 * MINUTE), "event_type")


def sliding_slide_gt_size(spark: SparkSession, d: str) -> DataFrame:
    return windowed_aggregate(_events(spark, d), Sliding(HOUR, 2 * HOUR), "event_type")


def running_count(spark: SparkSession, d: str) -> DataFrame:
    out = running.running_count(_events(spark, d), "event_type", F.col("event_id"), size_ms=HOUR)
    return out.select("arrival", "window_start_ms", "key", "count")


def map_explode_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("event_time", F.col("committed_at"))
    return transforms.split_words(docs, "text").groupBy("word").agg(F.count("*").alias("n"))


def filter_pred(spark: SparkSession, d: str) -> DataFrame:
    return transforms.filter_rows(_events(spark, d), (F.col("value") > 50) & (F.col("event_type") == "purchase")).select("event_id", "user_id", "value")


def key_by(spark: SparkSession, d: str) -> DataFrame:
    return transforms.key_by(_events(spark, d), "event_type").select("event_id", "key")


def wordcount_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Words of the rows that have a time, with their final count per hour: split, key, count. The count at every row is wordcount_running."""
    rows = table(spark, d, "input_rows").filter(F.col("event_time").isNotNull()).select("event_time", F.col("word").alias("text"))
    words = Pipeline(spark).source(rows).apply(transforms.split_words, "text").key_by("word").frame
    return words.withColumn("ms", bucket_start(epoch_ms(words, "event_time"), HOUR)).groupBy(F.col("ms").alias("window_start_ms"), "key").agg(F.count("*").alias("count"))


def wordcount_running(spark: SparkSession, d: str) -> DataFrame:
    """Words of the arriving rows, each with its count in the hour so far: split, key, count at every row."""
    rows = table(spark, d, "input_rows").select(F.col("arrived_at").alias("event_time"), F.col("word").alias("text"))
    words = Pipeline(spark).source(rows).apply(transforms.split_words, "text").key_by("word").frame
    # Rows are stored as they arrived; within one of them the words count from left to right.
    out = running.running_count(words.withColumn("arrival", F.monotonically_increasing_id()), "key", F.col("arrival"), size_ms=HOUR)
    return out.select("event_ms", "window_start_ms", "key", "count")


def sliding_avg_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Average value per user over five minutes, every minute."""
    frame = Pipeline(spark).source(_events(spark, d)).key_by("user_id").window(Sliding(5 * MINUTE, MINUTE), agg="avg", field="value").frame
    return _shown(frame, "avg")


def json_field_agg(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("k", text_number(member_text(F.col("props"), "k")))
    return _shown(windowed_aggregate(rows, Tumbling(HOUR), "event_type", "sum", "k"), "sum")


def null_as_zero_avg(spark: SparkSession, d: str) -> DataFrame:
    return _shown(windowed_aggregate(table(spark, d, "input_rows"), Tumbling(HOUR), "user_id", "avg", "x"), "avg")


def distinct_with_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "input_rows").select("event_time", "user_id", F.lit("all").alias("k"))
    return windowed_aggregate(rows, Tumbling(HOUR), "k", "distinct", "user_id")


def late_drop_record(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    order = (F.col("event_id") - F.col("event_id") % 64) + (63 - F.col("event_id") % 64)
    return watermark.on_time(rows, order, lateness_ms=2 * HOUR).select("event_id")


def watermark_running(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    order = (F.col("event_id") - F.col("event_id") % 64) + (63 - F.col("event_id") % 64)
    return watermark.with_watermark_ms(rows, order, lateness_ms=MINUTE).select("event_id", "watermark_ms")


def end_of_input(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    marks = watermark.end_watermark(rows)
    return marks.select(epoch_ms(marks, "watermark").alias("watermark_ms"))


def fold_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    out = fold.fold(rows, Tumbling(HOUR), F.lit(0.0), lambda acc, v: acc + v, "value", "event_id")
    return out.withColumn("state", F.round("state", 6))


def fold_merge_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = fold.fold_merge(_events(spark, d), Sliding(HOUR, HOUR // 4), F.sum("value"))
    return out.withColumn("state", F.round("state", 6))


def parquet_sink_layout(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_time", "event_id", "user_id")
    out = ParquetSink("unused", ByDate(fmt="%Y-%m-%dT%H")).layout(rows)
    return out.select("payload", "dt")


def parquet_field_layout(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_time", F.col("props").alias("payload"))
    return ParquetSink("unused", ByField("k")).layout(rows).groupBy("dt").agg(F.count("*").alias("n"))


def kafka_payload_time(spark: SparkSession, d: str) -> DataFrame:
    """The event time that the payloads give, by whole numbers, RFC 3339 texts, or the epoch."""
    return table(spark, d, "kafka_records").select("batch_id", "payload", F.unix_millis(json_event_time(F.col("payload"), "event_time")).alias("event_ms"))


def kafka_decode(spark: SparkSession, d: str) -> DataFrame:
    """Each record's payload as a message of text, and behind four bytes that are no text; what the decoded payloads hold."""
    value = F.encode(F.col("payload"), "UTF-8")
    rows = table(spark, d, "kafka_records").select(
        F.explode(F.array(value, F.concat(F.unhex(F.lit("009F9296")), value))).alias("value"),
        F.col("_topic").alias("topic"), F.col("_partition").alias("partition"), F.col("_offset").alias("offset"),
    )
    out = decode_messages(rows, "event_time")
    held = {n: member_text(F.col("payload"), n) for n in ("bytes", "bytes_b64", "_topic", "_partition", "_offset")}
    return out.select(
        F.unix_millis("event_time").alias("event_ms"), "_topic", "_partition", "_offset", held["bytes"].alias("bytes"), F.regexp_replace(held["bytes_b64"], r"\s", "").alias("bytes_b64"),
        held["_topic"].alias("held_topic"), held["_partition"].alias("held_partition"), held["_offset"].alias("held_offset"),
    )


def payload_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of any kind as message bytes: JSON as it is, all else wrapped."""
    rows = table(spark, d, "raw_lines").select("raw_id", decode_bytes(F.encode(F.col("line"), "UTF-8")).alias("payload"))
    wrapped = F.get_json_object("payload", "$.bytes")
    return rows.select("raw_id", wrapped.isNotNull().alias("wrapped"), wrapped.alias("bytes"))


def _folder(spark: SparkSession, d: str, name: str, write) -> str:
    """A new folder that ``write`` has filled, in the shared folder of the session."""
    path = new_folder(spark, name)
    write(path)
    return path


def jsonl_source(spark: SparkSession, d: str) -> DataFrame:
    """The events written as JSON lines by the sink, and read back by the source."""
    rows = _events(spark, d).select("event_time", "event_id", "value", "props", epoch_ms(_events(spark, d), "event_time").alias("at"))
    path = _folder(spark, d, "jsonl", lambda p: write_json_lines(rows, p))
    out = read_jsonl(spark, path, "at")
    return out.select(*[member_text(F.col("payload"), n).alias(n) for n in ("event_id", "props")], F.unix_millis("event_time").alias("event_ms"))


def csv_source(spark: SparkSession, d: str) -> DataFrame:
    """The events as CSV with a header, and read back by the source."""
    rows = _events(spark, d).select("event_id", "event_type", "props", epoch_ms(_events(spark, d), "event_time").alias("at"))
    path = _folder(spark, d, "csv", lambda p: rows.write.option("header", True).option("escape", '"').csv(p))
    return read_csv(spark, path, "at").select("event_id", "event_type", "props", F.unix_millis("event_time").alias("event_ms"))


def parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    """The events written by the Parquet sink, by day, and read back."""
    rows = _events(spark, d).select("event_time", "event_id", "user_id")
    path = _folder(spark, d, "parquet", lambda p: ParquetSink(p, max_rows=1000, codec="zstd").write(rows))
    back = spark.read.schema("event_time timestamp_ntz, payload string, dt string").parquet(path)
    return back.select("payload", "dt", epoch_ms(back, "event_time").alias("event_ms"))


def arrival_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("event_time", F.col("ts"))
    return arrival.arrival_sessions(rows, 10 * MINUTE, "event_type", F.col("event_id"), block=1000)


def arrival_sessions_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """The same with rows that arrive out of order."""
    rows = table(spark, d, "events").withColumn("event_time", F.col("ts"))
    order = F.col("event_id") - F.col("event_id") % 8 + (7 - F.col("event_id") % 8)
    return arrival.arrival_sessions(rows, 10 * MINUTE, "event_type", order, block=1000)


def lineitem_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Quantity per return flag in windows of thirty days."""
    rows = table(spark, d, "lineitem").withColumn("event_time", F.col("l_shipdate"))
    return _shown(windowed_aggregate(rows, Tumbling(30 * 24 * HOUR), "l_returnflag", "sum", "l_quantity"), "sum")


def orders_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Orders per priority in the last thirty days, every day."""
    rows = table(spark, d, "orders").withColumn("event_time", F.col("o_orderdate"))
    return windowed_aggregate(rows, Sliding(30 * 24 * HOUR, 24 * HOUR), "o_orderpriority")


QUERIES = {f"{kind}_{agg}": _windowed(kind, agg) for kind in WINDOWS for agg in FIELDS} | {f.__name__: f for f in (
    sliding_nondivisible, sliding_slide_gt_size, running_count, map_explode_words, filter_pred, key_by, wordcount_pipeline, wordcount_running,
    sliding_avg_pipeline, json_field_agg, null_as_zero_avg, distinct_with_null, watermark_running, late_drop_record,
    end_of_input, fold_sum, fold_merge_sliding, parquet_sink_layout, parquet_field_layout, kafka_payload_time, kafka_decode,
    payload_bytes, jsonl_source, csv_source, parquet_sink, arrival_sessions, arrival_sessions_shuffled, lineitem_monthly, orders_sliding,
)}

_MS = "(epoch_us({0}) // 1000)"
_AGG = {"count": "count(*) AS count", "sum": "round(sum({0}), 6) AS sum", "avg": "round(avg({0}), 6) AS avg", "distinct": "count(DISTINCT {0}) AS distinct_count"}


def _tumbling(size: int, key: str, agg: str, rows: str = "events", at: str = "ts") -> str:
    start = f"{_MS.format(at)} // {size} * {size}"
    return f"SELECT {start} AS window_start_ms, {start} + {size} AS window_end_ms, {key} AS key, {agg} FROM {rows} GROUP BY 1, 2, 3"


def _sliding(size: int, slide: int, key: str, agg: str, rows: str = "events", at: str = "ts") -> str:
    return f"""WITH r AS (SELECT *, {_MS.format(at)} AS ms FROM {rows}),
        w AS (SELECT r.*, ms // {slide} * {slide} - j * {slide} AS s FROM r, range({size // slide}) t(j))
        SELECT s AS window_start_ms, s + {size} AS window_end_ms, {key} AS key, {agg} FROM w WHERE s <= ms AND ms < s + {size} GROUP BY 1, 2, 3"""


def _session(gap: int, key: str, agg: str) -> str:
    return f"""WITH r AS (SELECT *, {_MS.format('ts')} AS ms FROM events),
        f AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= {gap} THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY {key} ORDER BY ms)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY ms ROWS UNBOUNDED PRECEDING) AS no FROM f)
        SELECT min(ms) AS window_start_ms, max(ms) + {gap} AS window_end_ms, {key} AS key, {agg} FROM s GROUP BY {key}, no"""


def _windowed_sql(kind: str, agg: str) -> str:
    shown = _AGG[agg].format(FIELDS[agg])
    if kind == "tumbling":
        return _tumbling(HOUR, "event_type", shown)
    if kind == "sliding":
        return _sliding(HOUR, HOUR // 4, "event_type", shown)
    return _session(10 * MINUTE, "event_type", shown)


_ORDER = "(event_id - event_id % 64) + (63 - event_id % 64)"
_JSON_TIME = """CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN
    CASE WHEN json_type(payload, '$.event_time') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(json_extract_string(payload, '$.event_time') AS BIGINT)
         WHEN json_type(payload, '$.event_time') = 'VARCHAR'
              AND regexp_full_match(json_extract_string(payload, '$.event_time'), '[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})')
         THEN epoch_us(TRY_CAST(json_extract_string(payload, '$.event_time') AS TIMESTAMPTZ)) // 1000 END END"""
_TIMED = "(SELECT * FROM input_rows WHERE event_time IS NOT NULL)"
_VALID = "(json_valid(line) AND NOT regexp_matches(line, ',[ ]*[}\\]]'))"
_SPACE = "[ \\t\\n\\r\\f\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"



def _arrival(order: str) -> str:
    return f"""WITH r AS (SELECT event_type AS key, {order} AS o, {_MS.format('ts')} AS ms FROM events),
        f AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= {10 * MINUTE} THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY key ORDER BY o)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY o ROWS UNBOUNDED PRECEDING) AS no FROM f)
        SELECT arg_min(ms, o) AS window_start_ms, arg_max(ms, o) + {10 * MINUTE} AS window_end_ms, key, count(*) AS count FROM s GROUP BY key, no"""


ORACLES = {f"{kind}_{agg}": _windowed_sql(kind, agg) for kind in WINDOWS for agg in FIELDS} | {
    "sliding_nondivisible": _sliding(HOUR, 25 * MINUTE, "event_type", "count(*) AS count"),
    "sliding_slide_gt_size": _sliding(HOUR, 2 * HOUR, "event_type", "count(*) AS count"),
    "running_count": f"""SELECT event_id AS arrival, {_MS.format('ts')} // {HOUR} * {HOUR} AS window_start_ms, event_type AS key,
        count(*) OVER (PARTITION BY {_MS.format('ts')} // {HOUR}, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS count FROM events""",
    "map_explode_words": f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '{_SPACE}')) AS word FROM documents WHERE text IS NOT NULL)
        WHERE word <> '' GROUP BY word""",
    "filter_pred": "SELECT event_id, user_id, value FROM events WHERE value > 50 AND event_type = 'purchase'",
    "key_by": "SELECT event_id, event_type AS key FROM events",
    "wordcount_pipeline": f"""SELECT {_MS.format('event_time')} // {HOUR} * {HOUR} AS window_start_ms, key, count(*) AS count
        FROM (SELECT event_time, unnest(string_split_regex(lower(word), '{_SPACE}')) AS key FROM input_rows WHERE event_time IS NOT NULL) WHERE key <> '' GROUP BY 1, 2""",
    "sliding_avg_pipeline": _sliding(5 * MINUTE, MINUTE, "user_id", "round(avg(value), 6) AS avg"),
    "json_field_agg": _tumbling(HOUR, "event_type", "round(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)), 6) AS sum"),
    "null_as_zero_avg": _tumbling(HOUR, "user_id", "round(avg(coalesce(x, 0)), 6) AS avg", _TIMED, "event_time"),
    "distinct_with_null": _tumbling(HOUR, "'all'", "count(DISTINCT coalesce(user_id, 'null')) AS distinct_count", _TIMED, "event_time"),
    "watermark_running": f"SELECT event_id, max({_MS.format('ts')}) OVER (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) - {MINUTE} AS watermark_ms FROM events",
    "late_drop_record": f"""SELECT event_id FROM (SELECT event_id, {_MS.format('ts')} AS ms,
        max({_MS.format('ts')}) OVER (ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {2 * HOUR} AS prior FROM events) WHERE prior IS NULL OR ms >= prior""",
    "end_of_input": f"SELECT max({_MS.format('ts')}) + {36_500 * 24 * HOUR} AS watermark_ms FROM events",
    "fold_sum": f"SELECT {_MS.format('ts')} // {HOUR} * {HOUR} AS window_start_ms, {_MS.format('ts')} // {HOUR} * {HOUR} + {HOUR} AS window_end_ms, round(sum(value), 6) AS state FROM events GROUP BY 1, 2",
    "fold_merge_sliding": f"SELECT window_start_ms, window_end_ms, state FROM ({_sliding(HOUR, HOUR // 4, '0', 'round(sum(value), 6) AS state')})",
    "parquet_sink_layout": """SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS payload, strftime(ts, '%Y-%m-%dT%H') AS dt FROM events""",
    "parquet_field_layout": "SELECT coalesce(json_extract_string(props, '$.k'), '') AS dt, count(*) AS n FROM events GROUP BY 1",
    "kafka_payload_time": f"SELECT batch_id, payload, coalesce({_JSON_TIME}, 0) AS event_ms FROM kafka_records",
    "kafka_decode": f"""WITH r AS (SELECT *, {_VALID} AS valid FROM (SELECT *, payload AS line FROM kafka_records)), o AS (SELECT *, valid AND json_type(CASE WHEN valid THEN payload END) = 'OBJECT' AS obj FROM r)
        SELECT coalesce({_JSON_TIME}, 0) AS event_ms, _topic, _partition, _offset, CASE WHEN NOT valid THEN payload WHEN obj THEN json_extract_string(payload, '$.bytes') END AS bytes, CASE WHEN obj THEN json_extract_string(payload, '$.bytes_b64') END AS bytes_b64,
               CASE WHEN payload IS NOT NULL AND coalesce(obj, true) AND valid THEN _topic END AS held_topic, CASE WHEN obj THEN CAST(_partition AS VARCHAR) END AS held_partition,
               CASE WHEN obj THEN CAST(_offset AS VARCHAR) END AS held_offset FROM o
        UNION ALL SELECT 0, _topic, _partition, _offset, NULL, to_base64('\\x00\\x9F\\x92\\x96'::BLOB || encode(payload)), CASE WHEN payload IS NOT NULL THEN _topic END,
               CASE WHEN payload IS NOT NULL THEN CAST(_partition AS VARCHAR) END, CASE WHEN payload IS NOT NULL THEN CAST(_offset AS VARCHAR) END FROM kafka_records""",
    "payload_bytes": f"SELECT raw_id, NOT {_VALID} AS wrapped, CASE WHEN NOT {_VALID} THEN line END AS bytes FROM raw_lines",
    "jsonl_source": f"SELECT CAST(event_id AS VARCHAR) AS event_id, props, {_MS.format('ts')} AS event_ms FROM events",
    "csv_source": f"SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props, {_MS.format('ts')} AS event_ms FROM events",
    "parquet_sink": f"""SELECT '{{"event_id":' || event_id || ',"user_id":' || user_id || '}}' AS payload, strftime(ts, '%Y-%m-%d') AS dt, {_MS.format('ts')} AS event_ms FROM events""",
    "arrival_sessions": _arrival("event_id"),
    "arrival_sessions_shuffled": _arrival("(event_id - event_id % 8 + (7 - event_id % 8))"),
    "lineitem_monthly": _tumbling(30 * 24 * HOUR, "l_returnflag", "round(sum(l_quantity), 6) AS sum", "lineitem", "l_shipdate"),
    "orders_sliding": _sliding(30 * 24 * HOUR, 24 * HOUR, "o_orderpriority", "count(*) AS count", "orders", "o_orderdate"),
}
