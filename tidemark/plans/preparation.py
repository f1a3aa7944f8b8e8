"""Queries of the data preparation operators over the test tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import clean_path, epoch_ms, floor_div, usable_ms, word_key
from tidemark.operators import archive, dedup, late, rejects, skew
from tidemark.operators.sessionize import sessionize
from tidemark.session import table

GAP_MS = 30_000
CUTOFF_MS = 10_000
PERIOD_MS = 60_000
HOUR_MS = 3_600_000


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "input_rows")
    return sessionize(rows, {"word": word_key(F.col("word"))}, usable_ms(rows, "event_time"), GAP_MS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(
        "word", F.col("first_ms").alias("window_start_ms"), (F.col("last_ms") + GAP_MS).alias("window_end_ms")
    )


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))


def p1_user_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "input_rows")
    out = sessionize(rows, {"user_id": F.col("user_id")}, usable_ms(rows, "event_time"), GAP_MS)
    return out.withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    judged = late.judged(late.messages(table(spark, d, "kafka_records")), CUTOFF_MS, period_ms=PERIOD_MS, only_beyond=True)
    return judged.filter("beyond").select(F.col("topic").alias("_topic"), F.col("part").alias("_partition"), F.col("off").alias("_offset"))


def p2_triangle(spark: SparkSession, d: str) -> DataFrame:
    """The cells of event minute by arrival of a thousand offsets, with what each corrects."""
    out = late.triangle(late.messages(table(spark, d, "kafka_records")), CUTOFF_MS, block=1000, period_ms=PERIOD_MS)
    return out.select("topic", "part", "arrival", "period_start_ms", "added", "total", "all_beyond", "none_beyond")


def p2_revisions(spark: SparkSession, d: str) -> DataFrame:
    return late.revisions(late.judged(late.messages(table(spark, d, "kafka_records")), CUTOFF_MS, period_ms=PERIOD_MS), PERIOD_MS, PERIOD_MS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "input_rows"), word_key(F.col("word")), 50, "word").select("word")


def _word_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "input_rows")
    return skew.key_states(rows, {"word": word_key(F.col("word"))}, F.col("x"), usable_ms(rows, "event_time"))


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    return _word_states(spark, d).select("word", "n", "first_ms", "last_ms", F.round("total", 2).alias("sum_x"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a word joined with all rows of the same word: per word, pairs and sums over them."""
    out = skew.eager_join_aggregate(_word_states(spark, d), _word_states(spark, d), ["word"], ["word"])
    return out.select("word", "pairs", F.round("left_total", 2).alias("left_x"), F.round("right_total", 2).alias("right_x"), "first_ms", "last_ms")


def _ids() -> dict:
    from tidemark.functions.columns import json_member, json_whole

    payload = F.col("payload")
    return {
        "_topic": F.coalesce(F.col("_topic"), json_member(payload, "_topic")),
        "_partition": F.coalesce(F.col("_partition"), json_whole(payload, "_partition", "int")),
        "_offset": F.coalesce(F.col("_offset"), json_whole(payload, "_offset", "bigint")),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kafka_records")
    return dedup.redelivered(rows, _ids(), epoch_ms(rows, "received_at"), HOUR_MS)


def p4_once(spark: SparkSession, d: str) -> DataFrame:
    """One row per identifier, the first received."""
    rows = table(spark, d, "kafka_records")
    order = [F.col("received_at"), F.col("batch_id"), F.col("payload")]
    out = dedup.deduplicate(rows, _ids(), epoch_ms(rows, "received_at"), order, HOUR_MS, ["batch_id", "received_at"])
    return out.select("_topic", "_partition", "_offset", "batch_id", epoch_ms(out, "received_at").alias("received_ms"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "raw_lines"), ["raw_id"]).select("raw_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(table(spark, d, "raw_lines"), ["raw_id"])


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return archive.pack(archive.small_files(table(spark, d, "sink_files")), table(spark, d, "sink_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the archive's index holds."""
    return archive.index(_blocks(spark, d)).filter("part = 0").select("path")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """The records of all small files, read back from the containers they were packed into."""
    return archive.unpack(_blocks(spark, d))


def p7_index(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold of each file."""
    return archive.index(_blocks(spark, d)).groupBy("dir", "path").agg(F.sum("records").alias("records"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_sessions, p1_user_sessions, p2_found, p2_triangle, p2_revisions, p3_found, p3_keys, p3_pairs, p4_found, p4_once,
    p5_found, p5_loaded, p7_found, p7_restored, p7_index,
)}

_WORD = "nullif(lower(trim(word, E' \\t\\r\\n')), '')"
_MS = "(epoch_us(event_time) - ((epoch_us(event_time) % 1000) + 1000) % 1000) // 1000"
_USABLE = f"CASE WHEN epoch_us(event_time) <> 0 THEN {_MS} END"


def _session_sql(key: str, name: str) -> str:
    return f"""
    WITH r AS (SELECT {key} AS k, {_USABLE} AS ms FROM input_rows),
    f AS (SELECT k, ms, CASE WHEN ms - lag(ms) OVER w > {GAP_MS} OR lag(ms) OVER w IS NULL THEN 1 ELSE 0 END AS new
          FROM r WHERE k IS NOT NULL AND ms IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY ms)),
    s AS (SELECT k, ms, sum(new) OVER (PARTITION BY k ORDER BY ms ROWS UNBOUNDED PRECEDING) AS no FROM f),
    {name} AS (SELECT k, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n_rows FROM s GROUP BY k, no)
    """


def _whole(name: str, kind: str) -> str:
    text = f"json_extract_string(CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END, '$.{name}')"
    return f"coalesce({name}, TRY_CAST(CASE WHEN regexp_full_match({text}, '-?[0-9]+') THEN {text} END AS {kind}))"


_TOPIC = "coalesce(_topic, json_extract_string(CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END, '$._topic'))"
_MESSAGES = f"""
    m AS (SELECT {_TOPIC} AS t, {_whole('_partition', 'INTEGER')} AS p, {_whole('_offset', 'BIGINT')} AS o,
                 {_USABLE} AS ms, epoch_us(received_at) // 1000 AS rms, batch_id, received_at, payload FROM kafka_records),
    ids AS (SELECT * FROM m WHERE t IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)
"""
_LATE = f"""
    {_MESSAGES},
    once AS (SELECT t, p, o, min(ms) AS ms, min(rms) AS rms FROM ids WHERE ms IS NOT NULL GROUP BY t, p, o),
    j AS (SELECT *, coalesce(max(ms) OVER (PARTITION BY t, p ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ms > {CUTOFF_MS}, false) AS beyond FROM once)
"""
_CLEAN = "regexp_replace(regexp_replace(regexp_replace({0}, '/+', '/', 'g'), '^(\\./)+', ''), '/(\\./)+', '/', 'g')"
_SMALL = f"""
    l AS (SELECT {_CLEAN.format('path')} AS path, closed_at, approx_bytes, row_number() OVER (PARTITION BY {_CLEAN.format('path')} ORDER BY listed_at DESC, listing_id DESC) AS rn
          FROM sink_files WHERE path IS NOT NULL),
    c AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM l WHERE rn = 1 AND closed_at IS NOT NULL AND approx_bytes < 4096),
    small AS (SELECT path, dir FROM c WHERE dir IN (SELECT dir FROM c GROUP BY dir HAVING count(*) > 1))
"""
_RECORDS = f"r AS (SELECT record_id, {_CLEAN.format('path')} AS path, epoch_us(event_time) AS event_us, payload FROM sink_records)"

_F = '("(?:[^"]|"")*"|[^",]*)'
_END = 4_102_444_800_000
_READ = f"""
    k AS (SELECT raw_id, line, lower(trim(format, ' ')) AS kind FROM raw_lines),
    c AS (SELECT *, kind = 'csv' AS csv, kind = 'jsonl' AND json_valid(line) AND NOT regexp_matches(line, ',[ ]*[}}\\]]') AND json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT' AS obj,
                 regexp_full_match(line, '(?s){_F}(,{_F})*') AS quoted, regexp_full_match(line, '(?s){_F},{_F},{_F},{_F}') AS four FROM k),
    f AS (SELECT *, [CASE WHEN starts_with(q, '"') THEN replace(q[2:-2], '""', '"') ELSE q END
                     FOR q IN [{', '.join(f"regexp_extract(line, '(?s)^{_F},{_F},{_F},{_F}$', {i})" for i in (1, 2, 3, 4))}]] AS v FROM
          (SELECT *, CASE WHEN obj THEN line END AS j FROM c)),
    t AS (SELECT *, CASE WHEN csv AND regexp_full_match(v[1], '[+-]?[0-9]+') THEN TRY_CAST(v[1] AS BIGINT)
                         WHEN obj AND json_type(j, '$.event_time') IN ('BIGINT', 'UBIGINT') THEN TRY_CAST(json_extract_string(j, '$.event_time') AS BIGINT)
                         WHEN obj AND json_type(j, '$.event_time') = 'VARCHAR' AND regexp_full_match(json_extract_string(j, '$.event_time'),
                              '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ]([01][0-9]|2[0-3]):[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?([Zz]|[+-][0-9]{{2}}:[0-9]{{2}})')
                         THEN epoch_us(TRY_CAST(json_extract_string(j, '$.event_time') AS TIMESTAMPTZ)) // 1000 END AS ms FROM f),
    r AS (SELECT *, CASE WHEN kind IS NULL OR kind NOT IN ('csv', 'jsonl') THEN 'format'
                         WHEN csv AND NOT quoted THEN 'quoting' WHEN csv AND NOT four THEN 'columns' WHEN NOT csv AND NOT obj THEN 'json'
                         WHEN ms IS NULL OR ms < 0 OR ms >= {_END} THEN 'event_time'
                         WHEN csv AND v[3] <> '' AND NOT regexp_full_match(v[3], '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'x'
                         WHEN NOT csv AND json_type(j, '$.x') NOT IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'x' END AS reason FROM t)
"""

ORACLES = {
    "p5_found": f"WITH {_READ} SELECT raw_id, reason FROM r WHERE reason IS NOT NULL",
    "p5_loaded": f"""WITH {_READ} SELECT raw_id, ms AS event_ms, CASE WHEN csv THEN v[2] ELSE json_extract_string(j, '$.word') END AS word,
        TRY_CAST(CASE WHEN csv THEN v[3] ELSE json_extract_string(j, '$.x') END AS DOUBLE) AS x,
        CASE WHEN csv THEN v[4] ELSE json_extract_string(j, '$.user_id') END AS user_id FROM r WHERE reason IS NULL""",
    "p1_found": f"{_session_sql(_WORD, 'x')} SELECT k AS word, first_ms AS window_start_ms, last_ms + {GAP_MS} AS window_end_ms FROM x",
    "p1_sessions": f"{_session_sql(_WORD, 'x')} SELECT k AS word, first_ms, last_ms, n_rows, last_ms - first_ms AS duration_ms FROM x",
    "p1_user_sessions": f"{_session_sql('user_id', 'x')} SELECT k AS user_id, first_ms, last_ms, n_rows, last_ms - first_ms AS duration_ms FROM x",
    "p2_found": f"WITH {_LATE} SELECT t AS _topic, p AS _partition, o AS _offset FROM j WHERE beyond",
    "p2_revisions": f"""WITH {_LATE},
        c AS (SELECT t, ms - ((ms % {PERIOD_MS}) + {PERIOD_MS}) % {PERIOD_MS} AS s, rms - rms % {PERIOD_MS} AS a, count(*) AS n, max(ms) AS hi
              FROM j WHERE NOT beyond AND rms IS NOT NULL GROUP BY 1, 2, 3)
        SELECT t AS topic, s AS period_start_ms, a AS arrival_start_ms, row_number() OVER w AS revision, n AS added,
               CAST(sum(n) OVER w AS BIGINT) AS total, max(hi) OVER w AS latest_ms
        FROM c WINDOW w AS (PARTITION BY t, s ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "p2_triangle": f"""WITH {_LATE},
        c AS (SELECT t, p, CAST(floor(o / 1000) AS BIGINT) AS a, ms - ((ms % {PERIOD_MS}) + {PERIOD_MS}) % {PERIOD_MS} AS s, count(*) AS n, min(ms) AS lo, max(ms) AS hi FROM once GROUP BY 1, 2, 3, 4),
        b AS (SELECT t, p, a, max(hi) AS top FROM c GROUP BY t, p, a),
        d AS (SELECT *, max(top) OVER (PARTITION BY t, p ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carry FROM b)
        SELECT t AS topic, p AS part, a AS arrival, s AS period_start_ms, n AS added,
               CAST(sum(n) OVER (PARTITION BY t, p, s ORDER BY a ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total,
               coalesce(hi < carry - {CUTOFF_MS}, false) AS all_beyond, lo >= greatest(top, coalesce(carry, top)) - {CUTOFF_MS} AS none_beyond
        FROM c JOIN d USING (t, p, a)""",
    "p3_found": f"SELECT {_WORD} AS word FROM input_rows WHERE {_WORD} IS NOT NULL GROUP BY 1 HAVING count(*) * 50 >= (SELECT count(*) FROM input_rows)",
    "p3_keys": f"""SELECT {_WORD} AS word, count(*) AS n, min({_USABLE}) AS first_ms, max({_USABLE}) AS last_ms, round(sum(x), 2) AS sum_x
        FROM input_rows WHERE {_WORD} IS NOT NULL GROUP BY 1""",
    "p3_pairs": f"""WITH r AS (SELECT {_WORD} AS word, x, user_id, {_USABLE} AS ms FROM input_rows)
        SELECT a.word, count(*) AS pairs, round(sum(a.x), 2) AS left_x, round(sum(b.x), 2) AS right_x, min(a.ms) AS first_ms, max(a.ms) AS last_ms
        FROM r a JOIN r b ON a.word = b.word GROUP BY a.word""",
    "p4_found": f"WITH {_MESSAGES} SELECT t AS _topic, p AS _partition, o AS _offset FROM ids GROUP BY t, p, o HAVING count(*) > 1",
    "p4_once": f"""WITH {_MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY t, p, o ORDER BY received_at, batch_id, payload) AS rn FROM ids)
        SELECT t AS _topic, p AS _partition, o AS _offset, batch_id, rms AS received_ms FROM n WHERE rn = 1""",
    "p7_found": f"WITH {_SMALL} SELECT path FROM small",
    "p7_restored": f"WITH {_SMALL}, {_RECORDS} SELECT r.* FROM r JOIN small USING (path)",
    "p7_index": f"WITH {_SMALL}, {_RECORDS} SELECT dir, path, count(record_id) AS records FROM small LEFT JOIN r USING (path) GROUP BY dir, path",
}
