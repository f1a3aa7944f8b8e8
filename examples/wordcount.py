"""python examples/wordcount.py LINES.jsonl: running count of each lower-cased word per minute, as JSON lines.

The input has event_time and text.
"""

import sys

from pyspark.sql import functions as F

from tidemark.functions.payload import member_text
from tidemark.operators.running import running_count
from tidemark.operators.transforms import split_words
from tidemark.plans.pipeline import Pipeline
from tidemark.session import build_session
from tidemark.sinks.files import write_json_lines
from tidemark.sources.files import read_jsonl


def words(spark, path):
    lines = read_jsonl(spark, path, "event_time")
    return Pipeline(spark).source(lines.withColumn("text", member_text(F.col("payload"), "text"))).apply(split_words, "text").key_by("word").frame


def counts(spark, path):
    found = words(spark, path)
    # One file is read in order, so the position of a row is the order in which it arrived.
    ordered = found.withColumn("arrival", F.monotonically_increasing_id())
    return running_count(ordered, "key", F.col("arrival")).select(F.timestamp_millis("event_ms").alias("event_time"), "window_start_ms", "key", "count")


if __name__ == "__main__":
    session = build_session(app="wordcount")
    write_json_lines(counts(session, sys.argv[1]), None)
