"""python examples/sliding_avg.py LINES.jsonl: average value per device over five minutes, every minute, as JSON lines.

The input has event_time, device and value.
"""

import sys

from pyspark.sql import functions as F

from tidemark.functions.payload import member_text, text_number
from tidemark.operators.windows import Sliding
from tidemark.plans.pipeline import Pipeline
from tidemark.session import build_session
from tidemark.sinks.files import write_json_lines
from tidemark.sources.files import read_jsonl


def averages(spark, path):
    lines = read_jsonl(spark, path, "event_time")
    typed = lines.select("event_time", member_text(F.col("payload"), "device").alias("device"), text_number(member_text(F.col("payload"), "value")).alias("value"))
    return Pipeline(spark).source(typed).key_by("device").window(Sliding(300_000, 60_000), agg="avg", field="value").frame


if __name__ == "__main__":
    session = build_session(app="sliding_avg")
    write_json_lines(averages(session, sys.argv[1]), None)
