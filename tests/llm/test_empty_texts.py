"""Every text query over tables without rows, and over tables in which all is null."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_no_rows(spark, tmp_path, name):
    for p in Path(DATA).glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), tmp_path / p.name)
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", queries.QUERIES)
def test_all_null(spark, tmp_path, name):
    for table in ("documents", "eval_items", "name_parts", "input_rows"):
        df = spark.read.parquet(f"{DATA}/{table}.parquet")
        nulls = df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        nulls.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == {"p8_ids": [(None, [])] * 3, "p8_counts": [(None, 3, 0)], "p10_redacted": [(None, None)] * 3}.get(name, [])
