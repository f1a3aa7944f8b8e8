"""Every query over tables without rows, and over tables in which all is null."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
CORE = {name: query for part in (entry.events, entry.preparation) for name, query in part.QUERIES.items()}


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for p in Path(DATA).glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), out / p.name)
    return str(out)


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("nulls")
    for p in Path(DATA).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).coalesce(1).write.parquet(str(out / p.name))
    return str(out)


@pytest.mark.parametrize("name", CORE)
def test_no_rows(spark, empty, name):
    got = CORE[name](spark, empty).collect()
    assert all(v is None for v in got[0]) if name == "end_of_input" else not got


@pytest.mark.parametrize("name", CORE)
def test_all_null(spark, nulls, name):
    CORE[name](spark, nulls).collect()
