"""Stateless steps: mapping, filtering and keys. All work on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.payload import member_json, words
from tidemark.session import ship_package


def map_columns(df: DataFrame, columns: dict[str, Column], at: str = "event_time") -> DataFrame:
    """One row per row: the event time and the given columns, which replace all others."""
    return df.select(at, *[c.alias(n) for n, c in columns.items()])


def flat_map(df: DataFrame, items: Column, name: str, at: str = "event_time") -> DataFrame:
    """A row per element of an array column, with the row's event time; null and empty arrays give none."""
    return df.select(at, F.explode(items).alias(name))


def split_words(df: DataFrame, text: str, at: str = "event_time", name: str = "word") -> DataFrame:
    """A row per lower-cased word of a text column."""
    return flat_map(df, words(F.col(text)), name, at)


def map_python(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """0 to n rows per row, by a Python function over the row as a dict; batches pass through Arrow."""
    ship_package(df.sparkSession)
    names = T.StructType.fromDDL(schema).fieldNames()

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [out for row in part.to_dict("records") for out in fn(row)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(work, schema)


def filter_rows(df: DataFrame, keep: Column) -> DataFrame:
    """The rows for which ``keep`` is true; false and null drop a row."""
    return df.filter(keep)


def filter_python(df: DataFrame, keep: Callable[[dict], bool]) -> DataFrame:
    """The rows for which a Python function over the row as a dict is true; its errors end the run."""
    ship_package(df.sparkSession)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[bool(keep(row)) for row in part.to_dict("records")]]

    return df.mapInPandas(work, df.schema)


def key_by(df: DataFrame, field: str) -> DataFrame:
    """Copies a column to ``key``, over any column of that name; a missing column gives null. Nothing is moved."""
    return df.withColumn("key", F.col(f"`{field}`") if field in df.columns else F.lit(None).cast("string"))


def key_by_payload(df: DataFrame, field: str, payload: str = "payload") -> DataFrame:
    """``key`` from a member of a JSON payload, as JSON text, so that numbers and strings stay apart."""
    return df.withColumn("key", member_json(F.col(payload), field))
