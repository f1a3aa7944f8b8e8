"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ends of words lose (fixed values).
EDGE_SPACE = " \t\r\n"


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, whatever the session's zone; nulls stay null."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    raise TypeError(f"{name} is {kind.simpleString()}, not a timestamp")


def floor_div(col: Column, by: int) -> Column:
    """Whole-number quotient rounded down, for negative numbers too."""
    step = F.lit(by).cast("bigint")
    return F.call_function("div", col - F.pmod(col, step), step)


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970, rounded down."""
    return floor_div(epoch_us(df, name), 1000)


def usable_ms(df: DataFrame, name: str) -> Column:
    """``epoch_ms``, null where the time is null or exactly the epoch."""
    us = epoch_us(df, name)
    return F.when(us != 0, floor_div(us, 1000))


def word_key(col: Column) -> Column:
    """A word without white space at its ends in lower case; null for null and blank words."""
    trimmed = F.lower(F.btrim(col, F.lit(EDGE_SPACE)))
    return F.when(trimmed != "", trimmed)


def clean_path(col: Column) -> Column:
    """A path without ``./`` steps and repeated slashes."""
    steps = F.regexp_replace(F.regexp_replace(col, r"/{2,}", "/"), r"(?<![^/])(?:\./)+", "")
    return F.regexp_replace(steps, r"/{2,}", "/")


def directory(col: Column) -> Column:
    """All before the last slash of a path; empty without a slash."""
    return F.regexp_extract(col, r"(?s)^(.*)/[^/]*$", 1)


def json_member(payload: Column, name: str) -> Column:
    """A member of a JSON object as text; null where the payload is no object."""
    return F.when(F.ltrim(payload).startswith("{"), F.get_json_object(payload, f"$['{name}']"))


def json_whole(payload: Column, name: str, kind: str) -> Column:
    """A member that is a whole number, or a string of digits, as ``kind``."""
    text = json_member(payload, name)
    return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast(kind))
