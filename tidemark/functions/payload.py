"""Reading dynamic JSON payloads: event time, numbers, distinct texts, bytes; and writing payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null for null.

    Spark's parsers read the first value and leave the rest. Put into an array it has to be the one element, and put
    into an object as well it has to be a whole member, which nothing that goes on behind a value can be both times.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    member = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.when(text.isNotNull(), F.coalesce(alone, F.lit(False)) & member)


def member_path(field: str) -> str:
    """The JSON path of a top-level member, whatever characters its name has, bar a quote."""
    if "'" in field:
        raise ValueError("a field name must not contain a single quote")
    return f"$['{field}']"


def member_text(payload: Column, field: str) -> Column:
    """A member's text: strings raw, other kinds as JSON; null where it is missing, null, or the payload no object."""
    return F.get_json_object(payload, member_path(field))


def member_json(payload: Column, field: str) -> Column:
    """A member as JSON text, strings with their quotes, so that ``1`` and ``"1"`` stay two keys; null where missing."""
    return F.to_json(F.variant_get(F.try_parse_json(payload), member_path(field), "variant"))


def rfc3339(text: Column) -> Column:
    """The instant of an RFC 3339 text; null for anything else."""
    return F.when(text.rlike(_RFC3339), F.translate(F.upper(text), " ", "T").try_cast("timestamp"))


def json_event_time(payload: Column, field: str) -> Column:
    """Event time of a JSON payload: a whole number is epoch ms, a string RFC 3339; anything else is the epoch."""
    shown = member_json(payload, field)
    number = F.when(shown.rlike("^-?[0-9]+$"), F.timestamp_millis(shown.try_cast("bigint")))
    text = F.when(shown.startswith('"'), rfc3339(member_text(payload, field)))
    return F.coalesce(number, text, F.timestamp_millis(F.lit(0)))


def csv_event_time(text: Column) -> Column:
    """Event time of a CSV field: a whole number of epoch ms; anything else is the epoch."""
    ms = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.timestamp_millis(F.coalesce(ms, F.lit(0).cast("bigint")))


def as_number(df: DataFrame, name: str) -> Column:
    """What a value adds to a sum: numbers as double; numeric strings parsed; null, booleans and all else 0."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.lit(0.0)
    if isinstance(kind, T.NumericType):
        return F.coalesce(col.cast("double"), F.lit(0.0))
    if isinstance(kind, T.StringType):
        return text_number(col)
    return F.lit(0.0)


def text_number(text: Column) -> Column:
    """The number that a text spells, as a whole and without white space; 0 for null and anything else."""
    plain = F.regexp_replace(text, r"^\+(?=(?i:nan|inf))", "")
    return F.coalesce(F.when(text.rlike(_NUMBER), plain.try_cast("double")), F.lit(0.0))


def as_text(df: DataFrame, name: str) -> Column:
    """What a value counts as among distinct values: its text; null counts as ``null``."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.to_json(col), F.lit("null"))
    return F.coalesce(col.cast("string"), F.lit("null"))


def finite(col: Column) -> Column:
    """Null for NaN and the infinities, which JSON cannot show."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def words(text: Column) -> Column:
    """The lower-cased words of a text between white space; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def decode_bytes(value: Column) -> Column:
    """A message's bytes as JSON text: JSON stays, other UTF-8 becomes ``{"bytes": text}``, all else ``{"bytes_b64": …}``."""
    text = F.when(F.is_valid_utf8(value.cast("string")), value.cast("string"))
    return (
        F.when(is_json(text), text)
        .when(text.isNotNull(), F.to_json(F.struct(text.alias("bytes"))))
        .when(value.isNotNull(), F.to_json(F.struct(F.base64(value).alias("bytes_b64"))))
    )


def payload_json(df: DataFrame, columns: list[str]) -> Column:
    """Columns as compact JSON with names in alphabetical order; nulls are kept, numbers that are not finite are null."""
    shown = []
    for name in sorted(columns):
        col = F.col(f"`{name}`")
        shown.append((finite(col) if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType) else col).alias(name))
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def date_pattern(fmt: str) -> str:
    """A strftime format as a pattern for ``date_format``; unknown directives are refused."""
    out = literal = ""

    def flushed() -> str:
        return "'" + literal.replace("'", "''") + "'" if literal else ""

    i = 0
    while i < len(fmt):
        c = fmt[i]
        if c != "%":
            literal += c
            i += 1
            continue
        directive = fmt[i + 1 : i + 2]
        if directive == "%":
            literal += "%"
        elif directive in _DIRECTIVES and directive:
            out, literal = out + flushed() + _DIRECTIVES[directive], ""
        else:
            raise ValueError(f"unknown directive in {fmt!r}")
        i += 2
    return out + flushed()
