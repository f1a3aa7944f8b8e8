import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import payload as P
from tidemark.functions.durations import parse_duration_ms


def test_durations():
    assert [parse_duration_ms(t) for t in ("500ms", "10s", "2m", "1h", "42", " 7s ", "-1s")] == [500, 10_000, 120_000, 3_600_000, 42_000, 7_000, -1_000]
    for bad in ("", "s", "1.5s", "1 s", "10d", "1e3", "9" * 30):
        with pytest.raises(ValueError):
            parse_duration_ms(bad)


def test_event_time_of_json(spark):
    cases = [
        ('{"t": 1704067200000}', 1704067200000), ('{"t": "2024-01-01T00:00:00Z"}', 1704067200000), ('{"t": "2024-01-01T01:00:00.250+01:00"}', 1704067200250),
        ('{"t": 1.5}', 0), ('{"t": true}', 0), ('{"t": null}', 0), ("{}", 0), ("3", 0), ('{"t": "2024-01-01"}', 0), ('{"t": "2024-01-01T00:00:00"}', 0),
        ('{"t": 99999999999999999999}', 0), ('{"t": "5"}', 0), ('{"t": -1}', -1), (None, 0),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "p string")
    assert [r[0] for r in df.select(F.unix_millis(P.json_event_time(F.col("p"), "t"))).collect()] == [w for _, w in cases]


def test_event_time_of_csv(spark):
    cases = [("12", 12), ("+12", 12), ("-3", -3), ("", 0), (" 1", 0), ("1.0", 0), ("2024-01-01T00:00:00Z", 0), (None, 0), ("9" * 30, 0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "p string")
    assert [r[0] for r in df.select(F.unix_millis(P.csv_event_time(F.col("p")))).collect()] == [w for _, w in cases]


def rust_number(text):
    """What text parses to as a float by the plain rule: sign, digits, fraction, exponent, or inf and nan."""
    import re

    if not re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))", text, re.A):
        return 0.0
    return float(text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789+-.eE infaxINF_d", max_size=7), min_size=150, max_size=150))
def test_numbers_in_texts(spark, texts):
    texts = [*texts, "+inf", "-Infinity", "nan", "+nan", "1d", " 1 ", ".5", "5.", "1e5", "."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.text_number(F.col("t"))).collect()]
    for text, value in zip(texts, got):
        want = rust_number(text)
        assert value == want or value != value and want != want, text


def test_numbers_and_texts_of_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.5, True, " 3", [1], None)], "i int, d double, b boolean, s string, a array<int>, n string")
    assert tuple(df.select(*[P.as_number(df, c) for c in df.columns]).first()) == (1.0, 2.5, 0.0, 0.0, 0.0, 0.0)
    assert tuple(df.select(*[P.as_text(df, c) for c in df.columns]).first()) == ("1", "2.5", "true", " 3", "[1]", "null")


def test_members_and_keys(spark):
    df = spark.createDataFrame([('{"a.b": 1, "k": "1", "n": null, "o": {"x": [1, "z"]}}',), ("[1]",), (None,)], "p string")
    p = F.col("p")
    got = df.select(P.member_text(p, "a.b"), P.member_json(p, "k"), P.member_json(p, "a.b"), P.member_json(p, "o"), P.member_text(p, "n")).collect()
    assert tuple(got[0]) == ("1", '"1"', "1", '{"x":[1,"z"]}', None)
    assert tuple(got[1]) == tuple(got[2]) == (None,) * 5
    with pytest.raises(ValueError):
        P.member_path("it's")


def test_one_json_value(spark):
    yes = ["1", '"a"', "null", "{}", "[]", '{"a": [1, {"b": 2}]}', " true "]
    no = ["", " ", "{}}", "{} {}", "1,2", "1] [2", '1}', '{"a":1', "{'a':1}", "NaN", "[1,]", '1,"k":2', "01", "tru"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in df.select(P.is_json(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_message_bytes(spark):
    raw = [b'{"a":1}', b"hello world", bytes([0, 0x9F, 0x92, 0x96]), b"", None]
    df = spark.createDataFrame([(r,) for r in raw], "v binary")
    got = [r[0] for r in df.select(P.decode_bytes(F.col("v"))).collect()]
    assert got == ['{"a":1}', '{"bytes":"hello world"}', '{"bytes_b64":"%s"}' % base64.b64encode(raw[2]).decode(), '{"bytes":""}', None]


def test_payloads_keep_nulls_and_sort_names(spark):
    df = spark.createDataFrame([(None, float("nan"), float("-inf"), 1.0, "é\"")], "z string, a double, b float, c double, q string")
    assert df.select(P.payload_json(df, df.columns)).first()[0] == '{"a":null,"b":null,"c":1.0,"q":"é\\"","z":null}'


def test_date_patterns(spark):
    df = spark.sql("select timestamp'2024-02-03 04:05:06' as t")
    shown = lambda fmt: df.select(F.date_format("t", P.date_pattern(fmt))).first()[0]
    assert [shown(f) for f in ("%Y-%m-%d", "%Y%m%dT%H:%M:%S", "day's %j", "%F %T", "100%%")] == ["2024-02-03", "20240203T04:05:06", "day's 034", "2024-02-03 04:05:06", "100%"]
    for bad in ("%Q", "%"):
        with pytest.raises(ValueError):
            P.date_pattern(bad)


def test_words(spark):
    df = spark.createDataFrame([(" Ab  cD\te f\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(P.words(F.col("t"))).collect()] == [["ab", "cd", "e", "f"], [], []]
