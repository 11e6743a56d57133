from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tickwatch.functions.conditions import compare, threshold_value
from tickwatch.functions.durations import duration_micros, duration_nanos, parse_micros
from tickwatch.functions.jsonpath import as_double, as_label, extract, path_text, variant_kind, variant_path, was_coerced
from tickwatch.functions.maps import merge_maps
from tickwatch.functions.text import number_text, rfc3339
from tickwatch.functions.timegrid import floor_div, floor_to, require_utc

DURATIONS = [
    ("1m", 60_000_000_000),
    ("500ms", 500_000_000),
    ("2h30m", 9_000_000_000_000),
    ("15s", 15_000_000_000),
    ("1.5h", 5_400_000_000_000),
    (".5s", 500_000_000),
    ("1.s", 1_000_000_000),
    ("-1m", -60_000_000_000),
    ("+3us", 3_000),
    ("3µs", 3_000),
    ("1h1h", 7_200_000_000_000),
    ("0", 0),
    ("-0", 0),
    ("1.9ns", 1),
    ("", None),
    ("abc", None),
    ("5", None),
    ("1 m", None),
    ("1d", None),
    ("m", None),
    (".s", None),
    ("99999999999h", None),
    (None, None),
]


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_durations(spark):
    rows = spark.createDataFrame(DURATIONS, "text string, want bigint").select(
        "text", "want", duration_nanos("text").alias("got"), duration_micros("text").alias("us")
    )
    for r in rows.collect():
        assert r["got"] == r["want"], r
        assert r["us"] == (None if r["want"] is None else int(r["want"] / 1000)), r


def test_plan_time_durations():
    assert parse_micros("2h30m") == 9_000_000_000
    for bad in ("", "0", "-1m", "5", "x"):
        with pytest.raises(ValueError):
            parse_micros(bad)


THRESHOLDS = [
    ("100", 100.0),
    ("0.5", 0.5),
    ("1e3", 1000.0),
    ("-2.", -2.0),
    ("", None),
    ("not_a_number", None),
    ("100 or vector(0)", None),
    ("1d", None),
    (" 5 ", None),
    ("1e400", None),
    ("+Inf", math.inf),
    ("-infinity", -math.inf),
]


def test_thresholds(spark):
    rows = spark.createDataFrame(THRESHOLDS, "t string, want double").select("t", "want", threshold_value(F.col("t")).alias("got"))
    for r in rows.collect():
        assert r["got"] == r["want"], r
    assert math.isnan(one(spark, "NaN", "string", threshold_value))


def test_compare(spark):
    nan = float("nan")
    cases = [
        (5.0, "greaterThan", 5.0, False), (5.0, "greaterThanOrEqual", 5.0, True), (4.0, "lessThan", 5.0, True),
        (5.0, "lessThanOrEqual", 5.0, True), (5.0, "equal", 5.0, True), (5.0, "unknown", 5.0, None),
        (5.0, "", 5.0, None), (5.0, "equal", None, None), (None, "equal", 1.0, None),
        (nan, "greaterThan", 5.0, False), (nan, "equal", nan, False), (5.0, "lessThan", nan, False),
        (nan, "greaterThanOrEqual", nan, False),
    ]
    rows = spark.createDataFrame(cases, "v double, op string, t double, want boolean")
    for r in rows.select("*", compare(F.col("v"), F.col("op"), F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_paths(spark):
    assert path_text("a.b.0.c") == "$['a']['b'][0]['c']"
    assert one(spark, "a.b.0.c", "string", variant_path) == "$['a']['b'][0]['c']"
    for bad in ("", "a.#.b", "a..b", "a|b", "a.*", "a.@this"):
        assert one(spark, bad, "string", variant_path) is None
        with pytest.raises(ValueError):
            path_text(bad)


def test_extraction(spark):
    # value text, kind, number, label, replaced by 0
    cases = [
        ("22.43", "number", 22.43, "22.43", False), ("10", "number", 10.0, "10", False), ("2.50", "number", 2.5, "2.5", False),
        ("1e10", "number", 1e10, "10000000000", False), ('"3.5"', "string", 3.5, "3.5", False),
        ('"x"', "string", 0.0, "x", True), ('" 5 "', "string", 0.0, " 5 ", True), ("null", "null", 0.0, "", True),
        ("true", "boolean", 1.0, "true", True), ("[1,2]", "array", 0.0, "[1,2]", True),
        ('{"a":1}', "object", 0.0, '{"a":1}', True),
    ]
    rows = spark.createDataFrame([('{"a":{"b":[' + c[0] + "]}}", *c[1:]) for c in cases], "doc string, kind string, x double, label string, co boolean")
    v = F.col("v")
    for r in rows.withColumn("v", extract(F.try_parse_json("doc"), "a.b.0")).select(
        "*", variant_kind(v).alias("k"), as_double(v).alias("d"), as_label(v).alias("l"), was_coerced(v).alias("c")
    ).drop("v").collect():
        assert (r["k"], r["d"], r["l"], r["c"]) == (r["kind"], r["x"], r["label"], r["co"]), r
    missing = spark.sql("select '{\"a\":{}}' as doc").select(extract(F.try_parse_json("doc"), "a.b").alias("v"))
    r = missing.select(v.isNull().alias("n"), as_double(v).alias("d"), as_label(v).alias("l"), variant_kind(v).alias("k")).first()
    assert (r["n"], r["d"], r["l"], r["k"]) == (True, None, None, None)


def test_merge_maps(spark):
    rows = spark.createDataFrame(
        [({"a": "1", "b": "2"}, {"b": "OVERRIDE", "c": "3"}), (None, None), ({}, {}), (None, {"x": "1"}), ({"x": "1"}, None)],
        "a map<string,string>, b map<string,string>",
    ).select(merge_maps(F.col("a"), F.col("b")).alias("m"))
    assert [r["m"] for r in rows.collect()] == [
        {"a": "1", "b": "OVERRIDE", "c": "3"}, None, None, {"x": "1"}, {"x": "1"},
    ]


def test_text(spark):
    assert [one(spark, x, "double", number_text) for x in (4.0, 0.5, 1e7, 12345678901.25)] == ["4", "0.5", "10000000", "12345678901.25"]
    assert spark.sql("select timestamp_ntz'2024-01-01 00:30:00.9' t").select(rfc3339(F.col("t"))).first()[0] == "2024-01-01T00:30:00Z"


def test_grid(spark):
    for x, step in [(7, 3), (-7, 3), (6, 3), (0, 5), (-1, 5)]:
        got = spark.range(1).select(floor_div(F.lit(x).cast("bigint"), step), floor_to(F.lit(x).cast("bigint"), step)).first()
        assert tuple(got) == (x // step, x // step * step)


def test_zone_guard(spark):
    require_utc(spark)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        with pytest.raises(ValueError):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_expressions_that_cannot_fail(spark):
    from tickwatch.functions.attempt import cannot_fail

    log = spark.createDataFrame([], "k string, n int, v double, b boolean, ts timestamp_ntz")
    safe = ["true", "k = 'a'", "k <> 'a' and v > 50", "n in (1, 2) or not (k = 'x')", "v >= n", "b", "b and k is not null", "K = 'a'", "(k = 'a' or v < 1.5) and n <=> 3"]
    unsafe = ["k > 5", "n = 'x'", "n / 2 > 1", "cast(k as int) = 1", "upper(k) = 'A'", "n % 2 = 0", "raise_error('x')", "ts > '2024-01-01'", "missing = 1", "k like 'a%'",
              "n -1 > 0", "date 'x' = ts", "k = 'it\\'s'", "v > -n", "k = 'a' || 'b'", "b = k", ""]
    assert [t for t in safe if not cannot_fail(t, log)] == []
    assert [t for t in unsafe if cannot_fail(t, log)] == [""]


def test_attempts_share_parts(spark):
    """Parts that several attempts have in common are not evaluated ahead of them."""
    from tickwatch.functions.attempt import attempt

    rows = spark.createDataFrame([("1",), ("x",), (None,), ("7",)], "k string")
    asked = {"a": attempt("cast(k as int) > 4", "boolean"), "b": attempt("cast(k as int) < 4", "boolean"), "c": attempt("10 / (cast(k as int) - 1)", "double"), "d": attempt("concat('v', k)", "string")}
    got = rows.select("k", *[x for n, a in asked.items() for x in (a.value.alias(n), a.failed.alias(f"{n}_failed"))])
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {
        "1": (False, False, True, False, None, True, "v1", False), "x": (None, True, None, True, None, True, "vx", False),
        None: (None, False, None, False, None, False, None, False), "7": (True, False, False, False, 10 / 6, False, "v7", False),
    }
