"""Windowed search against a scan of every window."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwatch.functions.timegrid import ROUND_MICROS
from tickwatch.model import Rule, Search, rules_frame, rules_from_frame
from tickwatch.operators import search
from tickwatch.operators.search import measures_of, slide

T0 = datetime(2024, 1, 1)
EPOCH = datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def log(spark, n=300, seed=1, minutes=600, keys="abc"):
    rnd = random.Random(seed)
    rows = [
        (T0 + timedelta(seconds=rnd.randint(0, minutes * 60)), rnd.choice(keys), float(rnd.randint(0, 99)) if rnd.random() > 0.1 else None)
        for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double")


RULES = [
    Rule("n", "count", Search(filter="k = 'a'", window="10m"), check_interval="5m"),
    Rule("n", "tumbling", Search(filter="v > 50", window="20m", metric="sum", field="v"), check_interval="20m"),
    Rule("n", "wide", Search(filter="true", window="3h", metric="avg", field="v"), check_interval="7m"),
    Rule("n", "sparse", Search(filter="k = 'none'", window="15m", metric="max", field="v"), check_interval="10m"),
    Rule("n", "low", Search(filter="k <> 'a'", window="25m", metric="min", field="v"), check_interval="10m"),
    Rule("n", "high", Search(filter="true", window="50m", metric="max", field="v"), check_interval="15m"),
    Rule("n", "share", Search(filter="true", window="30m", metric="pct", part="k = 'b'"), check_interval="15m"),
    Rule("n", "gappy", Search(filter="k = 'c'", window="4m", metric="count"), check_interval="10m"),
    Rule("n", "rounded", Search(filter="true", window="90m", round="h"), check_interval="25m"),
    Rule("n", "day", Search(filter="true", window="2h", round="d", metric="sum", field="v"), check_interval="1h"),
]
TESTS = {
    "count": lambda k, v: k == "a", "tumbling": lambda k, v: v is not None and v > 50, "wide": lambda k, v: True,
    "sparse": lambda k, v: False, "low": lambda k, v: k != "a", "high": lambda k, v: True, "share": lambda k, v: True,
    "gappy": lambda k, v: k == "c", "rounded": lambda k, v: True, "day": lambda k, v: True,
}


def brute(rules, rows, tests, lo, hi):
    from tickwatch.functions.durations import parse_micros

    out = {}
    for r in rules:
        step, width = parse_micros(r.check_interval), parse_micros(r.search.window)
        tick, last = lo // step * step + step, hi // step * step + step
        while tick <= last:
            end = tick // ROUND_MICROS.get(r.search.round, 1) * ROUND_MICROS.get(r.search.round, 1)
            hits = [(k, v) for t, k, v in rows if end - width <= us(t) < end and tests[r.name](k, v)]
            vals = [v for _, v in hits if v is not None]
            value = {
                "count": lambda: float(len(hits)),
                "sum": lambda: sum(vals),
                "avg": lambda: sum(vals) / len(vals) if vals else None,
                "min": lambda: min(vals, default=None),
                "max": lambda: max(vals, default=None),
                "pct": lambda: 100.0 * sum(k == "b" for k, _ in hits) / len(hits) if hits else None,
            }[r.search.metric]()
            out[(r.name, tick)] = (len(hits), value)
            tick += step
    return out


def collect(df):
    return {(r["rule"], us(r["tick"])): (r["hits"], r["raw_value"]) for r in df.collect()}


def same(seen, expect):
    assert seen.keys() == expect.keys()
    for k, (hits, value) in expect.items():
        assert seen[k][0] == hits, k
        assert seen[k][1] == (None if value is None else pytest.approx(value, rel=1e-12)), k


def test_rolling_values(spark):
    rows, df = log(spark)
    lo, hi = min(us(r[0]) for r in rows), max(us(r[0]) for r in rows)
    expect = brute(RULES, rows, TESTS, lo, hi)
    seen = collect(search.tick_values(df, RULES))
    same(seen, expect)


def test_literal_bounds_prune_and_agree(spark):
    rows, df = log(spark, seed=2)
    start, end = T0 + timedelta(minutes=100), T0 + timedelta(minutes=400)
    # ticks after the start up to the end, each with its whole window
    lo, hi = min(us(r[0]) for r in rows), max(us(r[0]) for r in rows)
    whole = brute(RULES[:4], [r for r in rows if r[0] < end], TESTS, min(lo, us(start)), max(hi, us(end)))
    expect = {k: v for k, v in whole.items() if us(start) < k[1] <= us(end)}
    got = search.tick_values(df, RULES[:4], start=str(start), end=str(end))
    seen = collect(got)
    same(seen, expect)


def test_no_rows_at_all(spark):
    empty = spark.createDataFrame([], "ts timestamp_ntz, k string, v double")
    assert search.tick_values(empty, RULES).count() == 0


def test_value_reads_no_answer_as_zero(spark):
    _, df = log(spark, n=5)
    rows = search.tick_values(df, [RULES[3]])
    assert rows.where("raw_value is not null or value <> 0 or hits <> 0").count() == 0


@pytest.mark.parametrize("window", ["30m", "6h"])
def test_bucket_values_and_picks(spark, window):
    rows, df = log(spark, n=200, seed=4, keys="abcdef")
    rule = Rule("n", "b", Search(window=window, metric="max", field="v", group_by="k", part="v > 50"), check_interval="30m")
    from tickwatch.functions.durations import parse_micros

    step, width = parse_micros("30m"), parse_micros(window)
    lo, hi = min(us(r[0]) for r in rows), max(us(r[0]) for r in rows)
    expect, tick = {}, lo // step * step + step
    while tick <= hi // step * step + step:
        for key in "abcdef":
            hit = [v for t, k, v in rows if k == key and tick - width <= us(t) < tick]
            if hit:
                expect[(tick, key)] = (len(hit), sum(v is not None and v > 50 for v in hit), max((v for v in hit if v is not None), default=None))
        tick += step
    buckets = search.bucket_values(df, [rule]).cache()
    assert {(us(r["tick"]), r["bucket"]): (r["doc_count"], r["part_count"], r["value"]) for r in buckets.collect()} == expect
    for pick, order in {
        "top": lambda b: (-b[1][0], b[0]), "max_bucket": lambda b: (-b[1][2], b[0]), "min_bucket": lambda b: (b[1][2], b[0])
    }.items():
        want = {}
        for t in {k[0] for k in expect}:
            have = [(key, e) for (t2, key), e in expect.items() if t2 == t and e[2] is not None]
            if have:
                want[t] = min(have, key=order)[0]
        seen = {us(r["tick"]): r["bucket"] for r in search.pick_bucket(buckets, ["tick"], pick).where("bucket is not null").collect()}
        assert seen == want
    buckets.unpersist()


def test_slide_merges_panes_of_a_hot_series(spark):
    # one series holds almost all panes; groups stay at the window's size
    k, n = 50, 4000
    panes = spark.range(n).select(F.lit(0).alias("rid"), F.col("id").alias("p"), (F.col("id") % 7).alias("hits"))
    out = slide(panes, ["rid"], [k], ["hits"])
    seen = {r["e"]: r["hits"] for r in out.where(f"e between {k} and {n}").collect()}
    assert seen == {e: sum(p % 7 for p in range(e - k, e)) for e in range(k, n + 1)}


def test_measures_are_pruned(spark):
    assert measures_of([RULES[0]]) == ["hits"]
    assert measures_of(RULES) == ["hits", "part", "n", "total", "low", "high"]


def test_scan_reads_only_what_rules_need(spark, tmp_path):
    _, df = log(spark)
    df.withColumn("unused", F.lit("x")).write.parquet(str(tmp_path / "log"))
    events = spark.read.parquet(str(tmp_path / "log"))
    plan = search.pane_counts(events, [RULES[0]], "ts")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,k:string>" in plan
    assert "EqualTo(k,a)" in plan


def test_no_cross_join_in_any_window_plan(spark):
    _, df = log(spark)
    for rows in (search.tick_values(df, RULES), search.bucket_values(df, [Rule("n", "b", Search(window="6h", group_by="k"), check_interval="1h")])):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_responses_have_the_listed_shape(spark):
    rows, df = log(spark, n=120, keys="abcd")
    rule = Rule("n", "r", Search(window="2h", group_by="k"), check_interval="2h")
    bodies = search.responses(search.bucket_values(df, [rule]), search.tick_values(df, [rule]), size=2)
    for r in bodies.collect():
        doc, t = json.loads(r["body"]), us(r["tick"])
        inside = [k for ts, k, _ in rows if t - 7_200_000_000 <= us(ts) < t]
        assert doc["hits"]["total"]["value"] == len(inside)
        if inside:
            order = sorted({(-inside.count(k), k) for k in inside})
            top = doc["aggregations"]["by_key"]
            assert [(b["key"], b["doc_count"]) for b in top["buckets"]] == [(k, -n) for n, k in order[:2]]
            assert top["sum_other_doc_count"] == -sum(n for n, _ in order[2:])
        else:
            assert "aggregations" not in doc


def test_late_rows(spark):
    rnd = random.Random(9)
    rows = [(T0 + timedelta(seconds=rnd.randint(0, 36000)), rnd.randint(0, 200)) for _ in range(300)]
    df = spark.createDataFrame([(t, t + timedelta(minutes=d)) for t, d in rows], "ts timestamp_ntz, ingest_ts timestamp_ntz")
    rule = Rule("n", "late", Search(window="1h"), check_interval="20m")
    step, lo, hi = 1_200_000_000, min(us(t) for t, _ in rows), max(us(t) for t, _ in rows)
    expect, tick = {}, lo // step * step + step
    while tick <= hi // step * step + step:
        expect[tick] = sum(tick - 3_600_000_000 <= us(t) < tick and us(t) + d * 60_000_000 <= tick for t, d in rows)
        tick += step
    assert {us(r["tick"]): r["hits"] for r in search.hits_as_of_ingest(df, rule).collect()} == expect


def test_plain_searches(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", None), (None, 5.0)], "k string, v double")
    assert search.total_hits(df, search.in_range(F.col("v"), gte=2.0, lt=5.0)).first()[0] == 2
    assert search.total_hits(df, F.col("v") > 100).first()[0] == 0
    top = search.terms(df, F.col("k"), size=2, metrics={"s": F.col("v")}).collect()
    assert [tuple(r) for r in top] == [(0, "a", 2, 3.0, 1), (1, "b", 1, 3.0, 1)]


def test_catalog_round_trip(spark, tmp_path):
    frame = rules_frame(spark, RULES)
    assert rules_from_frame(frame)[2].search == RULES[2].search
    row = frame.where("name = 'wide'").first()
    assert (row["check_us"], row["for_us"], row["threshold_value"]) == (420_000_000, 0, 0.0)
