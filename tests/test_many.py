"""Rules as a table, and windows over the panes that exist, against a scan of everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwatch.operators import many
from tickwatch.operators.search import slide, sparse_windows

T0 = datetime(2024, 1, 1)


def us(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def rules_of(rnd, n):
    out = []
    for i in range(n):
        terms = rnd.choice([{}, {}, {"k": rnd.choice("abc")}, {"k": rnd.choice("abc"), "u": str(rnd.randint(0, 4))}, {"nowhere": "x"}])
        low = rnd.choice([None, float(rnd.randint(-20, 90)), rnd.random() * 50])
        high = rnd.choice([None, 100.0, (low or 0.0) + rnd.choice([0.0, 0.25, 1.0, 3.0, 17.5, 64.0])])
        ranges = rnd.choice([{}, {"v": (low, high)}, {"v": (low, high), "u": (float(rnd.randint(0, 3)), None)}])
        out.append(("n", f"r{i}", terms, ranges, rnd.choice(["10m", "25m", "1h"]), rnd.choice(["5m", "10m", "7m"])))
    return out


def brute(rows, rules):
    width = {"10m": 10, "25m": 25, "1h": 60, "5m": 5, "7m": 7}
    out = {}
    for _, name, terms, ranges, window, interval in rules:
        for t, k, u, v in rows:
            row = {"k": k, "u": u, "v": v}
            if any(row.get(c) is None or str(row[c]) != x for c, x in terms.items()):
                continue
            if any(row[c] is None or (lo is not None and row[c] < lo) or (hi is not None and not row[c] < hi) for c, (lo, hi) in ranges.items()):
                continue
            step, wide = width[interval] * 60_000_000, width[window] * 60_000_000
            tick = us(t) // step * step + step
            while tick <= us(t) + wide:
                out.setdefault((name, tick), []).append(v)
                tick += step
    return {k: (len(v), max((x for x in v if x is not None), default=None)) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(2))
def test_rules_as_a_table(spark, seed):
    rnd = random.Random(seed)
    rows = [(T0 + timedelta(seconds=rnd.randint(0, 20000)), rnd.choice(["a", "b", "c", None]), rnd.randint(0, 4), rnd.choice([None, float(rnd.randint(-30, 110)), rnd.random() * 60])) for _ in range(150)]
    rules = rules_of(rnd, 80)
    events = spark.createDataFrame(rows, "ts timestamp_ntz, k string, u int, v double")
    table = spark.createDataFrame([*rules, ("n", "bad", {}, {}, "soon", "5m"), ("n", "null", None, None, "10m", "")], many.MANY_DDL)
    got = {(r["rule"], us(r["tick"])): (r["hits"], r["high"]) for r in many.rule_windows(events, table, field="v").collect()}
    assert got == brute(rows, rules)


def test_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(T0, x) for x in (nan, inf, -inf, 0.0, -0.0, 1e300, None)]
    rules = [("n", "zero", {}, {"v": (-1.0, 1.0)}, "5m", "5m"), ("n", "up", {}, {"v": (5.0, None)}, "5m", "5m"), ("n", "all", {}, {}, "5m", "5m"), ("n", "huge", {}, {"v": (1e299, 1e301)}, "5m", "5m")]
    got = many.rule_windows(spark.createDataFrame(rows, "ts timestamp_ntz, v double"), spark.createDataFrame(rules, many.MANY_DDL)).collect()
    # NaN is above every number, as in SQL
    assert {r["rule"]: r["hits"] for r in got} == {"zero": 2, "up": 3, "all": 7, "huge": 1}


def test_plan_does_not_grow(spark):
    events = spark.createDataFrame([], "ts timestamp_ntz, k string, u int, v double")

    def size(n):
        rules = spark.range(n).selectExpr("'n' as namespace", "concat('r', id) as rule", "map('k', cast(id % 7 as string)) as terms", "map('v', named_struct('low', id + 0d, 'high', id + 2d)) as ranges", "'10m' as window", "'5m' as check_interval")
        return len(many.rule_windows(events, rules)._jdf.queryExecution().analyzed().toString())

    assert size(10) == size(5000) or abs(size(10) - size(5000)) < 20


@pytest.mark.parametrize("k,align", [(1, 1), (4, 1), (4, 3), (7, 7), (5, 2)])
def test_sparse_windows_equal_dense_ones(spark, k, align):
    rnd = random.Random(k * 10 + align)
    rows = [(s, p, rnd.randint(1, 5), rnd.random()) for s in range(3) for p in rnd.sample(range(-40, 60), 25)]
    panes = spark.createDataFrame(rows, "s int, p bigint, hits bigint, low double")
    got = sparse_windows(panes, ["s"], F.lit(k).cast("bigint"), F.lit(align).cast("bigint"), ["hits", "low"]).collect()
    assert len({(r["s"], r["e"]) for r in got}) == len(got)
    want = {}
    for s, p, hits, low in rows:
        for e in range(p + 1, p + k + 1):
            if e % align == 0:
                a, b = want.get((s, e), (0, 1.0))
                want[s, e] = (a + hits, min(b, low))
    assert {(r["s"], r["e"]): (r["hits"], r["low"]) for r in got} == want
    dense = panes.unionByName(spark.range(-60, 80).selectExpr("explode(array(0, 1, 2)) as s", "id as p", "0L as hits", "null as low"))
    full = slide(dense.withColumn("rid", F.col("s")), ["rid"], [k], ["hits", "low"]).where("hits > 0").where(F.pmod("e", F.lit(align)) == 0)
    assert {(r["rid"], r["e"]): (r["hits"], r["low"]) for r in full.collect()} == want
