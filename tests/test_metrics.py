"""Custom metrics, series upkeep and per-series alerts on small literal cases."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwatch.model import Rule, Search, rules_frame
from tickwatch.operators import metrics, series
from tickwatch.plans.backtest import Backtest

T0 = datetime(2024, 1, 1)
HOSTS = {
    "by_host": {
        "buckets": [
            {"key": "a.example.com", "doc_count": 767, "errors": {"doc_count": 172}, "error_percentage": {"value": 22.43}},
            {"key": "b.example.com", "doc_count": 1000, "errors": {"doc_count": 4}, "error_percentage": {"value": 0.4}},
        ]
    }
}
HOST = [{"name": "host", "value": "key"}]


def samples(spark, tree, metric, cap=1000):
    rule = Rule("default", "demo", Search(), custom_metrics=[{"name": "m", **metric}])
    docs = spark.createDataFrame([("default", "demo", T0, None if tree is None else json.dumps(tree))], "namespace string, rule string, tick timestamp_ntz, body string")
    trees = docs.select("namespace", "rule", "tick", F.try_parse_json("body").alias("aggregations"))
    found = metrics.accepted_metrics(rules_frame(spark, [rule]))
    rows = metrics.custom_samples(trees, found, cap).collect()
    flags = [r["truncated"] for r in metrics.bucket_samples(trees, found, cap).select("truncated").distinct().collect()]
    missing = [(r["reason"], r["hint"]) for r in metrics.missing_maps(trees, found).collect()]
    got = sorted((r["value"], tuple(sorted((k, v) for k, v in r["labels"].items() if k not in ("rule", "searchrule_namespace")))) for r in rows)
    assert all(r["labels"]["rule"] == "demo" and r["labels"]["searchrule_namespace"] == "default" for r in rows)
    return got, flags, missing


CASES = {
    "value path and label": (
        HOSTS, {"aggregation_map": "by_host.buckets", "labels": HOST, "value": "error_percentage.value"},
        [(0.4, (("host", "b.example.com"),)), (22.43, (("host", "a.example.com"),))],
    ),
    "default value path": (
        {"t": {"buckets": [{"key": "foo", "doc_count": 42}]}}, {"aggregation_map": "t.buckets", "labels": HOST}, [(42.0, (("host", "foo"),))],
    ),
    "static label": (
        HOSTS, {"aggregation_map": "by_host.buckets", "labels": [*HOST, {"name": "tier", "value": "warning", "static": True}]},
        [(767.0, (("host", "a.example.com"), ("tier", "warning"))), (1000.0, (("host", "b.example.com"), ("tier", "warning")))],
    ),
    "missing label": (
        {"t": [{"key": "x", "doc_count": 1}, {"doc_count": 2}]}, {"aggregation_map": "t", "labels": HOST}, [(1.0, (("host", "x"),))],
    ),
    "value is a list": ({"t": [{"key": "x", "val": [1, 2, 3]}]}, {"aggregation_map": "t", "labels": HOST, "value": "val"}, []),
    "value is a boolean": ({"t": [{"key": "x", "val": True}]}, {"aggregation_map": "t", "labels": HOST, "value": "val"}, []),
    "value is null": ({"t": [{"key": "x", "val": None}]}, {"aggregation_map": "t", "labels": HOST, "value": "val"}, []),
    "value is text": ({"t": [{"key": "x", "val": "7.5"}]}, {"aggregation_map": "t", "labels": HOST, "value": "val"}, [(7.5, (("host", "x"),))]),
    "text that is no number": ({"t": [{"key": "x", "val": "z"}]}, {"aggregation_map": "t", "labels": HOST, "value": "val"}, [(0.0, (("host", "x"),))]),
    "object counts as one bucket": ({"global": {"key": "only", "value": 7}}, {"aggregation_map": "global", "labels": HOST, "value": "value"}, [(7.0, (("host", "only"),))]),
    "number label": ({"t": [{"key": 5.50, "doc_count": 1}, {"key": 1e12, "doc_count": 2}]}, {"aggregation_map": "t", "labels": HOST}, [(1.0, (("host", "5.5"),)), (2.0, (("host", "1000000000000"),))]),
    "null label is empty text": ({"t": [{"key": None, "doc_count": 1}]}, {"aggregation_map": "t", "labels": HOST}, [(1.0, (("host", ""),))]),
    "last equal label set wins": ({"t": [{"key": "x", "doc_count": 9}, {"key": "x", "doc_count": 3}]}, {"aggregation_map": "t", "labels": HOST}, [(3.0, (("host", "x"),))]),
}


@pytest.mark.parametrize("name", CASES)
def test_bucket_cases(spark, name):
    tree, metric, want = CASES[name]
    assert samples(spark, tree, metric)[0] == want


def test_missing_path_and_no_tree(spark):
    assert samples(spark, HOSTS, {"aggregation_map": "missing.path.buckets"})[::2] == ([], [("PathNotFound", None)])
    assert samples(spark, HOSTS, {"aggregation_map": "aggregations.by_host.buckets"})[::2] == (
        [], [("PathNotFound", "drop the aggregations. prefix")],
    )
    assert samples(spark, None, {"aggregation_map": "x"})[::2] == ([], [("NoAggregations", None)])


def test_cap_comes_before_the_skip_rules(spark):
    equal = {"t": [{"key": "k", "doc_count": 1} for _ in range(1005)]}
    got, flags, _ = samples(spark, equal, {"aggregation_map": "t", "labels": HOST})
    assert (got, flags) == ([(1.0, (("host", "k"),))], [True])
    skipped = {"t": [{"doc_count": 1}, {"key": "a", "doc_count": 2}, {"key": "b", "doc_count": 3}]}
    got, flags, _ = samples(spark, skipped, {"aggregation_map": "t", "labels": HOST}, cap=2)
    assert (got, flags) == ([(2.0, (("host", "a"),))], [True])


NAMES = [("cdn_5xx_by_host", True), ("a", True), ("_underscore", True), ("value", False), ("state", False), ("", False),
         ("with-hyphen", False), ("123leading", False), ("with:colon", False), ("with space", False), (None, False)]


def test_metric_names(spark):
    rows = spark.createDataFrame(NAMES, "name string, want boolean")
    for r in rows.select("*", metrics.valid_metric_name(F.col("name")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_basic_samples(spark):
    rows = spark.createDataFrame([("n", "r", T0, 2.5, "Firing")], "namespace string, rule string, tick timestamp_ntz, value double, state string")
    got = {(r["metric"], r["labels"].get("state")): r["value"] for r in metrics.basic_samples(rows).collect()}
    assert got == {
        ("searchrule_value", None): 2.5, ("searchrule_state", "Normal"): 0.0, ("searchrule_state", "Firing"): 1.0,
        ("searchrule_state", "PendingFiring"): 0.0, ("searchrule_state", "PendingResolving"): 0.0,
    }


def test_label_conflict_rejects_the_later_declarer(spark):
    def rule(name, labels):
        return Rule("n", name, Search(), custom_metrics=[{"name": "m", "aggregation_map": "t", "labels": [{"name": x, "value": x} for x in labels]}])

    found = rules_frame(spark, [rule("b", ["pod"]), rule("a", ["host"]), rule("c", ["host"])])
    assert [(r["rule"], r["owner_rule"]) for r in metrics.label_conflicts(metrics.declared_metrics(found)).collect()] == [("b", "a")]
    assert sorted(r["rule"] for r in metrics.accepted_metrics(found).collect()) == ["a", "c"]


def test_metric_lives_while_declared(spark):
    ticks = spark.range(100).select((F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id * 10)")).alias("tick"), "id")
    declared = ticks.select("tick", F.lit("quiet").alias("metric")).unionByName(
        ticks.where("id < 40 or id between 60 and 70").select("tick", F.lit("gone").alias("metric"))
    )
    at = lambda i: T0 + timedelta(seconds=10 * i)
    got = {(r["metric"], r["registered_at"], r["dropped_at"]) for r in metrics.metric_lifecycle(declared, ticks).collect()}
    assert got == {("quiet", at(0), None), ("gone", at(0), at(40)), ("gone", at(60), at(71))}


def test_stale_series(spark):
    rows = [(0, "a"), (0, "b"), (1, "a"), (3, "b"), (4, "b")]
    have = spark.createDataFrame([(T0 + timedelta(hours=20 * t), "m", {"k": k}, 1.0) for t, k in rows], "tick timestamp_ntz, metric string, labels map<string,string>, value double")
    ticks = spark.createDataFrame([(T0 + timedelta(hours=20 * t),) for t in range(6)], "tick timestamp_ntz")
    got = {(round((r["tick"] - T0).total_seconds() / 72000), r["labels"]["k"]) for r in metrics.stale_series(have, ticks).collect()}
    assert got == {(1, "b"), (2, "a"), (5, "b")}


def test_truncation_counter(spark):
    flags = [(T0 + timedelta(hours=7 * i), i % 3 == 0) for i in range(30)]
    df = spark.createDataFrame([("m", t, f) for t, f in flags], "metric string, tick timestamp_ntz, truncated boolean")
    got = [r["total"] for r in metrics.truncation_counter(df, ["metric"]).orderBy("tick").collect()]
    assert got == [sum(f for _, f in flags[: i + 1]) for i in range(30)]


def test_top_buckets(spark):
    rows = [("g", k) for k in range(30) for _ in range(k % 4 + 1)] + [("h", 1)]
    got = metrics.top_buckets(spark.createDataFrame(rows, "g string, k int"), ["g"], "k", cap=5).collect()
    order = sorted(range(30), key=lambda k: (-(k % 4 + 1), k))[:5]
    assert [(r["k"], r["truncated"]) for r in sorted(got, key=lambda r: r["pos"]) if r["g"] == "g"] == [(k, True) for k in order]
    assert [(r["k"], r["pos"], r["truncated"]) for r in got if r["g"] == "h"] == [(1, 0, False)]


METRIC_CHOICE = [
    ([], None, "searchrule_value", False), (["a"], None, "searchrule_a", False), (["a", "b"], None, "searchrule_a", False),
    (["a", "b"], "b", "searchrule_b", False), (["a", "b"], "typo", "searchrule_a", True), ([], "typo", "searchrule_value", False),
]


def test_alert_metric_choice(spark):
    rules = [
        Rule("n", f"rule-{i}", Search(), operator="equal", threshold="1e3", for_="1m",
             custom_metrics=[{"name": n, "aggregation_map": "t"} for n in names],
             series_alert={"enabled": True, "metric_name": wanted})
        for i, (names, wanted, _, _) in enumerate(METRIC_CHOICE)
    ]
    got = {r["rule"]: r for r in series.series_rules(rules_frame(spark, rules)).collect()}
    for i, (_, _, metric, mismatch) in enumerate(METRIC_CHOICE):
        r = got[f"rule-{i}"]
        assert (r["metric"], r["mismatch"] is not None, r["alert_name"]) == (metric, mismatch, f"rule_{i}")
        assert r["expr"] == f'{metric}{{searchrule_namespace="n",rule="rule-{i}"}} == 1000'
        assert r["alert_labels"] == {"searchrule": f"rule-{i}", "searchrule_namespace": "n"}


@pytest.mark.parametrize("op,symbol", [("greaterThan", ">"), ("greaterThanOrEqual", ">="), ("lessThan", "<"), ("lessThanOrEqual", "<="), ("equal", "=="), ("unknown", None), ("", None)])
def test_operator_symbols(spark, op, symbol):
    rule = Rule("n", "r", Search(), operator=op, threshold="0.5", for_="1m", series_alert={"enabled": True, "alert_name": "Mine", "labels": {"searchrule": "x"}, "annotations": {"description": "own"}})
    got = series.series_rules(rules_frame(spark, [rule])).collect()
    if symbol is None:
        assert got == []
    else:
        assert got[0]["expr"].endswith(f"}} {symbol} 0.5") and got[0]["alert_name"] == "Mine"
        assert got[0]["alert_labels"]["searchrule"] == "x" and got[0]["alert_annotations"] == {"description": "own"}


def test_definitions_need_valid_conditions(spark):
    bad = [("not_a_number", "1m"), ("", "1m"), ("100 or vector(0)", "1m"), ("1", "abc")]
    rules = [Rule("n", f"r{i}", Search(), threshold=t, for_=f, series_alert={"enabled": True}) for i, (t, f) in enumerate(bad)]
    assert series.series_rules(rules_frame(spark, [*rules, Rule("n", "off", Search(), series_alert={"enabled": False})])).count() == 0


def test_series_runs_across_days(spark):
    rnd = random.Random(3)
    rule = Rule("n", "r", Search(), threshold="0", for_="90m", series_alert={"enabled": True})
    rows, expect = [], {}
    for k in range(12):
        start, i = None, 0
        present = True
        for i in range(150):
            if rnd.random() < 0.08:
                present = not present
            value = float(rnd.random() > 0.05)
            tick = T0 + timedelta(minutes=30 * i)
            if present:
                rows.append((tick, "searchrule_value", {"searchrule_namespace": "n", "rule": "r", "k": str(k)}, value))
            if present and value > 0:
                start = start or tick
                expect[(k, tick)] = (start, "firing" if tick - start >= timedelta(minutes=90) else "pending")
            else:
                start = None
    df = spark.createDataFrame(rows, "tick timestamp_ntz, metric string, labels map<string,string>, value double")
    out = series.series_alerts(df, series.series_rules(rules_frame(spark, [rule])), 30 * 60 * 1_000_000)
    assert {(int(r["labels"]["k"]), r["tick"]): (r["active_at"], r["state"]) for r in out.collect()} == expect


def test_backtest_samples_include_custom(spark):
    rows = [(T0 + timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(120)]
    rule = Rule("n", "r", Search(window="30m", group_by="k"), check_interval="30m", custom_metrics=[{"name": "by_k", "aggregation_map": "by_key.buckets", "labels": [{"name": "k", "value": "key"}]}])
    run = Backtest(spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double"), [rule])
    counts = {r["metric"]: r["n"] for r in run.samples().groupBy("metric").agg(F.count("*").alias("n")).collect()}
    assert counts == {"searchrule_value": 4, "searchrule_state": 16, "searchrule_by_k": 8}
