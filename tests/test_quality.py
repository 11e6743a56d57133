"""Lint, sources, outcomes, status, listing, and the sources and sinks."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.model import SOURCE_DDL, Rule, Search, load_rules, local_frame, resolve_rules, rules_frame, rules_from_frame
from tickwatch.operators import quality, state
from tickwatch.operators.responses import response_ticks
from tickwatch.plans.backtest import Backtest
from tickwatch.plans.catalog import by_log, catalog_ticks, plan_catalog
from tickwatch.sources import sinks
from tickwatch.sources.logs import scan_index, union_logs

T0 = datetime(2024, 1, 1)
ACTION = {"name": "pager"}


def codes(spark, rule):
    return sorted(r["code"] for r in quality.lint(rules_frame(spark, [rule])).collect())


def metric(name="m", labels=(), path="t.buckets"):
    return {"name": name, "aggregation_map": path, "labels": [{"name": x, "value": "key"} for x in labels]}


def test_lint(spark):
    good = dict(search=Search(), action=ACTION, threshold="1", for_="1m", check_interval="30s")

    def check(**change):
        return codes(spark, Rule("n", "r", **{**good, **change}))

    assert check() == []
    assert check(operator="unknown", threshold="x", for_="5", check_interval="") == [
        "check_interval_invalid", "for_invalid", "operator_unknown", "threshold_invalid",
    ]
    assert check(action=None) == ["output_missing"]
    assert check(action=None, series_alert={"enabled": False}) == ["output_missing"]
    assert check(action=None, series_alert={"enabled": True}) == []
    assert check(custom_metrics=[metric(f"m{i}") for i in range(11)]) == ["too_many_metrics"]
    assert check(custom_metrics=[metric("value"), metric(""), metric("a-b"), metric("ok")]) == [
        "metric_name_invalid", "metric_name_required", "metric_name_reserved",
    ]
    assert check(custom_metrics=[metric(labels=["a-b", "rule"])]) == ["label_name_invalid"]
    assert check(custom_metrics=[metric(labels=["searchrule_namespace"])]) == ["label_name_reserved"]
    assert check(custom_metrics=[metric(labels=["host", "pod", "host"])]) == ["label_name_duplicate"]
    assert check(custom_metrics=[metric(path="aggregations.t.buckets")]) == ["aggregation_prefix"]
    assert check(search=Search(value_path="a.#.b")) == ["value_path_unsupported"]


def test_output_reason_takes_the_worst_first(spark):
    def rule(name, **kw):
        return Rule("n", name, Search(), for_="1m", **{"threshold": "1", "series_alert": {"enabled": True, "metric_name": "typo"}, **kw})

    rules = rules_frame(spark, [
        rule("fine", series_alert={"enabled": True}), rule("typo", custom_metrics=[metric()]),
        rule("broken", threshold="x"), rule("bad", custom_metrics=[metric("value")], threshold="x"),
        rule("off", series_alert={"enabled": False}),
    ])
    shown = {r["rule"]: r["reason"] for r in quality.output_reason(rules).collect()}
    assert shown == {"fine": "Synced", "typo": "MetricNameMismatch", "broken": "PrometheusRuleError", "bad": "CustomMetricsInvalid"}
    hidden = {r["rule"]: (r["reason"], r["message"]) for r in quality.output_reason(rules, metrics_exposed=False).collect()}
    assert hidden["typo"][0] == "MetricsNotExposed" and "typo" in hidden["typo"][1]
    assert hidden["fine"] == ("MetricsNotExposed", "metrics are not exposed")


def test_sources(spark):
    rules = rules_frame(spark, [Rule("n", "a", Search(), source=("logs", "")), Rule("n", "b", Search(), source=("logs", "team")), Rule("n", "c", Search(), source=("none", ""))])
    sources = spark.createDataFrame([(None, "logs", "/cluster"), ("team", "logs", "/team")], "namespace string, name string, path string").withColumns({"ts_col": F.lit("ts"), "has_credentials": F.lit(True)})
    assert {r["name"]: r["source_path"] for r in quality.resolve_sources(rules, sources).collect()} == {"a": "/cluster", "b": "/team", "c": None}
    assert [r["name"] for r in quality.unresolved(rules, sources).collect()] == ["c"]


def test_first_failure_names_the_outcome(spark):
    rule = rules_frame(spark, [Rule("n", "r", Search(), threshold="x", for_="soon")])
    row = rule.withColumns({"source_path": F.lit("/p"), "has_credentials": F.lit(True), "status_code": F.lit(None).cast("int"), "path_found": F.lit(False)})

    def outcome(**change):
        return resolve_rules(row).withColumns({k: F.lit(v) for k, v in change.items()}).select(quality.outcome()).first()[0]

    assert outcome(source_path=None, has_credentials=False) == "source_not_found"
    assert outcome(has_credentials=False) == "no_credentials"
    assert outcome() == "bad_for"
    assert outcome(for_us=1, query_json="{}") == "no_query"
    assert outcome(for_us=1) == "connection_error"
    assert outcome(for_us=1, status_code=500) == "query_error"
    assert outcome(for_us=1, status_code=200) == "path_missing"
    assert outcome(for_us=1, status_code=200, path_found=True) == "bad_condition"
    assert outcome(for_us=1, status_code=200, path_found=True, threshold_value=1.0) == "ok"


def test_status_keeps_the_latest_per_type(spark):
    ticks = spark.createDataFrame([("n", "r", T0 + timedelta(minutes=i), o) for i, o in enumerate(["ok", "query_error", "ok", "no_query"])], "namespace string, rule string, tick timestamp_ntz, outcome string")
    states = ticks.where("outcome = 'ok'").withColumn("state", F.lit(model.FIRING))
    rows = quality.condition_rows(states).unionByName(quality.outcome_rows(ticks))
    got = {r["type"]: (r["reason"], r["status"], r["ts"]) for r in quality.latest_status(rows).collect()}
    last = T0 + timedelta(minutes=3)
    assert got == {"State": ("NoQueryFound", True, last), "ResourceSynced": ("KubernetesApiCallError", False, last)}
    gone = spark.createDataFrame([("n", "r", "State")], "namespace string, rule string, type string")
    assert [r["type"] for r in quality.latest_status(rows, gone).collect()] == ["ResourceSynced"]


def test_listing(spark):
    rules = rules_frame(spark, [Rule("n", "r", Search(), description="d"), Rule("n", "q", Search(), description="e")])
    latest = spark.createDataFrame([("n", "r", "PendingResolving", T0), ("n", "q", "Normal", None)], "namespace string, rule string, state string, firing_time timestamp_ntz")
    out = quality.listing(latest, rules)
    got = {r["alertname"]: (r["state"], r["active_at"], r["description"], r["summary"]) for r in out.collect()}
    assert got == {"n_r": ("pending", "2024-01-01 00:00:00", "d", "d"), "n_q": ("resolved", "", "e", "e")}
    assert quality.by_key(out, "n_r").count() == 1 and quality.by_key(out, "x").count() == 0


def test_load_rules_from_json(spark, tmp_path):
    doc = {
        "namespace": "n", "name": "r", "check_interval": "30s", "source": {"name": "logs"}, "index": "app-*",
        "search": {"filter": "true", "window": "5m", "metric": "count"},
        "condition": {"operator": "greaterThan", "threshold": "1e3", "for": "1m"},
        "action": {"name": "pager", "labels": {"a": "b"}},
        "custom_metrics": [{"name": "m", "aggregation_map": "t", "labels": [{"name": "x", "value": "key"}]}],
    }
    (tmp_path / "rules.json").write_text(json.dumps([doc]))
    rules = load_rules(spark, str(tmp_path))
    row = rules.first()
    assert (row["check_us"], row["for_us"], row["threshold_value"], row["series_alert"]) == (30_000_000, 60_000_000, 1000.0, None)
    assert quality.lint(rules).count() == 0


def test_index_patterns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "app-1.parquet"))
    spark.range(2).write.parquet(str(tmp_path / "app-2.parquet"))
    spark.range(4).select(F.col("id").alias("other")).write.parquet(str(tmp_path / "sys.parquet"))
    assert scan_index(spark, str(tmp_path), "app-*").count() == 5
    both = scan_index(spark, str(tmp_path), "app-*,sys")
    assert (both.count(), sorted(both.columns)) == (9, ["id", "other"])
    assert union_logs([both, both]).count() == 18


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(T0 + timedelta(hours=h), h) for h in range(48)], "tick timestamp_ntz, v int")
    path = str(tmp_path / "states")
    sinks.write_by_day(rows, path)
    # a rerun of one day replaces that day only
    sinks.write_by_day(rows.where("v >= 24").withColumn("v", F.col("v") * 100), path)
    got = spark.read.parquet(path)
    assert got.count() == 48 and got.where("v >= 2400").count() == 24 and got.where("v < 24").count() == 24
    sinks.append(rows, str(tmp_path / "log"))
    sinks.append(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 96
    assert sinks.materialize(rows, "t").schema == rows.schema


def test_batches_are_written_once(spark, tmp_path):
    path, ddl = str(tmp_path / "table"), "tick timestamp_ntz, v int"
    assert sinks.read_committed(spark, path, ddl).count() == 0
    rows = spark.createDataFrame([(T0 + timedelta(hours=h), h) for h in range(48)], ddl)
    sinks.write_batch(rows.where("v < 30"), path, 0)
    sinks.write_batch(rows.where("v >= 30"), path, 1)
    # a replay may have other files, even other days, and takes the place of what it repeats
    sinks.write_batch(rows.where("v >= 30").repartition(5), path, 1)
    # a batch that has rows but no commit is not there yet
    rows.withColumn("day", F.to_date("tick")).write.partitionBy("day").parquet(path + "/rows/batch_id=2")
    got = sinks.read_committed(spark, path, ddl)
    assert got.columns == ["tick", "v"] and sorted(r["v"] for r in got.collect()) == list(range(48))
    sinks.write_batch(rows.limit(0), path, 3)
    assert sinks.read_committed(spark, path, ddl).count() == 48
    sinks.write_batch(rows, str(tmp_path / "flat"), 7, None)
    assert sinks.read_committed(spark, str(tmp_path / "flat"), ddl, None).count() == 48


def test_lint_of_searches_and_messages(spark):
    good = dict(action=ACTION, threshold="1", for_="1m", check_interval="30s")

    def check(data=None, **asked):
        return codes(spark, Rule("n", "r", Search(**asked), **{**good, "action": {**ACTION, "mode": "raw", "data": data}}))

    assert check(window="abc") == check(window="0s") == ["window_invalid"]
    assert check(round="w") == ["round_unknown"] and check(round="h") == []
    assert check(metric="median", field="v") == ["metric_unknown"] and check(metric="avg") == ["field_missing"] and check(metric="pct") == ["part_missing"]
    assert check(pick="top") == ["pick_invalid"] == check(pick="best", group_by="k") and check(pick="top", group_by="k") == []
    assert check(filter=" ") == ["filter_empty"]
    assert check("{{ rule }} {{ .value }} {{sent_at}}") == [] and check("{{ rule }} {{ nothing }}") == ["message_variable_unknown"]
    assert codes(spark, Rule("n", "r", Search(), **{**good, "check_interval": "0s"})) == ["check_interval_invalid"]


def test_backtest_tables_hang_together(spark):
    rows = [(T0 + timedelta(minutes=i), "error") for i in range(0, 240, 3)] + [(T0 + timedelta(minutes=i), "ok") for i in range(0, 600, 5)]
    rule = Rule("n", "r", Search(filter="kind = 'error'", window="10m"), threshold="1", for_="20m", check_interval="10m", action={**ACTION, "mode": "alertmanager", "labels": {"v": "{{ value }}"}}, description="d")
    actions = spark.createDataFrame([("", "pager", "30m", "alertmanager")], model.ACTION_DDL)
    run = Backtest(spark.createDataFrame(rows, "ts timestamp_ntz, kind string"), [rule], actions)
    alert = run.alerts.collect()
    assert [(a["opened_at"], a["closed_at"]) for a in alert] == [(T0 + timedelta(minutes=40), T0 + timedelta(minutes=280))]
    sent = run.payloads().orderBy("sent_at").collect()
    assert [s["sent_at"] for s in sent] == [T0 + timedelta(minutes=m) for m in range(60, 280, 30)]
    assert all(s["valid"] for s in sent) and json.loads(sent[0]["payload"])[0]["labels"] == {"alertname": "r", "v": "3"}
    assert run.listing().first()["state"] == "resolved"
    assert {(r["type"], r["reason"]) for r in run.status().collect()} == {("State", "Normal"), ("ResourceSynced", "TargetSynced")}
    # the frozen value is the last firing tick's
    assert alert[0]["value"] == 3.0 or alert[0]["value"] == 4.0
    assert state.firing_events(run.rule_states, run.catalog).count() == run.rule_states.where("state = 'Firing'").count()


def test_catalog_reads_each_log_once(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=i), "ab"[i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "at timestamp_ntz, k string").write.parquet(str(tmp_path / "app-1.parquet"))
    spark.createDataFrame(rows[:30], "at timestamp_ntz, k string").write.parquet(str(tmp_path / "sys.parquet"))
    sources = spark.createDataFrame([("", "main", str(tmp_path), None, "at", True)], model.SOURCE_DDL)

    def rule(name, index, source="main", **kw):
        return Rule("n", name, Search(filter="k = 'a'", window="10m"), check_interval="10m", index=index, source=(source, ""), **kw)

    catalog = rules_frame(spark, [
        rule("one", "app-*"), rule("two", "app-*"), rule("three", "sys"), rule("lost", "sys", source="none"), rule("bad", "sys", threshold="x"),
    ])
    assert {k: len(v) for k, v in by_log(rules_from_frame(catalog)).items()} == {("", "main", "app-*"): 2, ("", "main", "sys"): 1, ("", "none", "sys"): 1}
    got = {(r["rule"], r["n"], r["hits"]) for r in catalog_ticks(spark, catalog, sources).groupBy("rule").agg(F.count("*").alias("n"), F.sum("hits").alias("hits")).collect()}
    assert got == {("one", 6, 30), ("two", 6, 30), ("three", 3, 15)}


def test_stored_responses(spark):
    rule = Rule("n", "r", Search(value_path="aggregations.by.buckets.0.doc_count"), threshold="2", for_="0s")
    docs = [
        (200, '{"aggregations":{"by":{"buckets":[{"doc_count":3}]}}}', "ok", 3.0, True, False),
        (200, '{"aggregations":{"by":{"buckets":[{"doc_count":"x"}]}}}', "ok", 0.0, False, True),
        (200, '{"aggregations":{"by":{"buckets":[]}}}', "path_missing", None, None, None),
        (200, "{", "path_missing", None, None, None),
        (500, "{}", "query_error", None, None, None),
        (None, None, "connection_error", None, None, None),
    ]
    rows = spark.createDataFrame([("n", "r", T0 + timedelta(minutes=i), d[0], d[1]) for i, d in enumerate(docs)], "namespace string, rule string, tick timestamp_ntz, status_code int, body string")
    got = response_ticks(rows, rules_frame(spark, [rule])).orderBy("tick").collect()
    assert [(r["outcome"], r["value"], r["firing"], r["coerced"]) for r in got] == [d[2:] for d in docs]
    none = spark.createDataFrame([], model.SOURCE_DDL)
    assert {r["outcome"] for r in response_ticks(rows, rules_frame(spark, [rule]), none).collect()} == {"source_not_found"}


def test_catalog_outlives_every_rule(spark, tmp_path):
    """Rules that cannot be planned, that fail on some rows, and that are listed twice, beside one that is fine."""
    rows = [(T0 + timedelta(minutes=i), "ab"[i % 2], str(i) if i < 30 else "x") for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string, n string").write.parquet(str(tmp_path / "app.parquet"))
    spark.createDataFrame([("a",)], "k string").write.parquet(str(tmp_path / "timeless.parquet"))
    sources = spark.createDataFrame([("", "main", str(tmp_path), None, "ts", True)], model.SOURCE_DDL)

    def rule(name, index="app", threshold="2", **asked):
        return Rule("n", name, Search(window="10m", **asked), threshold=threshold, for_="0s", check_interval="10m", index=index, source=("main", ""))

    asked = [
        rule("fine", filter="k = 'a'"), rule("fine", filter="k = 'a'"), rule("aggregate", filter="count(*) > 1"), rule("spread", filter="explode(array(true))"),
        rule("time", filter="true", metric="avg", field="ts"), rule("timeless", "timeless", filter="k = 'a'"),
        rule("late", filter="cast(n as int) >= 0"), rule("later", filter="cast(n as int) >= 40"), rule("text", filter="true", metric="avg", field="n"),
        rule("inside", filter="k = 'b'", group_by="element_at(array('p', 'q'), cast(n as int) % 2 + 1)", pick="top"),
    ]
    plan = plan_catalog(spark, rules_frame(spark, asked), sources)
    planned = [(r["rule"], r["outcome"]) for r in plan.outcomes.collect()]
    bad = {"aggregate", "spread", "time", "timeless"}
    assert sorted(planned) == sorted(
        [("fine", "duplicate_rule")] + [(r, "query_error") for r in bad] + [(r, "ok") for r in ("fine", "late", "later", "text", "inside")]
    )
    found = {(r["rule"], r["n_ticks"], r["n_failed"], r["outcome"]) for r in plan.run_outcomes().collect()}
    assert {x for x in found if x[1]} == {("fine", 6, 0, "ok")} | {(r, 6, 3, "query_error") for r in ("late", "later", "text", "inside")}
    hits = {(r["rule"], r["tick"].minute, r["hits"], r["value"]) for r in plan.states.where("minute(tick) = 10").collect()}
    assert hits == {("fine", 10, 5, 5.0), ("late", 10, 10, 10.0), ("later", 10, 0, 0.0), ("text", 10, 10, 4.5), ("inside", 10, 5, 5.0)}
    status = {(r["rule"], r["type"]): r for r in plan.status().where("ts is not null").collect()}
    assert status["fine", "State"]["reason"] == "AlertFiring" and status["fine", "ResourceSynced"]["status"]
    assert status["late", "State"]["reason"] == "QueryError" and not status["late", "ResourceSynced"]["status"]
    assert status["late", "State"]["message"].endswith("filter fails on 10 rows")


def test_catalog_end_to_end(spark, tmp_path):
    """Every table of a catalog over two logs, in one run and in two."""
    rows = [(T0 + timedelta(minutes=i), "abc"[i % 3]) for i in range(120)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string").write.parquet(str(tmp_path / "one.parquet"))
    spark.createDataFrame([r for r in rows if r[1] != "a" or r[0] < T0 + timedelta(hours=1)], "ts timestamp_ntz, k string").write.parquet(str(tmp_path / "two.parquet"))
    sources = spark.createDataFrame([("", "main", str(tmp_path), None, "ts", True)], model.SOURCE_DDL)
    actions = spark.createDataFrame([("", "pager", "20m", "alertmanager"), ("", "mail", "30m", None)], model.ACTION_DDL)

    def rule(name, index, labels, action, path="by_key.buckets"):
        metrics_ = [{"name": "hits", "aggregation_map": path, "labels": [{"name": x, "value": "key"} for x in labels]}]
        return Rule("n", name, Search(window="20m", group_by="k", pick="top"), threshold="3", for_="0s", check_interval="20m", index=index, source=("main", ""), action=action,
                    custom_metrics=metrics_, series_alert={"enabled": True, "metric_name": "hits"})

    asked = [
        rule("a", "one", ["kind"], {"name": "pager", "mode": "alertmanager", "labels": {"x": "{{ value }}"}}),
        rule("b", "two", ["kind"], {"name": "mail", "mode": "raw", "data": "{{ rule }}={{ value }}"}),
        rule("c", "two", ["other"], {"name": "mail", "mode": "raw", "data": "{{ rule }}"}),
        rule("d", "two", ["kind"], {"name": "mail", "mode": "raw", "data": "d"}, path="nowhere.buckets"),
    ]
    plan = plan_catalog(spark, rules_frame(spark, asked), sources, actions, start="2024-01-01 00:00:00", end="2024-01-01 02:00:00")
    assert [(r["rule"], r["owner_rule"]) for r in plan.label_conflicts().collect()] == [("c", "a")]
    custom = plan.samples().where("metric = 'searchrule_hits'").collect()
    assert {r["labels"]["rule"] for r in custom} == {"a", "b"} and len([r for r in custom if r["labels"]["rule"] == "a"]) == 18
    assert {(r["rule"], r["reason"]) for r in plan.missing_samples().collect()} == {("d", model.NO_PATH)}
    stale = plan.stale_series().where("metric = 'searchrule_hits'").collect()
    assert [(r["tick"], r["labels"]["kind"], r["labels"]["rule"]) for r in stale] == [(T0 + timedelta(minutes=80), "a", "b")]
    assert [(r["metric"], r["registered_at"], r["dropped_at"]) for r in plan.metric_lives().collect()] == [("searchrule_hits", T0 + timedelta(minutes=20), None)]
    assert {r["payload"] for r in plan.messages().where("rule = 'b'").collect()} == {"b=7"} and plan.payloads().where("valid").count() == 6
    assert plan.firing_log().count() == 24 and plan.series_alerts().count() > 0
    first = plan_catalog(spark, rules_frame(spark, asked), sources, actions, start="2024-01-01 00:00:00", end="2024-01-01 01:00:00")
    both = first.states.unionByName(first.after("2024-01-01 02:00:00").states)
    assert sorted(map(str, both.select(*plan.states.columns).collect())) == sorted(map(str, plan.states.collect()))


def test_status_names_what_is_wrong(spark):
    """A rule that cannot be planned says in its status which text it fails on."""
    rules = [
        Rule("bad", "for", Search(), for_="abc", source=("events", ""), index="events"),
        Rule("bad", "interval", Search(), check_interval="0s", source=("events", ""), index="events"),
        Rule("bad", "source", Search(), source=("nowhere", ""), index="events"),
    ]
    sources = local_frame(spark, [{"namespace": "", "name": "events", "path": "/nowhere", "format": "parquet", "ts_col": "ts", "has_credentials": True}], SOURCE_DDL)
    plan = plan_catalog(spark, rules_frame(spark, rules), sources)
    status = {(r["rule"], r["type"]): (r["reason"], r["message"]) for r in plan.status().collect()}
    assert status["for", "ResourceSynced"] == (model.SYNC_FAILED, "bad_for: abc")
    assert status["interval", "ResourceSynced"] == (model.SYNC_FAILED, "bad_interval: 0s")
    assert status["source", "State"] == ("QueryConnectorNotFound", "source_not_found: nowhere")
