"""Metric samples, series upkeep and per-series alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import register
from queries.common import STATE_SQL, backtest, grid_sql, table
from tickwatch.functions.timegrid import MINUTE
from tickwatch.model import CUSTOM_METRICS_TYPE, Rule, Search
from tickwatch.operators import metrics
from tickwatch.plans.backtest import Backtest


@register(
    "metric_samples",
    STATE_SQL + """
    SELECT tick, 'searchrule_value' AS metric, namespace, rule, NULL::VARCHAR AS state, round(value, 9) AS value FROM st
    UNION ALL
    SELECT tick, 'searchrule_state', namespace, rule, s.state, CASE WHEN st.state = s.state THEN 1.0 ELSE 0.0 END
    FROM st CROSS JOIN (VALUES ('Normal'), ('Firing'), ('PendingFiring'), ('PendingResolving')) s(state)""",
)
def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.col("labels")
    return backtest(spark, sf_dir).samples().select(
        "tick",
        "metric",
        labels["searchrule_namespace"].alias("namespace"),
        labels["rule"].alias("rule"),
        labels["state"].alias("state"),
        F.round("value", 9).alias("value"),
    )


_BY_TYPE = Search(
    window="6h", metric="pct", part="value > 80", field="value", group_by="event_type", pick="max_bucket"
)
_METRICS = [
    {
        "name": "events_by_type",
        "aggregation_map": "by_key.buckets",
        "labels": [{"name": "kind", "value": "key"}, {"name": "tier", "value": "gold", "static": True}],
    },
    {
        "name": "hot_share",
        "aggregation_map": "by_key.buckets",
        "labels": [{"name": "kind", "value": "key"}],
        "value": "metric.value",
    },
    {"name": "busiest", "aggregation_map": "by_key.buckets.0", "labels": [], "value": "doc_count"},
    {"name": "last_wins", "aggregation_map": "by_key.buckets", "labels": [], "value": "part.doc_count"},
    {"name": "no_label", "aggregation_map": "by_key.buckets", "labels": [{"name": "host", "value": "host"}]},
    {"name": "not_a_number", "aggregation_map": "by_key.buckets", "labels": [], "value": "part"},
    {"name": "state", "aggregation_map": "by_key.buckets", "labels": []},
]
_CUSTOM = Rule(
    "shop", "mix-watch", _BY_TYPE, operator="greaterThan", threshold="3e1", for_="2h", check_interval="1h",
    custom_metrics=_METRICS,
    series_alert={
        "enabled": True,
        "metric_name": "hot_share",
        "labels": {"severity": "page", "searchrule": "renamed"},
        "annotations": {"runbook": "r1"},
    },
)


def _custom(spark: SparkSession, sf_dir: str) -> Backtest:
    return Backtest(table(spark, sf_dir, "events"), [_CUSTOM])


_BUCKETS_SQL = "WITH" + grid_sql(60) + """,
    b AS (
      SELECT g.tick, e.event_type AS kind, count(*) AS n,
             count(*) FILTER (WHERE value > 80) AS hot
      FROM grid g JOIN events e ON e.ts >= g.tick - INTERVAL 6 HOUR AND e.ts < g.tick
      GROUP BY g.tick, e.event_type),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY tick ORDER BY n DESC, kind) AS rn,
             row_number() OVER (PARTITION BY tick ORDER BY n, kind DESC) AS nr,
             100.0::DOUBLE * hot / n AS share
      FROM b)"""


@register(
    "custom_metric_samples",
    _BUCKETS_SQL + """
    SELECT tick, 'searchrule_events_by_type' AS metric, 'shop' AS namespace, 'mix-watch' AS rule, kind, 'gold' AS tier,
           4 AS n_labels, n::DOUBLE AS value FROM r
    UNION ALL SELECT tick, 'searchrule_hot_share', 'shop', 'mix-watch', kind, NULL, 3, round(share, 9) FROM r
    UNION ALL SELECT tick, 'searchrule_busiest', 'shop', 'mix-watch', NULL, NULL, 2, n FROM r WHERE rn = 1
    UNION ALL SELECT tick, 'searchrule_last_wins', 'shop', 'mix-watch', NULL, NULL, 2, hot FROM r WHERE nr = 1""",
)
def custom_metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _custom(spark, sf_dir)
    labels = F.col("labels")
    return metrics.custom_samples(run.trees(), metrics.accepted_metrics(run.catalog)).select(
        "tick",
        "metric",
        labels["searchrule_namespace"].alias("namespace"),
        labels["rule"].alias("rule"),
        labels["kind"].alias("kind"),
        labels["tier"].alias("tier"),
        F.size("labels").alias("n_labels"),
        F.round("value", 9).alias("value"),
    )


@register(
    "bucket_cap",
    """
    WITH c AS (SELECT l_returnflag, l_partkey, count(*) AS doc_count FROM lineitem GROUP BY l_returnflag, l_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY doc_count DESC, l_partkey) - 1 AS pos,
                 count(*) OVER (PARTITION BY l_returnflag) > 1000 AS truncated FROM c)
    SELECT l_returnflag, l_partkey, doc_count, pos::INTEGER AS pos, truncated FROM r WHERE pos < 1000""",
)
def bucket_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_buckets(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey")


@register(
    "truncation_counter",
    """
    WITH c AS (
      SELECT l_returnflag, l_shipdate, count(DISTINCT l_suppkey) > 5 AS truncated
      FROM lineitem GROUP BY l_returnflag, l_shipdate)
    SELECT l_returnflag, l_shipdate, truncated,
           sum(truncated::INT) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate)::BIGINT AS total FROM c""",
)
def truncation_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    by = ["l_returnflag", "l_shipdate"]
    # one refresh per ship date; a metric with more than five buckets is over its cap
    flags = items.groupBy(*by, "l_suppkey").count().groupBy(*by).agg((F.count(F.lit(1)) > 5).alias("truncated"))
    return metrics.truncation_counter(flags, ["l_returnflag"], "l_shipdate")


_BY_USER = Rule(
    "shop", "user-watch", Search(window="360h", metric="count", group_by="user_id"), operator="greaterThan", threshold="0",
    for_="0s", check_interval="12h",
    custom_metrics=[{"name": "per_user", "aggregation_map": "by_key.buckets", "labels": [{"name": "user", "value": "key"}]}],
)
# event numbers make more buckets than a metric may list
_BY_EVENT = Rule(
    "shop", "event-watch", Search(window="360h", metric="count", group_by="event_id % 1300"), operator="greaterThan", threshold="0",
    for_="0s", check_interval="12h",
    custom_metrics=[{"name": "per_slot", "aggregation_map": "by_key.buckets", "labels": [{"name": "slot", "value": "key"}]}],
)


def _wide_sql(key: str) -> str:
    return "WITH" + grid_sql(720) + f""",
    b AS (
      SELECT g.tick, CAST({key} AS VARCHAR) AS key, count(*) AS n
      FROM grid g JOIN events e ON e.ts >= g.tick - INTERVAL 15 DAY AND e.ts < g.tick GROUP BY g.tick, {key}),
    r AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY n DESC, key) AS rn FROM b)"""


@register(
    "wide_metric_samples",
    _wide_sql("user_id") + """
    SELECT tick, 'searchrule_per_user' AS metric, key AS "user", n::DOUBLE AS value FROM r WHERE rn <= 1000
    UNION ALL SELECT tick, 'searchrule_state', s.state, CASE s.state WHEN 'Firing' THEN 1 ELSE 0 END FROM grid
    CROSS JOIN (VALUES ('Normal'), ('Firing'), ('PendingFiring'), ('PendingResolving')) s(state)
    UNION ALL SELECT tick, 'searchrule_value', NULL, count(e.event_id) FROM grid
    LEFT JOIN events e ON e.ts >= tick - INTERVAL 15 DAY AND e.ts < tick GROUP BY tick""",
)
def wide_metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic and custom samples in one table, with far more buckets than a search lists."""
    rows = Backtest(table(spark, sf_dir, "events"), [_BY_USER]).samples()
    label = F.coalesce(F.col("labels")["user"], F.col("labels")["state"])
    return rows.select("tick", "metric", label.alias("user"), "value")


@register(
    "capped_metric_totals",
    _wide_sql("event_id % 1300") + """,
    t AS (SELECT tick, max(rn) > 1000 AS truncated FROM r GROUP BY tick)
    SELECT tick, truncated, sum(truncated::INT) OVER (ORDER BY tick)::BIGINT AS total FROM t""",
)
def capped_metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Backtest(table(spark, sf_dir, "events"), [_BY_EVENT]).truncations()
    return rows.select("tick", "truncated", "total")


def _user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gauge per (user, kind) and hour in which it has events."""
    hour = F.window("ts", "1 hour").end.alias("tick")
    counts = table(spark, sf_dir, "events").groupBy(hour, "user_id", "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    return counts.select(
        "tick",
        F.lit("searchrule_user_events").alias("metric"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")).alias("labels"),
        "value",
    )


@register(
    "stale_series",
    """
    WITH s AS (SELECT DISTINCT date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick, user_id, event_type FROM events),
    t AS (SELECT tick, lead(tick) OVER (ORDER BY tick) AS next_tick FROM (SELECT DISTINCT tick FROM s))
    SELECT t.next_tick AS tick, s.user_id::VARCHAR AS "user", s.event_type AS kind
    FROM s JOIN t USING (tick)
    WHERE t.next_tick IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM s n WHERE n.tick = t.next_tick AND n.user_id = s.user_id AND n.event_type = s.event_type)""",
)
def stale_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _user_samples(spark, sf_dir)
    out = metrics.stale_series(samples, samples.select("tick"))
    return out.select("tick", F.col("labels")["user"].alias("user"), F.col("labels")["kind"].alias("kind"))


@register(
    "metric_lifecycle",
    """
    WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS tick, 'searchrule_user_' || user_id AS metric FROM events),
    t AS (SELECT tick, row_number() OVER (ORDER BY tick) AS i, lead(tick) OVER (ORDER BY tick) AS nxt
          FROM (SELECT DISTINCT tick FROM d)),
    g AS (SELECT d.metric, t.tick, t.i, t.nxt,
                 t.i - row_number() OVER (PARTITION BY d.metric ORDER BY t.tick) AS island
          FROM d JOIN t USING (tick))
    SELECT metric, min(tick) AS registered_at,
           CASE WHEN max(i) = (SELECT max(i) FROM t) THEN NULL ELSE (SELECT tick FROM t WHERE t.i = max(g.i) + 1) END AS dropped_at
    FROM g GROUP BY metric, island""",
)
def metric_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.window("ts", "1 day").start.alias("tick")
    declared = table(spark, sf_dir, "events").select(
        day, F.concat(F.lit("searchrule_user_"), F.col("user_id").cast("string")).alias("metric")
    )
    return metrics.metric_lifecycle(declared, declared.select("tick"))


@register(
    "label_conflicts",
    """
    WITH d AS (
      SELECT 'ns' || (p_size % 5) AS namespace, 'rule-' || lpad(p_partkey::VARCHAR, 9, '0') AS rule,
             'searchrule_' || lower(p_type) || '_' || (p_partkey % 40) AS metric,
             CASE WHEN p_size % 3 = 0 THEN 'pod,host' ELSE 'host,pod' END AS label_names
      FROM part WHERE p_partkey % 40 <> 7),
    o AS (SELECT *, first_value(namespace) OVER w AS owner_namespace, first_value(rule) OVER w AS owner_rule,
                 first_value(label_names) OVER w AS owner_label_names
          FROM d WINDOW w AS (PARTITION BY metric ORDER BY namespace, rule))
    SELECT * FROM o WHERE label_names <> owner_label_names""",
)
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # every part declares one metric; number 7 has a name that is not allowed
    name = F.expr(
        "if(p_partkey % 40 = 7, lower(p_type) || '-x', lower(p_type) || '_' || cast(p_partkey % 40 as string))"
    )
    names = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("pod"), F.lit("host"))).otherwise(
        F.array(F.lit("host"), F.lit("pod"))
    )
    labels = F.transform(names, lambda n: F.struct(n.alias("name"), n.alias("value"), F.lit(False).alias("static")))
    none = F.lit(None).cast("string")
    declared = part.select(
        F.expr("'ns' || cast(p_size % 5 as string)").alias("namespace"),
        F.expr("'rule-' || lpad(cast(p_partkey as string), 9, '0')").alias("name"),
        F.array(
            F.struct(
                name.alias("name"), none.alias("help"), F.lit("by.buckets").alias("aggregation_map"),
                labels.alias("labels"), none.alias("value"),
            )
        ).cast(CUSTOM_METRICS_TYPE).alias("custom_metrics"),
    )
    out = metrics.label_conflicts(metrics.declared_metrics(declared))
    return out.select(
        "namespace", "rule", "metric", F.concat_ws(",", "label_names").alias("label_names"),
        "owner_namespace", "owner_rule", F.concat_ws(",", "owner_label_names").alias("owner_label_names"),
    )


@register(
    "series_alerts",
    _BUCKETS_SQL + """,
    h AS (SELECT tick, kind, share, tick - to_hours(row_number() OVER (PARTITION BY kind ORDER BY tick)) AS island
          FROM r WHERE share > 30),
    a AS (SELECT *, min(tick) OVER (PARTITION BY kind, island) AS active_at FROM h)
    SELECT 'shop' AS namespace, 'mix-watch' AS rule, 'mix_watch' AS alert_name, 'searchrule_hot_share' AS metric,
           tick, kind, round(share, 9) AS value, active_at,
           CASE WHEN epoch_us(tick) - epoch_us(active_at) >= 7200000000 THEN 'firing' ELSE 'pending' END AS state,
           'page' AS severity, 'renamed' AS owner, 'r1' AS runbook, 2 AS n_annotations
    FROM a""",
)
def series_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _custom(spark, sf_dir).series_alerts(refresh_us=60 * MINUTE)
    return rows.select(
        "namespace",
        "rule",
        "alert_name",
        "metric",
        "tick",
        F.col("labels")["kind"].alias("kind"),
        F.round("value", 9).alias("value"),
        "active_at",
        "state",
        F.col("labels")["severity"].alias("severity"),
        F.col("labels")["searchrule"].alias("owner"),
        F.col("annotations")["runbook"].alias("runbook"),
        F.size("annotations").alias("n_annotations"),
    )
