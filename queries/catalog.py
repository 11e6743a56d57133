"""Sources, rule lint, tick outcomes, status and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import register
from queries.common import FIRING_SQL, STATE_SQL, VALUES_SQL, backtest, grid_sql, machine_sql, table
from tickwatch.model import CUSTOM_METRICS_TYPE, RULE_DDL, SEARCH_TYPE, SOURCE_DDL, Rule, Search, load_rules, local_frame, resolve_rules
from tickwatch.operators import quality, state
from tickwatch.plans.catalog import plan_catalog
from tickwatch.sources.sinks import run_dir


@register(
    "source_resolution",
    """
    WITH rules AS (
      SELECT c_custkey, lower(c_mktsegment) AS namespace, 'src-' || (c_nationkey % 10) AS source,
             CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE 'region-' || (c_custkey % 7) END AS source_ns
      FROM customer),
    sources AS (
      SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'region-' || (s_nationkey % 5) END AS ns,
             'src-' || (s_nationkey % 8) AS name FROM supplier)
    SELECT r.c_custkey AS rule, s.name IS NOT NULL AS found,
           CASE WHEN s.name IS NOT NULL THEN '/logs/' || ns || '/' || name END AS path
    FROM rules r LEFT JOIN sources s ON coalesce(r.source_ns, '') = s.ns AND r.source = s.name""",
)
def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "customer").selectExpr(
        "lower(c_mktsegment) as namespace",
        "c_custkey as rule",
        """named_struct('name', 'src-' || cast(c_nationkey % 10 as string), 'namespace',
           case c_custkey % 3 when 0 then null when 1 then '' else 'region-' || cast(c_custkey % 7 as string) end) as source""",
    )
    sources = table(spark, sf_dir, "supplier").selectExpr(
        "if(s_suppkey % 2 = 0, '', 'region-' || cast(s_nationkey % 5 as string)) as namespace",
        "'src-' || cast(s_nationkey % 8 as string) as name",
    ).distinct()
    sources = sources.selectExpr(
        "namespace", "name", "'/logs/' || namespace || '/' || name as path", "'ts' as ts_col", "true as has_credentials"
    )
    out = quality.resolve_sources(rules, sources)
    return out.select("rule", F.col("source_path").isNotNull().alias("found"), F.col("source_path").alias("path"))


_EVERY_KIND = [
    Rule("ops", "error-burst", Search(filter="event_type = 'error'", window="60m"), "greaterThan", "3", "60m", "30m", source=("events", ""), index="events"),
    Rule("shop", "large-orders", Search(filter="o_totalprice > 200000", window="24h"), "greaterThan", "5", "0s", "24h", source=("orders", ""), index="orders"),
    Rule("bad", "threshold", Search(), threshold="x", source=("events", ""), index="events"),
    Rule("bad", "for", Search(), for_="abc", source=("events", ""), index="events"),
    Rule("bad", "interval", Search(), check_interval="0s", source=("events", ""), index="events"),
    Rule("bad", "operator", Search(), operator="near", source=("events", ""), index="events"),
    Rule("bad", "source", Search(), source=("nowhere", ""), index="events"),
    Rule("bad", "secret", Search(), source=("locked", ""), index="events"),
    Rule("bad", "index", Search(), source=("events", ""), index="no_such_index"),
    Rule("bad", "window", Search(window="abc"), source=("events", ""), index="events"),
    Rule("bad", "round", Search(round="w"), source=("events", ""), index="events"),
    Rule("bad", "metric", Search(metric="median", field="value"), source=("events", ""), index="events"),
    Rule("bad", "field", Search(metric="avg"), source=("events", ""), index="events"),
    Rule("bad", "column", Search(filter="no_such_column = 1"), source=("orders", ""), index="orders"),
    Rule("bad", "filter", Search(filter="value"), source=("events", ""), index="events"),
]


@register(
    "catalog_outcomes",
    "WITH" + grid_sql(30) + """,
    err AS (SELECT g.tick, count(e.event_id) AS n FROM grid g LEFT JOIN events e
            ON e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick AND e.event_type = 'error' GROUP BY g.tick),
    days AS (SELECT unnest(generate_series(min(o_orderdate) + INTERVAL 1 DAY, max(o_orderdate) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS tick FROM orders),
    big AS (SELECT d.tick, count(o.o_orderkey) AS n FROM days d LEFT JOIN orders o
            ON o.o_orderdate = d.tick - INTERVAL 1 DAY AND o.o_totalprice > 200000 GROUP BY d.tick)
    SELECT 'ops' AS namespace, 'error-burst' AS rule, 'ok' AS outcome, count(*) AS n_ticks, sum(n)::BIGINT AS hits, count(*) FILTER (WHERE n > 3) AS n_firing FROM err
    UNION ALL SELECT 'shop', 'large-orders', 'ok', count(*), sum(n)::BIGINT, count(*) FILTER (WHERE n > 5) FROM big
    UNION ALL SELECT 'bad', rule, outcome, 0, NULL, NULL FROM (VALUES ('threshold', 'bad_condition'), ('for', 'bad_for'),
      ('interval', 'bad_interval'), ('operator', 'bad_condition'), ('source', 'source_not_found'), ('secret', 'no_credentials'),
      ('index', 'query_error'), ('window', 'query_error'), ('round', 'query_error'), ('metric', 'query_error'),
      ('field', 'query_error'), ('column', 'query_error'), ('filter', 'query_error')) b(rule, outcome)""",
)
def catalog_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of documents over two logs, with every kind of broken rule."""
    path = run_dir(spark, "rules")
    rules = local_frame(spark, [r.row() for r in _EVERY_KIND], RULE_DDL)
    rules.agg(F.to_json(F.collect_list(F.struct("*"))).alias("documents")).write.text(path)
    names = [c.split()[0] for c in SOURCE_DDL.split(", ")]
    known = [("", "events", sf_dir, "parquet", "ts", True), ("", "orders", sf_dir, "parquet", "o_orderdate", True), ("", "locked", sf_dir, "parquet", "ts", False)]
    plan = plan_catalog(spark, load_rules(spark, path), local_frame(spark, [dict(zip(names, s)) for s in known], SOURCE_DDL))
    counts = plan.states.groupBy("namespace", "rule").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.sum("hits").alias("hits"), F.count_if("firing").alias("n_firing")
    )
    return plan.outcomes.drop("detail").join(counts, ["namespace", "rule"], "left").withColumn("n_ticks", F.coalesce("n_ticks", F.lit(0).cast("bigint")))


def _runtime(name: str, namespace: str = "bad", **asked) -> Rule:
    return Rule(namespace, name, Search(window="60m", **asked), threshold="3", for_="60m", check_interval="30m", source=("events", ""), index="events")


_FAIL_LATE = [
    _runtime("error-burst", "ops", filter="event_type = 'error'"),
    _runtime("error-share", "ops", filter="true", metric="pct", part="event_type = 'error'"),
    _runtime("cast", filter="cast(if(event_id % 97 = 0, 'x', '7') as int) = 7 and event_type = 'view'"),
    _runtime("same-cast", filter="cast(if(event_id % 97 = 0, 'x', '7') as int) < 9 and event_type = 'error'"),
    _runtime("text-average", filter="event_type = 'purchase'", metric="avg", field="event_type"),
    _runtime("division", filter="event_type = 'view'", metric="sum", field="value / (user_id % 50)"),
    _runtime("assertion", filter="event_type = 'error'", metric="pct", part="assert_true(user_id % 40 <> 0) is null"),
    _runtime("bucket", filter="event_type = 'signup'", group_by="element_at(array('a', 'b', 'c'), cast(user_id % 4 as int))", pick="top"),
]


@register(
    "catalog_runtime_errors",
    "WITH" + grid_sql(30) + """,
    e AS (
      SELECT ts, rule, event_type = 'error' AND rule = 'error-share' AS part,
        CASE rule WHEN 'cast' THEN event_id % 97 = 0 WHEN 'same-cast' THEN event_id % 97 = 0 WHEN 'text-average' THEN true
          WHEN 'division' THEN user_id % 50 = 0 WHEN 'assertion' THEN user_id % 40 = 0 WHEN 'bucket' THEN user_id % 4 = 0 ELSE false END AS bad,
        CASE rule WHEN 'division' THEN value / nullif(user_id % 50, 0) END AS x, user_id % 4 AS bucket
      FROM events, (VALUES ('error-burst', 'error'), ('error-share', NULL), ('cast', 'view'), ('same-cast', 'error'), ('text-average', 'purchase'),
        ('division', 'view'), ('assertion', 'error'), ('bucket', 'signup')) r(rule, kind)
      WHERE kind IS NULL OR event_type = kind OR (rule IN ('cast', 'same-cast') AND event_id % 97 = 0)),
    rules AS (SELECT DISTINCT rule, CASE WHEN rule LIKE 'error-%' THEN 'ops' ELSE 'bad' END AS namespace,
      CASE rule WHEN 'cast' THEN 'filter' WHEN 'same-cast' THEN 'filter' WHEN 'text-average' THEN 'field' WHEN 'division' THEN 'field'
        WHEN 'assertion' THEN 'part' ELSE 'group_by' END AS kind FROM e),
    v AS (
      SELECT r.namespace, r.rule, r.kind, g.tick, count(*) FILTER (WHERE bad) AS n_bad, count(*) FILTER (WHERE NOT bad) AS hits,
        CASE r.rule WHEN 'error-share' THEN coalesce(100.0::DOUBLE * count(*) FILTER (WHERE part) / nullif(count(*) FILTER (WHERE NOT bad), 0), 0)
          WHEN 'assertion' THEN CASE WHEN count(*) FILTER (WHERE NOT bad) > 0 THEN 100.0 ELSE 0 END
          WHEN 'text-average' THEN 0 WHEN 'division' THEN coalesce(sum(x), 0)
          WHEN 'bucket' THEN greatest(count(*) FILTER (WHERE bucket = 1), count(*) FILTER (WHERE bucket = 2), count(*) FILTER (WHERE bucket = 3))
          ELSE count(*) FILTER (WHERE NOT bad) END AS value
      FROM rules r CROSS JOIN grid g LEFT JOIN e ON e.rule = r.rule AND e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick
      GROUP BY r.namespace, r.rule, r.kind, g.tick)
    SELECT namespace, rule, count(*) AS n_ticks, count(*) FILTER (WHERE n_bad > 0) AS n_failed,
      CASE WHEN arg_max(n_bad, tick) > 0 THEN 'query_error' ELSE 'ok' END AS outcome,
      CASE WHEN arg_max(n_bad, tick) > 0 THEN any_value(kind) || ' fails on ' || arg_max(n_bad, tick) || ' rows' END AS detail,
      arg_max(n_bad, tick) = 0 AS synced, coalesce(sum(hits) FILTER (WHERE n_bad = 0), 0)::BIGINT AS hits,
      count(*) FILTER (WHERE n_bad = 0 AND value > 3) AS n_firing
    FROM v GROUP BY namespace, rule""",
)
def catalog_runtime_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose expressions fail on some rows, beside good ones: each fails alone, at the ticks that see such rows."""
    rules = local_frame(spark, [r.row() for r in _FAIL_LATE], RULE_DDL)
    names = [c.split()[0] for c in SOURCE_DDL.split(", ")]
    sources = local_frame(spark, [dict(zip(names, ("", "events", sf_dir, "parquet", "ts", True)))], SOURCE_DDL)
    plan = plan_catalog(spark, rules, sources)
    keys = ["namespace", "rule"]
    synced = plan.status().where("type = 'ResourceSynced'").select(*keys, F.col("status").alias("synced"))
    good = plan.states.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.count_if("firing").alias("n_firing"))
    out = plan.run_outcomes().join(synced, keys, "left").join(good, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("hits", "n_firing")})


def _metric(name: str, label: str) -> list[dict]:
    return [{"name": name, "aggregation_map": "by_key.buckets", "value": "doc_count", "labels": [{"name": label, "value": "key"}]}]


_DAILY = dict(threshold="1000000", for_="0s", check_interval="24h")
_TWO_LOGS = [
    Rule("ops", "kinds", Search(window="24h", group_by="event_type", pick="top"), source=("events", ""), index="events", custom_metrics=_metric("rows_by", "kind"), **_DAILY),
    # the same metric with other labels, in another log: it gives way
    Rule("shop", "statuses", Search(window="24h", group_by="o_orderstatus", pick="top"), source=("orders", ""), index="orders", custom_metrics=_metric("rows_by", "status"), **_DAILY),
    Rule("shop", "priorities", Search(window="24h", group_by="o_orderpriority", pick="top"), source=("orders", ""), index="orders", custom_metrics=_metric("orders_by", "priority"), **_DAILY),
]


@register(
    "catalog_samples",
    """
    SELECT date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS tick, 'searchrule_rows_by' AS metric, 'kinds' AS rule, event_type AS label, count(*)::DOUBLE AS value
    FROM events GROUP BY 1, 4
    UNION ALL SELECT o_orderdate::TIMESTAMP + INTERVAL 1 DAY, 'searchrule_orders_by', 'priorities', o_orderpriority, count(*)::DOUBLE FROM orders GROUP BY 1, 4""",
)
def catalog_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom samples of a catalog over two logs; which labels a metric has is settled across both."""
    rules = local_frame(spark, [r.row() for r in _TWO_LOGS], RULE_DDL)
    names = [c.split()[0] for c in SOURCE_DDL.split(", ")]
    known = [("", "events", sf_dir, "parquet", "ts", True), ("", "orders", sf_dir, "parquet", "o_orderdate", True)]
    plan = plan_catalog(spark, rules, local_frame(spark, [dict(zip(names, s)) for s in known], SOURCE_DDL))
    rows = plan.samples().where("metric in ('searchrule_rows_by', 'searchrule_orders_by')")
    label = F.coalesce(F.col("labels")["kind"], F.col("labels")["status"], F.col("labels")["priority"])
    return rows.select("tick", "metric", F.col("labels")["rule"].alias("rule"), label.alias("label"), "value")


@register(
    "unresolved_sources",
    """
    WITH r AS (
      SELECT c_custkey AS rule, 'src-' || (c_nationkey % 10) AS name,
             CASE WHEN c_custkey % 3 = 2 THEN 'region-' || (c_custkey % 7) ELSE '' END AS namespace
      FROM customer),
    s AS (SELECT 'src-' || (s_nationkey % 8) AS name,
                 CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'region-' || (s_nationkey % 5) END AS namespace FROM supplier)
    SELECT rule FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.name = r.name AND s.namespace = r.namespace)""",
)
def unresolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # cluster scope is written as NULL or as an empty namespace
    rules = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as rule",
        """named_struct('name', 'src-' || cast(c_nationkey % 10 as string), 'namespace',
           case c_custkey % 3 when 0 then null when 1 then '' else 'region-' || cast(c_custkey % 7 as string) end) as source""",
    )
    sources = table(spark, sf_dir, "supplier").selectExpr(
        "if(s_suppkey % 2 = 0, '', 'region-' || cast(s_nationkey % 5 as string)) as namespace",
        "'src-' || cast(s_nationkey % 8 as string) as name",
    )
    return quality.unresolved(rules, sources).select("rule")


_LINT_RULES = {
    "namespace": "lower(c_mktsegment)",
    "name": "lower(replace(c_name, '#', '-'))",
    "k": "c_custkey",
    "check_interval": "case c_custkey % 6 when 0 then '30s' when 1 then '1m' when 2 then 'abc' when 3 then '5' when 4 then '2h30m' else '' end",
    "operator": """case c_custkey % 7 when 0 then 'greaterThan' when 1 then 'greaterThanOrEqual' when 2 then 'lessThan'
        when 3 then 'lessThanOrEqual' when 4 then 'equal' when 5 then 'unknown' else '' end""",
    "threshold": """case c_nationkey % 5 when 0 then '100' when 1 then '0.5' when 2 then '1e3' when 3 then 'not_a_number'
        else '100 or vector(0)' end""",
    "for_text": "case c_custkey % 5 when 0 then '1m' when 1 then '500ms' when 2 then '2h30m' when 3 then '' else '-' end",
    "query_json": "case when c_custkey % 11 in (1, 2) then '{}' else null end",
    "value_path": "case when c_custkey % 17 = 0 then 'a.#.b' else 'hits.total.value' end",
    "metric_name": """case c_custkey % 13 when 1 then 'with-hyphen' when 2 then 'value' when 3 then '' when 4 then 'a' when 5 then '_b'
        when 6 then 'c' when 8 then 'errors_by_host' end""",
    "label_names": """case c_custkey % 13 when 4 then 'with-hyphen' when 5 then 'host,rule' when 6 then 'host,host'
        when 8 then 'host' else '' end""",
    "metric_map": "case when c_custkey % 13 = 8 then 'aggregations.by.buckets' else 'by.buckets' end",
}


def _customer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per customer, with every kind of mistake somewhere."""
    rows = table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in _LINT_RULES.items()])
    one = F.struct(
        F.col("metric_name").alias("name"),
        F.lit(None).cast("string").alias("help"),
        F.col("metric_map").alias("aggregation_map"),
        F.transform(
            F.filter(F.split("label_names", ","), lambda n: n != ""),
            lambda n: F.struct(n.alias("name"), n.alias("value"), F.lit(False).alias("static")),
        ).alias("labels"),
        F.lit(None).cast("string").alias("value"),
    )
    eleven = F.transform(
        F.sequence(F.lit(0), F.lit(10)),
        lambda i: F.struct(
            F.concat(F.lit("m"), i.cast("string")).alias("name"), F.lit(None).cast("string").alias("help"),
            F.lit("by.buckets").alias("aggregation_map"),
            F.array().cast("array<struct<name:string,value:string,static:boolean>>").alias("labels"),
            F.lit(None).cast("string").alias("value"),
        ),
    )
    k = F.col("k")
    return resolve_rules(
        rows.select(
            "namespace",
            "name",
            "check_interval",
            "query_json",
            F.when(
                ~(k % 11).isin(0, 2),
                F.from_json(F.to_json(F.struct(F.lit("true").alias("filter"), "value_path")), SEARCH_TYPE),
            ).alias("search"),
            F.struct("operator", "threshold", F.col("for_text").alias("for")).alias("condition"),
            F.when(k % 4 != 0, F.struct(F.lit("pager").alias("name"))).alias("action"),
            F.when(
                k % 8 == 0, F.struct(F.lit(True).alias("enabled"), F.when(k % 3 == 0, "typo").alias("metric_name"))
            ).when(k % 8 == 4, F.struct(F.lit(False).alias("enabled"), F.lit(None).cast("string").alias("metric_name"))).alias("series_alert"),
            F.when(F.col("metric_name").isNotNull(), F.array(one))
            .when(k % 13 == 7, eleven)
            .cast(CUSTOM_METRICS_TYPE)
            .alias("custom_metrics"),
        )
    )


_LINT_SQL = "WITH r AS (SELECT " + ", ".join(
    f"{e} AS {n}" for n, e in _LINT_RULES.items()
) + ", c_nationkey % 5 AS t FROM customer)"


@register(
    "rule_lint",
    _LINT_SQL + """
    SELECT namespace, name AS rule, 'operator_unknown' AS code, operator AS message FROM r WHERE k % 7 IN (5, 6)
    UNION ALL SELECT namespace, name, 'threshold_invalid', threshold FROM r WHERE t IN (3, 4)
    UNION ALL SELECT namespace, name, 'for_invalid', for_text FROM r WHERE k % 5 IN (3, 4)
    UNION ALL SELECT namespace, name, 'check_interval_invalid', check_interval FROM r WHERE k % 6 IN (2, 3, 5)
    UNION ALL SELECT namespace, name, 'query_missing', 'no query' FROM r WHERE k % 11 = 0
    UNION ALL SELECT namespace, name, 'query_twice', 'two queries' FROM r WHERE k % 11 = 1
    UNION ALL SELECT namespace, name, 'output_missing', 'no output' FROM r WHERE k % 4 = 0 AND k % 8 <> 0
    UNION ALL SELECT namespace, name, 'too_many_metrics', '11' FROM r WHERE k % 13 = 7
    UNION ALL SELECT namespace, name, 'value_path_unsupported', value_path FROM r WHERE k % 17 = 0 AND k % 11 NOT IN (0, 2)
    UNION ALL SELECT namespace, name, CASE k % 13 WHEN 1 THEN 'metric_name_invalid' WHEN 2 THEN 'metric_name_reserved'
      WHEN 3 THEN 'metric_name_required' WHEN 4 THEN 'label_name_invalid' WHEN 5 THEN 'label_name_reserved'
      ELSE 'label_name_duplicate' END, metric_name FROM r WHERE k % 13 BETWEEN 1 AND 6
    UNION ALL SELECT namespace, name, 'aggregation_prefix', metric_map FROM r WHERE k % 13 = 8""",
)
def rule_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.lint(_customer_rules(spark, sf_dir))


@register(
    "output_reason",
    _LINT_SQL + """,
    x AS (SELECT *, CASE WHEN k % 13 BETWEEN 1 AND 6 THEN 'CustomMetricsInvalid'
                 WHEN t IN (3, 4) OR k % 5 IN (3, 4) OR k % 7 IN (5, 6) THEN 'PrometheusRuleError'
                 WHEN k % 3 = 0 AND k % 13 IN (7, 8) THEN 'MetricNameMismatch' ELSE 'Synced' END AS reason
          FROM r WHERE k % 8 = 0)
    SELECT namespace, name AS rule, reason, reason NOT IN ('CustomMetricsInvalid', 'PrometheusRuleError') AS status,
      CASE WHEN reason = 'MetricNameMismatch' THEN 'metric_name=typo matches no declared metric; falling back to '
           || CASE k % 13 WHEN 7 THEN 'm0' ELSE 'errors_by_host' END END AS message
    FROM x""",
)
def output_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.output_reason(_customer_rules(spark, sf_dir))


@register(
    "tick_outcome",
    """
    SELECT event_id, CASE
      WHEN user_id % 23 = 0 THEN 'source_not_found'
      WHEN user_id % 29 = 0 THEN 'no_credentials'
      WHEN user_id % 31 = 0 THEN 'bad_for'
      WHEN user_id % 37 = 0 OR user_id % 41 = 0 THEN 'no_query'
      WHEN event_id % 17 = 0 THEN 'connection_error'
      WHEN event_id % 19 = 0 THEN 'query_error'
      WHEN event_type = 'signup' THEN 'path_missing'
      WHEN user_id % 43 = 0 OR user_id % 47 = 0 THEN 'bad_condition'
      ELSE 'ok' END AS outcome FROM events""",
)
def tick_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each event stands for one tick of its user's rule and carries the answer of the search
    ticks = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "if(user_id % 23 = 0, null, '/logs') as source_path",
        "user_id % 29 <> 0 as has_credentials",
        "if(user_id % 31 = 0, 'soon', '5m') as for_text",
        "if(user_id % 37 = 0, null, named_struct('filter', 'true')) as search",
        "if(user_id % 41 = 0, '{}', '') as query_json",
        "case when event_id % 17 = 0 then null when event_id % 19 = 0 then 503 else 200 end as status_code",
        "event_type <> 'signup' as path_found",
        "named_struct('operator', if(user_id % 43 = 0, 'near', 'equal'), 'threshold', if(user_id % 47 = 0, 'x', '1'), 'for', if(user_id % 31 = 0, 'soon', '5m')) as condition",
        "named_struct('name', '') as source",
        "'30s' as check_interval",
    )
    return resolve_rules(ticks).select("event_id", quality.outcome().alias("outcome"))


@register(
    "rules_listing",
    STATE_SQL + """,
    l AS (SELECT namespace, rule, any_value(description) AS description, arg_max(state, tick) AS state,
                 max(tick) AS tick FROM times GROUP BY namespace, rule)
    SELECT l.namespace || '_' || l.rule AS alertname, l.namespace, l.description, l.description AS summary,
      CASE l.state WHEN 'Normal' THEN 'resolved' WHEN 'Firing' THEN 'firing' ELSE 'pending' END AS state,
      coalesce(strftime(t.firing_time, '%Y-%m-%d %H:%M:%S'), '') AS active_at
    FROM l JOIN times t ON t.namespace = l.namespace AND t.rule = l.rule AND t.tick = l.tick""",
)
def rules_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(spark, sf_dir).listing()


@register(
    "rule_by_key",
    STATE_SQL + """
    SELECT 'ops_error-burst' AS alertname, CASE arg_max(state, tick) WHEN 'Normal' THEN 'resolved' WHEN 'Firing' THEN 'firing'
      ELSE 'pending' END AS state FROM st WHERE namespace = 'ops' AND rule = 'error-burst'""",
)
def rule_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.by_key(backtest(spark, sf_dir).listing(), "ops_error-burst").select("alertname", "state")


@register(
    "status_latest",
    "WITH " + VALUES_SQL + "," + FIRING_SQL + """,
    good AS (SELECT * FROM cond WHERE hits % 7 <> 3),""" + machine_sql("good") + """,
    c AS (
      SELECT namespace, rule, 'State' AS type, TRUE AS status, tick AS ts,
        CASE state WHEN 'Normal' THEN 'Normal' WHEN 'Firing' THEN 'AlertFiring' WHEN 'PendingFiring' THEN 'PendingAlertFiring'
             ELSE 'PendingAlertResolved' END AS reason,
        CASE state WHEN 'Normal' THEN 'Rule is normal' WHEN 'Firing' THEN 'Alert is firing' WHEN 'PendingFiring' THEN 'Pending alert firing'
             ELSE 'Pending alert resolved' END AS message FROM st
      UNION ALL
      SELECT namespace, rule, 'State', TRUE, tick, 'QueryError', 'query_error' FROM cond WHERE hits % 7 = 3
      UNION ALL
      SELECT namespace, rule, 'ResourceSynced', hits % 7 <> 3, tick,
        CASE WHEN hits % 7 = 3 THEN 'KubernetesApiCallError' ELSE 'TargetSynced' END,
        CASE WHEN hits % 7 = 3 THEN 'query_error' ELSE 'Target was successfully synced' END FROM cond)
    SELECT namespace, rule, type, max(ts) AS ts, arg_max(status, ts) AS status, arg_max(reason, ts) AS reason,
      arg_max(message, ts) AS message
    FROM c WHERE NOT (rule = 'quiet-signups' AND type = 'ResourceSynced') GROUP BY namespace, rule, type""",
)
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = backtest(spark, sf_dir)
    # a search that answers 3, 10, 17 ... hits stands for one that failed
    failed = F.col("hits") % 7 == 3
    rows = run.evaluated.withColumn("outcome", F.when(failed, "query_error").otherwise("ok"))
    good = rows.withColumn("firing", F.when(F.col("outcome") == "ok", F.col("firing")))
    conditions = quality.condition_rows(state.states(good)).unionByName(quality.outcome_rows(rows))
    removed = run.catalog.where(F.col("action").isNull()).select(
        "namespace", F.col("name").alias("rule"), F.lit("ResourceSynced").alias("type")
    )
    return quality.latest_status(conditions, removed)
