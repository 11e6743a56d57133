"""Scans, filters, windows and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import register
from queries.common import grid_sql, table
from tickwatch.functions.conditions import compare, threshold_value
from tickwatch.functions.durations import duration_micros, duration_nanos
from tickwatch.functions.jsonpath import as_double, extract, variant_kind, was_coerced
from tickwatch.model import OPERATORS, Rule, Search
from tickwatch.operators import search
from tickwatch.operators.many import rule_windows
from tickwatch.sources.logs import scan_index


@register(
    "scan_total_hits",
    "SELECT count(*) AS total_hits FROM events WHERE value >= 49.9 AND event_type = 'error'",
)
def scan_total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hit = search.must(search.in_range(F.col("value"), gte=49.9), F.col("event_type") == "error")
    return search.total_hits(events, hit)


@register(
    "scan_index_pattern",
    """
    SELECT log, kind, count(*) AS n, count(value) AS with_value, count(o_totalprice) AS with_price FROM (
      SELECT 'events' AS log, event_type AS kind, value, NULL::DOUBLE AS o_totalprice FROM events
      UNION ALL SELECT 'orders', o_orderstatus, NULL, o_totalprice FROM orders)
    GROUP BY log, kind""",
)
def scan_index_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = scan_index(spark, sf_dir, "event*,orders")
    return logs.groupBy(
        F.when(F.col("event_id").isNotNull(), "events").otherwise("orders").alias("log"),
        F.coalesce("event_type", "o_orderstatus").alias("kind"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("with_value"),
        F.count("o_totalprice").alias("with_price"),
    )


@register(
    "bool_must_filter",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
    WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_discount > 0.02
      AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'
    GROUP BY l_returnflag, l_linestatus""",
)
def bool_must_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    ship = F.col("l_shipdate")
    hit = search.must(
        search.in_range(F.col("l_quantity"), gte=10.0, lte=40.0),
        search.in_range(F.col("l_discount"), gt=0.02),
        (ship >= F.lit("1996-01-01").cast("timestamp_ntz")) & (ship < F.lit("2000-01-01").cast("timestamp_ntz")),
    )
    return items.where(hit).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@register(
    "avg_metric",
    "WITH" + grid_sql(60) + """
    SELECT g.tick, count(e.event_id) AS hits, round(avg(e.value), 9) AS raw_value,
           round(coalesce(avg(e.value), 0), 9) AS value
    FROM grid g LEFT JOIN events e
      ON e.event_type = 'purchase' AND e.ts >= g.tick - INTERVAL 1 HOUR AND e.ts < g.tick
    GROUP BY g.tick""",
)
def avg_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule(
        "shop", "avg", Search(filter="event_type = 'purchase'", window="1h", metric="avg", field="value"),
        check_interval="1h",
    )
    out = search.tick_values(table(spark, sf_dir, "events"), [rule])
    return out.select(
        "tick", "hits", F.round("raw_value", 9).alias("raw_value"), F.round("value", 9).alias("value")
    )


@register(
    "terms_top",
    """
    WITH c AS (SELECT user_id AS key, count(*) AS doc_count, sum(value) AS total FROM events GROUP BY user_id),
    r AS (SELECT *, row_number() OVER (ORDER BY doc_count DESC, key) AS rn FROM c)
    SELECT (rn - 1)::INTEGER AS position, key, doc_count, round(total, 4) AS total,
           ((SELECT sum(doc_count) FROM c) - sum(doc_count) OVER ())::BIGINT AS sum_other_doc_count
    FROM r WHERE rn <= 10""",
)
def terms_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.terms(table(spark, sf_dir, "events"), F.col("user_id"), metrics={"total": F.col("value")})
    return out.withColumn("total", F.round("total", 4))


_RANGES = [
    ("all", "1995-01-01", "2002-01-01"),
    ("first-half", "1995-01-01", "1998-07-01"),
    ("mid", "1997-01-01", "1999-01-01"),
    ("last-year", "2000-08-01", "2001-08-01"),
]


@register(
    "date_range_terms",
    """
    WITH ranges(range, a, b) AS (VALUES
      ('all', TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01'),
      ('first-half', TIMESTAMP '1995-01-01', TIMESTAMP '1998-07-01'),
      ('mid', TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01'),
      ('last-year', TIMESTAMP '2000-08-01', TIMESTAMP '2001-08-01'))
    SELECT range, o_orderpriority AS key, count(*) AS doc_count
    FROM ranges JOIN orders ON o_orderdate >= a AND o_orderdate < b GROUP BY range, o_orderpriority""",
)
def date_range_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return search.date_range_terms(orders, F.col("o_orderdate"), _RANGES, F.col("o_orderpriority"))


@register(
    "error_pct_by_key",
    """
    SELECT user_id AS key, count(*) AS doc_count, count(*) FILTER (WHERE event_type = 'error') AS part_count,
           round(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'error') / count(*), 9) AS percentage
    FROM events GROUP BY user_id""",
)
def error_pct_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.ratio_by_key(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type") == "error")
    return out.withColumn("percentage", F.round("percentage", 9))


_EXTREME = Search(window="6h", metric="max", field="value", group_by="event_type")


@register(
    "max_bucket_value",
    "WITH" + grid_sql(120) + """,
    b AS (
      SELECT g.tick, e.event_type AS bucket, count(*) AS doc_count, max(e.value) AS value
      FROM grid g JOIN events e ON e.ts >= g.tick - INTERVAL 6 HOUR AND e.ts < g.tick
      GROUP BY g.tick, e.event_type),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY tick ORDER BY value DESC, bucket) AS hi,
             row_number() OVER (PARTITION BY tick ORDER BY value, bucket) AS lo,
             row_number() OVER (PARTITION BY tick ORDER BY doc_count DESC, bucket) AS top
      FROM b)
    SELECT tick, 'max_bucket' AS pick, bucket, doc_count, value FROM r WHERE hi = 1
    UNION ALL SELECT tick, 'min_bucket', bucket, doc_count, value FROM r WHERE lo = 1
    UNION ALL SELECT tick, 'top', bucket, doc_count, value FROM r WHERE top = 1""",
)
def max_bucket_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("shop", "extreme", _EXTREME, check_interval="2h")
    buckets = search.bucket_values(table(spark, sf_dir, "events"), [rule])
    picks = [
        search.pick_bucket(buckets, ["tick"], p).withColumn("pick", F.lit(p))
        for p in ("max_bucket", "min_bucket", "top")
    ]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


@register(
    "aggregation_payload",
    "WITH" + grid_sql(360) + """,
    b AS (
      SELECT g.tick, e.event_type AS key, count(*) AS doc_count, sum(e.value) AS value
      FROM grid g JOIN events e ON e.ts >= g.tick - INTERVAL 12 HOUR AND e.ts < g.tick
      GROUP BY g.tick, e.event_type),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY tick ORDER BY doc_count DESC, key) AS rn,
             sum(doc_count) OVER (PARTITION BY tick) AS total FROM b)
    SELECT tick, total::BIGINT AS hits, (rn - 1)::INTEGER AS pos, key, doc_count, round(value, 4) AS value,
           (total - sum(doc_count) OVER (PARTITION BY tick))::BIGINT AS other
    FROM r WHERE rn <= 3""",
)
def aggregation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule(
        "shop", "mix", Search(window="12h", metric="sum", field="value", group_by="event_type"), check_interval="6h"
    )
    events = table(spark, sf_dir, "events")
    bodies = search.responses(search.bucket_values(events, [rule]), search.tick_values(events, [rule]), size=3)
    doc = bodies.withColumn("doc", F.try_parse_json("body"))
    items = F.posexplode(extract(F.col("doc"), "aggregations.by_key.buckets").cast("array<variant>"))
    return doc.select(
        "tick",
        extract(F.col("doc"), "hits.total.value").cast("bigint").alias("hits"),
        extract(F.col("doc"), "aggregations.by_key.sum_other_doc_count").cast("bigint").alias("other"),
        items.alias("pos", "bucket"),
    ).select(
        "tick",
        "hits",
        "other",
        "pos",
        extract(F.col("bucket"), "key").cast("string").alias("key"),
        extract(F.col("bucket"), "doc_count").cast("bigint").alias("doc_count"),
        F.round(as_double(extract(F.col("bucket"), "metric.value")), 4).alias("value"),
    )


_ROLLING = [
    Rule("ops", "count-5m", Search(filter="event_type = 'error'", window="5m"), check_interval="5m"),
    Rule("ops", "count-90m", Search(filter="event_type <> 'view'", window="90m"), check_interval="20m"),
    Rule("ops", "rounded", Search(filter="event_type = 'click'", window="3h", round="h"), check_interval="20m"),
    Rule("shop", "low", Search(filter="event_type = 'purchase'", window="2h", metric="min", field="value"), check_interval="30m"),
    Rule("shop", "sum-day", Search(filter="true", window="24h", metric="sum", field="value"), check_interval="1h"),
    Rule("shop", "top-share", Search(filter="true", window="4h", group_by="event_type", pick="top"), check_interval="1h"),
]


@register(
    "rolling_window_value",
    "WITH" + ",".join(grid_sql(m, f"g{m}") for m in (5, 20, 30, 60)) + """,
    v AS (
      SELECT 'count-5m' AS rule, g.tick, count(e.event_id) AS hits, count(e.event_id)::DOUBLE AS value FROM g5 g LEFT JOIN events e
        ON e.event_type = 'error' AND e.ts >= g.tick - INTERVAL 5 MINUTE AND e.ts < g.tick GROUP BY g.tick
      UNION ALL
      SELECT 'count-90m', g.tick, count(e.event_id), count(e.event_id) FROM g20 g LEFT JOIN events e
        ON e.event_type <> 'view' AND e.ts >= g.tick - INTERVAL 90 MINUTE AND e.ts < g.tick GROUP BY g.tick
      UNION ALL
      SELECT 'rounded', g.tick, count(e.event_id), count(e.event_id) FROM g20 g LEFT JOIN events e
        ON e.event_type = 'click' AND e.ts >= date_trunc('hour', g.tick) - INTERVAL 3 HOUR
           AND e.ts < date_trunc('hour', g.tick) GROUP BY g.tick
      UNION ALL
      SELECT 'low', g.tick, count(e.event_id), coalesce(min(e.value), 0) FROM g30 g LEFT JOIN events e
        ON e.event_type = 'purchase' AND e.ts >= g.tick - INTERVAL 2 HOUR AND e.ts < g.tick GROUP BY g.tick
      UNION ALL
      SELECT 'sum-day', g.tick, count(e.event_id), coalesce(sum(e.value), 0) FROM g60 g LEFT JOIN events e
        ON e.ts >= g.tick - INTERVAL 24 HOUR AND e.ts < g.tick GROUP BY g.tick
      UNION ALL
      SELECT 'top-share', tick, sum(n)::BIGINT, coalesce(max(n), 0) FROM (
        SELECT g.tick, e.event_type, count(e.event_id) AS n FROM g60 g LEFT JOIN events e
          ON e.ts >= g.tick - INTERVAL 4 HOUR AND e.ts < g.tick GROUP BY g.tick, e.event_type) GROUP BY tick)
    SELECT rule, tick, hits, round(value, 4) AS value FROM v""",
)
def rolling_window_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.tick_values(table(spark, sf_dir, "events"), _ROLLING)
    return out.select("rule", "tick", "hits", F.round("value", 4).alias("value"))


_BODY = """
    CASE event_id % 8
      WHEN 0 THEN '{"hits":{"total":{"value":' || k || '}}}'
      WHEN 1 THEN '{"hits":{"total":{"value":"' || k || '.50"}}}'
      WHEN 2 THEN '{"hits":{"total":{"value":null}}}'
      WHEN 3 THEN '{"hits":{"total":{}}}'
      WHEN 4 THEN '{"hits":{"total":{"value":"' || event_type || '"}}}'
      WHEN 5 THEN '{"hits":{"total":{"value":' || k || '.25}},"aggregations":{"by":{"buckets":[{"doc_count":' || k || '}]}}}'
      WHEN 6 THEN '{"hits":{"total":{"value":[' || k || ']}}}'
      ELSE 'not json ' || k END"""


@register(
    "json_condition_value",
    f"""
    WITH p AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
    b AS (SELECT event_id, {_BODY} AS body FROM p),
    j AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS doc FROM b),
    x AS (
      SELECT event_id, json_type(doc, '$.hits.total.value') AS t, json_extract_string(doc, '$.hits.total.value') AS v,
             json_extract_string(doc, '$.aggregations.by.buckets[0].doc_count') AS d
      FROM j)
    SELECT event_id,
      CASE WHEN t IS NULL THEN NULL WHEN t IN ('UBIGINT', 'BIGINT') THEN 'number' WHEN t = 'DOUBLE' THEN 'number'
           WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'NULL' THEN 'null' ELSE 'array' END AS kind,
      t IS NOT NULL AS path_found,
      CASE WHEN t IS NULL THEN NULL WHEN t = 'ARRAY' THEN 0 ELSE coalesce(try_cast(v AS DOUBLE), 0) END AS value,
      CASE WHEN t IS NULL THEN NULL WHEN t IN ('ARRAY', 'NULL') THEN TRUE ELSE try_cast(v AS DOUBLE) IS NULL END AS coerced,
      try_cast(d AS DOUBLE) AS top_doc_count
    FROM x""",
)
def json_condition_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.withColumn("k", extract(F.try_parse_json("props"), "k").cast("string"))
    docs = rows.select("event_id", F.try_parse_json(F.expr(_BODY)).alias("doc"))
    found = docs.withColumn("v", extract(F.col("doc"), "hits.total.value"))
    return found.select(
        "event_id",
        variant_kind(F.col("v")).alias("kind"),
        F.col("v").isNotNull().alias("path_found"),
        as_double(F.col("v")).alias("value"),
        was_coerced(F.col("v")).alias("coerced"),
        as_double(extract(F.col("doc"), "aggregations.by.buckets.0.doc_count")).alias("top_doc_count"),
    )


_THRESHOLD = """
    CASE event_id % 9
      WHEN 0 THEN '10' WHEN 1 THEN '0.5' WHEN 2 THEN '1e1' WHEN 3 THEN 'not_a_number' WHEN 4 THEN ' 5 '
      WHEN 5 THEN '1d' WHEN 6 THEN 'NaN' WHEN 7 THEN '' ELSE CAST(event_id % 100 AS STRING) END"""


@register(
    "threshold_eval",
    f"""
    WITH ops(operator) AS (VALUES {", ".join(f"('{o}')" for o in OPERATORS)}, ('unknown')),
    t AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value,
                 {_THRESHOLD} AS threshold FROM events),
    p AS (SELECT *, CASE WHEN regexp_full_match(threshold, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN')
                         THEN threshold::DOUBLE END AS x FROM t)
    SELECT event_id, operator, threshold,
      CASE WHEN x IS NULL OR operator = 'unknown' THEN NULL
           WHEN isnan(x) OR isnan(value) THEN FALSE
           ELSE CASE operator WHEN 'greaterThan' THEN value > x WHEN 'greaterThanOrEqual' THEN value >= x
                WHEN 'lessThan' THEN value < x WHEN 'lessThanOrEqual' THEN value <= x ELSE value = x END END AS firing
    FROM p CROSS JOIN ops""",
)
def threshold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(
        "event_id",
        F.when(F.col("event_id") % 101 == 0, float("nan")).otherwise(F.col("value")).alias("value"),
        F.expr(_THRESHOLD).alias("threshold"),
        F.explode(F.array(*[F.lit(o) for o in [*OPERATORS, "unknown"]])).alias("operator"),
    )
    firing = compare(F.col("value"), F.col("operator"), threshold_value(F.col("threshold")))
    return rows.select("event_id", "operator", "threshold", firing.alias("firing"))


_DURATION = """
    CASE l_orderkey % 10
      WHEN 0 THEN CAST(l_linenumber AS STRING) || 'h' || CAST(CAST(l_quantity AS INT) AS STRING) || 'm'
      WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || 'ms'
      WHEN 2 THEN CAST(l_linenumber AS STRING) || '.5s'
      WHEN 3 THEN '-' || CAST(CAST(l_quantity AS INT) AS STRING) || 'us'
      WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS STRING)
      WHEN 5 THEN l_returnflag || 'm'
      WHEN 6 THEN '0'
      WHEN 7 THEN ''
      WHEN 8 THEN '.' || CAST(l_linenumber AS STRING) || 'h' || CAST(CAST(l_quantity AS INT) AS STRING) || 'ns'
      ELSE CAST(l_linenumber AS STRING) || 'h ' || '1m' END"""


@register(
    "duration_parse",
    f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {_DURATION} AS text FROM lineitem),
    n AS (
      SELECT *, CASE WHEN regexp_full_match(text, '[-+]?(0|(([0-9]+[.]?[0-9]*|[.][0-9]+)(ns|us|ms|s|m|h))+)') THEN
        (CASE WHEN text LIKE '-%' THEN -1 ELSE 1 END) * (
          coalesce(try_cast(regexp_extract(text, '([0-9]*[.]?[0-9]+)h', 1) AS DECIMAL(38, 9)) * 3600000000000, 0)
        + coalesce(try_cast(regexp_extract(text, '([0-9]*[.]?[0-9]+)m($|[0-9])', 1) AS DECIMAL(38, 9)) * 60000000000, 0)
        + coalesce(try_cast(regexp_extract(text, '([0-9]*[.]?[0-9]+)s$', 1) AS DECIMAL(38, 9)) * 1000000000, 0)
        + coalesce(try_cast(regexp_extract(text, '([0-9]*[.]?[0-9]+)ms', 1) AS DECIMAL(38, 9)) * 1000000, 0)
        + coalesce(try_cast(regexp_extract(text, '([0-9]*[.]?[0-9]+)us', 1) AS DECIMAL(38, 9)) * 1000, 0)
        + coalesce(try_cast(regexp_extract(text, '([0-9]*[.]?[0-9]+)ns', 1) AS DECIMAL(38, 9)), 0)) END AS d
      FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, text, d::BIGINT AS nanos, trunc(d / 1000)::BIGINT AS micros FROM n""",
)
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    texts = items.select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_DURATION).alias("text"))
    return texts.withColumns({"nanos": duration_nanos("text"), "micros": duration_micros("text")})


@register(
    "late_rows_asof",
    "WITH" + grid_sql(30) + """,
    e AS (SELECT *, ts + to_minutes(event_id % 97) AS ingest_ts FROM events WHERE event_type = 'error')
    SELECT g.tick, count(e.event_id) AS hits FROM grid g LEFT JOIN e
      ON e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick AND e.ingest_ts <= g.tick
    GROUP BY g.tick""",
)
def late_rows_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    late = events.withColumn(
        "ingest_ts", F.expr("ts + make_dt_interval(0, 0, cast(event_id % 97 as int), 0)")
    )
    rule = Rule("ops", "late", Search(filter="event_type = 'error'", window="60m"), check_interval="30m")
    return search.hits_as_of_ingest(late, rule, "ts", "ingest_ts").select("tick", "hits")


# --- many rules -------------------------------------------------------------------------------

_KINDS = "array('click', 'error', 'purchase', 'signup', 'view')"
_MANY = f"""
    select 'many' as namespace, concat('rule-', id) as rule,
      case id % 4 when 0 then map('event_type', element_at({_KINDS}, cast(id % 5 as int) + 1), 'user_id', cast(id % 97 as string))
        when 1 then map('user_id', cast((id * 7) % 101 as string)) when 3 then map('event_type', element_at({_KINDS}, cast(id % 5 as int) + 1)) end as terms,
      case id % 4 when 1 then map('value', named_struct('low', cast(id % 50 as double), 'high', cast(id % 50 + 20 as double)))
        when 2 then map('value', named_struct('low', cast((id * 13) % 900 as double) / 10, 'high', cast((id * 13) % 900 as double) / 10 + (1 + id % 7) / 2),
                        'event_id', named_struct('low', cast(id % 11 as double), 'high', cast(null as double)))
        when 3 then map('value', named_struct('low', cast(90 + id % 9 as double), 'high', cast(null as double))) end as ranges,
      case id % 3 when 0 then '24h' when 1 then '9h' else '6h' end as window,
      case id % 3 when 1 then '4h' else '6h' end as check_interval
    from range(1, 2001)"""


@register(
    "many_rules_hits",
    """
    WITH kinds AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'] AS kinds),
    rules AS (
      SELECT 'rule-' || id AS rule, id AS k, kinds[id % 5 + 1] AS kind,
        CASE id % 3 WHEN 0 THEN 24 WHEN 1 THEN 9 ELSE 6 END AS width, CASE id % 3 WHEN 1 THEN 4 ELSE 6 END AS step FROM (SELECT unnest(range(1, 2001)) AS id), kinds),
    hit AS (
      SELECT r.rule, r.width, r.step, e.ts, e.value FROM rules r JOIN events e ON CASE r.k % 4
        WHEN 0 THEN e.event_type = r.kind AND e.user_id = r.k % 97
        WHEN 1 THEN e.user_id = (r.k * 7) % 101 AND e.value >= r.k % 50 AND e.value < r.k % 50 + 20
        WHEN 2 THEN e.value >= ((r.k * 13) % 900)::DOUBLE / 10 AND e.value < ((r.k * 13) % 900)::DOUBLE / 10 + (1 + r.k % 7)::DOUBLE / 2 AND e.event_id >= r.k % 11
        ELSE e.event_type = r.kind AND e.value >= 90 + r.k % 9 END),
    due AS (
      SELECT rule, value, unnest(generate_series((epoch_us(ts) // (step * 3600000000) + 1) * step * 3600000000,
        ((epoch_us(ts) + width * 3600000000) // (step * 3600000000)) * step * 3600000000, step * 3600000000)) AS tick FROM hit),
    w AS (SELECT rule, tick, count(*) AS hits, max(value) AS high FROM due GROUP BY rule, tick)
    SELECT rule, count(*) AS n_ticks, sum(hits)::BIGINT AS hits, max(hits) AS peak, round(max(high), 6) AS high, make_timestamp(min(tick)) AS first_tick FROM w GROUP BY rule""",
)
def many_rules_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand rules, found through an index of rules: the plan is the same for ten rules and ten thousand."""
    rules = spark.sql(_MANY)
    rows = rule_windows(table(spark, sf_dir, "events"), rules, field="value")
    return rows.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.sum("hits").alias("hits"), F.max("hits").alias("peak"), F.round(F.max("high"), 6).alias("high"), F.min("tick").alias("first_tick")
    )
