"""The rules the queries run, and the SQL parts their oracles share."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tickwatch.model import ACTION_DDL, Rule, Search, local_frame, rules_frame
from tickwatch.plans.backtest import Backtest
from tickwatch.sources.logs import scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


PAGER = {
    "name": "pager",
    "namespace": "",
    "mode": "alertmanager",
    "labels": {"severity": "high", "team": "{{ namespace }}"},
    "annotations": {"summary": "{{ rule }} is at {{ value }}"},
}
MAILER = {"name": "mailer", "namespace": "shop", "mode": "raw", "data": "concat(rule, ' ', value)"}

RULES = [
    Rule(
        "ops", "error-burst", Search(filter="event_type = 'error'", window="60m"),
        operator="greaterThan", threshold="3", for_="60m", check_interval="30m",
        description="many errors", action=PAGER,
        series_alert={"enabled": True, "labels": {"severity": "page"}},
    ),
    Rule(
        "ops", "view-burst", Search(filter="event_type = 'view'", window="60m"),
        operator="greaterThanOrEqual", threshold="5", for_="30m", check_interval="30m",
        description="many views", action=PAGER,
    ),
    Rule(
        "shop", "basket-avg",
        Search(filter="event_type = 'purchase'", window="60m", metric="avg", field="value"),
        operator="greaterThan", threshold="6e1", for_="1h", check_interval="30m",
        description="large baskets", action=MAILER,
    ),
    Rule(
        "shop", "quiet-signups", Search(filter="event_type = 'signup'", window="60m"),
        operator="lessThan", threshold="2", for_="1h30m", check_interval="30m",
        description="few signups",
    ),
    Rule(
        "shop", "error-share",
        Search(filter="true", window="60m", metric="pct", part="event_type = 'error'"),
        operator="greaterThan", threshold="40", for_="0s", check_interval="30m",
        description="share of errors", action=PAGER,
    ),
]


def rules(spark: SparkSession) -> DataFrame:
    return rules_frame(spark, RULES)


ACTIONS = [
    ("", "pager", "10m", "alertmanager"),
    ("ops", "pager", "1h", "alertmanager"),
    ("shop", "mailer", "30m", None),
    ("shop", "unused", "", "other"),
]


def actions(spark: SparkSession) -> DataFrame:
    names = [c.split()[0] for c in ACTION_DDL.split(", ")]
    return local_frame(spark, [dict(zip(names, a)) for a in ACTIONS], ACTION_DDL)


def backtest(spark: SparkSession, sf_dir: str) -> Backtest:
    return Backtest(table(spark, sf_dir, "events"), RULES, actions(spark))


def incremental(spark: SparkSession, sf_dir: str) -> list[Backtest]:
    """The same history in three runs, each continuing the one before."""
    first = replace(backtest(spark, sf_dir), end="2024-01-11 00:10:00")
    second = first.after("2024-01-20 12:00:00")
    return [first, second, second.after()]


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(spark, sf_dir).evaluated


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(spark, sf_dir).states


# --- SQL: rules and values ------------------------------------------------------------

RULES_SQL = """
rules(namespace, rule, op, thr, for_us, action, description) AS (VALUES
  ('ops', 'error-burst', '>', 3.0, 3600000000, 'pager', 'many errors'),
  ('ops', 'view-burst', '>=', 5.0, 1800000000, 'pager', 'many views'),
  ('shop', 'basket-avg', '>', 60.0, 3600000000, 'mailer', 'large baskets'),
  ('shop', 'quiet-signups', '<', 2.0, 5400000000, NULL, 'few signups'),
  ('shop', 'error-share', '>', 40.0, 0, 'pager', 'share of errors'))"""


def grid_sql(minutes: int, name: str = "grid") -> str:
    """Ticks of one interval: the first multiple after the first event to the first after the last."""
    us = minutes * 60_000_000
    return f"""
{name} AS (
  SELECT make_timestamp(unnest(generate_series((epoch_us(lo) // {us} + 1) * {us},
                                               (epoch_us(hi) // {us} + 1) * {us}, {us}))) AS tick
  FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM events))"""


VALUES_SQL = (
    RULES_SQL
    + ","
    + grid_sql(30)
    + """,
agg AS (
  SELECT g.tick,
         count(e.event_id) AS n_all,
         count(*) FILTER (WHERE e.event_type = 'error') AS n_error,
         count(*) FILTER (WHERE e.event_type = 'view') AS n_view,
         count(*) FILTER (WHERE e.event_type = 'signup') AS n_signup,
         count(*) FILTER (WHERE e.event_type = 'purchase') AS n_purchase,
         avg(e.value) FILTER (WHERE e.event_type = 'purchase') AS a_purchase
  FROM grid g LEFT JOIN events e ON e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick
  GROUP BY g.tick),
vals AS (
  SELECT r.*, a.tick,
         CASE r.rule WHEN 'error-burst' THEN n_error WHEN 'view-burst' THEN n_view
              WHEN 'basket-avg' THEN n_purchase WHEN 'quiet-signups' THEN n_signup
              ELSE n_all END AS hits,
         CASE r.rule WHEN 'error-burst' THEN n_error WHEN 'view-burst' THEN n_view
              WHEN 'basket-avg' THEN coalesce(a_purchase, 0) WHEN 'quiet-signups' THEN n_signup
              ELSE CASE WHEN n_all > 0 THEN 100.0::DOUBLE * n_error / n_all ELSE 0 END END::DOUBLE AS value
  FROM rules r CROSS JOIN agg a)"""
)


def machine_sql(source: str, keys: str = "namespace, rule") -> str:
    """States, times and alerts by runs; ``source`` has keys, tick, value, firing, for_us."""
    return f"""
chg AS (
  SELECT *, CASE WHEN lag(firing) OVER (PARTITION BY {keys} ORDER BY tick) IS DISTINCT FROM firing
                 THEN 1 ELSE 0 END AS c
  FROM {source}),
run AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY tick) AS run_no FROM chg),
beg AS (SELECT *, min(tick) OVER (PARTITION BY {keys}, run_no) AS run_start FROM run),
st AS (
  SELECT *, CASE
    WHEN firing AND (epoch_us(tick) - epoch_us(run_start) > for_us OR for_us <= 0) THEN 'Firing'
    WHEN firing THEN 'PendingFiring'
    WHEN run_no = 1 OR epoch_us(tick) - epoch_us(run_start) > for_us OR for_us <= 0 THEN 'Normal'
    ELSE 'PendingResolving' END AS state
  FROM beg),
inc AS (
  SELECT *, coalesce(sum(CASE WHEN state = 'Normal' THEN 1 ELSE 0 END) OVER
    (PARTITION BY {keys} ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS incident
  FROM st),
times AS (
  SELECT *,
    CASE WHEN state <> 'Normal' THEN
      last_value(CASE WHEN firing THEN run_start END IGNORE NULLS) OVER w END AS firing_time,
    CASE WHEN state <> 'Normal' THEN
      last_value(CASE WHEN state = 'PendingResolving' THEN run_start END IGNORE NULLS) OVER w END AS resolving_time,
    CASE WHEN state <> 'Normal' THEN
      last_value(CASE WHEN state = 'Firing' THEN tick END IGNORE NULLS) OVER w END AS alert_tick,
    CASE WHEN state <> 'Normal' THEN
      last_value(CASE WHEN state = 'Firing' THEN value END IGNORE NULLS) OVER w END AS alert_value
  FROM inc
  WINDOW w AS (PARTITION BY {keys}, incident ORDER BY tick
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
alerts AS (
  SELECT {keys}, min(tick) FILTER (WHERE state = 'Firing') AS opened_at,
         max(tick) FILTER (WHERE state = 'Normal') AS closed_at,
         max(tick) FILTER (WHERE alert_tick IS NOT NULL) AS last_active_at,
         max(tick) FILTER (WHERE state = 'Firing') AS last_firing_at,
         arg_max(value, tick) FILTER (WHERE state = 'Firing') AS value
  FROM times GROUP BY {keys}, incident
  HAVING count(*) FILTER (WHERE state = 'Firing') > 0)"""


FIRING_SQL = """
cond AS (
  SELECT *, CASE op WHEN '>' THEN value > thr WHEN '>=' THEN value >= thr ELSE value < thr END AS firing
  FROM vals)"""

STATE_SQL = "WITH " + VALUES_SQL + "," + FIRING_SQL + "," + machine_sql("cond")
