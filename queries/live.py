"""The live path, replayed from the log and drained."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import register
from queries.common import FIRING_SQL, RULES, RULES_SQL, STATE_SQL, actions, grid_sql, machine_sql, table
from tickwatch.functions.timegrid import time_bounds
from tickwatch.model import Rule, Search, local_frame, rules_frame
from tickwatch.operators import search
from tickwatch.sources import sinks
from tickwatch.sources.logs import stream
from tickwatch.sources.sinks import run_dir
from tickwatch.streaming.live import VERSION_DDL, drain, live_outbox, live_states, response_states
from tickwatch.streaming.restate import on_grid, restated, tick_changes

_SLICES = 3


def replay_slices(spark: SparkSession, events: DataFrame) -> str:
    """The whole log as files in time order."""
    path = run_dir(spark, "replay")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * i / _SLICES for i in range(1, _SLICES)]
    edges = [None, *cuts, None]
    for a, b in zip(edges, edges[1:]):
        part = events
        if a is not None:
            part = part.where(F.col("ts") >= F.lit(a).cast("timestamp_ntz"))
        if b is not None:
            part = part.where(F.col("ts") < F.lit(b).cast("timestamp_ntz"))
        part.write.mode("append").parquet(path)
    return path


def replay(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The whole log as a stream, and a last row that closes the last window."""
    path = replay_slices(spark, events)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
    events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select("ts", *none).write.mode("append").parquet(path)
    return stream(spark, path, events.schema, maxFilesPerTrigger=16)


@register(
    "stream_rule_state",
    STATE_SQL + """ SELECT namespace, rule, tick, hits, round(value, 9) AS value, firing, state, firing_time,
      resolving_time, alert_tick, round(alert_value, 9) AS alert_value FROM times""",
)
def stream_rule_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = replay(spark, table(spark, sf_dir, "events"))
    rows = drain(live_states(log, RULES, delay="1 hour"), "live")
    return rows.withColumns({"value": F.round("value", 9), "alert_value": F.round("alert_value", 9)})


# --- rules that change, silent logs, deliveries ---------------------------------------------


def change_stream(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Versions of rules, as a stream of one file."""
    names = [c.split()[0].strip("`") for c in VERSION_DDL.split(", ")]
    path = run_dir(spark, "versions")
    at = [dict(zip(names, r)) | {"at": datetime.fromisoformat(r[2])} for r in rows]
    table = local_frame(spark, at, VERSION_DDL)
    table.write.parquet(path)
    return stream(spark, path, table.schema)


_STATE_COLUMNS = """SELECT namespace, rule, tick, hits, round(value, 9) AS value, firing, state, firing_time,
      resolving_time, alert_tick, round(alert_value, 9) AS alert_value FROM times"""

_EDITED = [RULES[0], RULES[2]]
_EDITS = [
    # namespace, name, at, operator, threshold, for, check_interval, window, round, deleted
    ("ops", "error-burst", "2023-12-31T00:00:00", "greaterThan", "3", "60m", "30m", "60m", None, False),
    ("ops", "error-burst", "2024-01-09T00:10:00", "greaterThanOrEqual", "2", "30m", "30m", "60m", None, False),
    ("ops", "error-burst", "2024-01-15T12:00:00", "greaterThan", "9", "30m", "1h", "4h", None, False),
    ("ops", "error-burst", "2024-01-22T07:20:00", "lessThan", "9", "0s", "30m", "4h", None, False),
    ("shop", "basket-avg", "2023-12-31T00:00:00", "greaterThan", "6e1", "1h", "1h30m", "60m", None, False),
    ("shop", "basket-avg", "2024-01-12T00:00:00", "greaterThan", "55", "30m", "30m", "90m", None, False),
]


@register(
    "stream_rule_edit",
    "WITH " + grid_sql(30) + """,
    versions(namespace, rule, since, op, thr, for_us, step_us, w) AS (VALUES
      ('ops', 'error-burst', TIMESTAMP '2023-12-31 00:00:00', '>', 3, 3600000000, 1800000000, 60),
      ('ops', 'error-burst', TIMESTAMP '2024-01-09 00:10:00', '>=', 2, 1800000000, 1800000000, 60),
      ('ops', 'error-burst', TIMESTAMP '2024-01-15 12:00:00', '>', 9, 1800000000, 3600000000, 240),
      ('ops', 'error-burst', TIMESTAMP '2024-01-22 07:20:00', '<', 9, 0, 1800000000, 240),
      ('shop', 'basket-avg', TIMESTAMP '2023-12-31 00:00:00', '>', 60, 3600000000, 5400000000, 60),
      ('shop', 'basket-avg', TIMESTAMP '2024-01-12 00:00:00', '>', 55, 1800000000, 1800000000, 90)),
    spans AS (SELECT *, lead(since) OVER (PARTITION BY namespace, rule ORDER BY since) AS until FROM versions),
    due AS (SELECT s.*, g.tick FROM spans s JOIN grid g ON g.tick >= s.since AND (s.until IS NULL OR g.tick < s.until) AND epoch_us(g.tick) % s.step_us = 0),
    vals AS (
      SELECT d.namespace, d.rule, d.op, d.thr, d.for_us, d.tick, count(e.event_id) AS hits,
        (CASE d.rule WHEN 'error-burst' THEN count(e.event_id) ELSE coalesce(avg(e.value), 0) END)::DOUBLE AS value
      FROM due d LEFT JOIN events e ON e.event_type = CASE d.rule WHEN 'error-burst' THEN 'error' ELSE 'purchase' END
        AND e.ts >= d.tick - to_minutes(d.w) AND e.ts < d.tick
      GROUP BY d.namespace, d.rule, d.op, d.thr, d.for_us, d.tick),""" + FIRING_SQL + "," + machine_sql("cond") + _STATE_COLUMNS,
)
def stream_rule_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, waits, intervals and windows change while the rules run; their state goes on."""
    log = replay(spark, table(spark, sf_dir, "events"))
    rows = drain(live_states(log, _EDITED, delay="1 hour", versions=change_stream(spark, _EDITS), pane="30m"), "edited")
    return rows.withColumns({"value": F.round("value", 9), "alert_value": F.round("alert_value", 9)})


_LIVES = [
    ("ops", "error-burst", "2023-12-31T00:00:00", "greaterThan", "3", "60m", "30m", "60m", None, False),
    ("ops", "error-burst", "2024-01-10T00:10:00", None, None, None, None, None, None, True),
    ("ops", "error-burst", "2024-01-15T12:00:00", "greaterThan", "2", "60m", "30m", "60m", None, False),
    ("shop", "basket-avg", "2024-01-05T00:00:00", "greaterThan", "6e1", "1h", "30m", "60m", None, False),
    ("shop", "basket-avg", "2024-01-20T00:00:00", None, None, None, None, None, None, True),
    ("shop", "basket-avg", "2024-01-20T00:00:01", "greaterThan", "55", "1h", "30m", "60m", None, False),
]


@register(
    "stream_rule_deletion",
    "WITH " + grid_sql(30) + """,
    lives(namespace, rule, life, since, until, op, thr, for_us) AS (VALUES
      ('ops', 'error-burst', 1, TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-01-10 00:10:00', '>', 3, 3600000000),
      ('ops', 'error-burst', 2, TIMESTAMP '2024-01-15 12:00:00', TIMESTAMP '2100-01-01 00:00:00', '>', 2, 3600000000),
      ('shop', 'basket-avg', 1, TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-20 00:00:00', '>', 60, 3600000000),
      ('shop', 'basket-avg', 2, TIMESTAMP '2024-01-20 00:00:01', TIMESTAMP '2100-01-01 00:00:00', '>', 55, 3600000000)),
    vals AS (
      SELECT d.namespace, d.rule, d.life, d.op, d.thr, d.for_us, g.tick, count(e.event_id) AS hits,
        (CASE d.rule WHEN 'error-burst' THEN count(e.event_id) ELSE coalesce(avg(e.value), 0) END)::DOUBLE AS value
      FROM lives d JOIN grid g ON g.tick >= d.since AND g.tick < d.until
      LEFT JOIN events e ON e.event_type = CASE d.rule WHEN 'error-burst' THEN 'error' ELSE 'purchase' END
        AND e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick
      GROUP BY d.namespace, d.rule, d.life, d.op, d.thr, d.for_us, g.tick),""" + FIRING_SQL + "," + machine_sql("cond", "namespace, rule, life") + _STATE_COLUMNS,
)
def stream_rule_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are deleted and come back: each life starts over, and nothing is evaluated between."""
    log = replay(spark, table(spark, sf_dir, "events"))
    rows = drain(live_states(log, _EDITED, delay="1 hour", versions=change_stream(spark, _LIVES), pane="30m"), "lives")
    return rows.withColumns({"value": F.round("value", 9), "alert_value": F.round("alert_value", 9)})


_GROUPED = [
    Rule("shop", "busiest", Search(window="60m", group_by="event_type", pick="top"), "greaterThanOrEqual", "4", "30m", "30m"),
    Rule("shop", "dearest", Search(filter="event_type <> 'error'", window="4h", metric="avg", field="value", group_by="event_type", pick="max_bucket"), "greaterThan", "65", "1h", "30m"),
    Rule("shop", "least", Search(window="2h", metric="sum", field="value", group_by="user_id % 20", pick="min_bucket"), "lessThan", "20", "0s", "30m"),
]


@register(
    "stream_bucket_state",
    "WITH " + grid_sql(30) + """,
    rules(namespace, rule, op, thr, for_us, w) AS (VALUES ('shop', 'busiest', '>=', 4, 1800000000, 60),
      ('shop', 'dearest', '>', 65, 3600000000, 240), ('shop', 'least', '<', 20, 0, 120)),
    b AS (
      SELECT r.namespace, r.rule, g.tick, CASE r.rule WHEN 'least' THEN (e.user_id % 20)::VARCHAR ELSE e.event_type END AS bucket, count(*) AS n,
        CASE r.rule WHEN 'busiest' THEN count(*) WHEN 'dearest' THEN avg(e.value) ELSE sum(e.value) END AS x
      FROM rules r CROSS JOIN grid g JOIN events e ON e.ts >= g.tick - to_minutes(r.w) AND e.ts < g.tick AND (r.rule <> 'dearest' OR e.event_type <> 'error')
      GROUP BY r.namespace, r.rule, g.tick, 4),
    best AS (
      SELECT namespace, rule, tick, sum(n)::BIGINT AS hits, CASE rule WHEN 'busiest' THEN max(n) WHEN 'dearest' THEN max(x) ELSE min(x) END AS x
      FROM b GROUP BY namespace, rule, tick),
    vals AS (
      SELECT r.*, g.tick, coalesce(b.hits, 0) AS hits, coalesce(b.x, 0)::DOUBLE AS value
      FROM rules r CROSS JOIN grid g LEFT JOIN best b ON b.rule = r.rule AND b.tick = g.tick),""" + FIRING_SQL + "," + machine_sql("cond") + _STATE_COLUMNS,
)
def stream_bucket_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over buckets, live: the bucket is picked from the shards' best ones."""
    log = replay(spark, table(spark, sf_dir, "events"))
    rows = drain(live_states(log, _GROUPED, delay="1 hour"), "grouped")
    return rows.withColumns({"value": F.round("value", 9), "alert_value": F.round("alert_value", 9)})


_SILENT = [RULES[0], RULES[3]]


@register(
    "stream_silent_log",
    "WITH " + RULES_SQL + "," + grid_sql(30) + """,
    log AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-12 00:00:00' AND event_type IN ('error', 'signup')),
    vals AS (
      SELECT r.namespace, r.rule, r.op, r.thr, r.for_us, g.tick, count(e.event_id) AS hits, count(e.event_id)::DOUBLE AS value
      FROM rules r CROSS JOIN grid g LEFT JOIN log e ON e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick
        AND e.event_type = CASE r.rule WHEN 'error-burst' THEN 'error' ELSE 'signup' END
      WHERE r.rule IN ('error-burst', 'quiet-signups') GROUP BY r.namespace, r.rule, r.op, r.thr, r.for_us, g.tick),"""
    + FIRING_SQL + "," + machine_sql("cond") + _STATE_COLUMNS,
)
def stream_silent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that stops: a clock, here the times of all events, goes on, and with it the ticks."""
    events = table(spark, sf_dir, "events")
    log = events.where("ts < timestamp_ntz'2024-01-12 00:00:00' and event_type in ('error', 'signup')")
    path = run_dir(spark, "stopped")
    log.write.parquet(path)
    beats = replay(spark, events.select("ts"))
    # the whole log is in the first batch, so the clock does not make any of it late
    rows = drain(live_states(stream(spark, path, events.schema), _SILENT, delay="1 hour", clock=beats), "silent")
    return rows.withColumns({"value": F.round("value", 9), "alert_value": F.round("alert_value", 9)})


@register(
    "stream_outbox",
    STATE_SQL + "," + """
    acts(action_namespace, action, p) AS (VALUES ('', 'pager', 600000000), ('ops', 'pager', 3600000000), ('shop', 'mailer', 1800000000)),
    act AS (SELECT t.*, lead(tick) OVER (PARTITION BY namespace, rule ORDER BY tick) AS nxt FROM times t),
    sent AS (
      SELECT a.namespace, a.rule, a.action AS action_name, c.action_namespace, a.alert_value AS value, make_timestamp(unnest(generate_series(
          ((epoch_us(a.tick) + c.p - 1) // c.p) * c.p, coalesce(epoch_us(a.nxt) - 1, epoch_us(a.tick)), c.p))) AS sent_at
      FROM act a JOIN acts c USING (action) WHERE a.alert_tick IS NOT NULL)
    SELECT namespace, rule, action_name, action_namespace, round(value, 9) AS value, sent_at, CASE action_name WHEN 'pager' THEN TRUE END AS valid,
      CASE action_name WHEN 'pager' THEN strftime(sent_at, '%Y-%m-%dT%H:%M:%SZ') END AS starts_at, CASE action_name WHEN 'pager' THEN rule END AS alertname,
      CASE action_name WHEN 'pager' THEN namespace END AS team
    FROM sent""",
)
def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in the stream, at every period of the alert's actions, with their payloads."""
    log = replay(spark, table(spark, sf_dir, "events"))
    rows = drain(live_outbox(log, RULES, actions(spark), delay="1 hour"), "outbox")
    first = F.from_json("payload", "array<struct<labels: map<string,string>, startsAt: string>>")[0]
    return rows.select(
        "namespace", "rule", "action_name", "action_namespace", F.round("value", 9).alias("value"), "sent_at", "valid",
        first["startsAt"].alias("starts_at"), first["labels"]["alertname"].alias("alertname"), first["labels"]["team"].alias("team"),
    )


# --- sinks and stored responses -----------------------------------------------------------------


@register(
    "sink_replay",
    "SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
)
def sink_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a sink of batches; one batch is written again and another is left without its commit."""
    events = table(spark, sf_dir, "events")
    base = run_dir(spark, "sink")
    log = stream(spark, replay_slices(spark, events), events.schema, maxFilesPerTrigger=1)
    sinks.stream_batches(log, f"{base}/table", f"{base}/checkpoint", once=True, ts_col="ts").awaitTermination()
    again = spark.read.parquet(f"{base}/table/rows/batch_id=1").select(events.columns)
    sinks.write_batch(sinks.materialize(again, "again"), f"{base}/table", 1, "ts")
    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{base}/table/rows/batch_id=999999")
    ddl = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    rows = sinks.read_committed(spark, f"{base}/table", ddl, "ts")
    return rows.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


_ASKED = [
    Rule("ops", "errors", Search(value_path="hits.total.value"), "greaterThan", "4", "1h", "30m", action={"name": "pager"}),
    Rule("ops", "views", Search(value_path="aggregations.n.value"), "greaterThanOrEqual", "3", "0s", "30m", action={"name": "pager"}),
]


@register(
    "stream_response_states",
    "WITH " + grid_sql(60) + """,
    n AS (SELECT g.tick, count(e.event_id) FILTER (WHERE event_type = 'error') AS errors, count(e.event_id) FILTER (WHERE event_type = 'view') AS views
          FROM grid g LEFT JOIN events e ON e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick GROUP BY g.tick),
    cond AS (
      SELECT 'ops' AS namespace, 'errors' AS rule, tick, errors::DOUBLE AS value, errors > 4 AS firing, 3600000000 AS for_us FROM n WHERE errors % 5 <> 2
      UNION ALL SELECT 'ops', 'views', tick, views::DOUBLE, views >= 3, 0 FROM n WHERE views % 7 <> 6),""" + machine_sql("cond")
    + "SELECT namespace, rule, tick, value, firing, state, firing_time, resolving_time, alert_tick, alert_value FROM times",
)
def stream_response_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of hourly searches, some of them failed, as a stream of files."""
    events = table(spark, sf_dir, "events")
    counts = search.tick_values(
        events, [Rule("ops", n, Search(filter=f"event_type = '{k}'", window="1h"), check_interval="1h") for n, k in (("errors", "error"), ("views", "view"))]
    )
    bodies = counts.selectExpr(
        "namespace", "rule", "tick", "if(rule = 'errors' and hits % 5 = 2, 503, 200) as status_code",
        """if(rule = 'errors', '{"hits":{"total":{"value":' || hits || '}}}', if(hits % 7 = 6, '{"aggregations":{}}', '{"aggregations":{"n":{"value":"' || hits || '"}}}')) as body""",
    )
    path = run_dir(spark, "responses")
    bodies.repartition(1).write.parquet(path)
    rows = response_states(stream(spark, path, bodies.schema), rules_frame(spark, _ASKED))
    return drain(rows, "response-states")


_LATE = [
    Rule("ops", "late", Search(filter="event_type = 'error'", window="60m"), check_interval="30m"),
    Rule("shop", "slow", Search(filter="value > 50", window="9h"), check_interval="4h"),
]


@register(
    "stream_restated_ticks",
    "WITH" + grid_sql(30) + "," + grid_sql(240, "wide") + """,
    e AS (SELECT *, ts + to_minutes(event_id % 97) AS ingest_ts FROM events)
    SELECT 'ops' AS namespace, 'late' AS rule, g.tick, count(e.event_id) AS hits FROM grid g LEFT JOIN e
      ON event_type = 'error' AND e.ts >= g.tick - INTERVAL 60 MINUTE AND e.ts < g.tick AND e.ingest_ts <= g.tick GROUP BY g.tick
    UNION ALL SELECT 'shop', 'slow', g.tick, count(e.event_id) FROM wide g LEFT JOIN e
      ON value > 50 AND e.ts >= g.tick - INTERVAL 9 HOUR AND e.ts < g.tick AND e.ingest_ts <= g.tick GROUP BY g.tick""",
)
def stream_restated_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come in any order: each batch restates ticks told before, and the changes applied by key are the counts."""
    events = table(spark, sf_dir, "events").withColumn("ingest_ts", F.expr("ts + make_dt_interval(0, 0, cast(event_id % 97 as int), 0)"))
    path = run_dir(spark, "late")
    for part in (2, 0, 1):
        # every part spans the whole time
        events.where(F.pmod("event_id", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(path)
    changes = tick_changes(stream(spark, path, events.schema, maxFilesPerTrigger=1), _LATE)
    base = run_dir(spark, "changes")
    sinks.stream_batches(changes, f"{base}/table", f"{base}/checkpoint", once=True).awaitTermination()
    told = sinks.read_committed(spark, f"{base}/table", ", ".join(f"{n} {t}" for n, t in changes.dtypes))
    first, last = time_bounds(events, "ts")
    return on_grid(restated(told), _LATE, first, last).select("namespace", "rule", "tick", "hits")
