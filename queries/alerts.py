"""Routing, outbox, messages, payloads and payload validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import register
from queries.common import RULES, STATE_SQL, backtest, machine_sql, table
from queries.metrics import _BUCKETS_SQL, _CUSTOM
from tickwatch.operators import notify, search, state
from tickwatch.plans.backtest import Backtest

_ACTIONS_SQL = """
    acts(action_namespace, action, period_us, validator) AS (VALUES
      ('', 'pager', 600000000, 'alertmanager'), ('ops', 'pager', 3600000000, 'alertmanager'),
      ('shop', 'mailer', 1800000000, NULL), ('shop', 'unused', 5000000, 'other'))"""


@register(
    "alert_routing",
    STATE_SQL + "," + _ACTIONS_SQL + """
    SELECT a.namespace, a.rule, a.opened_at, round(a.value, 9) AS value, r.action AS action_name, t.action_namespace, t.validator
    FROM alerts a JOIN rules r USING (namespace, rule) JOIN acts t ON t.action = r.action""",
)
def alert_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = backtest(spark, sf_dir)
    return notify.route(run.alerts, run.actions).select(
        "namespace", "rule", "opened_at", F.round("value", 9).alias("value"), "action_name", "action_namespace", "validator"
    )


@register(
    "notification_outbox",
    STATE_SQL + "," + _ACTIONS_SQL + """,
    routed AS (
      SELECT a.*, r.action, t.action_namespace, t.period_us AS p FROM alerts a JOIN rules r USING (namespace, rule)
      JOIN acts t ON t.action = r.action)
    SELECT namespace, rule, action AS action_name, action_namespace, round(value, 9) AS value,
      make_timestamp(unnest(generate_series(
        ((epoch_us(opened_at) + p - 1) // p) * p, coalesce(epoch_us(closed_at) - 1, epoch_us(last_active_at)), p))) AS sent_at
    FROM routed""",
)
def notification_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(spark, sf_dir).deliveries().select(
        "namespace", "rule", "action_name", "action_namespace", F.round("value", 9).alias("value"), "sent_at"
    )


_TEMPLATE = (
    "format_string('%s/%s %s since %s: %s', namespace, regexp_replace(rule, '-', ' '), "
    "trim(format_string('%10.2f', value)), date_format(opened_at, 'yyyy-MM-dd HH:mm'), "
    "array_join(transform(buckets, b -> concat(b.key, '=', b.doc_count)), ', '))"
)


@register(
    "raw_message",
    _BUCKETS_SQL + """,
    cond AS (
      SELECT 'shop' AS namespace, 'mix-watch' AS rule, g.tick, coalesce(max(share), 0) AS value,
             coalesce(max(share), 0) > 30 AS firing, 7200000000 AS for_us
      FROM grid g LEFT JOIN r ON r.tick = g.tick GROUP BY g.tick),""" + machine_sql("cond") + """,
    lists AS (SELECT tick, string_agg(kind || '=' || n, ', ' ORDER BY rn) AS text FROM r GROUP BY tick)
    SELECT namespace, rule, opened_at,
      'shop/mix watch ' || printf('%.2f', a.value) || ' since ' || strftime(opened_at, '%Y-%m-%d %H:%M') || ': ' || text AS message
    FROM alerts a JOIN lists l ON l.tick = a.last_firing_at""",
)
def raw_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = replace(_CUSTOM, action={"name": "mailer", "mode": "raw", "data": _TEMPLATE})
    run = Backtest(table(spark, sf_dir, "events"), [rule])
    bodies = search.responses(run.buckets, run.ticks)
    # the alert keeps the response of its last firing tick
    rows = state.state_times(run.evaluated.join(bodies, ["namespace", "rule", "tick"], "left"), payload="body")
    tree = "aggregations struct<by_key: struct<buckets: array<struct<key: string, doc_count: bigint>>>>"
    alerts = state.alert_intervals(rows, run.catalog).withColumn(
        "buckets", F.from_json("payload", tree)["aggregations"]["by_key"]["buckets"]
    )
    return notify.raw_message(alerts, rule.action["data"]).select("namespace", "rule", "opened_at", "message")


_LIST = '[{"labels":{"alertname":"{{ rule }}","ns":"{{namespace}}"},"startsAt":"{{ .sent_at }}"}]'
_TEXTS = [
    replace(RULES[0], action={"name": "pager", "mode": "raw", "data": _LIST}),
    replace(RULES[2], action={"name": "mailer", "mode": "raw", "data": "{{ rule }}{{ nothing }}: {{ value }} {{operator}} {{ threshold }}, since {{ opened_at }}"}),
    replace(RULES[4], action={"name": "pager", "mode": "raw", "data": "{{ description }} {{value}}"}),
    replace(RULES[1], action={"name": "pager", "mode": "alertmanager", "labels": {}}),
]


@register(
    "raw_deliveries",
    STATE_SQL + "," + _ACTIONS_SQL + """,
    sent AS (
      SELECT a.*, t.action AS action_name, t.action_namespace, t.validator, make_timestamp(unnest(generate_series(
        ((epoch_us(opened_at) + period_us - 1) // period_us) * period_us, coalesce(epoch_us(closed_at) - 1, epoch_us(last_active_at)), period_us))) AS sent_at
      FROM alerts a JOIN rules r USING (namespace, rule) JOIN acts t ON t.action = r.action WHERE a.rule IN ('error-burst', 'basket-avg', 'error-share'))
    SELECT namespace, rule, action_name, action_namespace, sent_at,
      CASE rule WHEN 'error-burst' THEN '[{"labels":{"alertname":"error-burst","ns":"ops"},"startsAt":"' || strftime(sent_at, '%Y-%m-%dT%H:%M:%SZ') || '"}]'
        WHEN 'basket-avg' THEN 'basket-avg: ' || regexp_replace(value::VARCHAR, '[.]0$', '') || ' greaterThan 6e1, since ' || strftime(opened_at, '%Y-%m-%dT%H:%M:%SZ')
        ELSE 'share of errors ' || regexp_replace(value::VARCHAR, '[.]0$', '') END AS payload,
      rule <> 'error-share' AS valid,
      CASE rule WHEN 'error-share' THEN 'error decoding JSON from ''message.data'' for Alertmanager validator' END AS error
    FROM sent""",
)
def raw_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's own text, rendered by one plan and checked by the action's validator."""
    rows = replace(backtest(spark, sf_dir), rules=_TEXTS).messages()
    return rows.select("namespace", "rule", "action_name", "action_namespace", "sent_at", "payload", "valid", "error")


@register(
    "alertmanager_payload",
    STATE_SQL + """,
    hours AS (
      SELECT a.namespace, a.rule, a.value, period,
        unnest(generate_series(((epoch_us(opened_at) + period - 1) // period) * period,
               coalesce(epoch_us(closed_at) - 1, epoch_us(last_active_at)), period)) AS us, ns AS action_namespace
      FROM alerts a JOIN rules r USING (namespace, rule) CROSS JOIN (VALUES ('', 600000000), ('ops', 3600000000)) n(ns, period)
      WHERE r.action = 'pager')
    SELECT namespace, rule, action_namespace, make_timestamp(us) AS sent_at, rule AS alertname, 'high' AS severity, namespace AS team,
      rule || ' is at ' || regexp_replace(value::VARCHAR, '[.]0$', '') AS summary,
      strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') AS starts_at,
      strftime(make_timestamp(us + 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS ends_at,
      TRUE AS valid, 1 AS items
    FROM hours""",
)
def alertmanager_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest(spark, sf_dir).payloads()
    return rows.select(
        "namespace",
        "rule",
        "action_namespace",
        "sent_at",
        F.col("alert.labels")["alertname"].alias("alertname"),
        F.col("alert.labels")["severity"].alias("severity"),
        F.col("alert.labels")["team"].alias("team"),
        F.col("alert.annotations")["summary"].alias("summary"),
        F.col("alert.startsAt").alias("starts_at"),
        F.col("alert.endsAt").alias("ends_at"),
        "valid",
        F.json_array_length("payload").alias("items"),
    )


_PAYLOAD = """
    CASE (conv_id * 7 + turn) % 14
      WHEN 0 THEN text
      WHEN 1 THEN 'null'
      WHEN 2 THEN '[]'
      WHEN 3 THEN '{"labels":{"alertname":"' || role || '"},"startsAt":"x"}'
      WHEN 4 THEN '[{"labels":{"alertname":"' || role || '"},"startsAt":"2024-01-01T00:00:00Z"}]'
      WHEN 5 THEN '[{"labels":{"name":"' || role || '"},"startsAt":"2024-01-01T00:00:00Z"}]'
      WHEN 6 THEN '[{"labels":{"alertname":"' || role || '"}}]'
      WHEN 7 THEN '[{"labels":{"alertname":' || CAST(turn AS STRING) || '},"startsAt":"x"}]'
      WHEN 8 THEN '[{"labels":{"alertname":"a"},"startsAt":"x"},{"labels":{"alertname":"b"},"startsAt":""},{"labels":{}}]'
      WHEN 9 THEN '[{"labels":null,"annotations":{"k":null},"startsAt":"x"}]'
      WHEN 10 THEN '[null]'
      WHEN 11 THEN '[{"labels":{"alertname":"a"},"startsAt":5}]'
      WHEN 12 THEN '[{"labels":{"alertname":"a"},"annotations":["x"],"startsAt":"x"}]'
      ELSE '[{"labels":{"alertname":null},"startsAt":"x","generatorURL":"u"}]' END"""

_VALIDATOR = "CASE WHEN conv_id % 11 = 3 THEN NULL WHEN conv_id % 11 = 4 THEN 'other' ELSE 'alertmanager' END"

_DECODE = "error decoding JSON from ''message.data'' for Alertmanager validator"
_SYNTAX = "notification field ''message.data'' does not meet the syntax requirements for Alertmanager: "


@register(
    "payload_validation",
    f"""
    WITH p AS (SELECT conv_id, turn, {_VALIDATOR} AS validator, (conv_id * 7 + turn) % 14 AS c, {_PAYLOAD} AS payload FROM conversations),
    -- what the validator says about each form of text; free text is never JSON here
    v AS (
      SELECT *, CASE WHEN c IN (3, 7, 11, 12) OR (c = 0 AND NOT json_valid(payload)) THEN '{_DECODE}' END AS err,
             CASE WHEN c = 1 THEN '{_SYNTAX}'
                  WHEN c IN (5, 9, 10) THEN '{_SYNTAX}label ''alertname'' not found'
                  WHEN c IN (6, 8) THEN '{_SYNTAX}field ''startsAt'' not found' END AS h FROM p)
    SELECT conv_id, turn, validator,
      CASE WHEN validator IS NULL THEN NULL WHEN validator = 'other' THEN 'validator other not found' ELSE err END AS error,
      CASE WHEN validator = 'alertmanager' THEN h END AS hint,
      CASE WHEN validator IS NULL THEN TRUE WHEN validator = 'other' THEN FALSE ELSE err IS NULL AND h IS NULL END AS valid
    FROM v""",
)
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(_VALIDATOR).alias("validator"), F.expr(_PAYLOAD).alias("payload")
    )
    return notify.validate(rows).select("conv_id", "turn", "validator", "error", "hint", "valid")


@register(
    "json_or_error",
    """
    WITH t AS (
      SELECT conv_id, turn,
        CASE WHEN turn % 3 = 0 THEN to_json({'role': role, 'turn': turn, 'n': length(text)})::VARCHAR
             WHEN turn % 3 = 1 THEN '["' || role || '",' || turn || ']' ELSE text END AS doc
      FROM conversations)
    SELECT conv_id, turn,
      CASE WHEN turn % 3 = 0 THEN json_extract_string(doc, '$.role') END AS role,
      CASE WHEN turn % 3 = 0 THEN json_extract_string(doc, '$.n') END AS n,
      CASE WHEN turn % 3 <> 0 THEN 'not a JSON object' END AS object_error,
      CASE WHEN turn % 3 = 1 THEN json_extract_string(doc, '$[1]') END AS second,
      CASE WHEN turn % 3 = 1 THEN json_extract_string(doc, '$[0]') ELSE 'not a JSON list' END AS first_item
    FROM t""",
)
def json_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    doc = (
        F.when(turn % 3 == 0, F.to_json(F.struct("role", "turn", F.length("text").alias("n"))))
        .when(turn % 3 == 1, F.expr("""'["' || role || '",' || cast(turn as string) || ']'"""))
        .otherwise(F.col("text"))
    )
    rows = text.select("conv_id", "turn", notify.json_object_or_error(doc).alias("o"), notify.json_array_or_error(doc).alias("a"))
    return rows.select(
        "conv_id",
        "turn",
        F.col("o")["role"].alias("role"),
        F.col("o")["n"].alias("n"),
        F.col("o")["Error"].alias("object_error"),
        F.get("a", 1).alias("second"),
        F.get("a", 0).alias("first_item"),
    )
