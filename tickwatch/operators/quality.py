"""Rule lint, source resolution, tick outcomes, status and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.functions.conditions import first_failure, threshold_value
from tickwatch.functions.durations import duration_micros
from tickwatch.functions.jsonpath import path_is_plain
from tickwatch.functions.timegrid import ROUND_MICROS
from tickwatch.operators.notify import unknown_variables
from tickwatch.operators.series import alert_metric
from tickwatch.operators.state import latest


def _violation(bad: Column, code: str, message: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), message.alias("message")))


def _has_search() -> Column:
    return F.col("search").isNotNull()


def _has_text_query() -> Column:
    return F.coalesce("query_json", F.lit("")) != ""


def has_output() -> Column:
    return F.col("action").isNotNull() | F.coalesce("series_alert.enabled", F.lit(False))


def metric_violation(m: Column) -> Column:
    """The first thing wrong with one custom metric, as a code; NULL when it is fine."""
    names = F.coalesce(F.transform(m["labels"], lambda x: x["name"]), F.array().cast("array<string>"))
    return (
        F.when(F.coalesce(m["name"], F.lit("")) == "", "metric_name_required")
        .when(~m["name"].rlike(model.IDENTIFIER), "metric_name_invalid")
        .when(m["name"].isin(model.RESERVED_METRICS), "metric_name_reserved")
        .otherwise(_label_violation(names))
    )


def _label_violation(names: Column) -> Column:
    """Labels are checked in order and the first bad one is reported."""
    each = F.transform(
        names,
        lambda n, i: F.when(~n.rlike(model.IDENTIFIER), "label_name_invalid")
        .when(n.isin(model.RESERVED_LABELS), "label_name_reserved")
        .when(F.array_position(names, n) <= i, "label_name_duplicate"),
    )
    return F.try_element_at(F.filter(each, lambda c: c.isNotNull()), F.lit(1))


def lint(rules: DataFrame) -> DataFrame:
    """``namespace, rule, code, message``: one row per broken check of a rule."""
    cond, paths = F.col("condition"), F.coalesce("custom_metrics", F.array().cast(model.CUSTOM_METRICS_TYPE))
    codes = F.transform(paths, metric_violation)
    named = F.col("search.value_path")
    unknown = unknown_variables(F.col("action.data")) if _has_field(rules, "action", "data") else F.array().cast("array<string>")
    checks = [
        _violation(~cond["operator"].isin(model.OPERATORS), "operator_unknown", cond["operator"]),
        _violation(threshold_value(cond["threshold"]).isNull(), "threshold_invalid", cond["threshold"]),
        _violation(duration_micros("condition.`for`").isNull(), "for_invalid", cond["for"]),
        _violation(~F.coalesce(duration_micros("check_interval") > 0, F.lit(False)), "check_interval_invalid", F.col("check_interval")),
        _violation(~_has_search() & ~_has_text_query(), "query_missing", F.lit("no query")),
        _violation(_has_search() & _has_text_query(), "query_twice", F.lit("two queries")),
        _violation(~has_output(), "output_missing", F.lit("no output")),
        _violation(F.size(paths) > model.MAX_CUSTOM_METRICS, "too_many_metrics", F.size(paths).cast("string")),
        _violation(named.isNotNull() & ~path_is_plain(named), "value_path_unsupported", named),
        *_search_checks(),
        _violation(F.coalesce(F.size(unknown), F.lit(0)) > 0, "message_variable_unknown", F.array_join(unknown, ", ")),
    ]
    per_metric = F.transform(
        F.arrays_zip(paths.alias("m"), codes.alias("c")),
        lambda z: F.when(z["c"].isNotNull(), F.struct(z["c"].alias("code"), z["m"]["name"].alias("message"))),
    )
    per_path = F.transform(
        paths,
        lambda m: F.when(
            m["aggregation_map"].startswith("aggregations."),
            F.struct(F.lit("aggregation_prefix").alias("code"), m["aggregation_map"].alias("message")),
        ),
    )
    found = F.array_compact(F.concat(F.array(*checks), per_metric, per_path))
    return rules.select("namespace", F.col("name").alias("rule"), F.inline(found))


def _has_field(rules: DataFrame, column: str, name: str) -> bool:
    return name in rules.schema[column].dataType.fieldNames()


def _search_checks() -> list[Column]:
    """What is wrong with the text of a search; a member that is not given has its default."""
    s = F.col("search")
    asked = F.coalesce(s["metric"], F.lit("count"))
    return [
        _violation(s["window"].isNotNull() & ~F.coalesce(duration_micros("search.window") > 0, F.lit(False)), "window_invalid", s["window"]),
        _violation(s["round"].isNotNull() & ~s["round"].isin(*ROUND_MICROS), "round_unknown", s["round"]),
        _violation(s["metric"].isNotNull() & ~s["metric"].isin(*model.METRICS), "metric_unknown", s["metric"]),
        _violation(asked.isin("avg", "sum", "min", "max") & (F.coalesce(s["field"], F.lit("")) == ""), "field_missing", asked),
        _violation((asked == "pct") & (F.coalesce(s["part"], F.lit("")) == ""), "part_missing", asked),
        _violation(s["pick"].isNotNull() & (~s["pick"].isin(*model.PICKS) | s["group_by"].isNull()), "pick_invalid", s["pick"]),
        _violation(s["filter"].isNotNull() & (F.trim(s["filter"]) == ""), "filter_empty", F.lit("no filter")),
    ]


def output_reason(rules: DataFrame, metrics_exposed: bool = True) -> DataFrame:
    """State of each rule's series alert, worst problem first, the rest in the message."""
    bad_metric = F.exists(
        F.coalesce("custom_metrics", F.array().cast(model.CUSTOM_METRICS_TYPE)), lambda m: metric_violation(m).isNotNull()
    )
    _, mismatch = alert_metric(F.col("custom_metrics"), F.col("series_alert.metric_name"))
    broken = F.col("threshold_value").isNull() | F.col("for_us").isNull() | ~F.col("condition.operator").isin(model.OPERATORS)
    hidden = F.lit(not metrics_exposed)
    reason = (
        F.when(bad_metric, model.METRICS_INVALID)
        .when(F.coalesce(broken, F.lit(True)), model.DEFINITION_ERROR)
        .when(hidden, model.METRICS_HIDDEN)
        .when(mismatch.isNotNull(), model.NAME_MISMATCH)
        .otherwise(model.DEFINITION_SYNCED)
    )
    message = F.when(
        reason == model.METRICS_HIDDEN, F.concat_ws("; additionally, ", F.lit("metrics are not exposed"), mismatch)
    ).when(reason == model.NAME_MISMATCH, mismatch)
    return rules.where(F.coalesce("series_alert.enabled", F.lit(False))).select(
        "namespace",
        F.col("name").alias("rule"),
        (~reason.isin(model.METRICS_INVALID, model.DEFINITION_ERROR)).alias("status"),
        reason.alias("reason"),
        message.alias("message"),
    )


def resolve_sources(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Each rule with its source's path, or NULL.  An empty namespace means cluster scope."""
    s = sources.select(
        F.coalesce("namespace", F.lit("")).alias("_ns"),
        F.col("name").alias("_name"),
        F.col("path").alias("source_path"),
        "ts_col",
        "has_credentials",
    )
    here = (F.coalesce("source.namespace", F.lit("")) == F.col("_ns")) & (F.col("source.name") == F.col("_name"))
    return rules.join(s, here, "left").drop("_ns", "_name")


def unresolved(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules whose source does not exist."""
    s = sources.select(F.coalesce("namespace", F.lit("")).alias("_ns"), F.col("name").alias("_name"))
    here = (F.coalesce("source.namespace", F.lit("")) == F.col("_ns")) & (F.col("source.name") == F.col("_name"))
    return rules.join(s, here, "left_anti")


def outcome() -> Column:
    """Name of the first failed check of a tick, else ``ok``.

    Reads ``source_path, has_credentials, for_us, search, query_json, status_code,
    path_found, threshold_value, condition`` and stays on the grid: a failed tick is a row
    with an outcome, not a missing row.
    """
    cond_ok = F.col("condition.operator").isin(model.OPERATORS) & F.col("threshold_value").isNotNull()
    return first_failure(
        [
            ("source_not_found", F.col("source_path").isNull()),
            ("no_credentials", ~F.coalesce("has_credentials", F.lit(False))),
            ("bad_for", F.col("for_us").isNull()),
            ("no_query", _has_search() == _has_text_query()),
            ("connection_error", F.col("status_code").isNull()),
            ("query_error", F.col("status_code") != 200),
            ("path_missing", ~F.coalesce("path_found", F.lit(False))),
            ("bad_condition", ~F.coalesce(cond_ok, F.lit(False))),
        ]
    )


def condition_rows(state_rows: DataFrame) -> DataFrame:
    """State conditions of evaluated ticks: ``namespace, rule, type, status, reason, message, ts``."""
    return state_rows.select(
        "namespace",
        "rule",
        F.lit(model.STATE_TYPE).alias("type"),
        F.lit(True).alias("status"),
        model.lookup({k: v[0] for k, v in model.STATE_REASON.items()}, F.col("state")).alias("reason"),
        model.lookup({k: v[1] for k, v in model.STATE_REASON.items()}, F.col("state")).alias("message"),
        F.col("tick").alias("ts"),
    )


def outcome_rows(ticks: DataFrame) -> DataFrame:
    """Sync conditions of all ticks, and state conditions of the failed ones.

    The message of a failed tick is its outcome, followed by what a ``detail`` column knows of it.
    """
    failed = F.col("outcome") != model.OK
    said = F.concat_ws(": ", "outcome", "detail") if "detail" in ticks.columns else F.col("outcome")
    synced = ticks.select(
        "namespace",
        "rule",
        F.lit(model.SYNCED_TYPE).alias("type"),
        (~failed).alias("status"),
        F.when(failed, model.SYNC_FAILED).otherwise(model.SYNCED[0]).alias("reason"),
        F.when(failed, said).otherwise(model.SYNCED[1]).alias("message"),
        F.col("tick").alias("ts"),
    )
    reason = model.lookup(model.OUTCOME_REASON, F.col("outcome"))
    state = ticks.where(reason.isNotNull()).select(
        "namespace", "rule", F.lit(model.STATE_TYPE).alias("type"), F.lit(True).alias("status"),
        reason.alias("reason"), said.alias("message"), F.col("tick").alias("ts"),
    )
    return synced.unionByName(state)


def latest_status(conditions: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Latest condition per (rule, type); ``removed`` names (rule, type) pairs to drop."""
    out = latest(conditions, ["namespace", "rule", "type"], "ts")
    return out if removed is None else out.join(removed, ["namespace", "rule", "type"], "left_anti")


def listing(latest_states: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules listing: key, description, display state and since when."""
    d = rules.select("namespace", F.col("name").alias("rule"), "description")
    return latest_states.join(d, ["namespace", "rule"]).select(
        F.concat_ws("_", "namespace", "rule").alias("alertname"),
        "namespace",
        F.col("description"),
        F.col("description").alias("summary"),
        model.lookup(model.DISPLAY_STATE, F.col("state")).alias("state"),
        F.coalesce(F.date_format("firing_time", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("active_at"),
    )


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """Look a rule up by its ``<namespace>_<name>`` key."""
    return rows.where(F.col("alertname") == key)
