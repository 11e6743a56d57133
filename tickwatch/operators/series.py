"""Per-series alerts: one alert per label set of a metric that is over the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.functions.conditions import compare
from tickwatch.functions.maps import labels_key, merge_maps
from tickwatch.functions.text import number_text
from tickwatch.functions.timegrid import from_micros, micros
from tickwatch.operators.state import chunk_of, unbroken


def alert_metric(custom_metrics: Column, preferred: Column) -> tuple[Column, Column]:
    """The metric a series alert reads, and why it is not the one asked for (else NULL)."""
    names = F.coalesce(F.transform(custom_metrics, lambda m: m["name"]), F.array().cast("array<string>"))
    wanted = F.nullif(preferred, F.lit(""))
    first = F.try_element_at(names, F.lit(1))
    hit = F.array_contains(names, wanted)
    name = F.when(F.size(names) == 0, F.lit(model.VALUE_METRIC)).otherwise(
        F.concat(F.lit(model.METRIC_PREFIX), F.when(hit, wanted).otherwise(first))
    )
    reason = F.when(
        (F.size(names) > 0) & ~hit,
        F.concat(F.lit("metric_name="), wanted, F.lit(" matches no declared metric; falling back to "), first),
    )
    return name, reason


def alert_name(name: Column, override: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), F.translate(name, "-", "_"))


def series_rules(rules: DataFrame) -> DataFrame:
    """Alert definition per rule with an enabled series alert: metric, text, labels, annotations.

    Rules whose operator, threshold or ``for`` is not valid have no definition.
    """
    metric, reason = alert_metric(F.col("custom_metrics"), F.col("series_alert.metric_name"))
    symbol = model.lookup(model.OPERATOR_SYMBOL, F.col("condition.operator"))
    labels = F.create_map(
        F.lit(model.ALERT_RULE_LABEL), F.col("name"), F.lit(model.NAMESPACE_LABEL), F.col("namespace")
    )
    described = F.create_map(
        F.lit("description"),
        F.format_string(
            "Rule %s/%s: condition %s threshold %s holds on metric %s",
            F.col("namespace"), F.col("name"), F.col("condition.operator"), F.col("condition.threshold"), metric,
        ),
    )
    selector = F.format_string(
        f'%s{{{model.NAMESPACE_LABEL}="%s",{model.RULE_LABEL}="%s"}} %s %s',
        metric, F.col("namespace"), F.col("name"), symbol, number_text(F.col("threshold_value")),
    )
    return (
        rules.where(F.coalesce("series_alert.enabled", F.lit(False)))
        .where(symbol.isNotNull() & F.col("threshold_value").isNotNull() & F.col("for_us").isNotNull())
        .select(
            "namespace",
            F.col("name").alias("rule"),
            alert_name(F.col("name"), F.col("series_alert.alert_name")).alias("alert_name"),
            metric.alias("metric"),
            reason.alias("mismatch"),
            F.col("condition.operator").alias("operator"),
            "threshold_value",
            "for_us",
            "check_us",
            selector.alias("expr"),
            merge_maps(labels, F.col("series_alert.labels")).alias("alert_labels"),
            merge_maps(described, F.col("series_alert.annotations")).alias("alert_annotations"),
        )
    )


def series_states(samples: DataFrame, definitions: DataFrame, refresh_us: int | None = None) -> DataFrame:
    """``pending`` / ``firing`` per series and tick, only while the condition holds.

    A tick where the condition is false or the sample is missing ends the run at once; a
    series fires when its run has lasted ``for``.  ``refresh_us`` is the period of the
    sample grid, by default each rule's interval: two samples further apart than that have a gap
    between them.
    """
    period = F.col("check_us") if refresh_us is None else F.lit(refresh_us).cast("bigint")
    d = definitions.withColumn("period", period).select("namespace", "rule", "metric", "operator", "threshold_value", "for_us", "period")
    labelled = samples.select(
        F.col("labels")[model.NAMESPACE_LABEL].alias("namespace"),
        F.col("labels")[model.RULE_LABEL].alias("rule"),
        "metric",
        "tick",
        labels_key(F.col("labels")).alias("series"),
        "value",
    )
    keys = ["namespace", "rule", "metric", "series"]
    held = (
        labelled.join(d, ["namespace", "rule", "metric"])
        .where(compare(F.col("value"), F.col("operator"), F.col("threshold_value")))
        .withColumns({"chunk": chunk_of(), "tick_us": micros(F.col("tick"))})
    )
    runs = unbroken(held, keys, "tick_us", F.col("period"))
    lasted = F.col("tick_us") - F.col("run_from")
    state = F.when(lasted >= F.col("for_us"), "firing").otherwise("pending")
    return runs.select(*keys, "tick", "value", from_micros(F.col("run_from")).alias("active_at"), state.alias("state"))


def series_alerts(samples: DataFrame, definitions: DataFrame, refresh_us: int | None = None) -> DataFrame:
    """Alert rows per series and tick with merged labels (the sample's labels under the
    alert's own) and annotations."""
    rows = series_states(samples, definitions, refresh_us)
    d = definitions.select("namespace", "rule", "metric", "alert_name", "alert_labels", "alert_annotations")
    return rows.join(d, ["namespace", "rule", "metric"]).select(
        "namespace",
        "rule",
        "alert_name",
        "metric",
        "tick",
        "value",
        "active_at",
        "state",
        merge_maps(F.map_from_entries("series"), F.col("alert_labels")).alias("labels"),
        F.col("alert_annotations").alias("annotations"),
    )
