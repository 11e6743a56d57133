"""Metric samples: rule gauges, custom metrics from aggregation trees, series upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.functions.jsonpath import as_double, as_label, key_path, lookup, variant_kind, variant_path
from tickwatch.functions.maps import labels_key
from tickwatch.functions.timegrid import floor_div
from tickwatch.operators.state import unbroken

KEYS = ["namespace", "rule"]
_RUN_CHUNK = 10_000


def _rule_labels(*more: Column) -> list[Column]:
    return [F.lit(model.NAMESPACE_LABEL), F.col("namespace"), F.lit(model.RULE_LABEL), F.col("rule"), *more]


def value_samples(ticks: DataFrame) -> DataFrame:
    """The value gauge alone; needs no states."""
    return ticks.select(
        "tick", F.lit(model.VALUE_METRIC).alias("metric"), F.create_map(*_rule_labels()).alias("labels"), "value"
    )


def basic_samples(state_rows: DataFrame) -> DataFrame:
    """The value gauge and the four state gauges (1 for the current state, else 0)."""
    value = F.struct(
        F.lit(model.VALUE_METRIC).alias("metric"), F.create_map(*_rule_labels()).alias("labels"), F.col("value")
    )
    one_hot = [
        F.struct(
            F.lit(model.STATE_METRIC).alias("metric"),
            F.create_map(*_rule_labels(F.lit("state"), F.lit(s))).alias("labels"),
            (F.col("state") == s).cast("double").alias("value"),
        )
        for s in model.STATES
    ]
    return state_rows.select("tick", F.inline(F.array(value, *one_hot)))


def declared_metrics(rules: DataFrame) -> DataFrame:
    """One row per (rule, custom metric): full name, help, ordered label names, definition, validity."""
    m = rules.select("namespace", F.col("name").alias("rule"), F.posexplode("custom_metrics").alias("metric_pos", "cm"))
    return m.select(
        *KEYS,
        "metric_pos",
        F.concat(F.lit(model.METRIC_PREFIX), F.col("cm.name")).alias("metric"),
        F.expr("coalesce(nullif(cm.help, ''), concat('Custom metric ', cm.name))").alias("help"),
        F.transform("cm.labels", lambda x: x["name"]).alias("label_names"),
        "cm",
        valid_metric_name(F.col("cm.name")).alias("name_ok"),
    )


def valid_metric_name(name: Column) -> Column:
    return F.coalesce(name.rlike(model.IDENTIFIER) & ~name.isin(model.RESERVED_METRICS), F.lit(False))


def label_conflicts(declared: DataFrame) -> DataFrame:
    """Declarations whose ordered label names differ from the metric's first declarer.

    The first declarer is the smallest (namespace, rule, position) with a valid name.
    """
    order = F.struct("namespace", "rule", "metric_pos")
    owner = declared.where("name_ok").groupBy("metric").agg(
        F.min_by(F.struct("namespace", "rule", "label_names"), order).alias("owner")
    )
    return (
        declared.where("name_ok")
        .join(owner, "metric")
        .where(F.col("label_names") != F.col("owner.label_names"))
        .select(
            *KEYS,
            "metric",
            "label_names",
            F.col("owner.namespace").alias("owner_namespace"),
            F.col("owner.rule").alias("owner_rule"),
            F.col("owner.label_names").alias("owner_label_names"),
        )
    )


def accepted_metrics(rules: DataFrame) -> DataFrame:
    """Declared metrics with a valid name and no label conflict."""
    declared = declared_metrics(rules).where("name_ok")
    bad = label_conflicts(declared).select(*KEYS, "metric", "label_names")
    return declared.join(bad, [*KEYS, "metric", "label_names"], "left_anti")


def _label_type() -> str:
    return "array<struct<name:string,value:string,static:boolean>>"


def extraction_plan(metrics: DataFrame) -> DataFrame:
    """Metric definitions with their paths translated once, ready to join to documents."""
    labels = F.coalesce("cm.labels", F.array().cast(_label_type()))
    value_path = F.coalesce(F.nullif(F.col("cm.value"), F.lit("")), F.lit(model.DEFAULT_VALUE_PATH))
    return metrics.select(
        *KEYS,
        "metric",
        "metric_pos",
        F.col("cm.aggregation_map").alias("map_text"),
        variant_path(F.col("cm.aggregation_map")).alias("map_path"),
        key_path(F.col("cm.aggregation_map")).alias("map_keys"),
        variant_path(value_path).alias("value_path"),
        key_path(value_path).alias("value_keys"),
        F.transform(labels, lambda x: x["name"]).alias("label_names"),
        F.transform(
            labels,
            lambda x: F.struct(
                F.when(F.coalesce(x["static"], F.lit(False)), x["value"]).alias("text"),
                variant_path(x["value"]).alias("path"),
                key_path(x["value"]).alias("keys"),
            ),
        ).alias("label_sources"),
    )


def bucket_samples(trees: DataFrame, metrics: DataFrame, cap: int = model.BUCKET_CAP) -> DataFrame:
    """One row per (rule, tick, metric, bucket): the custom-metric fan-out.

    ``trees`` holds ``namespace, rule, tick, aggregations VARIANT``; ``metrics`` comes from
    :func:`accepted_metrics`.  A path to an object counts as one bucket.  Only the first
    ``cap`` buckets of a list are listed, and ``truncated`` tells that there were more; the
    skip rules come after that: a missing label, then a missing or non-number value.
    """
    root = lookup(F.col("aggregations"), F.col("map_path"), F.col("map_keys"))
    as_list = F.try_variant_get(F.col("root"), F.lit("$"), "array<variant>")
    buckets = F.when(F.col("root").isNotNull(), F.coalesce(as_list, F.array("root")))
    found = (
        trees.where(F.col("aggregations").isNotNull())
        .join(extraction_plan(metrics), KEYS)
        .select("*", root.alias("root"))
        .select("*", buckets.alias("all_buckets"))
        .where(F.col("all_buckets").isNotNull())
        .select(
            *KEYS,
            "tick",
            "metric",
            "metric_pos",
            "label_names",
            "label_sources",
            "value_path",
            "value_keys",
            (F.size("all_buckets") > cap).alias("truncated"),
            F.posexplode(F.slice("all_buckets", 1, cap)).alias("pos", "bucket"),
        )
    )
    # find every label and value first, then give them their text and number forms
    label_found = F.transform(
        "label_sources",
        lambda x: F.struct(x["text"].alias("text"), lookup(F.col("bucket"), x["path"], x["keys"]).alias("v")),
    )
    value = lookup(F.col("bucket"), F.col("value_path"), F.col("value_keys"))
    return found.select(
        *KEYS, "tick", "metric", "metric_pos", "pos", "truncated", "label_names",
        label_found.alias("label_found"), value.alias("found"),
    )


def custom_samples(trees: DataFrame, metrics: DataFrame, cap: int = model.BUCKET_CAP) -> DataFrame:
    """``tick, metric, labels, value`` of the custom metrics; the last equal label set wins."""
    present = ~F.exists("label_found", lambda x: x["text"].isNull() & x["v"].isNull())
    numeric = variant_kind(F.col("found")).isin("number", "string")
    texts = F.transform("label_found", lambda x: F.coalesce(x["text"], as_label(x["v"])))
    rows = bucket_samples(trees, metrics, cap).where(present & numeric)
    return (
        rows.select(
            *KEYS, "tick", "metric", "label_names", texts.alias("label_values"),
            F.struct("metric_pos", "pos").alias("position"), as_double(F.col("found")).alias("value"),
        )
        .groupBy(*KEYS, "tick", "metric", "label_names", "label_values")
        .agg(F.max_by("value", "position").alias("value"))
        .select(
            "tick",
            "metric",
            F.map_from_arrays(
                F.concat(F.array(F.lit(model.NAMESPACE_LABEL), F.lit(model.RULE_LABEL)), F.col("label_names")),
                F.concat(F.array("namespace", "rule"), F.col("label_values")),
            ).alias("labels"),
            "value",
        )
    )


def missing_maps(trees: DataFrame, metrics: DataFrame) -> DataFrame:
    """Why a metric has no samples at a tick: ``NoAggregations`` or ``PathNotFound``, with a hint."""
    absent = F.col("aggregations").isNull() | F.coalesce(F.is_variant_null("aggregations"), F.lit(False))
    path = F.col("map_text")
    at_path = lookup(F.col("aggregations"), F.col("map_path"), F.col("map_keys"))
    reason = F.when(absent, model.NO_TREE).when(at_path.isNull(), model.NO_PATH)
    hint = F.when(
        (F.col("reason") == model.NO_PATH) & path.startswith("aggregations."), "drop the aggregations. prefix"
    )
    return (
        trees.join(extraction_plan(metrics).select(*KEYS, "metric", "map_text", "map_path", "map_keys"), KEYS)
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(*KEYS, "tick", "metric", "reason", hint.alias("hint"))
    )


def all_samples(state_rows: DataFrame, trees: DataFrame, rules: DataFrame, cap: int = model.BUCKET_CAP) -> DataFrame:
    """Basic and custom samples in one table."""
    return basic_samples(state_rows).unionByName(custom_samples(trees, accepted_metrics(rules), cap))


def top_buckets(rows: DataFrame, by: list[str], key: str, cap: int = model.BUCKET_CAP) -> DataFrame:
    """Bucket cap over rows that are not yet a list: the first ``cap`` buckets per group by
    count descending then key, with ``truncated`` telling that the group had more.

    The cap is the feature; ranking keeps at most ``cap`` rows per group map-side.
    """
    counts = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("doc_count"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("doc_count"), F.asc(key)))
    kept = counts.withColumn("pos", rank).where(F.col("pos") <= cap)
    sizes = counts.groupBy(*by).agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return kept.withColumn("pos", F.col("pos") - 1).join(sizes, by)


def truncation_counter(flags: DataFrame, by: list[str], order: str = "tick") -> DataFrame:
    """Running number of refreshes in which a metric went over the cap.

    ``flags`` holds ``by, order, truncated``.  Counted per day first, so one metric's
    whole history never has to be one window partition.
    """
    day = F.to_date(order)
    rows = flags.groupBy(*by, order).agg(F.max("truncated").cast("int").alias("t")).withColumn("day", day)
    inside = Window.partitionBy(*by, "day").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*by, "day").agg(F.sum("t").alias("n"))
    carried = days.select(*by, "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return rows.join(carried, [*by, "day"]).select(
        *by, order, (F.col("t") == 1).alias("truncated"), (F.sum("t").over(inside) + F.col("earlier")).alias("total")
    )


def refresh_order(refreshes: DataFrame, tick: str = "tick") -> DataFrame:
    """``tick``, its number ``n`` in time order, and the refresh after it, ``next_tick``.

    Refresh ticks are the distinct instants of one grid; they are numbered per day so that
    a long grid is not one window partition.
    """
    ticks = refreshes.select(F.col(tick).alias("tick")).distinct().withColumn("day", F.to_date("tick"))
    days = ticks.groupBy("day").agg(F.min("tick").alias("head"), F.count(F.lit(1)).alias("size"))
    order = Window.orderBy("day")
    linked = days.select(
        "day",
        F.lead("head").over(order).alias("after"),
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("before"),
    )
    inside = Window.partitionBy("day").orderBy("tick")
    return ticks.join(linked, "day").select(
        "tick",
        (F.col("before") + F.row_number().over(inside)).alias("n"),
        F.coalesce(F.lead("tick").over(inside), F.col("after")).alias("next_tick"),
    )


def stale_series(samples: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Series present at one refresh and absent at the next: what has to be deleted when.

    Both sides are keyed by (metric, labels, tick), so this is an equi anti-join.
    """
    link = refresh_order(refreshes)
    keyed = samples.select("tick", "metric", labels_key(F.col("labels")).alias("series")).distinct()
    expected = keyed.join(link.where(F.col("next_tick").isNotNull()).drop("n"), "tick").select(
        F.col("next_tick").alias("tick"), "metric", "series"
    )
    gone = expected.join(keyed, ["tick", "metric", "series"], "left_anti")
    return gone.select("tick", "metric", F.map_from_entries("series").alias("labels"))


def metric_lifecycle(declarations: DataFrame, refreshes: DataFrame) -> DataFrame:
    """When each metric is registered and dropped: ``metric, registered_at, dropped_at``.

    ``declarations`` holds ``tick, metric`` for every refresh at which some rule declares
    the metric, with or without samples.  A metric dies at the first refresh without a
    declarer; one row per life, ``dropped_at`` NULL while it lives.
    """
    declared = declarations.select("tick", "metric").distinct()
    numbered = declared.join(refresh_order(refreshes), "tick").withColumn("chunk", floor_div(F.col("n"), _RUN_CHUNK))
    lives = unbroken(numbered, ["metric"], "n", 1)
    return lives.groupBy("metric", "run_from").agg(
        F.min("tick").alias("registered_at"), F.max_by("next_tick", "n").alias("dropped_at")
    ).drop("run_from")
