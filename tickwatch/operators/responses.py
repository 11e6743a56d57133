"""Ticks from stored search responses: the answer is JSON text, not a count over a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.functions.conditions import compare
from tickwatch.functions.jsonpath import as_double, variant_path, was_coerced
from tickwatch.operators import quality

DEFAULT_PATH = "hits.total.value"


def response_ticks(responses: DataFrame, rules: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Evaluate stored responses against their rules.

    ``responses`` holds ``namespace, rule, tick, status_code, body``; a NULL status means the
    call itself failed.  Adds ``value``, ``coerced``, ``aggregations``, ``outcome``,
    ``for_us`` and ``firing``, which is NULL on a failed tick, so the state operators skip
    it.  Without ``sources`` every source counts as found.
    """
    if sources is not None:
        resolved = quality.resolve_sources(rules, sources)
    else:
        resolved = rules.withColumns({"source_path": F.lit(""), "has_credentials": F.lit(True)})
    path = F.coalesce(F.nullif(F.col("search.value_path"), F.lit("")), F.lit(DEFAULT_PATH))
    wanted = resolved.select(
        "namespace", F.col("name").alias("rule"), "search", "query_json", "condition", "threshold_value", "for_us",
        "source_path", "has_credentials", variant_path(path).alias("_path"),
    )
    rows = (
        responses.join(wanted, ["namespace", "rule"])
        .withColumn("_doc", F.try_parse_json("body"))
        .withColumn("_found", F.try_variant_get(F.col("_doc"), F.col("_path"), "variant"))
        .withColumn("path_found", F.col("_found").isNotNull())
        .withColumn("outcome", quality.outcome())
    )
    ok = F.col("outcome") == model.OK
    found = F.col("_found")
    # one projection per step: an expression that is read often has to be a column first
    valued = rows.withColumn("_number", as_double(found)).withColumn("value", F.when(ok, F.col("_number")))
    return valued.select(
        "namespace",
        "rule",
        "tick",
        "outcome",
        "value",
        F.when(ok, was_coerced(found)).alias("coerced"),
        F.when(ok, F.try_variant_get(F.col("_doc"), F.lit("$.aggregations"), "variant")).alias("aggregations"),
        "for_us",
        F.when(ok, compare(F.col("value"), F.col("condition.operator"), F.col("threshold_value"))).alias("firing"),
    )
