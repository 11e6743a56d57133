"""Thousands of rules over one log: rules as a table that rows are joined to.

A rule here is a row: equality terms, numeric ranges, a window and an interval.  The rules become an index of
(shape, key) entries and every log row lists the keys it has, so the join is on equality, the plan does not grow with the
number of rules, and a row meets only the rules that can match it:

* a rule with terms is found by the values of its term columns, one shape per set of columns;
* a rule with ranges only is found by its narrowest range: the range lies in at most two cells of a grid whose step is the
  power of two next above its width, one shape per column and power;
* a rule without a bounded range meets every row.

What the key does not decide (further ranges, the exact bounds) is checked after the join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.functions.durations import duration_micros
from tickwatch.functions.timegrid import floor_div, from_micros, micros, require_utc
from tickwatch.operators.search import sparse_windows

#: one rule; ``low`` is inclusive, ``high`` exclusive, and NULL is no bound
MANY_DDL = "namespace string, rule string, terms map<string,string>, ranges map<string,struct<low: double, high: double>>, window string, check_interval string"
_GCD = "aggregate(sequence(1, 128), struct(window_us as a, step as b), (s, _) -> if(s.b = 0, s, struct(s.b as a, s.a % s.b as b))).a"


def planned(rules: DataFrame) -> DataFrame:
    """Rules that can be evaluated, with their grid: step, pane ``g``, ``k`` panes a window, ends every ``align`` panes."""
    rows = rules.withColumns({"step": duration_micros("check_interval"), "window_us": duration_micros("window")}).where("step > 0 and window_us > 0")
    return rows.withColumn("g", F.expr(_GCD)).selectExpr(
        "namespace", "rule", "coalesce(terms, map()) as terms", "coalesce(ranges, map()) as ranges", "step", "g", "window_us div g as k", "step div g as align"
    )


def indexed(rules: DataFrame) -> DataFrame:
    """``rules`` with ``shape`` and ``key``, a row per entry: at most two for a rule.

    A shape is a JSON list of columns, or a column and a power of two; a key is a JSON list of values, or a cell.
    """
    bounded = F.filter(F.map_entries("ranges"), lambda r: r["value"]["low"].isNotNull() & (r["value"]["high"] > r["value"]["low"]))
    narrow = F.sort_array(F.transform(bounded, lambda r: F.struct((r["value"]["high"] - r["value"]["low"]).alias("width"), r["key"].alias("column"), r["value"].alias("range"))))
    names = F.array_sort(F.map_keys("terms"))
    power = F.ceil(F.log2("_range.width")).cast("int")
    low, high = (F.floor(F.col(f"_range.range.{x}") / F.pow(F.lit(2.0), power)).cast("string") for x in ("low", "high"))
    rows = rules.withColumns({"_range": F.get(narrow, F.lit(0)), "_names": names})
    shape = (
        F.when(F.size("_names") > 0, F.to_json("_names")).when(F.col("_range").isNotNull(), F.concat_ws("^", F.col("_range.column"), power.cast("string"))).otherwise("")
    )
    keys = (
        F.when(F.size("_names") > 0, F.array(F.to_json(F.transform("_names", lambda n: F.col("terms")[n]))))
        .when(F.col("_range").isNotNull(), F.array_distinct(F.array(low, high)))
        .otherwise(F.array(F.lit("")))
    )
    return rows.select("*", shape.alias("shape"), F.explode(keys).alias("key")).drop("_range", "_names")


def row_keys(events: DataFrame, shapes: list[str]) -> Column:
    """The entries a log row can match, as an array of (shape, key); a row without a value has no key of that shape."""
    known = set(events.columns)
    out = []
    for shape in shapes:
        if not shape:
            key = F.lit("")
        elif shape.startswith("["):
            names = json.loads(shape)
            if not set(names) <= known:
                continue  # no row of this log has such a column
            texts = [F.col(f"`{n}`").cast("string") for n in names]
            present = [t.isNotNull() for t in texts]
            key = F.to_json(F.array(*texts))
            for p in present:
                key = F.when(p, key)
        else:
            column, power = shape.rsplit("^", 1)
            if column not in known:
                continue
            x = F.col(f"`{column}`").cast("double")
            # what is not finite is in no bounded range
            key = F.when(F.abs(x) < float("inf"), F.floor(x / 2.0 ** int(power)).cast("string"))
        out.append(F.when(key.isNotNull(), F.struct(F.lit(shape).alias("shape"), key.alias("key"))))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<shape: string, key: string>>")


def matched(events: DataFrame, rules: DataFrame, ts_col: str = "ts", field: str | None = None) -> DataFrame:
    """A row per log row and rule that it matches: the rule's grid, ``us`` and ``x``."""
    index = indexed(planned(rules))
    # as many shapes as there are sets of columns and widths, however many rules
    shapes = sorted(r["shape"] for r in index.select("shape").distinct().collect())
    ranged = sorted(r["c"] for r in index.select(F.explode(F.map_keys("ranges")).alias("c")).distinct().collect())
    numbers = [x for c in ranged for x in (F.lit(c), (F.col(f"`{c}`").cast("double") if c in events.columns else F.lit(None).cast("double")))]
    values = F.create_map(*numbers) if numbers else F.create_map().cast("map<string,double>")
    x = F.col(f"`{field}`").cast("double") if field else F.lit(None).cast("double")
    rows = events.select(micros(F.col(ts_col)).alias("us"), x.alias("x"), values.alias("_values"), F.explode(row_keys(events, shapes)).alias("_k"))
    rows = rows.select("us", "x", "_values", "_k.shape", "_k.key").join(index, ["shape", "key"])
    inside = F.forall(
        F.map_entries("ranges"),
        lambda r: F.coalesce(
            F.col("_values")[r["key"]].isNotNull()
            & (r["value"]["low"].isNull() | (F.col("_values")[r["key"]] >= r["value"]["low"]))
            & (r["value"]["high"].isNull() | (F.col("_values")[r["key"]] < r["value"]["high"])),
            F.lit(False),
        ),
    )
    return rows.where(inside).select("namespace", "rule", "step", "g", "k", "align", "us", "x")


def rule_windows(events: DataFrame, rules: DataFrame, ts_col: str = "ts", field: str | None = None) -> DataFrame:
    """``namespace, rule, tick, hits, total, low, high`` for every tick whose window holds a matching row.

    Rows are counted per rule and pane before they are shuffled; windows without rows are not listed.
    """
    require_utc(events.sparkSession)
    series = ["namespace", "rule", "step", "g"]
    panes = (
        matched(events, rules, ts_col, field)
        .withColumn("p", floor_div(F.col("us"), F.col("g")))
        .groupBy(*series, "k", "align", "p")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    windows = sparse_windows(panes, series, F.col("k"), F.col("align"), ["hits", "total", "low", "high"])
    return windows.select("namespace", "rule", from_micros(F.col("e") * F.col("g")).alias("tick"), "hits", "total", "low", "high")
