"""Search operators: filters, windowed metrics, terms, ranges and response assembly.

All rules that read one log are answered from a single scan:

1. each log row is matched against every rule and counted per *pane* (the widest slice
   that divides every window and interval), combined map-side before any shuffle;
2. panes are merged into windows by :func:`slide`, whose cost does not depend on how
   many times windows overlap;
3. the pane grid is complete, so a tick whose window holds no rows still gets a row.

After step 1 the data no longer grows with the log, only with rules x panes.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwatch.functions.attempt import Attempt, cannot_fail, label, number, predicate
from tickwatch.functions.durations import parse_micros
from tickwatch.functions.timegrid import (
    ROUND_MICROS,
    floor_div,
    from_micros,
    micros,
    require_utc,
    time_bounds,
)
from tickwatch.model import OK, Rule, Search, local_frame

# how each measure is merged; a plan carries only the ones its rules read
MERGE = {"hits": "sum", "part": "sum", "n": "sum", "total": "sum", "low": "min", "high": "max", "errors": "sum", "failed": "min"}
_READS = {"count": [], "avg": ["n", "total"], "sum": ["total"], "min": ["low"], "max": ["high"], "pct": ["part"]}
_SPINE_CHUNK = 4096


# --- plain searches ---------------------------------------------------------------


def must(*predicates: Column) -> Column:
    """Conjunction of filters."""
    return reduce(lambda a, b: a & b, predicates)


def in_range(col: Column, gte=None, gt=None, lte=None, lt=None) -> Column:
    """Range filter; any bound may be left out."""
    tests = []
    if gte is not None:
        tests.append(col >= F.lit(gte))
    if gt is not None:
        tests.append(col > F.lit(gt))
    if lte is not None:
        tests.append(col <= F.lit(lte))
    if lt is not None:
        tests.append(col < F.lit(lt))
    return must(*tests) if tests else F.lit(True)


def total_hits(rows: DataFrame, predicate: Column) -> DataFrame:
    """One row with the number of matching rows, 0 when nothing matches."""
    return rows.where(predicate).agg(F.count(F.lit(1)).alias("total_hits"))


def terms(
    rows: DataFrame, key: Column, size: int = 10, metrics: dict[str, Column] | None = None
) -> DataFrame:
    """Buckets by value: ``position, key, doc_count``, metrics, ``sum_other_doc_count``.

    Order is ``doc_count`` descending, then key ascending; ``size`` is the number of
    buckets a terms search lists.
    """
    metrics = metrics or {}
    grouped = (
        rows.select(key.alias("key"), *[c.alias(f"_{n}") for n, c in metrics.items()])
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("doc_count"), *[F.sum(f"_{n}").alias(n) for n in metrics])
    )
    top = grouped.orderBy(F.desc("doc_count"), F.asc("key")).limit(size)
    # only ``size`` rows reach the single-partition window
    position = F.row_number().over(Window.orderBy(F.desc("doc_count"), F.asc("key"))) - 1
    total = grouped.select(F.sum("doc_count")).scalar()
    kept = F.sum("doc_count").over(Window.partitionBy())
    return top.select(
        position.alias("position"), "key", "doc_count", *metrics, (total - kept).alias("sum_other_doc_count")
    )


def date_range_terms(
    rows: DataFrame, ts: Column, ranges: list[tuple[str, str, str]], key: Column
) -> DataFrame:
    """Counts by named ``(name, from, to)`` half-open ranges, which may overlap, then by key."""
    named = F.array(
        *[
            F.struct(
                F.lit(n).alias("range"),
                F.lit(a).cast("timestamp_ntz").alias("from"),
                F.lit(b).cast("timestamp_ntz").alias("to"),
            )
            for n, a, b in ranges
        ]
    )
    hit = F.filter(named, lambda r: (ts >= r["from"]) & (ts < r["to"]))
    return (
        rows.select(F.explode(hit).alias("r"), key.alias("key"))
        .groupBy(F.col("r.range").alias("range"), "key")
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )


def ratio_by_key(rows: DataFrame, key: Column, part: Column) -> DataFrame:
    """Per bucket: ``doc_count``, the filtered sub-count and its share in percent."""
    return rows.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.count_if(part).alias("part_count"),
        (F.lit(100.0) * F.count_if(part) / F.count(F.lit(1))).alias("percentage"),
    )


def pick_bucket(buckets: DataFrame, by: list[str], pick: str, value: str = "value") -> DataFrame:
    """The bucket a condition reads: ``top``, ``max_bucket`` or ``min_bucket`` per ``by``.

    Ties go to the smallest key.  Aggregates map-side, so the number of buckets per group
    does not matter.
    """
    v = F.col(value)
    order = {
        "top": F.struct(-F.col("doc_count"), F.col("bucket")),
        "max_bucket": F.struct(-v, F.col("bucket")),
        "min_bucket": F.struct(v, F.col("bucket")),
    }[pick]
    best = F.min_by(F.struct("bucket", "doc_count", v.alias("value")), F.when(v.isNotNull(), order))
    return buckets.groupBy(*by).agg(best.alias("b")).select(*by, "b.bucket", "b.doc_count", "b.value")


# --- windowed searches ------------------------------------------------------------


def pane_micros(rule: Rule) -> int:
    """The widest slice that divides the rule's window, interval and rounding unit."""
    s = rule.search
    parts = [parse_micros(s.window), parse_micros(rule.check_interval)]
    if s.round:
        parts.append(ROUND_MICROS[s.round])
    return gcd(*parts)


PLAN_DDL = (
    "rid int, namespace string, rule string, metric string, pick string, "
    "step bigint, round_us bigint, g bigint, k bigint"
)


def plan_frame(spark: SparkSession, rules: list[Rule], first_us: Column, last_us: Column) -> DataFrame:
    """One small row per rule with its grid: interval, rounding unit, pane size ``g``, window
    of ``k`` panes, and the first and last tick and pane of the evaluated time."""
    require_utc(spark)
    rows = [
        {
            "rid": i,
            "namespace": r.namespace,
            "rule": r.name,
            "metric": r.search.metric,
            "pick": r.search.pick,
            "step": parse_micros(r.check_interval),
            "round_us": ROUND_MICROS.get(r.search.round, 1),
            "g": pane_micros(r),
            "k": parse_micros(r.search.window) // pane_micros(r),
        }
        for i, r in enumerate(rules)
    ]
    bounded = local_frame(spark, rows, PLAN_DDL).withColumns({"first_us": first_us, "last_us": last_us})
    return bounded.selectExpr(
        "*",
        "first_us - pmod(first_us, step) + step as first_tick",
        "last_us - pmod(last_us, step) + step as last_tick",
    ).selectExpr(
        "*",
        "(first_tick - pmod(first_tick, round_us) - pmod(first_tick - pmod(first_tick, round_us), g)) div g - k as first_p",
        "(last_tick - pmod(last_tick, g)) div g - 1 as last_p",
    ).where("first_tick <= last_tick")


def measures_of(rules: list[Rule]) -> list[str]:
    used = {m for r in rules for m in _READS[r.search.metric]} | {"part" for r in rules if r.search.part}
    return ["hits", *[m for m in MERGE if m in used]]


def _per_rule(values: list[int]) -> Column:
    """A per-rule constant looked up by ``rid``."""
    if len(set(values)) == 1:
        return F.lit(values[0]).cast("bigint")
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("rid") + 1)


def attempts(rule: Rule, events: DataFrame) -> dict[str, Attempt]:
    """A rule's expressions over its log, in the order in which a row's first failure is named."""
    s = rule.search
    out = {"filter": predicate(s.filter, events), "part": predicate(s.part or "false", events), "field": number(s.field or "null", events)}
    return out | ({"group_by": label(s.group_by, events)} if s.group_by else {})


def can_fail(rules: list[Rule], events: DataFrame) -> bool:
    """Whether an expression of any rule may raise on some row."""
    return any(a.failed is not None for r in rules for a in attempts(r, events).values())


def failure_measures(rules: list[Rule], events: DataFrame) -> list[str]:
    return ["errors", "failed"] if can_fail(rules, events) else []


def _matches(rows: DataFrame, rules: list[Rule], ts_col: str, keyed: bool) -> DataFrame:
    """``rid, p, [bucket], x, part, failed`` for every (row, rule) whose filter holds or one of whose expressions fails;
    ``p`` counts the rule's own panes, ``failed`` names the expression."""
    hits = []
    for i, r in enumerate(rules):
        tried = attempts(r, rows)
        failed = F.lit(None).cast("string")
        for name, a in reversed(tried.items()):
            if a.failed is not None:
                failed = F.when(a.failed, F.lit(name)).otherwise(failed)
        fields = [
            F.lit(i).alias("rid"),
            floor_div(F.col("__us"), F.lit(pane_micros(r)).cast("bigint")).alias("p"),
            tried["field"].value.alias("x"),
            tried["part"].value.alias("part"),
            failed.alias("failed"),
        ]
        if keyed:
            fields.append(tried["group_by"].value.alias("bucket"))
        holds = tried["filter"].value
        if tried["filter"].failed is not None:
            holds = holds | tried["filter"].failed
        hits.append(F.when(holds, F.struct(*fields)))
    if all(r.search.filter != "true" and cannot_fail(r.search.filter, rows) for r in rules):
        # reaches the parquet reader
        rows = rows.where(reduce(lambda a, b: a | b, [F.expr(r.search.filter) for r in rules]))
    out = rows.withColumn("__us", micros(F.col(ts_col))).select(F.inline(F.array_compact(F.array(*hits))))
    return out.where(F.col("bucket").isNotNull() & F.col("failed").isNull()) if keyed else out


def pane_counts(events: DataFrame, rules: list[Rule], ts_col: str, keyed: bool = False) -> DataFrame:
    """Measures per rule, (bucket) and pane number ``p``: the only pass over the log.

    A row on which an expression fails is counted in ``errors`` and nowhere else.
    """
    keys = ["rid", "bucket"] if keyed else ["rid"]
    failing = [] if keyed else failure_measures(rules, events)
    good = F.col("failed").isNull() if failing else F.lit(True)
    x = F.when(good, F.col("x")) if failing else F.col("x")
    first = {
        "hits": F.count_if(good) if failing else F.count(F.lit(1)),
        "part": F.count_if(good & F.col("part")),
        "n": F.count(x),
        "total": F.sum(x),
        "low": F.min(x),
        "high": F.max(x),
        "errors": F.count("failed"),
        "failed": F.min("failed"),
    }
    measures = measures_of(rules) + failing
    matched = _matches(events, rules, ts_col, keyed)
    return matched.groupBy(*keys, "p").agg(*[first[m].alias(m) for m in measures])


def _zero_measures(measures: list[str]) -> list[Column]:
    none = {True: F.lit(0).cast("bigint"), False: F.lit(None).cast("double")}
    return [(F.lit(None).cast("string") if m == "failed" else none[m in ("hits", "part", "n", "errors")]).alias(m) for m in measures]


def _merge(measures: list[str]) -> list[Column]:
    return [F.expr(f"{MERGE[m]}({m}) as {m}") for m in measures]


def spine(plan: DataFrame) -> DataFrame:
    """Every pane of every rule over the evaluated time, in two steps so that no single
    task has to write out a whole history."""
    size = _SPINE_CHUNK
    chunks = plan.selectExpr(
        "rid",
        "first_p",
        "last_p",
        f"explode(sequence((first_p - pmod(first_p, {size})) div {size}, (last_p - pmod(last_p, {size})) div {size})) as c",
    )
    parallel = plan.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(parallel, "rid", "c").selectExpr(
        "rid", f"explode(sequence(greatest(first_p, c * {size}), least(last_p, c * {size} + {size - 1}))) as p"
    )


def slide(panes: DataFrame, series: list[str], widths: list[int], measures: list[str]) -> DataFrame:
    """Merge panes into windows of ``k`` panes: ``series..., e, measures``, window ``[e-k, e)``.

    Panes are cut into blocks of ``k``.  A window of ``k`` panes is the tail of one block
    plus the head of the next, so every window is one running aggregate read backwards
    plus one read forwards.  Each pane therefore takes part in two rows however much the
    windows overlap, each group holds ``k`` panes at most, and nothing is subtracted, so
    minimum and maximum work like sums.  ``panes`` must be complete within its blocks.
    """
    k = _per_rule(widths)
    merged = (
        panes.withColumn("block", floor_div(F.col("p"), k))
        .repartition(*series, "block")
        .groupBy(*series, "block", "p")
        .agg(*_merge(measures))
    )
    if set(widths) == {1}:
        return merged.select(*series, (F.col("p") + 1).alias("e"), *measures)
    group = f"partition by {', '.join([*series, 'block'])} order by p"
    running = merged.selectExpr(
        *series,
        "p",
        "struct(p + 1 as e, " + ", ".join(f"{MERGE[m]}({m}) over ({group} rows unbounded preceding) as {m}" for m in measures) + ") as head",
        "struct(p, " + ", ".join(f"{MERGE[m]}({m}) over ({group} desc rows unbounded preceding) as {m}" for m in measures) + ") as tail",
    ).withColumn("k", k)
    sides = running.selectExpr(
        *series,
        "head",
        # a block's full tail equals its full head, so it is sent once
        "if(pmod(p, k) <> 0, struct(p + k as e, " + ", ".join(f"tail.{m} as {m}" for m in measures) + "), null) as tail",
    ).selectExpr(*series, "inline(array_compact(array(head, tail)))")
    return sides.groupBy(*series, "e").agg(*_merge(measures))


def sparse_windows(panes: DataFrame, series: list[str], k: Column, align: Column, measures: list[str]) -> DataFrame:
    """Windows of ``k`` panes that hold any pane, at ends that are multiples of ``align``: ``series..., e, measures``.

    ``panes`` lists only what exists, and nothing is filled in: a window is again the tail of one block and the head of
    the next, and between two panes of a block neither changes.  Each pane therefore stands for a span of heads and
    one of tails, and only the ends asked for are listed.  ``k`` and ``align`` are constant within a series.
    """
    merged = (
        panes.withColumns({"k": k, "align": align})
        .withColumn("block", floor_div(F.col("p"), F.col("k")))
        .groupBy(*series, "k", "align", "block", "p")
        .agg(*_merge(measures))
    )
    group = f"partition by {', '.join([*series, 'block'])} order by p"
    running = merged.selectExpr(
        *series, "k", "align", "block", "p", f"lead(p) over ({group}) as _next", f"lag(p) over ({group}) as _prev",
        "struct(" + ", ".join(f"{MERGE[m]}({m}) over ({group} rows unbounded preceding) as {m}" for m in measures) + ") as head",
        "struct(" + ", ".join(f"{MERGE[m]}({m}) over ({group} desc rows unbounded preceding) as {m}" for m in measures) + ") as tail",
    )

    def ends(low: str, high: str) -> str:
        first, last = f"({low} + pmod(-({low}), align))", f"({high} - pmod({high}, align))"
        return f"if({first} <= {last}, sequence({first}, {last}, align), array())"

    spans = running.selectExpr(
        *series,
        "inline(array("
        + f"struct({ends('p + 1', 'least(coalesce(_next, (block + 1) * k), (block + 1) * k)')} as es, head as m), "
        # a block's full tail equals its full head, so it is sent once
        + f"struct({ends('greatest(coalesce(_prev, block * k), block * k) + 1 + k', 'p + k')} as es, tail as m)))",
    )
    return spans.selectExpr(*series, "explode(es) as e", *[f"m.{m} as {m}" for m in measures]).groupBy(*series, "e").agg(*_merge(measures))


def _to_ticks(windows: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """Window ends to ticks.  With rounding, all ticks of one unit read the same window."""
    ends = windows.join(plan, "rid").withColumn("end_us", F.expr("e * g"))
    first_step = "end_us + pmod(-end_us, step)"
    ticks = f"""explode(case
        when round_us = 1 then case when pmod(end_us, step) = 0 then array(end_us) end
        when pmod(end_us, round_us) = 0 and {first_step} < end_us + round_us
          then sequence({first_step}, end_us + round_us - 1, step) end) as tick_us"""
    return ends.selectExpr(
        "namespace", "rule", "metric", "pick", *keep, "first_tick", "last_tick", ticks
    ).where("tick_us between first_tick and last_tick")


def _value(rules: list[Rule]) -> Column:
    hits, n, total = F.col("hits"), F.col("n"), F.col("total")
    answer = {
        "count": lambda: hits.cast("double"),
        "avg": lambda: F.when(n > 0, total / n),
        "sum": lambda: F.coalesce(total, F.lit(0.0)),
        "min": lambda: F.col("low"),
        "max": lambda: F.col("high"),
        "pct": lambda: F.when(hits > 0, F.lit(100.0) * F.col("part") / hits),
    }
    out = F.lit(None).cast("double")
    for metric in sorted({r.search.metric for r in rules}):
        out = F.when(F.col("metric") == metric, answer[metric]()).otherwise(out)
    return out


def _bounds(events: DataFrame, rules: list[Rule], ts_col: str, start, end) -> tuple[DataFrame, Column, Column]:
    """Rows to evaluate and the evaluated time.

    Without bounds that is the log's whole time.  With bounds the ticks are those in ``(start, end]``, so
    that adjacent runs share none, and rows are read from the first window's start on, so that no window is
    cut.  Literal bounds prune the scan.
    """
    first, last = time_bounds(events, ts_col) if start is None or end is None else (None, None)
    ts = F.col(ts_col)
    if start is not None:
        reach = max((parse_micros(r.search.window) + ROUND_MICROS.get(r.search.round, 0) for r in rules), default=0)
        first = micros(F.lit(start).cast("timestamp_ntz"))
        events = events.where(ts >= F.lit(start).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {reach} / 1000000.0bd)"))
    if end is not None:
        end = F.lit(end).cast("timestamp_ntz")
        events = events.where(ts < end)
        # the plan takes the tick after its last instant; the last tick here is at the end or before it
        last = micros(end) - F.col("step")
    return events, first, last


def bucket_values(
    events: DataFrame, rules: list[Rule], ts_col: str = "ts", start=None, end=None
) -> DataFrame:
    """``namespace, rule, tick, bucket, doc_count, value`` for the rules with ``group_by``.

    Buckets without rows in a window are not listed.
    """
    rules = [r for r in rules if r.search.group_by]
    measures = measures_of(rules)
    events, first_us, last_us = _bounds(events, rules, ts_col, start, end)
    plan = plan_frame(events.sparkSession, rules, first_us, last_us)
    widths = [parse_micros(r.search.window) // pane_micros(r) for r in rules]
    panes = pane_counts(events, rules, ts_col, keyed=True)
    # windows end where ticks read them: at each tick, or with rounding at each unit
    aligns = [(ROUND_MICROS[r.search.round] if r.search.round else parse_micros(r.check_interval)) // pane_micros(r) for r in rules]
    windows = sparse_windows(panes, ["rid", "bucket"], _per_rule(widths), _per_rule(aligns), measures).where(F.col("hits") > 0)
    part = F.col("part") if "part" in measures else F.lit(0).cast("bigint")
    return _to_ticks(windows, plan, ["bucket", *measures]).select(
        "namespace",
        "rule",
        from_micros(F.col("tick_us")).alias("tick"),
        "bucket",
        F.col("hits").alias("doc_count"),
        part.alias("part_count"),
        _value(rules).alias("value"),
        "pick",
    )


def tick_values(
    events: DataFrame,
    rules: list[Rule],
    ts_col: str = "ts",
    start=None,
    end=None,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """``namespace, rule, tick, hits, raw_value, value, outcome, detail``: one row per rule and tick.

    ``raw_value`` is NULL where the metric has no answer (an average over no rows);
    a condition reads that as 0, which is ``value``.  ``buckets`` are the rules'
    :func:`bucket_values` where they are already at hand.

    A tick whose window holds a row on which an expression of the rule fails is a ``query_error`` without a
    value; ``detail`` names the expression and the number of such rows.  Other rules do not notice.
    """
    failing = failure_measures(rules, events)
    measures = measures_of(rules) + failing
    rows, first_us, last_us = _bounds(events, rules, ts_col, start, end)
    plan = plan_frame(events.sparkSession, rules, first_us, last_us)
    widths = [parse_micros(r.search.window) // pane_micros(r) for r in rules]
    panes = pane_counts(rows, rules, ts_col).unionByName(
        spine(plan).select("rid", "p", *_zero_measures(measures))
    )
    windows = slide(panes, ["rid"], widths, measures)
    ticks = _to_ticks(windows, plan, measures).select(
        "namespace", "rule", from_micros(F.col("tick_us")).alias("tick"), "hits", "pick", _value(rules).alias("own"), *failing
    )
    picked = [r for r in rules if r.search.group_by and r.search.pick]
    raw = F.col("own")
    if picked:
        buckets = bucket_values(events, picked, ts_col, start, end) if buckets is None else buckets
        keys = ["namespace", "rule", "tick"]
        best = reduce(
            DataFrame.unionByName,
            [
                pick_bucket(buckets.where(F.col("pick") == p), keys, p).select(*keys, F.col("value").alias("picked"))
                for p in sorted({r.search.pick for r in picked})
            ],
        )
        ticks = ticks.join(best, keys, "left")
        raw = F.when(F.col("pick").isNotNull(), F.col("picked")).otherwise(F.col("own"))
    keep = ["namespace", "rule", "tick", "hits"]
    if not failing:
        ok = [F.lit(OK).alias("outcome"), F.lit(None).cast("string").alias("detail")]
        return ticks.select(*keep, raw.alias("raw_value"), F.coalesce(raw, F.lit(0.0)).alias("value"), *ok)
    good = F.col("errors") == 0
    return ticks.select(
        *keep,
        F.when(good, raw).alias("raw_value"),
        F.when(good, F.coalesce(raw, F.lit(0.0))).alias("value"),
        F.when(good, F.lit(OK)).otherwise("query_error").alias("outcome"),
        F.when(~good, F.format_string("%s fails on %d rows", "failed", "errors")).alias("detail"),
    )


def responses(buckets: DataFrame, ticks: DataFrame, size: int = 10, agg: str = "by_key") -> DataFrame:
    """One nested search response per (rule, tick), as JSON text.

    The bucket list holds the first ``size`` buckets, the length a terms search lists, so
    the collected array is bounded.
    """
    keys = ["namespace", "rule", "tick"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("doc_count"), F.asc("bucket")))
    top = buckets.withColumn("rank", rank).where(F.col("rank") <= size)
    item = F.struct(
        F.col("rank"),
        F.struct(
            F.col("bucket").alias("key"),
            F.col("doc_count"),
            F.struct(F.col("part_count").alias("doc_count")).alias("part"),
            F.struct("value").alias("metric"),
        ).alias("bucket"),
    )
    lists = top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["bucket"]).alias("buckets"),
        F.sum("doc_count").alias("kept"),
    )
    # rows without a key are hits but belong to no bucket
    lists = lists.join(buckets.groupBy(*keys).agg(F.sum("doc_count").alias("listed")), keys)
    doc = F.struct(
        F.struct(F.struct(F.col("hits").alias("value")).alias("total")).alias("hits"),
        F.struct(
            F.struct(
                "buckets", (F.col("listed") - F.col("kept")).alias("sum_other_doc_count")
            ).alias(agg)
        ).alias("aggregations"),
    )
    none = F.struct(F.struct(F.struct(F.col("hits").alias("value")).alias("total")).alias("hits"))
    return ticks.join(lists, keys, "left").select(
        *keys, F.when(F.col("buckets").isNull(), F.to_json(none)).otherwise(F.to_json(doc)).alias("body")
    )


def hits_as_of_ingest(events: DataFrame, rule: Rule, ts_col: str = "ts", ingest_col: str = "ingest_ts") -> DataFrame:
    """``tick, hits`` where a row counts only at ticks that come after its arrival.

    A row counts from the first tick that is after its time and not before its arrival to
    the last tick whose window still covers it.  Rows are first counted per such span, and
    only the counts are spread over the ticks.
    """
    step, width = parse_micros(rule.check_interval), parse_micros(rule.search.window)
    first_us, last_us = time_bounds(events, ts_col)
    # a plan of single panes: its spine is the tick grid
    plan = plan_frame(events.sparkSession, [replace(rule, search=Search(window=rule.check_interval))], first_us, last_us)
    spans = (
        events.where(F.expr(rule.search.filter))
        .select(micros(F.col(ts_col)).alias("t"), micros(F.col(ingest_col)).alias("i"))
        .selectExpr(
            f"greatest((t - pmod(t, {step})) div {step} + 1, (i + pmod(-i, {step})) div {step}) as a",
            f"(t + {width} - pmod(t + {width}, {step})) div {step} as b",
        )
        .where("a <= b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("explode(sequence(a, b)) as tick_no", "n")
    )
    counted = (
        spans.unionByName(spine(plan).selectExpr("p + 1 as tick_no", "0L as n"))
        .groupBy("tick_no")
        .agg(F.sum("n").alias("hits"))
    )
    grid = plan.selectExpr("first_tick div step as first_no", "last_tick div step as last_no")
    inside = F.col("tick_no").between(
        grid.select("first_no").scalar(), grid.select("last_no").scalar()
    )
    return counted.where(inside).select(from_micros(F.col("tick_no") * step).alias("tick"), "hits")
