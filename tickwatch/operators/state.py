"""Rule states, state times, transitions and alert intervals.

A rule's history is cut into chunks of time.  Windows run inside one (rule, chunk), and
a one-row summary per chunk carries what the next chunk needs, so a rule with a very long
or very dense history is still spread over many tasks.  The same carry takes the last
rows of an earlier run (``seed``), which makes incremental runs equal to one long run.

States follow runs of equal condition outcome:

* true: ``PendingFiring`` until the run has lasted longer than ``for``, then ``Firing``;
* false: ``Normal`` if the rule never fired, else ``PendingResolving`` until the run has
  lasted longer than ``for``, then ``Normal``.

A ``for`` of zero or less counts as passed at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.functions.conditions import compare
from tickwatch.functions.durations import parse_micros
from tickwatch.functions.timegrid import floor_div, from_micros, micros

KEYS = ["namespace", "rule"]
DEFAULT_CHUNK = "24h"

# what a later run needs to know about the last row of a rule
SEED_COLUMNS = [
    "tick",
    "firing",
    "state",
    "run_start",
    "firing_time",
    "resolving_time",
    "alert_tick",
    "alert_value",
    "alert_payload",
    "incident",
]


def evaluate_conditions(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``for_us`` and ``firing`` from the rule catalog; ``firing`` is NULL on a bad condition,
    and a duration that cannot be read is one.  A tick whose ``outcome`` is a failure has none either."""
    r = rules.select(
        "namespace",
        F.col("name").alias("rule"),
        F.col("condition.operator").alias("operator"),
        "threshold_value",
        "for_us",
    )
    able = F.col("for_us").isNotNull()
    if "outcome" in ticks.columns:
        able &= F.col("outcome") == model.OK
    return (
        ticks.join(r, KEYS)
        .withColumn(
            "firing",
            F.when(able, compare(F.col("value"), F.col("operator"), F.col("threshold_value"))),
        )
        .drop("operator", "threshold_value")
    )


def chunk_of(chunk: str = DEFAULT_CHUNK) -> Column:
    """Number of the time slice a row's tick lies in."""
    return floor_div(micros(F.col("tick")), parse_micros(chunk))


def _past(start: Column) -> Column:
    return (micros(F.col("tick")) - micros(start) > F.col("for_us")) | (F.col("for_us") <= 0)


def _runs(ticks: DataFrame, keys: list[str], seed: DataFrame | None) -> DataFrame:
    """Add ``run_start`` and ``fired_before`` (any true tick earlier in the history)."""
    group = ", ".join(keys)
    inside = f"partition by {group}, chunk order by tick"
    so_far = f"over ({inside} rows unbounded preceding)"
    local = ticks.selectExpr(
        "*", f"if(firing <=> lag(firing) over ({inside}), null, tick) as _break"
    ).selectExpr(
        "*",
        f"last_value(_break) ignore nulls {so_far} as _start",
        f"first_value(tick) {so_far} as _head",
        f"max(firing) {so_far} as _fired",
    )
    # one row per chunk: how it begins, how it ends
    ends = local.groupBy(*keys, "chunk").agg(
        F.expr("min_by(firing, tick) as first_firing"),
        F.expr("max_by(firing, tick) as last_firing"),
        F.expr("max_by(_start, tick) as last_start"),
        F.expr("min(tick) as head"),
        F.expr("max(firing) as any_fired"),
    )
    if seed is not None:
        ends = ends.unionByName(
            seed.select(
                *keys,
                F.lit(-(2**62)).alias("chunk"),
                F.col("firing").alias("first_firing"),
                F.col("firing").alias("last_firing"),
                F.col("run_start").alias("last_start"),
                # never equal to last_start: a seed always opens its own run
                F.lit(None).cast("timestamp_ntz").alias("head"),
                # a rule that is Normal behaves as one that never fired
                (F.col("state") != model.NORMAL).alias("any_fired"),
            )
        )
    across = f"partition by {group} order by chunk"
    earlier = f"over ({across} rows between unbounded preceding and 1 preceding)"
    carry = ends.selectExpr("*", f"lag(last_firing) over ({across}) as _prev_firing").selectExpr(
        "*",
        """if(head is null or last_start > head or _prev_firing is null or _prev_firing <> first_firing,
           last_start, null) as _own""",
    ).selectExpr(
        *keys,
        "chunk",
        "_prev_firing",
        f"last_value(_own) ignore nulls {earlier} as _prev_start",
        f"max(any_fired) {earlier} as _prev_fired",
    )
    kept = [c for c in ticks.columns if c not in (*keys, "chunk")]
    return local.join(carry, [*keys, "chunk"], "left").selectExpr(
        *keys,
        "chunk",
        *kept,
        "if(_start = _head and _prev_firing = firing, _prev_start, _start) as run_start",
        "_fired or coalesce(_prev_fired, false) as fired_before",
    )


def carry_last(
    rows: DataFrame,
    keys: list[str],
    marks: dict[str, Column],
    up_to_now: dict[str, bool],
    seeds: DataFrame | None = None,
    order: tuple[str, ...] = ("tick",),
) -> DataFrame:
    """For each mark, its last non-NULL value in the history of ``keys``.

    ``rows`` is cut into chunks by its ``chunk`` column; ``up_to_now[name]`` tells whether
    the current row counts or only earlier rows; ``seeds`` holds ``_e_<name>`` columns
    from before the first row.
    """
    group = ", ".join(keys)
    until = {True: "current row", False: "1 preceding"}
    marked = rows.withColumns({f"_m_{n}": c for n, c in marks.items()})
    local = marked.selectExpr(
        "*",
        *[
            f"""last_value(_m_{n}) ignore nulls over (partition by {group}, chunk order by {', '.join(order)}
                rows between unbounded preceding and {until[up_to_now[n]]}) as _l_{n}"""
            for n in marks
        ],
    )
    ends = marked.groupBy(*keys, "chunk").agg(
        *[F.expr(f"max_by(_m_{n}, if(_m_{n} is null, null, struct({', '.join(order)}))) as _e_{n}") for n in marks]
    )
    if seeds is not None:
        ends = ends.unionByName(seeds.withColumn("chunk", F.lit(-(2**62))))
    earlier = f"over (partition by {group} order by chunk rows between unbounded preceding and 1 preceding)"
    carry = ends.selectExpr(*keys, "chunk", *[f"last_value(_e_{n}) ignore nulls {earlier} as _c_{n}" for n in marks])
    kept = [c for c in rows.columns if c not in (*keys, "chunk")]
    return local.join(carry, [*keys, "chunk"], "left").selectExpr(
        *keys, "chunk", *kept, *[f"coalesce(_l_{n}, _c_{n}) as {n}" for n in marks]
    )


def states(
    ticks: DataFrame, keys: list[str] | None = None, chunk: str = DEFAULT_CHUNK, seed: DataFrame | None = None
) -> DataFrame:
    """Add ``run_start`` and ``state`` to evaluated ticks (``keys, tick, value, firing, for_us``).

    Rows whose ``firing`` is NULL are failed ticks: they change nothing and are dropped.
    """
    keys = keys or KEYS
    good = ticks.where(F.col("firing").isNotNull()).withColumn("chunk", chunk_of(chunk))
    runs = _runs(good, keys, seed)
    past = _past(F.col("run_start"))
    state = (
        F.when(F.col("firing"), F.when(past, model.FIRING).otherwise(model.PENDING_FIRING))
        .when(~F.col("fired_before") | past, model.NORMAL)
        .otherwise(model.PENDING_RESOLVING)
    )
    return runs.withColumn("state", state).drop("fired_before")


def state_times(
    ticks: DataFrame,
    keys: list[str] | None = None,
    chunk: str = DEFAULT_CHUNK,
    seed: DataFrame | None = None,
    payload: str | None = None,
) -> DataFrame:
    """States with the times and alert fields a rule keeps until it is ``Normal`` again.

    Adds ``firing_time``, ``resolving_time``, and while an alert is active ``alert_tick``,
    ``alert_value`` and ``alert_payload`` (the last ``Firing`` tick, its value and its
    ``payload`` column), and ``incident`` (the last ``Normal`` tick before this row).
    """
    keys = keys or KEYS
    rows = states(ticks, keys, chunk, seed)
    state, tick, start = F.col("state"), F.col("tick"), F.col("run_start")
    none = F.lit(None)
    extra = F.col(payload) if payload else none.cast("string")

    def mark(cond: Column, value: Column, kind: str) -> Column:
        # Normal clears the mark, so it has to be a non-NULL struct around a NULL
        return F.when(state == model.NORMAL, F.struct(none.cast(kind).alias("v"))).when(
            cond, F.struct(value.cast(kind).alias("v"))
        )

    alert = F.struct(tick.alias("tick"), F.col("value").alias("value"), extra.alias("payload"))
    alert_kind = f"struct<tick: timestamp_ntz, value: double, payload: {rows.schema[payload].dataType.simpleString() if payload else 'string'}>"
    marks = {
        "firing_time": mark(F.col("firing"), start, "timestamp_ntz"),
        "resolving_time": mark(state == model.PENDING_RESOLVING, start, "timestamp_ntz"),
        "alert": mark(state == model.FIRING, alert, alert_kind),
        "incident": F.when(state == model.NORMAL, tick),
    }
    up_to_now = {"firing_time": True, "resolving_time": True, "alert": True, "incident": False}
    seeds = None
    if seed is not None:
        seeds = seed.select(
            *keys,
            F.struct(F.col("firing_time").alias("v")).alias("_e_firing_time"),
            F.struct(F.col("resolving_time").alias("v")).alias("_e_resolving_time"),
            F.struct(
                F.when(
                    F.col("alert_tick").isNotNull(),
                    F.struct(F.col("alert_tick").alias("tick"), F.col("alert_value").alias("value"), F.col("alert_payload").alias("payload")),
                ).alias("v")
            ).alias("_e_alert"),
            F.when(F.col("state") == model.NORMAL, F.col("tick")).otherwise(F.col("incident")).alias("_e_incident"),
        )
    carried = carry_last(rows, keys, marks, up_to_now, seeds)
    return (
        carried.withColumn("firing_time", F.col("firing_time.v"))
        .withColumn("resolving_time", F.col("resolving_time.v"))
        .withColumn("alert_tick", F.col("alert.v.tick"))
        .withColumn("alert_value", F.col("alert.v.value"))
        .withColumn("alert_payload", F.col("alert.v.payload"))
        .drop("alert", "chunk")
    )


def unbroken(rows: DataFrame, keys: list[str], position: str, gap: int | Column) -> DataFrame:
    """Add ``run_from``: the first ``position`` of the gapless run a row lies in.

    Two rows further apart than ``gap``, the same for all rows of a key, are in different runs.  ``rows`` is cut into chunks
    by its ``chunk`` column; a one-row summary per chunk tells whether its first run
    continues the last run of the chunk before.
    """
    rows = rows.withColumn("_gap", F.lit(gap).cast("bigint") if isinstance(gap, int) else gap)
    inside = Window.partitionBy(*keys, "chunk").orderBy(position)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.lag(position).over(inside)
    here = F.col(position)
    local = rows.select("*", F.when(prev.isNull() | (here - prev > F.col("_gap")), here).alias("_break")).select(
        "*", F.last("_break", ignorenulls=True).over(so_far).alias("_start"), F.first(position).over(so_far).alias("_head")
    )
    ends = local.groupBy(*keys, "chunk").agg(
        F.min(position).alias("head"), F.max(position).alias("tail"), F.max("_start").alias("last_start"), F.max("_gap").alias("_gap")
    )
    across = Window.partitionBy(*keys).orderBy("chunk")
    joined = F.coalesce(F.col("head") - F.lag("tail").over(across) <= F.col("_gap"), F.lit(False))
    linked = ends.select(
        *keys,
        "chunk",
        joined.alias("_joined"),
        F.when((F.col("last_start") > F.col("head")) | ~joined, F.col("last_start")).alias("_own"),
    )
    carried = F.last("_own", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carry = linked.select(*keys, "chunk", "_joined", carried.alias("_carried"))
    continues = (F.col("_start") == F.col("_head")) & F.col("_joined")
    return (
        local.join(carry, [*keys, "chunk"])
        .withColumn("run_from", F.when(continues, F.col("_carried")).otherwise(F.col("_start")))
        .drop("_break", "_start", "_head", "_joined", "_carried", "_gap")
    )


def seed_of(state_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last row per rule of :func:`state_times`, as the seed of the next run."""
    keys = keys or KEYS
    rest = [c for c in state_rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "tick").alias("s")
    return state_rows.groupBy(*keys).agg(last).select(*keys, "s.*").select(*keys, *SEED_COLUMNS)


def latest(state_rows: DataFrame, keys: list[str] | None = None, order: str = "tick") -> DataFrame:
    """Latest row per key; the same rule serves any last-write-wins table."""
    keys = keys or KEYS
    rest = [c for c in state_rows.columns if c not in keys]
    return state_rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")


def transitions(
    state_rows: DataFrame, keys: list[str] | None = None, chunk: str = DEFAULT_CHUNK, seed: DataFrame | None = None
) -> DataFrame:
    """Rows at which the state differs from the rule's row before; the first row counts
    when it differs from the state in ``seed``, the last rows of an earlier run, or else from
    ``Normal``.  Columns ``keys, tick, from_state, to_state, value``."""
    keys = keys or KEYS
    rows = state_rows.select(*keys, "tick", "state", "value").withColumn("chunk", chunk_of(chunk))
    # the state before a row: inside the chunk by lag, at its head from the chunk before
    prev = carry_last(rows, keys, {"from_state": F.col("state")}, {"from_state": False}, None if seed is None else seed.select(*keys, F.col("state").alias("_e_from_state")))
    before = F.coalesce("from_state", F.lit(model.NORMAL))
    return prev.where(before != F.col("state")).select(
        *keys, "tick", before.alias("from_state"), F.col("state").alias("to_state"), "value"
    )


def alert_intervals(
    state_rows: DataFrame,
    rules: DataFrame | None = None,
    keys: list[str] | None = None,
    still_open: DataFrame | None = None,
) -> DataFrame:
    """One row per alert: ``opened_at``, ``closed_at`` (NULL while open), ``last_active_at``,
    ``last_firing_at`` and the frozen ``value`` and ``payload`` of the last ``Firing`` tick.

    With ``rules``, alerts of rules without an action are dropped and the rest carry the
    action's name and namespace.  Takes the rows of :func:`state_times`.  A run that was
    seeded passes the earlier run's open alerts as ``still_open`` to keep ``opened_at``.
    """
    keys = keys or KEYS
    fires = F.col("state") == model.FIRING
    normal = F.col("state") == model.NORMAL
    out = (
        state_rows.groupBy(*keys, "incident")
        .agg(
            F.min(F.when(fires, F.col("tick"))).alias("opened_at"),
            F.max(F.when(normal, F.col("tick"))).alias("closed_at"),
            F.max(F.when(~normal & F.col("alert_tick").isNotNull(), F.col("tick"))).alias("last_active_at"),
            F.max(F.when(fires, F.col("tick"))).alias("last_firing_at"),
            F.max_by("value", F.when(fires, F.col("tick"))).alias("value"),
            F.max_by("alert_payload", F.when(fires, F.col("tick"))).alias("payload"),
            F.min("tick").alias("_from"),
        )
    )
    if still_open is not None:
        out = _reopen(out, still_open, keys)
    out = out.where(F.col("opened_at").isNotNull()).drop("incident", "_from")
    if rules is None:
        return out
    actions = rules.where(F.col("action").isNotNull()).select(
        "namespace",
        F.col("name").alias("rule"),
        F.col("action.name").alias("action_name"),
        F.col("action.namespace").alias("action_namespace"),
    )
    return out.join(actions, ["namespace", "rule"])


def _reopen(found: DataFrame, still_open: DataFrame, keys: list[str]) -> DataFrame:
    """Continue alerts that were open at the end of the earlier run."""
    first = found.groupBy(*keys).agg(F.min("_from").alias("_rule_from"))
    old = still_open.where(F.col("closed_at").isNull()).select(
        *keys,
        F.col("opened_at").alias("_o"),
        F.col("last_active_at").alias("_a"),
        F.col("last_firing_at").alias("_f"),
        F.col("value").alias("_v"),
        F.col("payload").alias("_p"),
        F.lit(True).alias("_has"),
    )
    # only a rule's first group of rows can belong to the old alert
    cont = (F.col("_from") == F.col("_rule_from")) & F.coalesce("_has", F.lit(False))
    fired = F.col("last_firing_at").isNotNull()
    return found.join(first, keys).join(old, keys, "left").select(
        *keys,
        "incident",
        "_from",
        F.when(cont, F.col("_o")).otherwise(F.col("opened_at")).alias("opened_at"),
        "closed_at",
        F.when(cont, F.coalesce("last_active_at", "_a")).otherwise(F.col("last_active_at")).alias("last_active_at"),
        F.when(cont, F.coalesce("last_firing_at", "_f")).otherwise(F.col("last_firing_at")).alias("last_firing_at"),
        F.when(cont & ~fired, F.col("_v")).otherwise(F.col("value")).alias("value"),
        F.when(cont & ~fired, F.col("_p")).otherwise(F.col("payload")).alias("payload"),
    )


def firing_events(state_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """One log row per ``Firing`` tick of a rule with an action."""
    from tickwatch.functions.text import number_text

    owners = rules.where(F.col("action").isNotNull()).select("namespace", F.col("name").alias("rule"))
    return (
        state_rows.where(F.col("state") == model.FIRING)
        .join(owners, KEYS, "left_semi")
        .select(
            "namespace",
            "rule",
            "tick",
            F.lit(model.FIRING_ACTION).alias("reason"),
            F.concat(F.lit(model.FIRING_NOTE), number_text(F.col("value"))).alias("note"),
        )
    )


def with_lives(
    ticks: DataFrame, deletions: DataFrame, keys: list[str] | None = None, chunk: str = DEFAULT_CHUNK
) -> DataFrame:
    """Give each life of a rule its own ``life`` number.

    ``deletions`` holds ``keys, deleted_at``.  A deletion drops the rule's state and alert,
    so ticks at or after it start over: add ``life`` to the keys of the state operators.
    """
    keys = keys or KEYS
    gone = deletions.select(
        *keys, F.col("deleted_at").alias("tick"), F.col("deleted_at"), F.lit(0).alias("_seq")
    ).distinct()
    # a deletion at the instant of a tick comes first
    rows = ticks.withColumn("_seq", F.lit(1)).unionByName(gone, allowMissingColumns=True)
    carried = carry_last(
        rows.withColumn("chunk", chunk_of(chunk)),
        keys,
        {"_life": F.col("deleted_at")},
        {"_life": True},
        order=("tick", "_seq"),
    )
    return (
        carried.where(F.col("_seq") == 1)
        .withColumn("life", F.coalesce(micros(F.col("_life")), F.lit(0).cast("bigint")))
        .drop("_seq", "_life", "deleted_at", "chunk")
    )


def as_of(
    state_rows: DataFrame,
    refresh: str = model.DEFAULT_REFRESH,
    keys: list[str] | None = None,
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """The state each refresh tick sees: the last row at or before it, per rule.

    Refresh ticks are multiples of ``refresh`` from a rule's first row to its last.
    Every row answers the refresh ticks from its own tick up to the next row, so no
    inequality join is needed.
    """
    keys = keys or KEYS
    every = parse_micros(refresh)
    rest = [c for c in state_rows.columns if c not in keys]
    rows = state_rows.withColumn("chunk", chunk_of(chunk))
    inside = Window.partitionBy(*keys, "chunk").orderBy("tick")
    heads = rows.groupBy(*keys, "chunk").agg(F.min("tick").alias("head"))
    after = heads.select(
        *keys, "chunk", F.lead("head").over(Window.partitionBy(*keys).orderBy("chunk")).alias("_after")
    )
    nxt = F.coalesce(F.lead("tick").over(inside), F.col("_after"))
    spans = rows.join(after, [*keys, "chunk"], "left").withColumn("_next", nxt)
    lo = floor_div(micros(F.col("tick")) + (every - 1), every)
    # the last row answers only its own instant
    hi = floor_div(F.coalesce(micros(F.col("_next")) - 1, micros(F.col("tick"))), every)
    return spans.where(lo <= hi).select(
        *keys,
        F.explode(F.sequence(lo, hi)).alias("_n"),
        *rest,
    ).select(*keys, from_micros(F.col("_n") * F.lit(every)).alias("refresh_tick"), *rest)
