"""Ticks that late rows restate: a change log of hits, beside the live states.

The live path tells a tick once, when time has passed it.  Here every row of the log is kept count of, however late it comes:
it counts at the ticks that come after its arrival and whose window holds it, as
:func:`tickwatch.operators.search.hits_as_of_ingest` has it, and each tick whose count it changes gets a change row with the
old and the new count.  Applied by key, the newest change of a tick is its count after all rows so far.

A rule's ticks lie in chunks, and a chunk is the key of the state, so neither a rule nor a day of many rows is one task.
No row is ever too late, so counts are never dropped: the state is one number per tick told, packed by the chunk.  To
forget old ticks, begin a new checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickwatch.functions.durations import parse_micros
from tickwatch.functions.timegrid import floor_div, from_micros, micros, require_utc
from tickwatch.model import Rule
from tickwatch.operators.search import attempts, plan_frame, spine
from tickwatch.streaming.live import require_state_store

# workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 512
CHANGES = "namespace string, rule string, tick bigint, seq bigint, old_hits bigint, new_hits bigint"


class ChangeProcessor(StatefulProcessor):
    """Counts of one chunk of a rule's ticks.  Rows are (first tick, last tick, n): n log rows that count at these ticks."""

    def __init__(self, chunk: int) -> None:
        self.chunk = chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "seq bigint, hits array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        base = int(key[2]) * self.chunk
        added = np.zeros(self.chunk + 1, np.int64)
        for part in rows:
            np.add.at(added, part["a"].to_numpy(np.int64) - base, part["n"].to_numpy(np.int64))
            np.subtract.at(added, part["b"].to_numpy(np.int64) - base + 1, part["n"].to_numpy(np.int64))
        added = np.cumsum(added[:-1])
        held = self.counts.get() if self.counts.exists() else None
        seq, old = (held[0], np.array(list(held[1]), np.int64)) if held else (0, np.zeros(self.chunk, np.int64))
        changed = np.flatnonzero(added)
        if not len(changed):
            return
        new = old + added
        self.counts.update((seq + 1, new.tolist()))
        before = pd.array([None if x == 0 else int(x) for x in old[changed]], dtype="Int64")
        out = pd.DataFrame({"namespace": key[0], "rule": key[1], "tick": changed + base, "seq": seq + 1, "old_hits": before, "new_hits": new[changed]})
        yield out.astype({"namespace": "object", "rule": "object"})

    def close(self) -> None:
        pass


def tick_spans(events: DataFrame, rules: list[Rule], ts_col: str, ingest_col: str, chunk: int) -> DataFrame:
    """``namespace, rule, chunk, a, b, n``: the ticks at which each row counts, cut at the chunks' edges."""

    def ticks(r: Rule) -> Column:
        step, width = parse_micros(r.check_interval), parse_micros(r.search.window)
        t, i = micros(F.col(ts_col)), micros(F.col(ingest_col))
        # from the first tick after the row's time and not before its arrival, to the last whose window holds it
        first = F.greatest(floor_div(t, step) + 1, floor_div(i + (step - 1), step))
        return F.struct(F.lit(r.namespace).alias("namespace"), F.lit(r.name).alias("rule"), first.alias("a"), floor_div(t + width, step).alias("b"))

    def holds(r: Rule) -> Column:
        tried = attempts(r, events)["filter"]
        return tried.value if tried.failed is None else tried.value & ~tried.failed

    hits = F.array_compact(F.array(*[F.when(holds(r), ticks(r)) for r in rules]))
    rows = events.select(F.inline(hits)).where("a <= b")
    lowest, highest = floor_div(F.col("a"), chunk), floor_div(F.col("b"), chunk)
    rows = rows.withColumn("chunk", F.explode(F.sequence(lowest, highest)))
    base = F.col("chunk") * chunk
    return rows.select("namespace", "rule", "chunk", F.greatest("a", base).alias("a"), F.least("b", base + (chunk - 1)).alias("b"), F.lit(1).cast("bigint").alias("n"))


def tick_changes(events: DataFrame, rules: list[Rule], ts_col: str = "ts", ingest_col: str = "ingest_ts", chunk: int = CHUNK) -> DataFrame:
    """The change log of the rules' hits: ``namespace, rule, tick, seq, old_hits, new_hits``.  ``seq`` orders the changes of
    a tick; ``old_hits`` is NULL for a tick that had no rows before."""
    for r in rules:
        if r.search.metric != "count" or r.search.group_by or r.search.round:
            raise ValueError(f"rule {r.namespace}/{r.name}: only counts of rows are restated")
    require_utc(events.sparkSession)
    require_state_store(events.sparkSession)
    steps = F.create_map(*[F.lit(x) for r in rules for x in (f"{r.namespace}/{r.name}", parse_micros(r.check_interval))])
    changes = (
        tick_spans(events, rules, ts_col, ingest_col, chunk)
        .groupBy("namespace", "rule", "chunk")
        .transformWithStateInPandas(ChangeProcessor(chunk), CHANGES, outputMode="Append", timeMode="None")
    )
    tick = from_micros(F.col("tick") * steps[F.concat_ws("/", "namespace", "rule")])
    return changes.withColumn("tick", tick)


def restated(changes: DataFrame) -> DataFrame:
    """The newest count of every tick that had rows, and how often it was told: ``namespace, rule, tick, hits, n_changes``."""
    return changes.groupBy("namespace", "rule", "tick").agg(F.max_by("new_hits", "seq").alias("hits"), F.count(F.lit(1)).alias("n_changes"))


def on_grid(counts: DataFrame, rules: list[Rule], first_us: Column, last_us: Column) -> DataFrame:
    """``counts`` on every tick between two instants, 0 where no row counts."""
    plan = plan_frame(counts.sparkSession, rules, first_us, last_us)
    ticks = spine(plan.selectExpr("rid", "first_tick div step as first_p", "last_tick div step as last_p")).join(plan.select("rid", "namespace", "rule", "step"), "rid")
    grid = ticks.select("namespace", "rule", from_micros(F.col("p") * F.col("step")).alias("tick"))
    return grid.join(counts, ["namespace", "rule", "tick"], "left").fillna(0, ["hits"])
