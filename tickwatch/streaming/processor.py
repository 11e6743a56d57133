"""The keyed state of live rules, in two steps.

Spark counts the log per closed pane.  :class:`WindowProcessor` sees those small rows per (rule, shard of its buckets):
it keeps the panes that a window can still reach, joins them into windows, and gives one row per tick, with the shard's
best bucket.  :class:`RuleProcessor` sees these rows per life of a rule: it picks the rule's bucket, steps the state
machine and lists the deliveries that fall due.

Versions of rules come in between the panes.  A version holds from its time on: ticks before it are evaluated by the
version before, whatever the order of arrival, as long as it arrives before its time has passed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTS = ["hits", "part", "n", "errors"]
MEASURES = [*COUNTS, "total", "low", "high"]
CLOCK_STATE = "first_us bigint, horizon_us bigint, next_us bigint, life bigint, version string, pending string"
BLOCK_STATE = "p array<bigint>, " + ", ".join(f"{m} array<{'bigint' if m in COUNTS else 'double'}>" for m in MEASURES)
# what a shard says about a tick; a row without a tick says that time has come to ``at_us``, ``gone`` that the life has ended
TICKS = (
    "namespace string, rule string, life bigint, shard int, at_us bigint, tick bigint, gone boolean, hits bigint, errors bigint, own double, "
    "bucket string, doc_count bigint, value double, spec string"
)
RULE_STATE = (
    "tick bigint, state string, firing_us bigint, resolving_us bigint, alert_us bigint, alert_value double, alert_from bigint, sent_to bigint"
)
HELD_STATE = "hits bigint, errors bigint, own double, bucket string, doc_count bigint, value double, shards int"
OUTPUT = (
    "namespace string, rule string, tick timestamp_ntz, hits bigint, value double, firing boolean, state string, "
    "firing_time timestamp_ntz, resolving_time timestamp_ntz, alert_tick timestamp_ntz, alert_value double, "
    "life bigint, bucket string, action_namespace string, sent_at timestamp_ntz"
)


def _table(rows: list, ddl: str) -> pd.DataFrame:
    """Rows as a table whose kinds are those of ``ddl``, with NULLs."""
    kinds = {"string": "object", "bigint": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean"}
    columns = [c.split() for c in ddl.split(", ")]
    out = pd.DataFrame(rows, columns=[c for c, _ in columns], dtype="object")
    for name, kind in columns:
        if kind == "timestamp_ntz":
            out[name] = pd.to_datetime(out[name].astype("Int64"), unit="us")
        else:
            out[name] = out[name].astype(kinds[kind])
    return out


# --- windows -------------------------------------------------------------------------


def _running(p: np.ndarray, values: np.ndarray, blocks: np.ndarray, merge: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Per pane, its block merged up to it, and its block merged from it on."""
    heads, tails = np.empty_like(values), np.empty_like(values)
    edges = np.flatnonzero(np.diff(blocks)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(p)]):
        heads[lo:hi] = merge.accumulate(values[lo:hi])
        tails[lo:hi] = merge.accumulate(values[lo:hi][::-1])[::-1]
    return heads, tails


def windows(p: np.ndarray, measures: dict[str, np.ndarray], ends: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Windows ``[e - k, e)`` over sparse panes ``p`` (sorted, once each).

    A window is the tail of one block of ``k`` panes and the head of the next: two numbers each, however many panes
    or windows there are, and nothing is subtracted.  Work follows the panes that exist.
    """
    blocks = p // k
    begin = ends // k * k  # where the window's last block begins, or the end itself
    last = np.searchsorted(p, ends) - 1
    has_head = (last >= 0) & (p[np.maximum(last, 0)] >= begin) if len(p) else np.zeros(len(ends), bool)
    first = np.searchsorted(p, ends - k)
    has_tail = (first < len(p)) & (p[np.minimum(first, len(p) - 1)] < begin) if len(p) else has_head
    out = {}
    for name, values in measures.items():
        merge, zero = {"low": (np.fmin, np.nan), "high": (np.fmax, np.nan)}.get(name, (np.add, 0))
        if not len(p):
            out[name] = np.full(len(ends), zero, values.dtype)
            continue
        heads, tails = _running(p, values, blocks, merge)
        head = np.where(has_head, heads[np.maximum(last, 0)], zero)
        tail = np.where(has_tail, tails[np.minimum(first, len(p) - 1)], zero)
        out[name] = merge(tail, head)
    return out


def answer(metric: str, w: dict[str, np.ndarray]) -> np.ndarray:
    """The metric per window; NaN where there is no answer."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "count": lambda: w["hits"].astype(float),
            "avg": lambda: np.where(w["n"] > 0, w["total"] / w["n"], np.nan),
            "sum": lambda: w["total"].astype(float),
            "min": lambda: w["low"],
            "max": lambda: w["high"],
            "pct": lambda: np.where(w["hits"] > 0, 100.0 * w["part"] / w["hits"], np.nan),
        }[metric]()


def _better(pick: str, doc_count, value, held) -> bool:
    """Whether a bucket goes before the one held, by count or value; the caller settles ties."""
    if held is None:
        return True
    return {"top": doc_count > held[0], "max_bucket": value > held[1], "min_bucket": value < held[1]}[pick]


class WindowProcessor(StatefulProcessor):
    """``searches`` maps (namespace, rule) to what the plan counts: metric, pick, rounding unit, pane size, widest window,
    and the version that holds from the beginning, if any.

    Panes are held in blocks, one state row each, and leave by the block once no window can reach them.
    """

    def __init__(self, searches: dict[tuple[str, str], dict]) -> None:
        self.searches = searches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", CLOCK_STATE)
        self.blocks = handle.getMapState("blocks", "bucket string, block bigint", BLOCK_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        search = self.searches.get((key[0], key[1]))
        changes = [json.loads(x) for x in rows["version"].dropna()]
        panes = rows[rows["version"].isna()]
        known = self.clock.get() if self.clock.exists() else None
        names = [c.split()[0] for c in CLOCK_STATE.split(", ")]
        s = dict(zip(names, known)) if known else {"first_us": None, "horizon_us": None, "next_us": None, "life": None, "version": None, "pending": "[]"}
        if search is None and not (changes and s["life"] is not None):
            # the plan no longer counts for this rule: nothing of it is kept
            self.clock.clear()
            self.blocks.clear()
            return
        if known is None and search and search["version"]:
            s["version"], s["life"] = json.dumps(search["version"]), 0
        pending = sorted(json.loads(s["pending"]) + changes, key=lambda v: v["at_us"])
        if search is None:
            # counted no more, but its end has to be told
            gone = [v for v in pending if v["deleted"]]
            if gone:
                yield _table([self._row(key, s, gone[0]["at_us"], gone=True)], TICKS)
            self.clock.clear()
            self.blocks.clear()
            return
        if len(panes):
            if s["first_us"] is None:
                s["first_us"] = int(panes["pane_us"].min())
            s["horizon_us"] = max(s["horizon_us"] or 0, int(panes["pane_us"].max()) + search["pane"])
            self._hold(search, panes[panes["counted"] > 0])
        out = list(self._advance(key, search, s, pending)) if s["horizon_us"] is not None else []
        s["pending"] = json.dumps(pending)
        self.clock.update(tuple(s[n] for n in names))
        if len(panes):
            self._evict(search, s, pending)
        if out:
            yield _table(out, TICKS)

    def _hold(self, search: dict, panes: pd.DataFrame) -> None:
        p = panes["pane_us"].to_numpy(np.int64) // search["pane"]
        panes = panes.assign(p=p, block=p // search["block"], bucket=np.where(panes["bucket"].isna(), "o", "b" + panes["bucket"].fillna("")))
        for (bucket, block), fresh in panes.groupby(["bucket", "block"]):
            held = self.blocks.getValue((bucket, int(block)))
            table = fresh[["p", *MEASURES]]
            if held is not None:
                old = pd.DataFrame({n: list(v) for n, v in zip(["p", *MEASURES], held)})
                table = pd.concat([old, table])
            table = table.astype({m: "float64" for m in ("total", "low", "high")}).groupby("p", as_index=False).agg(
                {**{m: "sum" for m in [*COUNTS, "total"]}, "low": "min", "high": "max"}
            )
            whole = [[int(x) for x in table[m]] for m in ["p", *COUNTS]]
            real = [[None if np.isnan(x) else float(x) for x in table[m]] for m in ("total", "low", "high")]
            self.blocks.updateValue((bucket, int(block)), (*whole, *real))

    def _load(self) -> dict[str, tuple[np.ndarray, dict[str, np.ndarray]]]:
        found: dict[str, list] = {}
        for (bucket, block), value in self.blocks.iterator():
            found.setdefault(bucket, []).append((block, value))
        out = {}
        for bucket, parts in found.items():
            columns = list(zip(*[v for _, v in sorted(parts, key=lambda x: x[0])]))
            kinds = [np.int64] * (1 + len(COUNTS)) + [np.float64] * 3
            arrays = [np.array([x for part in c for x in part], kind) for c, kind in zip(columns, kinds)]
            out[bucket] = (arrays[0], dict(zip(MEASURES, arrays[1:])))
        return out

    def _advance(self, key, search: dict, s: dict, pending: list[dict]) -> Iterator[tuple]:
        """All ticks up to the horizon, by the versions that hold at them; used versions leave ``pending``."""
        horizon, loaded = s["horizon_us"], None
        while True:
            version = json.loads(s["version"]) if s["version"] else None
            change = pending[0] if pending and pending[0]["at_us"] <= horizon else None
            if version is not None:
                step = version["step_us"]
                if s["next_us"] is None:
                    # the first tick is after the first row, and in the version's time
                    begin = max(s["first_us"] + 1, version["at_us"] or 0)
                    s["next_us"] = -(-begin // step) * step
                until = horizon if change is None else min(horizon, change["at_us"] - 1)
                ticks = np.arange(s["next_us"], until + 1, step, dtype=np.int64)
                if len(ticks):
                    loaded = self._load() if loaded is None else loaded
                    yield from self._ticks(key, search, s, version, ticks, loaded)
                    s["next_us"] = int(ticks[-1]) + step
            if change is None:
                break
            pending.pop(0)
            if change["deleted"]:
                if s["life"] is not None:
                    yield self._row(key, s, change["at_us"], gone=True)
                s["version"], s["next_us"], s["life"] = None, None, None
            elif not search["pane"] or change["step_us"] % search["pane"] or change["window_us"] % search["pane"] or change["round_us"] % search["pane"]:
                # cannot be counted by this plan's panes: nothing is evaluated until another version comes, the life goes on
                s["version"], s["next_us"] = None, None
            else:
                if s["life"] is None:
                    s["life"] = change["at_us"]
                if version is None:
                    s["next_us"] = None
                else:
                    # the grid goes on after the ticks already told
                    begin = max(change["at_us"], s["next_us"] - version["step_us"] + 1)
                    s["next_us"] = -(-begin // change["step_us"]) * change["step_us"]
                s["version"] = json.dumps(change)
        if s["version"]:
            yield self._row(key, s, horizon)

    def _ticks(self, key, search, s, version, ticks, loaded) -> Iterator[tuple]:
        pane, k = search["pane"], version["window_us"] // search["pane"]
        ends = ticks // version["round_us"] * version["round_us"] // pane
        none = (np.zeros(0, np.int64), {m: np.zeros(0, np.int64 if m in COUNTS else np.float64) for m in MEASURES})
        own = windows(*loaded.get("o", none), ends, k)
        values = answer(search["metric"], own)
        best: list = [None] * len(ticks)
        if search["pick"]:
            # in ascending order, so that a tie stays with the smaller bucket
            for bucket in sorted(b for b in loaded if b[0] == "b"):
                w = windows(*loaded[bucket], ends, k)
                found = answer(search["metric"], w)
                for i in np.flatnonzero((w["hits"] > 0) & ~np.isnan(found)).tolist():
                    if _better(search["pick"], w["hits"][i], found[i], best[i] and best[i][1:]):
                        best[i] = (bucket[1:], int(w["hits"][i]), float(found[i]))
        spec = json.dumps({n: version[n] for n in ("operator", "threshold", "for_us")} | {"pick": search["pick"], "shards": search["shards"]})
        for i, tick in enumerate(ticks.tolist()):
            value = None if np.isnan(values[i]) else float(values[i])
            # ``or`` would take a bucket of value zero for none
            bucket = (None, None, None) if best[i] is None else best[i]
            yield (key[0], key[1], s["life"], int(key[2]), tick, tick, False, int(own["hits"][i]), int(own["errors"][i]), value, *bucket, spec)

    @staticmethod
    def _row(key, s, at_us: int, gone: bool = False) -> tuple:
        return (key[0], key[1], s["life"], int(key[2]), at_us, None, gone, None, None, None, None, None, None, None)

    def _evict(self, search: dict, s: dict, pending: list[dict]) -> None:
        """Blocks that no window of this or a coming version can reach."""
        versions = [json.loads(s["version"])] if s["version"] else []
        widest = max([search["widest"], *[v["window_us"] + v["round_us"] for v in [*versions, *pending] if not v["deleted"]]])
        reached = min(s["next_us"] or s["horizon_us"], s["horizon_us"])
        keep = (reached - widest) // search["pane"] // search["block"]
        for bucket, block in list(self.blocks.keys()):
            if block < keep:
                self.blocks.removeKey((bucket, block))

    def close(self) -> None:
        pass


# --- states and deliveries --------------------------------------------------------------


def step(state: dict, tick: int, firing: bool, value: float, for_us: int) -> dict:
    """One tick of the four-state machine; times in microseconds, None when unset."""
    s = dict(state)
    if firing:
        if s["state"] in ("Normal", "PendingResolving"):
            s["firing_us"], s["state"] = tick, "PendingFiring"
        if tick - s["firing_us"] > for_us or for_us <= 0:
            s["state"], s["alert_us"], s["alert_value"] = "Firing", tick, value
    elif s["state"] != "Normal":
        if s["state"] != "PendingResolving":
            s["resolving_us"], s["state"] = tick, "PendingResolving"
        if tick - s["resolving_us"] > for_us or for_us <= 0:
            s.update(state="Normal", firing_us=None, resolving_us=None, alert_us=None, alert_value=None)
    return s


def compare(value: float, operator: str, threshold: float) -> bool:
    # Python answers comparisons with NaN with false, as wanted
    return bool(
        {
            "greaterThan": value > threshold,
            "greaterThanOrEqual": value >= threshold,
            "lessThan": value < threshold,
            "lessThanOrEqual": value <= threshold,
            "equal": value == threshold,
        }[operator]
    )


class RuleProcessor(StatefulProcessor):
    """State of one life of a rule.  ``routes`` maps (namespace, rule) to its actions, as (namespace, period).

    A delivery falls due at each multiple of an action's period while an alert is active, also between ticks: time
    comes with the rows that say how far it has passed, so an alert of a silent rule is sent again like any other.
    The row that ends a life clears all of its state.
    """

    def __init__(self, routes: dict[tuple[str, str], list[tuple[str, int]]]) -> None:
        self.routes = routes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rule = handle.getValueState("rule", RULE_STATE)
        self.held = handle.getMapState("held", "tick bigint", HELD_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        names = [c.split()[0] for c in RULE_STATE.split(", ")]
        state = {"tick": None, "state": "Normal", "firing_us": None, "resolving_us": None, "alert_us": None, "alert_value": None, "alert_from": None, "sent_to": None}
        if self.rule.exists():
            state = dict(zip(names, self.rule.get()))
        out: list[dict] = []
        for tick, (spec, w) in sorted(self._whole(rows).items()):
            if state["tick"] is not None and tick <= state["tick"]:
                continue  # comes too late
            self._due(key, state, tick - 1, out)
            if w["errors"]:
                continue  # a failed tick changes nothing
            value = w["value"] if spec.get("pick") else w["own"]
            value = 0.0 if value is None else value
            firing = compare(value, spec["operator"], spec["threshold"])
            was = state["alert_us"] is not None
            state = step(state, tick, firing, value, spec["for_us"]) | {"tick": tick}
            if state["alert_us"] is not None and not was:
                # sent from its opening on
                state["sent_to"] = tick - 1
            out.append(
                {
                    "tick": tick, "hits": w["hits"], "value": value, "firing": firing, "state": state["state"], "firing_time": state["firing_us"],
                    "resolving_time": state["resolving_us"], "alert_tick": state["alert_us"], "alert_value": state["alert_value"], "bucket": w["bucket"],
                }
            )
            self._due(key, state, tick, out)
        told = rows[(rows["shard"] == 0) & rows["tick"].isna()]
        ended = told[told["gone"].astype(bool)]
        if len(ended):
            self._due(key, state, int(ended["at_us"].min()) - 1, out)
            self.rule.clear()
            self.held.clear()
        else:
            if len(told):
                self._due(key, state, int(told["at_us"].max()), out)
            if state["tick"] is not None:
                self.rule.update(tuple(state[n] for n in names))
        if out:
            mine = {"namespace": key[0], "rule": key[1], "life": int(key[2])}
            yield _table([r | mine for r in out], OUTPUT)

    def _whole(self, rows: pd.DataFrame) -> dict[int, tuple[dict, dict]]:
        """The ticks that every shard has told about; the others wait."""
        out: dict[int, tuple[dict, dict]] = {}
        names = [c.split()[0] for c in HELD_STATE.split(", ")]
        for tick, same in rows[rows["tick"].notna()].groupby("tick"):
            tick, spec = int(tick), json.loads(same["spec"].iloc[0])
            if spec["shards"] > 1:
                held = self.held.getValue((tick,))
                w = dict(zip(names, held)) if held is not None else {n: None for n in names} | {"shards": 0}
            else:
                w = {n: None for n in names} | {"shards": 0}
            for r in same.sort_values("shard").to_dict("records"):
                w["shards"] += 1
                if r["shard"] == 0:
                    w |= {"hits": int(r["hits"]), "errors": int(r["errors"]), "own": None if pd.isna(r["own"]) else float(r["own"])}
                if not pd.isna(r["doc_count"]):
                    mine, held = (int(r["doc_count"]), float(r["value"])), w["bucket"] and (w["doc_count"], w["value"])
                    tie = w["bucket"] is not None and not _better(spec["pick"], *held, mine) and r["bucket"] < w["bucket"]
                    if w["bucket"] is None or _better(spec["pick"], *mine, held) or tie:
                        w |= {"bucket": r["bucket"], "doc_count": mine[0], "value": mine[1]}
            if w["shards"] >= spec["shards"]:
                out[tick] = (spec, w)
                if spec["shards"] > 1:
                    self.held.removeKey((tick,))
            else:
                self.held.updateValue((tick,), tuple(w[n] for n in names))
        return out

    def _due(self, key, state: dict, until: int, out: list[dict]) -> None:
        """Deliveries after the last ones up to ``until``."""
        if state["alert_us"] is None or state["sent_to"] is None or until <= state["sent_to"]:
            return
        for namespace, period in self.routes.get((key[0], key[1]), []):
            for sent in range(-(-(state["sent_to"] + 1) // period) * period, until + 1, period):
                out.append({"action_namespace": namespace, "sent_at": sent, "alert_tick": state["alert_us"], "alert_value": state["alert_value"], "state": state["state"]})
        state["sent_to"] = until

    def close(self) -> None:
        pass
