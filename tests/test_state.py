"""States against a row-at-a-time machine on random histories."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwatch.operators import state

T0 = datetime(2024, 1, 1)
SCHEMA = "namespace string, rule string, tick timestamp_ntz, value double, firing boolean, for_us bigint"


def machine(history, for_us):
    """The four-state machine, one tick at a time: the definition the operators must meet."""
    st, fire, res, alert, last_normal = "Normal", None, None, None, None
    out = []
    for tick, value, firing in history:
        if firing is None:
            continue
        incident = last_normal
        if firing:
            if st in ("Normal", "PendingResolving"):
                fire, st = tick, "PendingFiring"
            if tick - fire > timedelta(microseconds=for_us) or for_us <= 0:
                st, alert = "Firing", (tick, value)
        elif st != "Normal":
            if st != "PendingResolving":
                res, st = tick, "PendingResolving"
            if tick - res > timedelta(microseconds=for_us) or for_us <= 0:
                st, fire, res, alert = "Normal", None, None, None
        if st == "Normal":
            last_normal = tick
        out.append((tick, st, fire, res, alert[0] if alert else None, alert[1] if alert else None, incident))
    return out


def histories(n, seed, gaps=(1, 2, 5, 40), errors=0.1):
    rnd = random.Random(seed)
    rules = {}
    for i in range(n):
        tick, rows, firing = T0 + timedelta(minutes=rnd.randint(0, 50)), [], rnd.random() < 0.5
        stick = rnd.choice([0.3, 0.6, 0.9])
        for j in range(rnd.randint(1, 60)):
            if rnd.random() > stick:
                firing = not firing
            rows.append((tick, float(j), None if rnd.random() < errors else firing))
            tick += timedelta(minutes=rnd.choice(gaps))
        rules[f"r{i}"] = (rnd.choice([-1, 0, 1, 2, 3, 5, 8, 50]) * 60_000_000, rows)
    return rules


def frame(spark, rules):
    rows = [("n", name, t, v, f, for_us) for name, (for_us, hist) in rules.items() for t, v, f in hist]
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    out = {}
    for r in df.orderBy("rule", "tick").collect():
        out.setdefault(r["rule"], []).append(
            (r["tick"], r["state"], r["firing_time"], r["resolving_time"], r["alert_tick"], r["alert_value"], r["incident"])
        )
    return out


def want(rules):
    return {k: w for k, (f, h) in rules.items() if (w := machine(h, f))}


@pytest.mark.parametrize("chunk", ["7m", "24h"])
def test_states_match_machine(spark, chunk):
    rules = histories(150, seed=len(chunk))
    assert got(state.state_times(frame(spark, rules), chunk=chunk)) == want(rules)


@pytest.mark.parametrize("cut", [7, 60])
def test_any_split_gives_the_same_rows(spark, cut):
    rules = histories(80, seed=cut)
    at = T0 + timedelta(minutes=cut)
    rows = frame(spark, rules).cache()
    first = state.state_times(rows.where(F.col("tick") < F.lit(at).cast("timestamp_ntz")), chunk="13m")
    second = state.state_times(
        rows.where(F.col("tick") >= F.lit(at).cast("timestamp_ntz")), chunk="13m", seed=state.seed_of(first)
    )
    assert got(first.unionByName(second)) == want(rules)
    # alerts that were open at the cut keep their opening time
    whole = state.alert_intervals(state.state_times(rows))
    open_ones = state.alert_intervals(first)
    later = state.alert_intervals(second, still_open=open_ones)
    key = lambda r: (r["rule"], r["opened_at"])
    joined = {key(r): r for r in open_ones.collect()} | {key(r): r for r in later.collect()}
    assert joined == {key(r): r for r in whole.collect()}
    rows.unpersist()


def test_error_ticks_change_nothing(spark):
    rules = {"r": (60_000_000, [(T0 + timedelta(minutes=i), float(i), f) for i, f in enumerate([True, None, None, True, False, None, False, False, False])])}
    rows = got(state.state_times(frame(spark, rules)))
    assert [x[1] for x in rows["r"]] == ["PendingFiring", "Firing", "PendingResolving", "Normal", "Normal", "Normal"]
    assert rows == want(rules)


def test_alert_intervals_and_transitions(spark):
    rules = histories(120, seed=5)
    rows = state.state_times(frame(spark, rules), chunk="30m")
    intervals = {}
    moves = {}
    for name, w in want(rules).items():
        cur, prev = None, "Normal"
        for tick, st, _, _, alert_tick, value, _ in w:
            if alert_tick is not None:
                if cur is None:
                    cur = {"opened_at": tick, "closed_at": None}
                cur.update(last_active_at=tick, last_firing_at=alert_tick, value=value)
            elif cur is not None:
                cur["closed_at"] = tick
                intervals.setdefault(name, []).append(cur)
                cur = None
            if st != prev:
                moves.setdefault(name, []).append((tick, prev, st))
            prev = st
        if cur is not None:
            intervals.setdefault(name, []).append(cur)
    seen = {}
    for r in state.alert_intervals(rows).orderBy("rule", "opened_at").collect():
        seen.setdefault(r["rule"], []).append({k: r[k] for k in ("opened_at", "closed_at", "last_active_at", "last_firing_at", "value")})
    assert seen == intervals
    steps = {}
    for r in state.transitions(rows, chunk="30m").orderBy("rule", "tick").collect():
        steps.setdefault(r["rule"], []).append((r["tick"], r["from_state"], r["to_state"]))
    assert steps == moves


def test_as_of(spark):
    rules = histories(30, seed=11, errors=0.0)
    rows = state.states(frame(spark, rules))
    seen = {}
    for r in state.as_of(rows.select("namespace", "rule", "tick", "state"), "3m", chunk="20m").collect():
        seen[(r["rule"], r["refresh_tick"])] = (r["tick"], r["state"])
    expect = {}
    for name, w in want(rules).items():
        lo, hi = w[0][0], w[-1][0]
        t = T0
        while t <= hi:
            if t >= lo:
                expect[(name, t)] = [(x[0], x[1]) for x in w if x[0] <= t][-1]
            t += timedelta(minutes=3)
    assert seen == expect


def test_lives(spark):
    rules = histories(40, seed=3, errors=0.0)
    rnd = random.Random(1)
    gone = [("n", name, T0 + timedelta(minutes=rnd.randint(0, 200), seconds=rnd.choice([0, 0, 30]))) for name in rules for _ in range(rnd.randint(0, 3))]
    deletions = spark.createDataFrame(gone, "namespace string, rule string, deleted_at timestamp_ntz")
    lives = state.with_lives(frame(spark, rules), deletions, chunk="17m")
    rows = state.state_times(lives, ["namespace", "rule", "life"], chunk="17m")
    expect = {}
    for name, (for_us, hist) in rules.items():
        cuts = sorted({d for _, n, d in gone if n == name})
        for i in range(len(cuts) + 1):
            part = [h for h in hist if sum(c <= h[0] for c in cuts) == i]
            expect.setdefault(name, []).extend(machine(part, for_us))
    assert got(rows) == {k: v for k, v in expect.items() if v}
