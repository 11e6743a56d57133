"""The live path equals the batch path, survives a restart and drops deleted rules."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwatch.model import ACTION_DDL, Rule, Search
from tickwatch.operators import search, state
from tickwatch.plans.backtest import Backtest
from tickwatch.sources.logs import stream
from tickwatch.streaming import live, processor

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, k string, v double"
RULES = [
    Rule("n", "count", Search(filter="k = 'a'", window="10m"), threshold="2", for_="10m", check_interval="5m"),
    Rule("n", "wide", Search(filter="true", window="1h", metric="avg", field="v"), threshold="50", for_="0s", check_interval="7m"),
    Rule("n", "quiet", Search(filter="k = 'none'", window="15m"), operator="lessThan", threshold="1", for_="5m", check_interval="5m"),
    Rule("m", "high", Search(filter="k <> 'a'", window="30m", metric="max", field="v"), threshold="95", for_="5m", check_interval="10m"),
    Rule("m", "rounded", Search(filter="true", window="2h", round="h", metric="pct", part="k = 'b'"), threshold="30", for_="1h", check_interval="20m"),
]
COLUMNS = ["namespace", "rule", "tick", "hits", "firing", "state", "firing_time", "resolving_time", "alert_tick"]


def rows_between(seed, lo, hi, n=150):
    rnd = random.Random(seed)
    return [(T0 + timedelta(seconds=rnd.randint(lo * 60, hi * 60 - 1)), rnd.choice("abc"), float(rnd.randint(0, 99))) for _ in range(n)]


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, log, rules, out, checkpoint):
    events = stream(spark, log, spark.createDataFrame([], SCHEMA).schema, maxFilesPerTrigger=1)
    live.start(live.live_states(events, rules, delay="10 minutes"), out, checkpoint, once=True).awaitTermination()


def as_set(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_live_equals_batch_over_a_restart(spark, tmp_path):
    log, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    first, second = rows_between(1, 0, 300), rows_between(2, 500, 800)
    put(spark, log, first)
    run(spark, log, RULES, out, mark)
    put(spark, log, second)
    run(spark, log, RULES, out, mark)
    # one late row moves time on, so that everything before it is closed
    end = max(r[0] for r in second) + timedelta(days=1)
    put(spark, log, [(end, "z", 0.0)])
    run(spark, log, RULES, out, mark)
    got = spark.read.parquet(out)
    batch = Backtest(spark.createDataFrame(first + second, SCHEMA), RULES).states
    horizon = got.agg(F.max("tick")).first()[0]
    expect, seen = as_set(batch), as_set(got)
    # batch goes on to the first tick after the last row; live stops with the last closed pane
    assert seen <= expect
    assert {r for r in expect - seen if r[2] <= horizon - timedelta(hours=1)} == set()
    assert {r[:2] for r in seen} == {(r.namespace, r.name) for r in RULES}
    assert len(seen) == got.count()


def test_deleted_rule_loses_its_state(spark, tmp_path):
    log, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    always = replace(RULES[2], name="always")
    put(spark, log, rows_between(3, 0, 120))
    put(spark, log, rows_between(4, 200, 260))
    run(spark, log, [always, RULES[0]], out, mark)
    before = spark.read.parquet(out).where("rule = 'always'").agg(F.max("tick")).first()[0]
    put(spark, log, rows_between(5, 400, 460))
    # the rule is gone for a while: it is not evaluated
    run(spark, log, [RULES[0]], out, mark)
    assert spark.read.parquet(out).where("rule = 'always'").agg(F.max("tick")).first()[0] == before


def test_a_changed_threshold_keeps_the_state(spark, tmp_path):
    log, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    quiet = RULES[2]
    put(spark, log, rows_between(6, 0, 100))
    put(spark, log, rows_between(7, 200, 260))
    run(spark, log, [quiet], out, mark)
    opened = spark.read.parquet(out).agg(F.min("firing_time")).first()[0]
    put(spark, log, rows_between(8, 400, 460))
    # a longer wait does not take a firing rule back, and its firing time stays
    run(spark, log, [replace(quiet, for_="100h")], out, mark)
    rows = spark.read.parquet(out)
    assert rows.agg(F.max("tick")).first()[0] > T0 + timedelta(minutes=260)
    assert rows.where("state <> 'Firing'").where(f"tick > timestamp_ntz'{opened + timedelta(minutes=10)}'").count() == 0
    assert rows.select("firing_time").distinct().count() == 1


def test_active_alerts_are_handed_to_the_sender(spark, tmp_path):
    log, mark = str(tmp_path / "log"), str(tmp_path / "mark")
    put(spark, log, rows_between(9, 0, 200))
    put(spark, log, [(T0 + timedelta(days=1), "z", 0.0)])
    events = stream(spark, log, spark.createDataFrame([], SCHEMA).schema)
    sent = []
    alerts = live.firing_alerts(live.live_states(events, [RULES[2]], delay="1 minute"))
    query = live.deliver(alerts, lambda df, _: sent.extend(df.select("rule", "tick").collect()), mark, every="1 second")
    query.processAllAvailable()
    query.stop()
    assert sent and {r["rule"] for r in sent} == {"quiet"}
    assert state.KEYS == ["namespace", "rule"] and search.measures_of([RULES[2]]) == ["hits"]


def held(spark, mark, operator, name):
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    return reader.load(mark)


def test_grouped_rules_equal_batch_over_a_restart(spark, tmp_path):
    log, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    rules = [
        Rule("n", "top", Search(window="1h", group_by="k", pick="top"), threshold="8", for_="5m", check_interval="5m"),
        Rule("n", "max", Search(window="20m", metric="avg", field="v", group_by="concat(k, cast(v as int) % 5)", pick="max_bucket"), threshold="90", for_="0s", check_interval="10m"),
        Rule("n", "min", Search(filter="k <> 'b'", window="2h", round="h", metric="min", field="v", group_by="k", pick="min_bucket"), operator="lessThan", threshold="3", for_="20m", check_interval="20m"),
    ]
    first, second = rows_between(21, 0, 300, 200), rows_between(22, 420, 700, 200)
    put(spark, log, first)
    put(spark, log, second)
    run(spark, log, rules, out, mark)
    end = max(r[0] for r in second) + timedelta(days=1)
    put(spark, log, [(end, "z", 0.0)])
    run(spark, log, rules, out, mark)
    got = spark.read.parquet(out)
    horizon = got.agg(F.max("tick")).first()[0]
    columns = [*COLUMNS, "value"]
    def rounded(df):
        return {tuple(r[c] for c in columns) for r in df.withColumn("value", F.round("value", 9)).collect()}
    expect, seen = rounded(Backtest(spark.createDataFrame(first + second, SCHEMA), rules).states), rounded(got)
    assert seen <= expect and len(seen) == got.count()
    assert {r for r in expect - seen if r[2] <= horizon - timedelta(hours=2)} == set()
    # of the buckets only what a window can still reach is held
    blocks = held(spark, mark, 1, "blocks").select("key.rule", "user_map_key.bucket", "user_map_key.block").collect()
    assert blocks and {r["rule"] for r in blocks} == {"top", "max", "min"}
    oldest = min(r["block"] for r in blocks if r["rule"] == "max")
    assert oldest >= ((horizon - T0).total_seconds() // 60 - 60) // 20 + (T0 - datetime(1970, 1, 1)).total_seconds() // 60 // 20


def version(name, at, operator="greaterThan", threshold="2", for_="0s", step="5m", window="10m", deleted=False):
    return ("n", name, T0 + timedelta(minutes=at), operator, threshold, for_, step, window, None, deleted)


def test_versions_and_deletions(spark, tmp_path):
    log, out, mark, changes = (str(tmp_path / x) for x in ("log", "out", "mark", "changes"))
    rules = [Rule("n", "a", Search(filter="k = 'a'", window="10m"), check_interval="5m"), Rule("n", "b", Search(filter="k = 'b'", window="10m"), check_interval="5m")]
    ddl = live.VERSION_DDL

    def go(versions, some=rules):
        if versions:
            spark.createDataFrame(versions, ddl).coalesce(1).write.mode("append").parquet(changes)
        events = stream(spark, log, spark.createDataFrame([], SCHEMA).schema, maxFilesPerTrigger=1)
        control = stream(spark, changes, spark.createDataFrame([], ddl).schema)
        live.start(live.live_states(events, some, delay="10 minutes", versions=control, pane="5m"), out, mark, once=True).awaitTermination()

    rows = rows_between(31, 0, 400, 300)
    put(spark, log, [r for r in rows if r[0] < T0 + timedelta(minutes=200)])
    # the second version of b cannot be counted in panes of five minutes, the third can
    go([version("a", -10), version("b", 30, step="10m"), version("b", 100, step="7m"), version("b", 130, window="40m", step="20m"), version("a", 150, deleted=True)])
    put(spark, log, [r for r in rows if r[0] >= T0 + timedelta(minutes=200)])
    put(spark, log, [(T0 + timedelta(days=1), "z", 0.0)])
    go([version("a", 300, threshold="1", operator="lessThan")])
    got = {(r["rule"], (r["tick"] - T0) // timedelta(minutes=1)): (r["hits"], r["firing"], r["state"]) for r in spark.read.parquet(out).collect()}

    def hits(k, tick, width):
        return sum(x[1] == k and T0 + timedelta(minutes=tick - width) <= x[0] < T0 + timedelta(minutes=tick) for x in rows)

    first = min((r[0] - T0) // timedelta(minutes=1) for r in rows) // 5 * 5
    want = {}
    for t in range(first + 5, 401, 5):
        if t < 150 or t >= 300:
            n = hits("a", t, 10)
            want["a", t] = (n, n < 1 if t >= 300 else n > 2)
        if 30 <= t < 100 and t % 10 == 0 or t >= 130 and t % 20 == 0:
            n = hits("b", t, 10 if t < 130 else 40)
            want["b", t] = (n, n > 2)
    assert {k: v[:2] for k, v in got.items()} == want
    # a life that begins again knows nothing of the one before: it waits as a new rule does
    life = held(spark, mark, 0, "rule").select("key.rule", "key.life").collect()
    begun = (T0 + timedelta(minutes=300) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert {r["life"] for r in life if r["rule"] == "a"} == {begun}
    # the plan goes on without b, and b is deleted: nothing of it is held
    put(spark, log, [(T0 + timedelta(days=2), "z", 0.0)])
    go([version("b", 3000, deleted=True)], rules[:1])
    assert {r["rule"] for r in held(spark, mark, 0, "rule").select("key.rule").collect()} == {"a"}
    assert {r["rule"] for r in held(spark, mark, 1, "clock").select("key.rule").collect()} == {"a"}


def test_a_silent_log_goes_on_with_the_clock(spark, tmp_path):
    log, beats = str(tmp_path / "log"), str(tmp_path / "beats")
    rows = rows_between(41, 0, 100)
    put(spark, log, rows)
    spark.createDataFrame([(T0 + timedelta(minutes=m),) for m in range(0, 600, 5)], "ts timestamp_ntz").coalesce(1).write.parquet(beats)
    rule = Rule("n", "none", Search(filter="k = 'a'", window="10m"), operator="lessThan", threshold="1", for_="30m", check_interval="10m")
    events = stream(spark, log, spark.createDataFrame([], SCHEMA).schema)
    clock = stream(spark, beats, spark.createDataFrame([], "ts timestamp_ntz").schema)
    got = live.drain(live.live_states(events, [rule], delay="10 minutes", clock=clock), "silent").orderBy("tick").collect()
    assert [(r["tick"] - T0) // timedelta(minutes=1) for r in got] == list(range(10, 590, 10))
    assert all(r["hits"] == 0 and r["firing"] for r in got if r["tick"] > T0 + timedelta(minutes=110))
    assert got[-1]["state"] == "Firing"


def test_outbox_and_failing_rows(spark, tmp_path):
    """Deliveries between ticks; a tick that sees a row on which an expression fails changes nothing."""
    log = str(tmp_path / "log")
    rows = [(T0 + timedelta(minutes=m), "a" if m != 62 else "x", 1.0) for m in range(0, 120, 2)] + [(T0 + timedelta(minutes=300), "z", 0.0)]
    put(spark, log, rows)
    action = {"name": "pager", "mode": "alertmanager", "labels": {"v": "{{ value }}"}}
    rules = [
        Rule("n", "good", Search(filter="k = 'a'", window="20m"), threshold="5", for_="0s", check_interval="20m", action=action),
        Rule("n", "bad", Search(filter="if(k = 'x', cast(k as int), 1) = 1", window="20m"), threshold="5", for_="0s", check_interval="20m"),
    ]
    actions = spark.createDataFrame([("", "pager", "15m", "alertmanager"), ("n", "pager", "1h", None), ("n", "other", "1m", None)], ACTION_DDL)
    events = stream(spark, log, spark.createDataFrame([], SCHEMA).schema)
    sent = live.drain(live.live_outbox(events, rules, actions, delay="1 minute"), "sent").collect()
    minutes = lambda t: (t - T0) // timedelta(minutes=1)
    # active from the first tick, 20, to the last closed pane's end, 120
    assert sorted((r["action_namespace"], minutes(r["sent_at"])) for r in sent) == sorted([("", m) for m in range(30, 121, 15)] + [("n", 60), ("n", 120)])
    # the value is that of the tick before: one of the rows at 60 to 80 is not a hit
    assert {minutes(r["sent_at"]): r["value"] for r in sent if r["action_namespace"] == ""} == {30: 10.0, 45: 10.0, 60: 10.0, 75: 10.0, 90: 9.0, 105: 10.0, 120: 10.0}
    assert all(r["valid"] and '"v":"10"' in r["payload"] for r in sent if r["value"] == 10.0)
    states = live.drain(live.live_states(events, rules, delay="1 minute"), "states")
    assert {minutes(r["tick"]) for r in states.where("rule = 'bad'").collect()} == {20, 40, 60, 100, 120}


@pytest.mark.parametrize("seed", range(4))
def test_windows_against_every_window(seed):
    r = random.Random(seed)
    p = np.array(sorted(r.sample(range(-50, 200), r.choice([0, 1, 30, 120]))), np.int64)
    m = {n: np.array([r.randint(0, 9) for _ in p], np.int64) for n in processor.COUNTS}
    m |= {n: np.array([r.random() if r.random() < 0.8 else (0.0 if n == "total" else np.nan) for _ in p]) for n in ("total", "low", "high")}
    for k in (1, 2, 7, 60):
        ends = np.arange(-60, 280, r.choice([1, 3]))
        got = processor.windows(p, m, ends, k)
        for i, e in enumerate(ends.tolist()):
            inside = (p >= e - k) & (p < e)
            for n in [*processor.COUNTS, "total"]:
                assert got[n][i] == pytest.approx(m[n][inside].sum())
            for n, f in (("low", np.nanmin), ("high", np.nanmax)):
                held_ = m[n][inside][~np.isnan(m[n][inside])]
                assert (np.isnan(got[n][i]) and not len(held_)) or got[n][i] == f(held_)


def test_responses_as_a_stream(spark, tmp_path):
    """States of a stream of responses are those of the batch, over a restart; late ones are left out."""
    from tickwatch.model import rules_frame
    from tickwatch.operators.responses import response_ticks

    rnd = random.Random(3)
    ddl = "namespace string, rule string, tick timestamp_ntz, status_code int, body string"
    rows = [
        ("n", f"r{k}", T0 + timedelta(minutes=10 * i), rnd.choice([200, 200, 200, 503, None]), rnd.choice(['{"hits":{"total":{"value":%d}}}' % rnd.randint(0, 9), "{", '{"hits":{}}']))
        for k in range(3) for i in range(60)
    ]
    rules = rules_frame(spark, [Rule("n", "r0", Search(), threshold="3", for_="15m"), Rule("n", "r1", Search(), threshold="6", for_="0s")])
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def go(some):
        spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(path)
        live.start(live.response_states(stream(spark, path, spark.createDataFrame([], ddl).schema), rules), out, mark, once=True).awaitTermination()

    half = T0 + timedelta(minutes=300)
    go([r for r in rows if r[2] < half])
    go([r for r in rows if r[2] >= half] + [("n", "r0", T0, 200, '{"hits":{"total":{"value":99}}}')])
    columns = ["namespace", "rule", "tick", "value", "firing", "state", "firing_time", "resolving_time", "alert_tick", "alert_value"]
    want = state.state_times(response_ticks(spark.createDataFrame(rows, ddl), rules).drop("aggregations")).select(*columns).collect()
    assert sorted(map(str, spark.read.parquet(out).select(*columns).collect())) == sorted(map(str, want))


def test_late_rows_restate_ticks(spark, tmp_path):
    """Rows in any order of arrival, over a restart: the change log is a chain per tick, and its end is the count."""
    from tickwatch.sources import sinks
    from tickwatch.streaming import restate

    ddl = "ts timestamp_ntz, ingest_ts timestamp_ntz, k string"
    rnd = random.Random(8)
    rows = [(t := T0 + timedelta(seconds=rnd.randint(0, 30000)), t + timedelta(seconds=rnd.choice([0, 30, 900, 9000])), rnd.choice("ab")) for _ in range(300)]
    rules = [Rule("n", "a", Search(filter="k = 'a'", window="50m"), check_interval="10m"), Rule("n", "all", Search(window="7m"), check_interval="5m")]
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(log)
        changes = restate.tick_changes(stream(spark, log, spark.createDataFrame([], ddl).schema), rules, chunk=8)
        sinks.stream_batches(changes, out, mark, once=True).awaitTermination()
    told = sinks.read_committed(spark, out, ", ".join(f"{n} {t}" for n, t in changes.dtypes))
    chains = {}
    for r in sorted(told.collect(), key=lambda r: r["seq"]):
        assert r["old_hits"] == chains.get((r["rule"], r["tick"])) and r["new_hits"] != r["old_hits"]
        chains[r["rule"], r["tick"]] = r["new_hits"]
    whole = spark.createDataFrame(rows, ddl)
    for rule in rules:
        want = {r["tick"]: r["hits"] for r in search.hits_as_of_ingest(whole, rule).collect()}
        got = {t: n for (name, t), n in chains.items() if name == rule.name and t in want}
        assert got == {t: n for t, n in want.items() if n}
    assert told.where("old_hits is not null").count() > 0
    with pytest.raises(ValueError):
        restate.tick_changes(changes, [Rule("n", "x", Search(metric="avg", field="v"))])
