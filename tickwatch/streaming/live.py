"""Live rules: the log as a stream, states per rule, results appended as ticks close.

The plan reads the stream once and counts it per (rule, bucket, pane) on the JVM.  Next to the rule's own rows every log
row feeds a clock, so a pane with rows of any kind reaches every rule and a rule whose filter matches nothing is still
evaluated.  Time passes with the watermark; rows of a ``clock`` stream move it too, so a log that falls silent goes on
giving its zero ticks.  A row later than the watermark delay is dropped, where a batch run would count it at later ticks.

Grouped rules are spread over shards by a hash of the bucket, so no task holds all buckets of a rule; every shard tells its
best bucket per tick, and the rule picks among these.

Versions of rules (thresholds, intervals, windows, deletions) are a stream as well and change running rules.  What a rule
searches (filter, metric, buckets) is part of the plan: a rule with another search is another plan, started from the
same checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import gcd

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickwatch.functions.conditions import threshold_value
from tickwatch.functions.durations import duration_micros, parse_micros
from tickwatch.functions.text import number_text
from tickwatch.functions.timegrid import ROUND_MICROS, micros, require_utc
from tickwatch.model import ALERTMANAGER, OPERATORS, Rule, rules_frame
from tickwatch.operators import notify
from tickwatch.operators.responses import response_ticks
from tickwatch.operators.search import attempts, pane_micros
from tickwatch.sources.sinks import run_dir
from tickwatch.streaming import processor

# workers need not have the package installed
cloudpickle.register_pickle_by_value(processor)

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 8
#: a version of a rule: what it changes, from when on; ``deleted`` ends the rule's life
VERSION_DDL = "namespace string, name string, at timestamp_ntz, operator string, threshold string, `for` string, check_interval string, window string, round string, deleted boolean"


def require_state_store(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def base_pane(rules: list[Rule]) -> int:
    """The pane that all rules of a plan are counted in."""
    return gcd(*[pane_micros(r) for r in rules])


def search_specs(rules: list[Rule], pane: int, shards: int, versioned: bool) -> dict[tuple[str, str], dict]:
    """What the plan counts per rule, and the version that holds from the beginning unless versions are a stream."""
    out = {}
    for r in rules:
        window, unit = parse_micros(r.search.window), ROUND_MICROS.get(r.search.round, pane)
        version = {
            "at_us": None, "operator": r.operator, "threshold": float(r.threshold), "for_us": 0 if r.for_.strip("+-0smh") == "" else parse_micros(r.for_),
            "step_us": parse_micros(r.check_interval), "window_us": window, "round_us": unit, "deleted": False,
        }
        out[(r.namespace, r.name)] = {
            "pane": pane, "block": window // pane, "widest": window + unit, "metric": r.search.metric, "pick": r.search.pick,
            "shards": shards if r.search.pick else 1, "version": None if versioned else version,
        }
    return out


def live_panes(events: DataFrame, rules: list[Rule], ts_col: str, delay: str, pane: int, shards: int = SHARDS, clock: DataFrame | None = None) -> DataFrame:
    """Closed panes: ``namespace, rule, shard, bucket, pane_us, counted`` and the measures.

    A row of a grouped rule counts in its rule's own pane (bucket NULL) and in its bucket's.
    """

    def hit(namespace, name, bucket, counted, x, part, failed):
        return F.struct(
            F.lit(namespace).alias("namespace"), F.lit(name).alias("rule"), bucket.cast("string").alias("bucket"), F.lit(counted).alias("counted"),
            x.cast("double").alias("x"), part.cast("boolean").alias("part"), failed.cast("boolean").alias("failed"),
        )

    none, no = F.lit(None), F.lit(False)
    hits = [hit("", "", none, 0, none, no, no)]
    for r in rules:
        tried = attempts(r, events)
        bad = [a.failed for a in tried.values() if a.failed is not None]
        failed = reduce(lambda a, b: a | b, bad) if bad else no
        holds = tried["filter"].value
        if tried["filter"].failed is not None:
            holds = holds | tried["filter"].failed
        own = hit(r.namespace, r.name, none, 1, tried["field"].value, tried["part"].value, failed)
        hits.append(F.when(holds, own))
        if r.search.pick:
            bucket = tried["group_by"].value
            hits.append(F.when(holds & ~failed & bucket.isNotNull(), hit(r.namespace, r.name, bucket, 1, tried["field"].value, tried["part"].value, no)))
    is_log = F.col("__log")
    log = events.withColumn("__log", F.lit(True))
    if clock is not None:
        beats = clock.select(F.col(clock.columns[0]).cast(events.schema[ts_col].dataType).alias(ts_col), F.lit(False).alias("__log"))
        log = log.unionByName(beats, allowMissingColumns=True)
    all_hits = F.array_compact(F.array(*hits))
    good = ~F.col("failed")
    counted = (
        # watermarks need an instant; in a UTC session the naive time is one
        log.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
        .withWatermark(ts_col, delay)
        .select(F.col(ts_col), F.inline(F.when(is_log, all_hits).otherwise(F.array(hits[0]))))
        .groupBy(F.window(ts_col, f"{pane} microseconds"), "namespace", "rule", "bucket")
        .agg(
            F.sum("counted").cast("bigint").alias("counted"),
            F.count_if(good & (F.col("counted") > 0)).alias("hits"),
            F.count_if(good & F.col("part")).alias("part"),
            F.count(F.when(good, F.col("x"))).alias("n"),
            F.count_if("failed").alias("errors"),
            F.sum(F.when(good, F.col("x"))).alias("total"),
            F.min(F.when(good, F.col("x"))).alias("low"),
            F.max(F.when(good, F.col("x"))).alias("high"),
        )
    )
    places = [(r.namespace, r.name, i) for r in rules for i in range(shards if r.search.pick else 1)]
    everyone = F.array(*[F.struct(F.lit(a).alias("namespace"), F.lit(b).alias("rule"), F.lit(i).alias("shard")) for a, b, i in places])
    shard = F.when(F.col("bucket").isNull(), 0).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(shards))).cast("int")
    here = F.array(F.struct("namespace", "rule", shard.alias("shard")))
    return counted.select(
        micros(F.col("window.start")).alias("pane_us"), "bucket", "counted", "hits", "part", "n", "errors", "total", "low", "high",
        F.inline(F.when(F.col("rule") == "", everyone).otherwise(here)),
    )


def version_rows(versions: DataFrame, pane: int, shards: int) -> DataFrame:
    """Versions as rows for the processors, one per shard.  A version that cannot be read (operator, threshold, ``for``,
    interval or window) ends the rule's evaluation until a better one comes, like a deletion without an end of its life."""
    unit = F.lit(pane).cast("bigint")
    for name, us in ROUND_MICROS.items():
        unit = F.when(F.col("round") == name, F.lit(us).cast("bigint")).otherwise(unit)
    gone = F.coalesce("deleted", F.lit(False))
    read = versions.select(
        "namespace", F.col("name").alias("rule"), micros(F.col("at")).alias("at_us"), "operator", threshold_value(F.col("threshold")).alias("threshold"),
        duration_micros("`for`").alias("for_us"), duration_micros("check_interval").alias("step_us"), duration_micros("window").alias("window_us"), unit.alias("round_us"), gone.alias("deleted"),
    )
    readable = F.col("operator").isin(OPERATORS) & F.col("threshold").isNotNull() & F.col("for_us").isNotNull() & (F.col("step_us") > 0) & (F.col("window_us") > 0)
    # an interval that no pane divides is refused by the processor
    usable = F.col("deleted") | F.coalesce(readable, F.lit(False))
    fixed = read.withColumns({c: F.when(usable, F.col(c)).otherwise(F.lit(1).cast("bigint")) for c in ("step_us", "window_us")})
    body = F.to_json(F.struct("at_us", "operator", "threshold", "for_us", "step_us", "window_us", "round_us", "deleted"))
    return fixed.where("at_us is not null").select("namespace", "rule", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), body.alias("version"))


def live_rows(
    events: DataFrame,
    rules: list[Rule],
    ts_col: str = "ts",
    delay: str = "1 minute",
    versions: DataFrame | None = None,
    clock: DataFrame | None = None,
    actions: DataFrame | None = None,
    pane: str | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """States and deliveries as one stream; ``sent_at`` is set on deliveries only.

    ``pane`` is the finest step that versions may use, by default what the rules need now.
    """
    spark = events.sparkSession
    require_utc(spark)
    require_state_store(spark)
    size = gcd(base_pane(rules), parse_micros(pane)) if pane else base_pane(rules)
    panes = live_panes(events, rules, ts_col, delay, size, shards, clock).withColumn("version", F.lit(None).cast("string"))
    if versions is not None:
        panes = panes.unionByName(version_rows(versions, size, shards), allowMissingColumns=True)
    ticks = panes.groupBy("namespace", "rule", "shard").transformWithStateInPandas(
        processor.WindowProcessor(search_specs(rules, size, shards, versions is not None)), processor.TICKS, outputMode="Append", timeMode="None"
    )
    return ticks.groupBy("namespace", "rule", "life").transformWithStateInPandas(
        processor.RuleProcessor(live_routes(rules, actions)), processor.OUTPUT, outputMode="Append", timeMode="None"
    )


def live_routes(rules: list[Rule], actions: DataFrame | None) -> dict[tuple[str, str], list[tuple[str, int]]]:
    """The actions of each rule, by name, with their periods.  Actions are configuration, read once."""
    if actions is None:
        return {}
    known = actions.select("namespace", "name", notify.sync_micros().alias("period")).where("period > 0").collect()
    return {(r.namespace, r.name): sorted((a["namespace"], a["period"]) for a in known if r.action and a["name"] == r.action.get("name")) for r in rules}


def response_states(responses: DataFrame, rules: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """States from a stream of stored responses (``namespace, rule, tick, status_code, body``).

    The answer of each response is read by the same expressions as in a batch; a response that fails changes nothing, and
    one whose tick is not after the last evaluated one comes too late.
    """
    require_utc(responses.sparkSession)
    require_state_store(responses.sparkSession)
    found = response_ticks(responses, rules, sources)
    d = rules.select("namespace", F.col("name").alias("rule"), "condition.operator", "threshold_value")
    spec = F.to_json(F.struct("operator", F.col("threshold_value").alias("threshold"), "for_us", F.lit(1).alias("shards")))
    at, none = micros(F.col("tick")), F.lit(None)
    ticks = found.join(d, ["namespace", "rule"]).select(
        "namespace", "rule", F.lit(0).cast("bigint").alias("life"), F.lit(0).alias("shard"), at.alias("at_us"), at.alias("tick"), F.lit(False).alias("gone"),
        F.lit(0).cast("bigint").alias("hits"), F.col("firing").isNull().cast("bigint").alias("errors"), F.col("value").alias("own"),
        none.cast("string").alias("bucket"), none.cast("bigint").alias("doc_count"), none.cast("double").alias("value"), spec.alias("spec"),
    )
    rows = ticks.groupBy("namespace", "rule", "life").transformWithStateInPandas(processor.RuleProcessor({}), processor.OUTPUT, outputMode="Append", timeMode="None")
    return rows.select(*[c for c in _STATES if c != "hits"])


_STATES = ["namespace", "rule", "tick", "hits", "value", "firing", "state", "firing_time", "resolving_time", "alert_tick", "alert_value"]


def live_states(events: DataFrame, rules: list[Rule], ts_col: str = "ts", delay: str = "1 minute", **streams) -> DataFrame:
    """Streaming states of the rules, the same rows a batch run gives for the closed ticks."""
    rows = live_rows(events, rules, ts_col, delay, **streams)
    return rows.where(F.col("sent_at").isNull()).select(*_STATES)


def live_outbox(events: DataFrame, rules: list[Rule], actions: DataFrame, ts_col: str = "ts", delay: str = "1 minute", **streams) -> DataFrame:
    """Streaming deliveries: each active alert at every multiple of its actions' periods, with the alert's value at that
    time, and the payload of rules that ask for a structured one."""
    rows = live_rows(events, rules, ts_col, delay, actions=actions, **streams).where(F.col("sent_at").isNotNull())
    return payloads(rows, rules)


def payloads(deliveries: DataFrame, rules: list[Rule]) -> DataFrame:
    """Deliveries with their action's name, and ``payload`` and ``valid`` where the rule's mode is structured."""
    table = rules_frame(deliveries.sparkSession, rules).where(F.col("action").isNotNull())
    d = table.select("namespace", F.col("name").alias("rule"), F.col("action.name").alias("action_name"), "action.mode", "check_us", "action.labels", "action.annotations")
    rows = deliveries.select("namespace", "rule", "action_namespace", F.col("alert_value").alias("value"), "sent_at").join(F.broadcast(d), ["namespace", "rule"])
    variables = {"rule": F.col("rule"), "namespace": F.col("namespace"), "value": number_text(F.col("value"))}
    checked = notify.alertmanager_validator(notify.alertmanager_payload(rows, variables))
    asked = F.col("mode") == ALERTMANAGER
    return checked.select(
        "namespace", "rule", "action_name", "action_namespace", "value", "sent_at", F.when(asked, F.col("payload")).alias("payload"), F.when(asked, F.col("valid")).alias("valid")
    )


def wall_clock(spark: SparkSession, every: str = "10 seconds") -> DataFrame:
    """The time of day as a clock stream.  For a log that is read as it is written: a backlog older than the delay would be late."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    unit = parse_micros(every.replace(" seconds", "s").replace(" minutes", "m"))
    return beats.where(micros(F.col("timestamp")) % unit < 1_000_000).select(F.col("timestamp").alias("ts"))


def start(rows: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Append a stream to a table; ``once`` drains what is there and stops."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start(path)


def drain(rows: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read the result back."""
    spark = rows.sparkSession
    base = run_dir(spark, name)
    start(rows, f"{base}/rows", f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def deliver(
    rows: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds"
) -> StreamingQuery:
    """Hand every micro-batch to a user-supplied sender; sending is the user's code and may
    run with ``foreachPartition`` on the executors."""
    return (
        rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )


def firing_alerts(states: DataFrame) -> DataFrame:
    """The alerts active at each tick of a state stream, for :func:`deliver`."""
    return states.where(F.col("alert_tick").isNotNull()).select(
        "namespace", "rule", "tick", "state", "alert_tick", F.col("alert_value").alias("value")
    )
