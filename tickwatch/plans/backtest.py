"""Evaluate a rule catalog over a log and derive every table from it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.functions.text import number_text
from tickwatch.model import ALERTMANAGER, BUCKET_CAP, OK, Rule, rules_frame
from tickwatch.operators import metrics, notify, quality, search, series, state
from tickwatch.sources.sinks import materialize


@dataclass
class Backtest:
    """Rules over one log, between ``start`` and ``end`` or over the log's whole time.

    Give ``start`` and ``end`` when the log is large: they prune the scan, and the log is
    then read exactly once.  ``ticks`` is written to the shared folder the first time it
    is needed, because every other table starts from it.

    A run covers the ticks in ``(start, end]``.  :meth:`after` continues it: states, transitions and
    alerts go on from its last rows (``seed``) and its open alerts, so that any split of a history gives the
    rows of one long run.
    """

    events: DataFrame
    rules: list[Rule]
    actions: DataFrame | None = None
    ts_col: str = "ts"
    start: object = None
    end: object = None
    seed: DataFrame | None = None
    open_alerts: DataFrame | None = None
    rule_rows: DataFrame | None = None
    #: the custom metrics that are accepted, where rules of other logs take part in the decision
    metric_rows: DataFrame | None = None

    @cached_property
    def accepted(self) -> DataFrame:
        return metrics.accepted_metrics(self.catalog) if self.metric_rows is None else self.metric_rows

    @cached_property
    def catalog(self) -> DataFrame:
        return rules_frame(self.events.sparkSession, self.rules) if self.rule_rows is None else self.rule_rows

    @cached_property
    def ticks(self) -> DataFrame:
        buckets = self.buckets if any(r.search.pick for r in self.rules) else None
        rows = search.tick_values(self.events, self.rules, self.ts_col, self.start, self.end, buckets)
        return materialize(rows, "ticks")

    @cached_property
    def evaluated(self) -> DataFrame:
        return state.evaluate_conditions(self.ticks, self.catalog).drop("outcome", "detail")

    @property
    def good_ticks(self) -> DataFrame:
        """Ticks whose search had an answer; samples come from these only."""
        return self.ticks.where(F.col("outcome") == OK)

    def outcomes(self) -> DataFrame:
        """Per rule: ticks, failed ticks, and the outcome and detail of the last tick."""
        return self.ticks.groupBy("namespace", "rule").agg(
            F.count(F.lit(1)).alias("n_ticks"),
            F.count_if(F.col("outcome") != OK).alias("n_failed"),
            F.max_by("outcome", "tick").alias("outcome"),
            F.max_by("detail", "tick").alias("detail"),
        )

    @cached_property
    def rule_states(self) -> DataFrame:
        """States only."""
        return state.states(self.evaluated, seed=self.seed)

    @cached_property
    def states(self) -> DataFrame:
        """States with times and alert fields."""
        return state.state_times(self.evaluated, seed=self.seed)

    @cached_property
    def alerts(self) -> DataFrame:
        return state.alert_intervals(self.states, self.catalog, still_open=self.open_alerts)

    @property
    def transitions(self) -> DataFrame:
        return state.transitions(self.states, seed=self.seed)

    def after(self, end=None) -> Backtest:
        """The run that follows this one, up to ``end``.  What it continues is written, so that runs do not
        pile up plans."""
        seed = state.seed_of(self.states)
        if self.seed is not None:
            # rules without a tick in this run keep the row they had
            seed = seed.unionByName(self.seed.join(seed.select("namespace", "rule"), ["namespace", "rule"], "left_anti"))
        alerts = state.alert_intervals(self.states, still_open=self.open_alerts).where("closed_at is null")
        if self.open_alerts is not None:
            seen = self.states.select("namespace", "rule").distinct()
            alerts = alerts.unionByName(self.open_alerts.select(alerts.columns).join(seen, ["namespace", "rule"], "left_anti"))
        return replace(self, start=self.end, end=end, seed=materialize(seed, "seed"), open_alerts=materialize(alerts, "open-alerts"))

    @cached_property
    def buckets(self) -> DataFrame:
        rows = search.bucket_values(self.events, self.rules, self.ts_col, self.start, self.end)
        return materialize(rows, "buckets")

    def trees(self, size: int = BUCKET_CAP + 1, agg: str = "by_key") -> DataFrame:
        """Aggregation trees of the grouped rules, one per (rule, tick): every bucket up to the cap of
        custom metrics, and one more that tells that there were more."""
        bodies = search.responses(self.buckets, self.good_ticks, size, agg)
        doc = F.try_parse_json("body")
        tree = F.try_variant_get(doc, F.lit("$.aggregations"), "variant")
        return bodies.select("namespace", "rule", "tick", tree.alias("aggregations"))

    def samples(self, size: int = BUCKET_CAP + 1, agg: str = "by_key") -> DataFrame:
        basic = metrics.basic_samples(self.rule_states)
        if not any(r.custom_metrics for r in self.rules):
            return basic
        custom = metrics.custom_samples(self.trees(size, agg), self.accepted)
        return basic.unionByName(custom)

    def missing_samples(self, agg: str = "by_key") -> DataFrame:
        """Why a declared metric has no samples at a tick."""
        return metrics.missing_maps(self.trees(agg=agg), self.accepted)

    def firing_log(self) -> DataFrame:
        return state.firing_events(self.rule_states, self.catalog)

    def truncations(self, agg: str = "by_key") -> DataFrame:
        """Running number of ticks at which a custom metric went over the bucket cap."""
        found = metrics.bucket_samples(self.trees(agg=agg), self.accepted)
        return metrics.truncation_counter(found, ["namespace", "rule", "metric"])

    def series_alerts(self, refresh_us: int | None = None, size: int = BUCKET_CAP + 1, agg: str = "by_key") -> DataFrame:
        """Per-series alerts, from the samples of the rules that ask for them.  A gap is a missing
        refresh, by default of the rule's own interval."""
        asked = [r for r in self.rules if r.series_alert and r.series_alert.get("enabled")]
        parts = []
        if any(not r.custom_metrics for r in asked):
            parts.append(metrics.value_samples(self.good_ticks))
        if any(r.custom_metrics for r in asked):
            parts.append(metrics.custom_samples(self.trees(size, agg), self.accepted))
        rows = materialize(reduce(DataFrame.unionByName, parts), "samples")
        return series.series_alerts(rows, series.series_rules(self.catalog), refresh_us)

    def deliveries(self, period_us: Column | None = None, match_namespace: bool = False) -> DataFrame:
        """The outbox: one row per alert and action sync."""
        if self.actions is None:
            raise ValueError("a backtest without actions has no deliveries")
        routed = notify.route(self.alerts, self.actions, match_namespace)
        return notify.outbox(routed, period_us=period_us)

    def payloads(self, period_us: Column | None = None) -> DataFrame:
        """Structured payloads of the deliveries whose rule asks for them, validated."""
        d = self.catalog.where(F.col("action.mode") == "alertmanager").select(
            "namespace", F.col("name").alias("rule"), "check_us", "action.labels", "action.annotations"
        )
        rows = self.deliveries(period_us).join(d, ["namespace", "rule"])
        variables = {
            "rule": F.col("rule"),
            "namespace": F.col("namespace"),
            "value": number_text(F.col("value")),
        }
        return notify.validate(notify.alertmanager_payload(rows, variables))

    def messages(self, period_us: Column | None = None) -> DataFrame:
        """Deliveries of the rules that send their own text, rendered and checked by their actions' validators.  Every
        text is taken apart once, with its rule, so a thousand texts are one plan."""
        d = self.catalog.where((F.coalesce("action.mode", F.lit("")) != ALERTMANAGER) & F.col("action.data").isNotNull()).select(
            "namespace", F.col("name").alias("rule"), F.coalesce("description", F.lit("")).alias("description"), "condition.operator", "condition.threshold",
            notify.message_parts(F.col("action.data")).alias("parts"),
        )
        rows = self.deliveries(period_us).join(d, ["namespace", "rule"])
        return notify.validate(notify.raw_messages(rows)).drop("parts", "description", "operator", "threshold")

    def listing(self) -> DataFrame:
        return quality.listing(state.latest(self.states.select("namespace", "rule", "tick", "state", "firing_time")), self.catalog)

    def status(self) -> DataFrame:
        """Latest conditions per rule: the state of the last good tick or the reason of a later failure, and
        whether the last tick was evaluated."""
        return quality.latest_status(quality.condition_rows(self.rule_states).unionByName(quality.outcome_rows(self.ticks)))
