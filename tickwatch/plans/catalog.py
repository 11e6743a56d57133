"""Evaluate a whole catalog: rules grouped by the log they read, with an outcome for every rule."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwatch.functions.durations import parse_micros
from tickwatch.functions.timegrid import ROUND_MICROS, micros
from tickwatch.model import METRICS, OK, OPERATORS, PICKS, Rule, Search, local_frame, resolve_rules, rules_frame, rules_from_frame
from tickwatch.operators import metrics, quality, search
from tickwatch.plans.backtest import Backtest
from tickwatch.sources.logs import open_row, registry

OUTCOME_DDL = "namespace string, rule string, outcome string, detail string"


def by_log(rules: list[Rule]) -> dict[tuple[str, str, str], list[Rule]]:
    """Rules by (source namespace, source name, index): each group shares one scan."""
    groups: dict[tuple[str, str, str], list[Rule]] = {}
    for r in rules:
        groups.setdefault((r.source[1], r.source[0], r.index), []).append(r)
    return groups


def search_problem(s: Search, events: DataFrame) -> str | None:
    """Why a search cannot be planned over its log, or None."""
    try:
        if parse_micros(s.window) <= 0:
            return f"window {s.window!r} is not positive"
    except ValueError as e:
        return str(e)
    if s.round is not None and s.round not in ROUND_MICROS:
        return f"unknown rounding {s.round!r}"
    if s.metric not in METRICS:
        return f"unknown metric {s.metric!r}"
    if s.metric in ("avg", "sum", "min", "max") and not s.field:
        return f"metric {s.metric!r} without a field"
    if s.metric == "pct" and not s.part:
        return "metric 'pct' without a part"
    if s.pick is not None and (s.pick not in PICKS or not s.group_by):
        return f"cannot pick a bucket by {s.pick!r}"
    asked = {"filter": s.filter, "part": s.part, "field": s.field, "group_by": s.group_by}
    for name, text in asked.items():
        if text is None:
            continue
        try:
            kind = events.select(F.expr(text).alias("x")).schema[0].dataType.simpleString()
        except (AnalysisException, ParseException) as e:
            return f"{name}: {e.getCondition() or 'not a valid expression'}"
        if name in ("filter", "part") and kind != "boolean":
            return f"{name} is {kind}, not boolean"
    rule = Rule("", "", s)
    if search.can_fail([rule], events):
        try:
            # where the expressions are used: no aggregates or generators there, and only kinds that can be counted
            for keyed in {False, s.group_by is not None}:
                _ = search.pane_counts(events.withColumn("__at", F.lit(None).cast("timestamp_ntz")), [rule], "__at", keyed).schema
        except (AnalysisException, ParseException) as e:
            return e.getCondition() or "cannot be evaluated over a log"
    return None


def once(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules, each key once, and the rows that repeat a key; of rows with one key the first by its text is kept."""
    place = Window.partitionBy("namespace", "name").orderBy(F.to_json(F.struct(*[c for c in rules.columns])))
    numbered = rules.withColumn("_place", F.row_number().over(place))
    return numbered.where("_place = 1").drop("_place"), numbered.where("_place > 1").drop("_place")


@dataclass
class Catalog:
    """A planned catalog: a run per log for the rules that can be evaluated, and an outcome for every rule."""

    runs: list[Backtest] = field(default_factory=list)
    outcomes: DataFrame | None = None
    rules: DataFrame | None = None

    def _all(self, name: str, runs: list[Backtest] | None = None) -> DataFrame | None:
        """A table of every run, together; None if there is no run to ask."""
        parts = [getattr(r, name) for r in (self.runs if runs is None else runs)]
        parts = [p() if callable(p) else p for p in parts]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _with(self, test) -> list[Backtest]:
        return [r for r in self.runs if any(test(x) for x in r.rules)]

    @property
    def ticks(self) -> DataFrame | None:
        return self._all("ticks")

    @property
    def states(self) -> DataFrame | None:
        return self._all("states")

    @property
    def alerts(self) -> DataFrame | None:
        return self._all("alerts")

    @property
    def transitions(self) -> DataFrame | None:
        return self._all("transitions")

    def deliveries(self) -> DataFrame | None:
        return self._all("deliveries", [r for r in self.runs if r.actions is not None])

    def payloads(self) -> DataFrame | None:
        return self._all("payloads", [r for r in self.runs if r.actions is not None])

    def messages(self) -> DataFrame | None:
        return self._all("messages", [r for r in self.runs if r.actions is not None])

    def firing_log(self) -> DataFrame | None:
        return self._all("firing_log")

    def samples(self) -> DataFrame | None:
        """Samples of all rules.  The labels of a metric are those of its first declarer, whatever log that reads."""
        return self._all("samples")

    def series_alerts(self) -> DataFrame | None:
        return self._all("series_alerts", self._with(lambda r: r.series_alert and r.series_alert.get("enabled")))

    def label_conflicts(self) -> DataFrame:
        """Declarations that give way to another rule's labels of the same metric."""
        return metrics.label_conflicts(metrics.declared_metrics(self.rules))

    def missing_samples(self) -> DataFrame | None:
        return self._all("missing_samples", self._with(lambda r: r.custom_metrics))

    def stale_series(self) -> DataFrame | None:
        """Series that one refresh has and the next has not: to be deleted then."""
        samples = self.samples()
        return None if samples is None else metrics.stale_series(samples, self.ticks.select("tick"))

    def metric_lives(self) -> DataFrame | None:
        """When each declared metric is registered and dropped."""
        if not self.runs:
            return None
        declared = metrics.declared_metrics(self.rules).where("name_ok").select("namespace", "rule", "metric")
        ticks = self.ticks.select("namespace", "rule", "tick")
        return metrics.metric_lifecycle(ticks.join(declared, ["namespace", "rule"]).select("tick", "metric"), ticks.select("tick"))

    def after(self, end=None) -> Catalog:
        """The same catalog up to ``end``, each run going on from its last rows."""
        return replace(self, runs=[r.after(end) for r in self.runs])

    def status(self) -> DataFrame:
        """Latest conditions of all rules; a rule that cannot be evaluated has those of its failure, without a time."""
        failed = self.outcomes.where(F.col("outcome") != OK).withColumn("tick", F.lit(None).cast("timestamp_ntz"))
        rows = quality.outcome_rows(failed)
        for run in self.runs:
            rows = rows.unionByName(run.status())
        return rows

    def run_outcomes(self) -> DataFrame:
        """Every rule with its outcome: of planning, else of its last tick; with the numbers of ticks and failed ticks."""
        none = F.lit(0).cast("bigint")
        planned = self.outcomes.where(F.col("outcome") != OK).select("*", none.alias("n_ticks"), none.alias("n_failed"))
        return reduce(DataFrame.unionByName, [planned, *[r.outcomes() for r in self.runs]])


def plan_catalog(spark: SparkSession, rules: DataFrame, sources: DataFrame, actions: DataFrame | None = None, start=None, end=None) -> Catalog:
    """Plan every rule of a catalog.  A rule that cannot be evaluated is an outcome row with the reason; it
    neither stops the others nor disappears.  Both tables are configuration and are read once.

    A rule listed several times is evaluated once; its other rows are ``duplicate_rule``.
    """
    rules, repeated = once(resolve_rules(rules.drop("check_us", "for_us", "threshold_value")))
    known = registry(sources)
    outcomes: list[tuple[str, str, str, str | None]] = [
        (r["namespace"], r["name"], "duplicate_rule", "another row has this key") for r in repeated.select("namespace", "name").toLocalIterator()
    ]
    good: dict[tuple[str, str], Rule] = {}
    able = {(r.namespace, r.name): r for r in rules_from_frame(rules)}
    listed = rules.select(
        "namespace", "name", "source", "index", "condition", "check_interval", "query_json", F.col("search").isNotNull().alias("searches"), "check_us", "for_us", "threshold_value"
    )
    logs: dict[tuple[str, str, str], DataFrame | str] = {}
    for r in listed.toLocalIterator():
        where = ((r["source"]["namespace"] or "") if r["source"] else "", r["source"]["name"] if r["source"] else None)
        row, rule = known.get(where), able.get((r["namespace"], r["name"]))
        log = (*where, r["index"])
        if row is not None and log not in logs:
            try:
                logs[log] = open_row(spark, row, r["index"])
                _ = logs[log].select(micros(F.col("ts"))).schema
            except AnalysisException as e:
                logs[log] = e.getCondition() or "cannot be read"
        if row is None:
            found = ("source_not_found", where[1])
        elif not row["has_credentials"]:
            found = ("no_credentials", where[1])
        elif r["for_us"] is None:
            found = ("bad_for", r["condition"]["for"] if r["condition"] else None)
        elif r["searches"] == bool(r["query_json"]):
            found = ("no_query", None)
        elif not (r["check_us"] or 0) > 0:
            found = ("bad_interval", r["check_interval"])
        elif isinstance(logs[log], str):
            found = ("query_error", logs[log])
        elif r["threshold_value"] is None or r["condition"]["operator"] not in OPERATORS:
            found = ("bad_condition", f"{r['condition']['operator']} {r['condition']['threshold']}")
        elif rule is None:
            found = ("no_query", "query text is not evaluated here")
        elif problem := search_problem(rule.search, logs[log]):
            found = ("query_error", problem)
        else:
            found = (OK, None)
            good[r["namespace"], r["name"]] = rule
        outcomes.append((r["namespace"], r["name"], *found))
    runs = []
    names = rules_frame(spark, list(good.values())).select("namespace", "name")
    kept = rules.join(names, ["namespace", "name"])
    accepted = metrics.accepted_metrics(kept)
    for key, group in by_log(list(good.values())).items():
        names = rules_frame(spark, group).select("namespace", "name")
        # the whole catalog rows, with their actions and metrics
        rows = rules.join(names, ["namespace", "name"])
        runs.append(Backtest(logs[key], group, actions, "ts", start, end, rule_rows=rows, metric_rows=accepted))
    table = local_frame(spark, [dict(zip(("namespace", "rule", "outcome", "detail"), o)) for o in outcomes], OUTCOME_DDL)
    return Catalog(runs, table, kept)


def catalog_ticks(spark: SparkSession, rules: DataFrame, sources: DataFrame, start=None, end=None) -> DataFrame | None:
    """Tick values of every rule whose source exists, one scan per log.

    Rules without a source are in :func:`tickwatch.operators.quality.unresolved`, rules that
    cannot be planned in the outcomes of :func:`plan_catalog`.  None when no rule is left.
    """
    parts = []
    known = registry(sources)
    for (namespace, name, index), group in by_log(rules_from_frame(once(rules)[0])).items():
        if (namespace, name) not in known:
            continue
        events = open_row(spark, known[namespace, name], index)
        group = [r for r in group if search_problem(r.search, events) is None]
        if group:
            parts.append(search.tick_values(events, group, "ts", start, end))
    return reduce(DataFrame.unionByName, parts) if parts else None
