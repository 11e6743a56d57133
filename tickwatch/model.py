"""Data model: fixed values, table schemas, and the rule catalog.

A rule names a log index, a filter, a windowed metric, a threshold and a ``for``
duration.  Rules, sources and actions are small tables; everything else in the
package is derived from them and from the log rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# --- fixed values: these must not change, other tools read them ---------------
NORMAL = "Normal"
FIRING = "Firing"
PENDING_FIRING = "PendingFiring"
PENDING_RESOLVING = "PendingResolving"
STATES = [NORMAL, FIRING, PENDING_FIRING, PENDING_RESOLVING]

DISPLAY_STATE = {
    "PendingFiring": "pending",
    "PendingResolving": "pending",
    "Firing": "firing",
    "Normal": "resolved",
}

OPERATORS = ["greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual", "equal"]
OPERATOR_SYMBOL = {
    "greaterThan": ">",
    "greaterThanOrEqual": ">=",
    "lessThan": "<",
    "lessThanOrEqual": "<=",
    "equal": "==",
}

METRIC_PREFIX = "searchrule_"
VALUE_METRIC = "searchrule_value"
STATE_METRIC = "searchrule_state"
NAMESPACE_LABEL = "searchrule_namespace"
RULE_LABEL = "rule"
ALERT_RULE_LABEL = "searchrule"
RESERVED_METRICS = ["value", "state"]
RESERVED_LABELS = ["searchrule_namespace", "rule"]
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"

DEFAULT_ACTION_INTERVAL = "5s"
DEFAULT_REFRESH = "10s"
DEFAULT_VALUE_PATH = "doc_count"
BUCKET_CAP = 1000
MAX_CUSTOM_METRICS = 10
ALERTMANAGER = "alertmanager"

# condition reason and message by state
STATE_REASON = {
    "Normal": ("Normal", "Rule is normal"),
    "Firing": ("AlertFiring", "Alert is firing"),
    "PendingFiring": ("PendingAlertFiring", "Pending alert firing"),
    "PendingResolving": ("PendingAlertResolved", "Pending alert resolved"),
}

STATE_TYPE = "State"
SYNCED_TYPE = "ResourceSynced"
SYNCED = ("TargetSynced", "Target was successfully synced")

# reasons of a rule's series alert, worst first
METRICS_INVALID = "CustomMetricsInvalid"
DEFINITION_ERROR = "PrometheusRuleError"
METRICS_HIDDEN = "MetricsNotExposed"
NAME_MISMATCH = "MetricNameMismatch"
DEFINITION_SYNCED = "Synced"

# reasons why a custom metric has no samples
NO_TREE = "NoAggregations"
NO_PATH = "PathNotFound"

FIRING_NOTE = "Rule is in firing state. Current value is "
FIRING_ACTION = "AlertFiring"

PAYLOAD_ERROR = "error decoding JSON from 'message.data' for Alertmanager validator"
PAYLOAD_HINT = "notification field 'message.data' does not meet the syntax requirements for Alertmanager: "
HINT_NO_NAME = "label 'alertname' not found"
HINT_NO_START = "field 'startsAt' not found"
# condition reason by failed tick outcome, of a rule that was not evaluated, and of one without an output
OUTCOME_REASON = {
    "source_not_found": "QueryConnectorNotFound",
    "no_credentials": "NoCredsFound",
    "no_query": "NoQueryFound",
    "connection_error": "ConnectionError",
    "query_error": "QueryError",
    "path_missing": "QueryError",
    "bad_condition": "QueryError",
    "duplicate_rule": "QueryError",
}
SYNC_FAILED = "KubernetesApiCallError"
MISSING_OUTPUT = "MissingOutput"
# --- end of fixed values --------------------------------------------------------

OK = "ok"
METRICS = ("count", "avg", "sum", "min", "max", "pct")
PICKS = ("top", "max_bucket", "min_bucket")

SEARCH_TYPE = (
    "struct<filter: string, window: string, round: string, metric: string, field: string, "
    "part: string, group_by: string, pick: string, value_path: string>"
)
CONDITION_TYPE = "struct<operator: string, threshold: string, `for`: string>"
ACTION_REF_TYPE = (
    "struct<name: string, namespace: string, mode: string, data: string, "
    "labels: map<string,string>, annotations: map<string,string>>"
)
CUSTOM_METRICS_TYPE = (
    "array<struct<name: string, help: string, aggregation_map: string, "
    "labels: array<struct<name: string, value: string, static: boolean>>, value: string>>"
)
SERIES_ALERT_TYPE = (
    "struct<enabled: boolean, alert_name: string, metric_name: string, "
    "labels: map<string,string>, annotations: map<string,string>>"
)
RULE_DDL = (
    "namespace string, name string, description string, check_interval string, "
    "source struct<name: string, namespace: string>, `index` string, "
    f"search {SEARCH_TYPE}, query_json string, condition {CONDITION_TYPE}, action {ACTION_REF_TYPE}, "
    f"custom_metrics {CUSTOM_METRICS_TYPE}, series_alert {SERIES_ALERT_TYPE}"
)
SOURCE_DDL = "namespace string, name string, path string, format string, ts_col string, has_credentials boolean"
ACTION_DDL = "namespace string, name string, sync_interval string, validator string"


def rule_schema() -> T.StructType:
    return T.StructType.fromDDL(RULE_DDL)


@dataclass(frozen=True)
class Search:
    """What one rule measures over its window.

    ``filter`` and ``part`` are Spark SQL predicates over the log rows and ``field`` a
    Spark SQL expression.  ``metric`` is one of ``count avg sum min max pct``; ``pct``
    is the share of rows matching ``part``, in percent.  With ``group_by`` the metric is
    computed per bucket and ``pick`` (``top``, ``max_bucket``, ``min_bucket``) names the
    bucket whose value the condition reads.  ``round`` (``s m h d``) rounds "now" down
    before the window is cut, as in ``now-5m/m .. now/m``.
    """

    filter: str = "true"
    window: str = "5m"
    round: str | None = None
    metric: str = "count"
    field: str | None = None
    part: str | None = None
    group_by: str | None = None
    pick: str | None = None
    value_path: str | None = None


@dataclass(frozen=True)
class Rule:
    """One row of the rule catalog, as a Python value for use at plan time."""

    namespace: str
    name: str
    search: Search
    operator: str = "greaterThan"
    threshold: str = "0"
    for_: str = "0s"
    check_interval: str = "30s"
    description: str = ""
    source: tuple[str, str] = ("logs", "")
    index: str = "logs"
    action: dict | None = None
    custom_metrics: list = field(default_factory=list)
    series_alert: dict | None = None

    def row(self) -> dict:
        action = None if self.action is None else {
            k: self.action.get(k) for k in ("name", "namespace", "mode", "data", "labels", "annotations")
        }
        series = None if self.series_alert is None else {
            k: self.series_alert.get(k) for k in ("enabled", "alert_name", "metric_name", "labels", "annotations")
        }
        return {
            "namespace": self.namespace,
            "name": self.name,
            "description": self.description,
            "check_interval": self.check_interval,
            "source": {"name": self.source[0], "namespace": self.source[1]},
            "index": self.index,
            "search": vars(self.search).copy(),
            "query_json": None,
            "condition": {"operator": self.operator, "threshold": self.threshold, "for": self.for_},
            "action": action,
            "custom_metrics": [
                {
                    "name": m["name"],
                    "help": m.get("help"),
                    "aggregation_map": m["aggregation_map"],
                    "labels": [
                        {"name": x["name"], "value": x["value"], "static": x.get("static", False)}
                        for x in m.get("labels", [])
                    ],
                    "value": m.get("value"),
                }
                for m in self.custom_metrics
            ],
            "series_alert": series,
        }


def local_frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table whose size the optimizer knows, so joins with it need no shuffle."""
    schema = T.StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rule catalog as a DataFrame, with durations and thresholds parsed."""
    return resolve_rules(local_frame(spark, [r.row() for r in rules], RULE_DDL))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a catalog of JSON rule documents and apply the defaults."""
    return resolve_rules(spark.read.schema(rule_schema()).option("multiLine", True).json(path))


def resolve_rules(rules: DataFrame) -> DataFrame:
    """Add ``check_us``, ``for_us`` and ``threshold_value``; NULL where the text is not valid."""
    from tickwatch.functions.conditions import threshold_value
    from tickwatch.functions.durations import duration_micros

    return rules.withColumns(
        {
            "check_us": duration_micros("check_interval"),
            "for_us": duration_micros("condition.`for`"),
            "threshold_value": threshold_value(F.col("condition")["threshold"]),
        }
    )


def rules_from_frame(rules: DataFrame) -> list[Rule]:
    """Catalog rows that can be evaluated, as Python values for planning searches.

    A catalog is configuration written by people; what shapes a plan comes to the driver.  Rows that cannot be planned are left out: the lint report and
    :func:`tickwatch.plans.catalog.plan_catalog` name them.
    """
    usable = rules.where(
        "search is not null and check_us > 0 and for_us is not null and threshold_value is not null"
    )
    rows = usable.select(
        "namespace", "name", "search", "condition", "check_interval", "index", "source", "action", "custom_metrics", "series_alert"
    ).toLocalIterator()
    return [
        Rule(
            namespace=r["namespace"],
            name=r["name"],
            search=Search(**{k: v for k, v in r["search"].asDict().items() if v is not None}),
            operator=r["condition"]["operator"],
            threshold=r["condition"]["threshold"],
            for_=r["condition"]["for"],
            check_interval=r["check_interval"],
            index=r["index"],
            source=(r["source"]["name"], r["source"]["namespace"] or ""),
            action=r["action"] and r["action"].asDict(),
            custom_metrics=[m.asDict(recursive=True) for m in r["custom_metrics"] or []],
            series_alert=r["series_alert"] and r["series_alert"].asDict(),
        )
        for r in rows
    ]


def lookup(values: dict[str, str], key: Column) -> Column:
    """``values[key]`` as a ``when`` chain; NULL for an unknown key."""
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out
