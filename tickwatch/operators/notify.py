"""Alert routing, the notification outbox, payloads and payload validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.functions.jsonpath import variant_kind
from tickwatch.functions.maps import merge_maps
from tickwatch.functions.durations import duration_micros
from tickwatch.functions.text import number_text, rfc3339
from tickwatch.functions.timegrid import add_micros, floor_div, from_micros, micros

_DAY_US = 86_400_000_000


def route(alerts: DataFrame, actions: DataFrame, match_namespace: bool = False) -> DataFrame:
    """Alerts joined to the action they name.

    By default the action's name alone decides, so actions of the same name in two
    namespaces both get the alert; ``match_namespace`` also compares namespaces.
    """
    a = actions.select(
        F.col("name").alias("action_name"),
        F.col("namespace").alias("_action_ns"),
        F.col("sync_interval"),
        F.col("validator"),
    )
    out = alerts.join(a, "action_name")
    if match_namespace:
        out = out.where(F.coalesce("action_namespace", F.lit("")) == F.coalesce("_action_ns", F.lit("")))
    return out.drop("action_namespace").withColumnRenamed("_action_ns", "action_namespace")


def sync_micros(text: str = "sync_interval") -> Column:
    """An action's re-send period; the default when none is set."""
    return duration_micros(f"coalesce(nullif({text}, ''), '{model.DEFAULT_ACTION_INTERVAL}')")


def outbox(
    routed: DataFrame, until: Column | None = None, period_us: Column | None = None
) -> DataFrame:
    """One row per delivery: every alert at every sync of its action while it is active.

    ``routed`` holds ``opened_at, closed_at`` from the alert intervals.  Syncs are
    multiples of the action's period in ``[opened_at, closed_at)``, or up to and with
    ``until`` (the last evaluated instant) while the alert is open.  Long intervals are
    first cut into days, so no task has to list a whole one, and no inequality join is
    needed.
    """
    period = period_us if period_us is not None else sync_micros()
    open_end = until if until is not None else F.col("last_active_at")
    last = F.coalesce(micros(F.col("closed_at")) - 1, micros(open_end))
    spans = (
        routed.withColumn("_period", period)
        .where(F.col("_period") > 0)
        .withColumn("_from", micros(F.col("opened_at")))
        .withColumn("_to", last)
        .where(F.col("_from") <= F.col("_to"))
        .withColumn("_day", F.explode(F.sequence(floor_div(F.col("_from"), _DAY_US), floor_div(F.col("_to"), _DAY_US))))
    )
    day = F.lit(_DAY_US)
    lo = floor_div(F.greatest("_from", F.col("_day") * day) + F.col("_period") - 1, F.col("_period"))
    hi = floor_div(F.least("_to", F.col("_day") * day + (day - 1)), F.col("_period"))
    rest = [c for c in routed.columns]
    parallel = routed.sparkSession.sparkContext.defaultParallelism
    return (
        spans.withColumns({"_lo": lo, "_hi": hi})
        .where(F.col("_lo") <= F.col("_hi"))
        # a day of a short-period action is many deliveries: spread the days, not the alerts
        .repartition(parallel, *[c for c in ("namespace", "rule") if c in rest], "_day")
        .select(*rest, "_period", F.explode(F.sequence("_lo", "_hi")).alias("_n"))
        .select(*rest, from_micros(F.col("_n") * F.col("_period")).alias("sent_at"))
    )


def raw_message(rows: DataFrame, template: str, name: str = "message") -> DataFrame:
    """Render a message with a Spark SQL expression over the row, e.g.
    ``format_string('%s is %s', rule, value)``."""
    return rows.withColumn(name, F.expr(template))


def rendered_map(templates: Column, variables: dict[str, Column]) -> Column:
    """Fill ``{{ name }}`` placeholders in every value of a label or annotation map.

    Only plain variables are filled; anything richer is a :func:`raw_message` expression.
    """

    def fill(_: Column, text: Column) -> Column:
        for name, value in variables.items():
            text = F.regexp_replace(
                text, F.lit(r"\{\{\s*\.?" + name + r"\s*\}\}"),
                F.regexp_replace(F.coalesce(value, F.lit("")), r"([\\$])", r"\\$1"),
            )
        return text

    return F.transform_values(templates, fill)


_SLOT = r"\{\{\s*\.?([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
#: what a message may name
VARIABLES = ["namespace", "rule", "value", "description", "operator", "threshold", "opened_at", "sent_at"]


def message_parts(template: Column) -> Column:
    """A message's text as a list of (text, variable that follows it or NULL), to be kept with its rule."""
    return F.transform(
        F.arrays_zip(F.split(template, _SLOT, -1).alias("text"), F.regexp_extract_all(template, F.lit(_SLOT), 1).alias("name")),
        lambda p: F.struct(p["text"].alias("text"), p["name"].alias("name")),
    )


def filled(parts: Column, variables: Column) -> Column:
    """The parts with their variables filled in from a map, by one expression for all messages; a variable that the map
    does not have is empty text."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.coalesce(F.try_element_at(variables, p["name"]), F.lit("")))), "")


def unknown_variables(template: Column) -> Column:
    """The variables of a message that no message can have."""
    return F.array_except(F.regexp_extract_all(template, F.lit(_SLOT), 1), F.array(*[F.lit(v) for v in VARIABLES]))


def raw_messages(rows: DataFrame) -> DataFrame:
    """Add ``payload`` to deliveries (``rule, sent_at, value, opened_at``) that carry their rule's ``parts``, ``description``,
    ``operator`` and ``threshold``."""
    values = {
        "namespace": F.col("namespace"), "rule": F.col("rule"), "value": number_text(F.col("value")), "description": F.col("description"), "operator": F.col("operator"),
        "threshold": F.col("threshold"), "opened_at": rfc3339(F.col("opened_at")), "sent_at": rfc3339(F.col("sent_at")),
    }
    variables = F.map_from_arrays(F.array(*[F.lit(v) for v in VARIABLES]), F.array(*[values[v] for v in VARIABLES]))
    return rows.withColumn("_variables", variables).withColumn("payload", filled(F.col("parts"), F.col("_variables"))).drop("_variables")


def alertmanager_alert(
    rule: Column, sent_at: Column, check_us: Column, labels: Column, annotations: Column
) -> Column:
    """One structured alert: labels with a default ``alertname``, annotations and times."""
    named = merge_maps(F.create_map(F.lit("alertname"), rule), labels)
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        named.alias("labels"),
        F.coalesce(annotations, empty).alias("annotations"),
        rfc3339(sent_at).alias("startsAt"),
        rfc3339(add_micros(sent_at, check_us * 2)).alias("endsAt"),
    )


def alertmanager_payload(rows: DataFrame, variables: dict[str, Column] | None = None) -> DataFrame:
    """Add ``alert`` (struct) and ``payload`` (JSON text of a one-element list).

    ``rows`` holds ``rule, sent_at, check_us, labels, annotations``.
    """
    variables = variables or {}
    labels = rendered_map(F.col("labels"), variables) if variables else F.col("labels")
    notes = rendered_map(F.col("annotations"), variables) if variables else F.col("annotations")
    alert = alertmanager_alert(F.col("rule"), F.col("sent_at"), F.col("check_us"), labels, notes)
    return rows.withColumn("alert", alert).withColumn("payload", F.to_json(F.array(F.col("alert"))))


# --- validation -------------------------------------------------------------------


def _member(obj: Column, key: str) -> Column:
    return F.try_variant_get(obj, F.lit(f"$.{key}"), "variant")


def _text_or_null(v: Column) -> Column:
    """A text field may be missing, null or text."""
    return F.coalesce(variant_kind(v), F.lit("null")).isin("null", "string")


def _text_map_or_null(v: Column) -> Column:
    kind = F.coalesce(variant_kind(v), F.lit("null"))
    members = F.map_values(F.try_variant_get(v, F.lit("$"), "map<string,variant>"))
    return (kind == "null") | ((kind == "object") & F.coalesce(F.forall(members, _text_or_null), F.lit(False)))


def _decodes(item: Column) -> Column:
    kind = variant_kind(item)
    fields = (
        _text_map_or_null(_member(item, "labels"))
        & _text_map_or_null(_member(item, "annotations"))
        & _text_or_null(_member(item, "startsAt"))
        & _text_or_null(_member(item, "endsAt"))
        & _text_or_null(_member(item, "generatorURL"))
    )
    return (kind == "null") | ((kind == "object") & fields)


def alertmanager_validator(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``valid``, ``error`` (text that does not decode) and ``hint`` (first failed check)."""
    doc = F.try_parse_json(F.col(payload))
    kind = variant_kind(F.col("_doc"))
    items = F.when(kind == "array", F.col("_doc").cast("array<variant>"))
    decodes = (kind == "null") | ((kind == "array") & F.forall("_items", _decodes))

    def failure(item: Column) -> Column:
        names = F.map_keys(F.try_variant_get(_member(item, "labels"), F.lit("$"), "map<string,variant>"))
        has_name = F.coalesce(F.array_contains(names, "alertname"), F.lit(False))
        start = F.coalesce(F.try_variant_get(item, F.lit("$.startsAt"), "string"), F.lit(""))
        return F.when(~has_name, F.lit(model.HINT_NO_NAME)).when(start == "", F.lit(model.HINT_NO_START))

    failed = F.filter(F.transform("_items", failure), lambda h: h.isNotNull())
    ok = F.coalesce(decodes, F.lit(False))
    hint = F.when(kind == "null", F.lit(model.PAYLOAD_HINT)).when(
        F.size(failed) > 0, F.concat(F.lit(model.PAYLOAD_HINT), F.try_element_at(failed, F.lit(1)))
    )
    return (
        rows.withColumn("_doc", doc)
        .withColumn("_items", items)
        .withColumn("error", F.when(~ok, F.lit(model.PAYLOAD_ERROR)))
        .withColumn("hint", F.when(ok, hint))
        .withColumn("valid", F.col("error").isNull() & F.col("hint").isNull())
        .drop("_doc", "_items")
    )


VALIDATORS: dict[str, Callable[[DataFrame, str], DataFrame]] = {model.ALERTMANAGER: alertmanager_validator}


def validate(rows: DataFrame, payload: str = "payload", validator: str = "validator") -> DataFrame:
    """Apply the validator each row names; no name passes, an unknown name is an error.

    Every row comes back with ``valid, error, hint``, so a bad payload holds up only itself.
    """
    out = rows.withColumns(
        {
            "_valid": F.coalesce(F.col(validator), F.lit("")) == "",
            "_error": F.when(
                (F.coalesce(F.col(validator), F.lit("")) != "") & ~F.col(validator).isin(*VALIDATORS),
                F.format_string("validator %s not found", F.col(validator)),
            ),
            "_hint": F.lit(None).cast("string"),
        }
    )
    for name, check in VALIDATORS.items():
        mine = F.col(validator).eqNullSafe(name)
        out = check(out, payload)
        out = out.withColumns(
            {
                "_valid": F.when(mine, F.col("valid")).otherwise(F.col("_valid")),
                "_error": F.when(mine, F.col("error")).otherwise(F.col("_error")),
                "_hint": F.when(mine, F.col("hint")).otherwise(F.col("_hint")),
            }
        ).drop("valid", "error", "hint")
    return out.withColumnsRenamed({"_valid": "valid", "_error": "error", "_hint": "hint"})


# --- JSON in and out --------------------------------------------------------------


def json_object_or_error(text: Column) -> Column:
    """A JSON object as a map of members; text that is none becomes ``{"Error": message}``."""
    doc = F.try_parse_json(text)
    members = F.try_variant_get(doc, F.lit("$"), "map<string,variant>")
    as_text = F.transform_values(
        members, lambda _, v: F.when(variant_kind(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    )
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.is_variant_null(doc), empty).otherwise(
        F.coalesce(as_text, F.create_map(F.lit("Error"), F.lit("not a JSON object")))
    )


def json_array_or_error(text: Column) -> Column:
    """A JSON list as list of texts; text that is none becomes a list of one message."""
    doc = F.try_parse_json(text)
    items = F.transform(
        F.try_variant_get(doc, F.lit("$"), "array<variant>"),
        lambda v: F.when(variant_kind(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)),
    )
    empty = F.array().cast("array<string>")
    return F.when(F.is_variant_null(doc), empty).otherwise(F.coalesce(items, F.array(F.lit("not a JSON list"))))
