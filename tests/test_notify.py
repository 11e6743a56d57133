"""Routing, outbox, payloads and validation."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.operators import notify

T0 = datetime(2024, 1, 1)

VALID = '[{"labels":{"alertname":"a"},"startsAt":"2024-01-01T00:00:00Z"}]'
PAYLOADS = [
    (VALID, True, None, None),
    ("[]", True, None, None),
    ("null", False, None, ""),
    ('{"labels":{"alertname":"a"},"startsAt":"x"}', False, "decode", None),
    ("not json", False, "decode", None),
    ("", False, "decode", None),
    ('"text"', False, "decode", None),
    ("[1]", False, "decode", None),
    ("[null]", False, None, model.HINT_NO_NAME),
    ('[{"labels":{"x":"a"},"startsAt":"x"}]', False, None, model.HINT_NO_NAME),
    ('[{"startsAt":"x"}]', False, None, model.HINT_NO_NAME),
    ('[{"labels":{"alertname":"a"}}]', False, None, model.HINT_NO_START),
    ('[{"labels":{"alertname":"a"},"startsAt":""}]', False, None, model.HINT_NO_START),
    ('[{"labels":{"alertname":"a"},"startsAt":null}]', False, None, model.HINT_NO_START),
    ('[{"labels":{"alertname":1},"startsAt":"x"}]', False, "decode", None),
    ('[{"labels":{"alertname":null},"startsAt":"x"}]', True, None, None),
    ('[{"labels":{"alertname":"a"},"annotations":{"k":[1]},"startsAt":"x"}]', False, "decode", None),
    ('[{"labels":{"alertname":"a"},"startsAt":"x","endsAt":7}]', False, "decode", None),
    ('[{"labels":{"alertname":"a"},"startsAt":"x"},{"labels":{}}]', False, None, model.HINT_NO_NAME),
    # a value that does not decode anywhere beats the checks before it
    ('[{"labels":{}},{"labels":{"alertname":{}},"startsAt":"x"}]', False, "decode", None),
]


def test_validation(spark):
    rows = spark.createDataFrame([(p, "alertmanager", i) for i, (p, *_) in enumerate(PAYLOADS)], "payload string, validator string, i int")
    for r in notify.validate(rows).collect():
        payload, valid, error, hint = PAYLOADS[r["i"]]
        assert r["valid"] == valid, payload
        assert (r["error"] is not None) == (error is not None), payload
        assert r["hint"] == (None if hint is None else model.PAYLOAD_HINT + hint), payload


def test_validator_choice(spark):
    rows = spark.createDataFrame([("x", None), ("x", ""), ("x", "nope"), ("x", "alertmanager")], "payload string, validator string")
    got = {r["validator"]: (r["valid"], r["error"]) for r in notify.validate(rows).collect()}
    assert got == {
        None: (True, None), "": (True, None), "nope": (False, "validator nope not found"),
        "alertmanager": (False, model.PAYLOAD_ERROR),
    }


def _alerts(spark):
    rows = [("n", "long", "pager", "n", T0 + timedelta(seconds=3), T0 + timedelta(days=2, seconds=1), None, 1.0),
            ("n", "open", "pager", "m", T0, None, T0 + timedelta(seconds=20), 2.0),
            ("n", "other", "nobody", "n", T0, None, T0, 3.0)]
    return spark.createDataFrame(rows, "namespace string, rule string, action_name string, action_namespace string, opened_at timestamp_ntz, closed_at timestamp_ntz, last_active_at timestamp_ntz, value double")


def _actions(spark):
    rows = [("n", "pager", "1h", "alertmanager"), ("", "pager", None, None)]
    return spark.createDataFrame(rows, model.ACTION_DDL)


def test_routing_by_name_and_by_namespace(spark):
    by_name = notify.route(_alerts(spark), _actions(spark))
    assert sorted((r["rule"], r["action_namespace"]) for r in by_name.collect()) == [("long", ""), ("long", "n"), ("open", ""), ("open", "n")]
    both = notify.route(_alerts(spark), _actions(spark), match_namespace=True)
    assert [(r["rule"], r["action_namespace"]) for r in both.collect()] == [("long", "n")]


def test_outbox_sends_at_every_sync_while_active(spark):
    sent = notify.outbox(notify.route(_alerts(spark), _actions(spark)))
    got = {}
    for r in sent.collect():
        got.setdefault((r["rule"], r["action_namespace"]), set()).add((r["sent_at"] - T0).total_seconds())
    assert got == {
        ("long", "n"): {3600.0 * i for i in range(1, 49)},
        # no interval set: every five seconds; the instant of closing is no longer active
        ("long", ""): {5.0 * i for i in range(1, 2 * 86400 // 5 + 1)},
        ("open", "n"): {0.0},
        ("open", ""): {0.0, 5.0, 10.0, 15.0, 20.0},
    }


def test_structured_payload(spark):
    rows = spark.createDataFrame(
        [("n", "r", T0, 30_000_000, {"severity": "{{ .value }}", "cost": "{{ dollars }}"}, None, 1.5),
         ("n", "named", T0, 30_000_000, {"alertname": "mine"}, {"text": "{{rule}}/{{ namespace }} {{ unknown }}"}, 2.0)],
        "namespace string, rule string, sent_at timestamp_ntz, check_us bigint, labels map<string,string>, annotations map<string,string>, value double",
    )
    variables = {"value": F.col("value").cast("string"), "rule": F.col("rule"), "namespace": F.col("namespace"), "dollars": F.lit("$1\\2")}
    got = {r["rule"]: json.loads(r["payload"]) for r in notify.validate(notify.alertmanager_payload(rows, variables).withColumn("validator", F.lit("alertmanager"))).where("valid").collect()}
    assert got["r"] == [{
        "labels": {"alertname": "r", "severity": "1.5", "cost": "$1\\2"}, "annotations": {},
        "startsAt": "2024-01-01T00:00:00Z", "endsAt": "2024-01-01T00:01:00Z",
    }]
    assert got["named"][0]["labels"] == {"alertname": "mine"}
    assert got["named"][0]["annotations"] == {"text": "named/n {{ unknown }}"}


def test_raw_message(spark):
    rows = spark.createDataFrame([("a-b", 2.5)], "rule string, value double")
    assert notify.raw_message(rows, "format_string('%s=%.1f', replace(rule, '-', ' '), value)").first()["message"] == "a b=2.5"


@pytest.mark.parametrize("text,want", [('{"a":"x","b":2,"c":{"d":1}}', {"a": "x", "b": "2", "c": '{"d":1}'}), ("null", {}), ("[1]", {"Error": "not a JSON object"}), ("{", {"Error": "not a JSON object"})])
def test_json_object(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(notify.json_object_or_error(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text,want", [('["a",2,null]', ["a", "2", "null"]), ("null", []), ('{"a":1}', ["not a JSON list"]), ("[", ["not a JSON list"])])
def test_json_array(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(notify.json_array_or_error(F.col("t"))).first()[0] == want


def test_messages_of_many_templates(spark):
    texts = [
        ("a", "{{ rule }}"), ("b", "{{x}}{{ .value }} {{value}}!"), ("c", "no slot"), ("d", ""), ("e", None), ("f", "{{ a b }} {value} }}{{ $rule"),
        ("g", "cost $1 \\\\ {{ rule }}\nline {{rule}}"),
    ]
    rows = spark.createDataFrame(texts, "rule string, data string").withColumn("parts", notify.message_parts(F.col("data")))
    vars_ = F.create_map(F.lit("rule"), F.concat(F.lit("$1"), F.col("rule")), F.lit("value"), F.lit("7"))
    got = {r["rule"]: r["m"] for r in rows.select("rule", notify.filled(F.col("parts"), vars_).alias("m")).collect()}
    assert got == {"a": "$1a", "b": "7 7!", "c": "no slot", "d": "", "e": None, "f": "{{ a b }} {value} }}{{ $rule", "g": "cost $1 \\\\ $1g\nline $1g"}
