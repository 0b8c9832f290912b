import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillguard.functions.text import hmac_sha256
from quillguard.operators import analytics, events
from quillguard.sources import intake, sinks


@pytest.mark.parametrize(
    "reasons, types, confidence, intended",
    [
        (["pii.redacted:PII:email_address", "pii.allowed:PII:us_ssn"], ["email_address", "us_ssn"], 0.5, 0.8),
        (["pii.redacted:email"], [], 0.95, 0.95),
        (["tokenized:PII:us_ssn"], [], 0.95, 0.95),
        ([], [], 0.95, 0.95),
        (None, [], 0.95, 0.95),
        (["pii.x:allowed:y"], ["y"], 0.9, 0.5),
    ],
)
def test_summary(spark, reasons, types, confidence, intended):
    df = spark.createDataFrame([(reasons,)], "reasons array<string>")
    row = events.detector_summary(df).first()
    assert (row["pii_types"], row["confidence"]) == (types, pytest.approx(confidence))
    assert events.detector_summary(df, intended=True).first()["confidence"] == pytest.approx(intended)


DECISIONS = (
    "request_id string, pass string, tool string, scope string, raw_text string, raw_text_out string, "
    "decision string, reasons array<string>, rule_id string, user_id string, corr_id string, ts bigint, key string"
)


def decisions(spark):
    rows = [
        ("r1", "input", "t", None, "raw é", None, "deny", None, "tool-access", "u", "c1", 1704067200, "secret"),
        ("r2", "output", "t", "net.x", "raw", "raw", "transform", None, "net-redact-regex", None, None, 1704067201, ""),
    ]
    return spark.createDataFrame(rows, DECISIONS)


def test_decision_event(spark):
    out = {
        r["request_id"]: (json.loads(r["j"]), str(r["event_date"]))
        for r in events.decision_events(decisions(spark), "org", "org:decisions", "key")
        .select("request_id", "event_date", F.to_json("event", {"ignoreNullFields": "false"}).alias("j"))
        .collect()
    }
    event, day = out["r1"]
    assert event == {
        "type": "INGEST",
        "channel": "org:decisions",
        "schema": "decision.v1",
        "idempotencyKey": "input-1704067200-c1",
        "data": {
            "orgId": "org",
            "direction": "input",
            "decision": "deny",
            "tool": "t",
            "scope": None,
            "rawText": "raw é",
            "rawTextOut": "",
            "reasons": [],
            "detectorSummary": {"reasons": [], "confidence": 0.95, "piiDetected": []},
            "payloadHash": "sha256:" + hashlib.sha256("raw é".encode()).hexdigest(),
            "latencyMs": 0,
            "correlationId": "c1",
            "tags": [],
            "ts": "2024-01-01T00:00:00Z",
            "authentication": {"userId": "u", "apiKeyId": hashlib.sha256(b"secret").hexdigest()[:16]},
        },
    }
    assert day == "2024-01-01" and "secret" not in json.dumps(event)
    second = out["r2"][0]["data"]
    assert second["reasons"] is None and second["authentication"] == {"userId": None, "apiKeyId": None}
    assert second["correlationId"].startswith("corr-") and len(second["correlationId"]) == 29


def test_event_times_do_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = events.decision_events(decisions(spark)).select("event_date", "event.data.ts").first()
        assert (str(row["event_date"]), row["ts"]) == ("2024-01-01", "2024-01-01T00:00:00Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 5, None)], "k string, ts int, v string")
    assert sorted(map(tuple, events.dedupe_events(df, ["k"], ["ts"]).collect())) == [("k", 1, "a"), ("l", 5, None)]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("ws://h/x?org=o1&key=k%20y&channels=a:usage,%20b:decisions,c:decisions", ("o1", "b:decisions", "k y")),
        ("ws://h?channels=a:usage#org=x", (None, None, None)),
        ("ws://h?org=&key=a+b", (None, None, "a b")),
        ("not a url", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_endpoint(spark, url, expected):
    row = events.endpoint_config(spark.createDataFrame([(url,)], "url string")).first()
    assert (row["org_id"], row["channel"], row["api_key"]) == expected


def test_delivery(spark):
    sent = spark.createDataFrame([(i,) for i in range(1, 6)], "event_id int")
    tries = spark.createDataFrame(
        [
            (1, 1, None),
            (2, 1, "websocket_exception:E:x"),
            (2, 2, None),
            (3, 1, "a"),
            (3, 2, "b"),
            (3, 3, "auth_failed:no"),
            (3, 4, None),
            (4, 1, ""),
        ],
        "event_id int, attempt int, error string",
    )
    outcomes, failed = events.delivery_outcomes(sent, tries)
    got = {r["event_id"]: (r["status"], r["attempts_used"], r["backoff_ms"], r["err"], r["error_type"]) for r in outcomes.collect()}
    assert got == {
        1: ("success", 1, 0, None, None),
        2: ("success", 2, 150, None, None),
        3: ("failed", 3, 450, "auth_failed:no", "auth_failed"),
        4: ("failed", 1, 0, "", "unknown"),
        5: ("failed", 0, 0, "webhook_url_not_configured", "webhook_url_not_configured"),
    }
    assert {r["event_id"] for r in failed.collect()} == {3, 4, 5}


def test_auth(spark):
    keys = spark.createDataFrame(
        [("good", True, None), ("off", False, None), ("old", True, datetime(2024, 1, 1)), ("void", None, None)],
        "k string, is_active boolean, expires_at timestamp",
    ).withColumn("key_hash", hmac_sha256("s", F.col("k")))
    asked = spark.createDataFrame(
        [(k, datetime(2024, 1, 2)) for k in (None, "", "good", "off", "old", "void", "who")], "api_key string, ts timestamp"
    )
    out = {r["api_key"]: r["auth_result"] for r in events.auth_outcomes(asked, keys, "s").collect()}
    assert out == {
        None: "missing_api_key",
        "": "missing_api_key",
        "good": "ok",
        "off": "invalid_api_key",
        "void": "invalid_api_key",
        "who": "invalid_api_key",
        "old": "expired_api_key",
    }


def test_histogram(spark):
    df = spark.createDataFrame([("a", 0.001), ("a", 0.3), ("a", 99.0), ("b", None)], "l string, v double")
    rows = analytics.latency_histogram(df, "v", ["l"]).collect()
    a = {r["le"]: r["cum_count"] for r in rows if r["l"] == "a"}
    assert len(a) == 13 and a[0.001] == 1 and a[0.25] == 1 and a[0.5] == 2 and a[10.0] == 2 and a[None] == 3
    assert {r["total"] for r in rows if r["l"] == "a"} == {99.301}


def test_action_counts(spark):
    rows = [(["pii.redacted:email", "pii.allowed:PII:us_ssn"],), (["tokenized:PII:us_ssn", "default.ingress.deny"],), (None,)]
    out = analytics.pii_action_counts(spark.createDataFrame(rows, "reasons array<string>")).collect()
    assert {(r["pii_type"], r["action"], r["n"]) for r in out} == {
        ("email", "redacted", 1),
        ("us_ssn", "allowed", 1),
        ("us_ssn", "tokenized", 1),
    }


def test_backlog(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 1, 3)], "ts timestamp")
    assert [(r["day"].day, r["n"], r["backlog"]) for r in analytics.dead_letter_backlog(df).orderBy("day").collect()] == [(1, 2, 2), (3, 1, 3)]


# ------------------------------------------------------------------------------- intake and sinks
POLICY = '{"tool_access":{"z":{"direction":"both"},"a":{"direction":"both"}}}'


def test_intake(spark):
    good = {
        "tool": "t",
        "raw_text": "x",
        "tags": ["a"],
        "policy_config": json.loads(POLICY),
        "tool_config": {"metadata": {"amount": 5}},
        "budget_context": {"monthly_limit": "12.5", "llm_spend": 2},
        "unknown": 1,
    }
    raw = [
        json.dumps(good, separators=(",", ":")),
        '{"raw_text":"x","tool":null}',
        '{"tool":"t","raw_text":"x","user_id":null,"tags":{}}',
        '{"tool":"t"',
        '{"tool":"t","raw_text":"x","budget_context":{"monthly_limit":null,"budget_type":3}}',
        "[1]",
        '{"tool":"t","raw_text":"x","tags":["a",1],"policy_config":{"tool_access":{"a":{},"b":{"direction":1},"c":2}}}',
        '{"tool":"t","raw_text":"x","budget_context":{"llm_spend":"lots","current_spend":{}},"tool_config":5}',
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, value string")
    accepted, rejected = intake.request_intake(df)
    (row,) = accepted.collect()
    assert (row["i"], row["tool"], row["raw_text"], row["tags"], row["user_id"]) == (0, "t", "x", ["a"], None)
    assert list(json.loads(row["policy_config"])["tool_access"]) == ["z", "a"]  # rule order is kept
    assert row["tool_config"]["metadata"] == {"amount": "5"} and row["tool_config"]["direction"] == "ingress"
    assert row["budget_context"]["monthly_limit"] == 12.5 and row["budget_context"]["budget_type"] == "user"
    errors = {r["i"]: [(e["loc"], e["kind"]) for e in r["errors"]] for r in rejected.collect()}
    assert errors == {
        1: [("body.tool", "string_type")],
        2: [("body.tags", "list_type")],
        3: [("body", "json_invalid")],
        4: [("body.budget_context.monthly_limit", "float_type"), ("body.budget_context.budget_type", "string_type")],
        5: [("body", "model_attributes_type")],
        6: [
            ("body.tags.1", "string_type"),
            ("body.policy_config.tool_access.a.direction", "missing"),
            ("body.policy_config.tool_access.b.direction", "string_type"),
            ("body.policy_config.tool_access.c", "model_attributes_type"),
        ],
        7: [
            ("body.tool_config", "model_attributes_type"),
            ("body.budget_context.current_spend", "float_type"),
            ("body.budget_context.llm_spend", "float_parsing"),
        ],
    }
    assert "value" not in rejected.columns


def test_policy_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(POLICY)
    (tmp_path / "broken.yaml").write_text("a: [")
    (tmp_path / "empty.yaml").write_text("")
    assert json.loads(intake.read_policy_file(spark, str(tmp_path / "p.json"))) == json.loads(POLICY)
    assert intake.read_policy_file(spark, str(tmp_path / "broken.yaml")) == "{}"
    assert intake.read_policy_file(spark, str(tmp_path / "empty.yaml")) == "{}"
    assert intake.read_policy_file(spark, str(tmp_path / "missing.yaml")) == "{}"
    with pytest.raises(ValueError):
        intake.read_policy_file(spark, str(tmp_path))
    found = {r["path"].rsplit("/", 1)[1]: json.loads(r["policy"]) for r in intake.read_policy_files(spark, str(tmp_path)).collect()}
    assert found == {"p.json": json.loads(POLICY), "broken.yaml": {}}
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(json.loads(POLICY), sort_keys=False))
    assert json.loads(intake.read_policy_file(spark, str(tmp_path / "p.yaml"))) == json.loads(POLICY)


def test_sinks(spark, tmp_path):
    judged = decisions(spark)
    out = events.decision_events(judged, "o", "c", "key")
    sinks.write_decision_events(out, str(tmp_path / "events"))
    sinks.write_decision_events(out, str(tmp_path / "parquet"), fmt="parquet")
    assert (tmp_path / "events" / "event_date=2024-01-01").is_dir()
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    back = spark.read.json(str(tmp_path / "events"))
    assert {r["idempotencyKey"].split("-")[0] for r in back.collect()} == {"input", "output"}

    failed = out.withColumn("err", F.lit("auth_timeout"))
    for _ in range(2):
        sinks.write_dead_letters(failed, str(tmp_path / "dead"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "dead")).collect()]
    assert len(lines) == 4 and all(set(x) == {"err", "event"} and x["err"] == "auth_timeout" for x in lines)

    sinks.write_audit_trail(judged, str(tmp_path / "audit"))
    audit = sorted(r["value"] for r in spark.read.text(str(tmp_path / "audit")).collect())
    assert audit[0] == (
        '{"t":1704067200,"event":"input","user_id":"u","tool":"t","decision":"deny","corr_id":"c1",'
        '"policy_id":"tool-access","reasons":[]}'
    )
    assert audit[1].endswith('"policy_id":"net-redact-regex","reasons":null}')

    sinks.write_usage(judged, str(tmp_path / "usage"))
    usage = spark.read.parquet(str(tmp_path / "usage"))
    assert usage.filter("payload_hash = sha2('raw', 256) and policy_id = 'net-redact-regex'").count() == 1
