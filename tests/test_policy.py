import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions import text as X
from quillguard.operators import decide as D
from quillguard.operators import rules as R

FILE = {
    "defaults": {"ingress": {"action": "redact"}, "egress": {"action": "redact"}},
    "tool_access": {
        "book_courier": {
            "direction": "ingress",
            "allow_pii": {"PII:email_address": "pass_through", "PII:us_ssn": "tokenize"},
        },
        "print_label": {"direction": "egress", "allow_pii": {"PII:email_address": "pass_through"}},
        "anything": {"direction": "both"},
    },
}


def tok(value):
    return "pii_" + hashlib.sha256((X.DEFAULT_SALT + value).encode()).hexdigest()[:8]


def static(spark, tool, text, scope=None, direction="ingress", policy=FILE, **options):
    df = spark.createDataFrame(
        [(tool, scope, text, direction)], "tool string, scope string, raw_text string, direction string"
    )
    r = D.decide(df, None, json.dumps(policy), mode="static", **options).first()
    return r["decision"], r["raw_text_out"], r["reasons"], r["rule_id"]


BUDGET = {
    "monthly_limit": 100.0,
    "current_spend": 10.0,
    "llm_spend": 10.0,
    "purchase_spend": 0.0,
    "remaining_budget": 90.0,
    "budget_type": "user",
}


def payload(spark, policy, tool, text, direction="ingress", metadata=None, budget=None, user="u", check=False):
    row = (tool, text, direction, user, "p", None if metadata is None else (tool, None, direction, metadata), budget)
    df = spark.createDataFrame(
        [row],
        "tool string, raw_text string, direction string, user_id string, policy_key string, "
        f"tool_config {S.TOOL_CONFIG_DDL}, budget_context {S.BUDGET_CONTEXT_DDL}",
    )
    policies = spark.createDataFrame([("p", json.dumps(policy), "payload")], "policy_key string, doc string, form string")
    run = D.check_pass if check else D.decide
    r = run(df, policies, json.dumps(FILE)).first()
    return r


def brief(r):
    return r["decision"], r["raw_text_out"], r["reasons"], r["rule_id"]


# ---------------------------------------------------------------------------------- static chain
@pytest.mark.parametrize("tool", S.DEFAULT_DENY_TOOLS)
def test_code_tools_are_denied(spark, tool):
    assert static(spark, tool, "a@x.com") == ("deny", None, ["blocked tool: code/exec"], "deny-exec")


def test_static_rule(spark):
    out = static(spark, "book_courier", "a@x.com ssn 123-45-6789 cvv: 123")
    assert out == (
        "transform",
        f"a@x.com ssn {tok('123-45-6789')} <PCI_CVV>",
        ["pii.redacted:PII:pci_cvv", "pii.tokenized:PII:us_ssn", "pii.allowed:PII:email_address"],
        "tool-access",
    )
    assert static(spark, "book_courier", "clean") == ("allow", "clean", None, "tool-access")


def test_static_rule_without_detector_allows_unchanged(spark):
    out = static(spark, "book_courier", "a@x.com", static_rule_detector="none")
    assert out == ("allow", "a@x.com", None, "tool-access")


def test_static_rule_needs_its_direction_and_both_is_not_one(spark):
    assert static(spark, "print_label", "clean")[3] == "strict-fallback"
    assert static(spark, "anything", "clean")[3] == "strict-fallback"


@pytest.mark.parametrize(
    "action, expected",
    [
        ("deny", ("deny", None, ["default.ingress.deny"], "defaults")),
        ("pass_through", ("allow", "a@x.com", ["default.ingress.pass_through"], "defaults")),
        ("tokenize", ("transform", tok("a@x.com"), ["default.ingress.tokenize"], "defaults")),
    ],
)
def test_static_defaults(spark, action, expected):
    policy = {"defaults": {"ingress": {"action": action}}, "tool_access": {}}
    assert static(spark, "model.chat", "a@x.com", policy=policy) == expected


@pytest.mark.parametrize("tool, scope", [("web.fetch", None), ("http.get", "x"), ("model.chat", "net.external")])
def test_network_redaction(spark, tool, scope):
    out = static(spark, tool, "exp: 12/29 a@x.com", scope)
    assert out == (
        "transform",
        "<PCI_EXPIRY> a***@x.com",
        ["pii.redacted:email", "pii.redacted:pci_expiry"],
        "net-redact-regex",
    )
    assert static(spark, tool, "clean", scope) == ("transform", "clean", None, "net-redact-regex")


def test_strict_fallback(spark):
    assert static(spark, "model.chat", "clean") == ("allow", "clean", ["strict_fallback.allow"], "strict-fallback")
    assert static(spark, "model.chat", "pwd: x, a@x.com $5") == (
        "transform",
        "<PASSWORD> <USER_EMAIL> <PAYMENT_AMOUNT>",
        ["pii.redacted:email_address", "pii.redacted:password", "pii.redacted:payment_amount"],
        "strict-fallback",
    )


def test_missing_and_unreadable_policy_files_count_as_empty(spark):
    for doc in ("{}", "", "not json"):
        df = spark.createDataFrame([("book_courier", "clean", "ingress")], "tool string, raw_text string, direction string")
        assert D.decide(df, None, doc, mode="static").first()["rule_id"] == "strict-fallback"


# --------------------------------------------------------------------------------- payload chain
def rules(**tools):
    return {"tool_access": tools}


def test_payload_deny_list_replaces_the_default_one(spark):
    policy = {"deny_tools": ["web.fetch"]}
    assert brief(payload(spark, policy, "web.fetch", "t")) == ("deny", "t", ["blocked tool: code/exec"], "deny-exec")
    assert payload(spark, policy, "python.exec", "t")["decision"] == "allow"


def test_payload_rule_redacts_and_tokenises(spark):
    policy = rules(chat={"direction": "both", "allow_pii": {"PII:phone_number": "tokenize"}})
    assert brief(payload(spark, policy, "chat", "a@x.com 555-867-5309")) == (
        "transform",
        f"[PII:EMAIL_ADDRESS] {tok('555-867-5309')}",
        ["tokenized:PII:phone_number", "redacted:PII:email_address"],
        "tool-access",
    )


def test_payload_rule_that_keeps_everything_has_empty_reasons(spark):
    policy = rules(chat={"direction": "both", "allow_pii": {"PII:email_address": "pass_through"}})
    assert brief(payload(spark, policy, "chat", "a@x.com")) == ("transform", "a@x.com", [], "tool-access")


def test_payload_block_names_the_first_blocked_type(spark):
    allow = {"PII:phone_number": "deny", "PII:email_address": "block"}
    policy = rules(chat={"direction": "ingress", "allow_pii": allow})
    assert brief(payload(spark, policy, "chat", "555-867-5309 a@x.com")) == (
        "deny",
        "555-867-5309 a@x.com",
        ["pii.blocked:email_address"],
        "tool-access",
    )


def test_suffix_match_takes_the_first_rule_in_document_order(spark):
    policy = rules(
        current={"direction": "egress", "action": "deny"},
        **{"weather.current": {"direction": "both", "action": "confirm"}, "ent": {"direction": "ingress", "action": "deny"}},
    )
    assert payload(spark, policy, "mcp.weather.current", "t")["reasons"] == ["tool-specific.confirm"]
    assert payload(spark, policy, "mcp.weather.current", "t", "egress")["reasons"] == ["tool-specific.block"]


def test_exact_name_wins_over_an_earlier_suffix(spark):
    policy = rules(chat={"direction": "both", "action": "deny"}, **{"model.chat": {"direction": "ingress"}})
    assert payload(spark, policy, "model.chat", "t")["decision"] == "allow"
    assert payload(spark, policy, "model.chat", "t", "egress")["decision"] == "deny"


@pytest.mark.parametrize(
    "action, expected",
    [
        ("deny", ("deny", "t", ["tool-specific.block"])),
        ("block", ("deny", "t", ["tool-specific.block"])),
        ("tokenize", ("transform", tok("t"), ["tool-specific.tokenize"])),
        ("confirm", ("confirm", "t", ["tool-specific.confirm"])),
        ("redact", ("allow", "t", None)),
        (None, ("allow", "t", None)),
    ],
)
def test_actions_without_findings(spark, action, expected):
    r = payload(spark, rules(chat={"direction": "both", "action": action}), "chat", "t")
    assert brief(r) == (*expected, "tool-access")


def test_payload_defaults_keep_the_text_of_denied_requests(spark):
    policy = {"defaults": {"egress": {"action": "deny"}}}
    assert brief(payload(spark, policy, "x", "t", "egress")) == ("deny", "t", ["default.egress.deny"], "defaults")
    assert payload(spark, policy, "x", "t")["rule_id"] == "strict-fallback"


def test_payload_network_branch_reads_the_policy_not_the_request(spark):
    assert payload(spark, {"version": "v1"}, "web.fetch", "t")["rule_id"] == "strict-fallback"
    assert payload(spark, {"tool": "web.x"}, "plain", "t")["rule_id"] == "net-redact-regex"
    assert payload(spark, {"scope": "lan.a", "network_scopes": ["lan."]}, "plain", "t")["rule_id"] == "net-redact-regex"


@pytest.mark.parametrize(
    "on_error, expected",
    [
        ("block", ("deny", "a@x.com", ["evaluation.error"], "error-handler")),
        ("odd", ("deny", "a@x.com", ["evaluation.error"], "error-handler")),
        ("pass", ("allow", "a@x.com", ["evaluation.bypass"], "error-handler")),
        ("best_effort", ("transform", "a***@x.com", ["pii.redacted:email"], "error-handler-regex")),
    ],
)
def test_malformed_rules(spark, on_error, expected):
    policy = {"tool_access": "broken", "on_error": on_error}
    assert brief(payload(spark, policy, "x", "a@x.com")) == expected
    assert payload(spark, policy, "python.exec", "a@x.com")["rule_id"] == "deny-exec"


def test_static_errors(spark):
    df = spark.createDataFrame([("a@x.com", e) for e in ("pass", "block", "best_effort")], "raw_text string, on_error string")
    out = {r["on_error"]: (r["decision"], r["raw_text_out"]) for r in D.resolve_errors(df, mode="static").collect()}
    assert out == {"pass": ("pass_through", None), "block": ("deny", "a@x.com"), "best_effort": ("transform", "a***@x.com")}


def test_empty_policy_falls_back_to_the_file(spark):
    assert payload(spark, {}, "book_courier", "a@x.com")["reasons"] == ["pii.allowed:PII:email_address"]


# ----------------------------------------------------------------------------------------- budgets
CHAT = rules(chat={"direction": "both"})


def test_budget_gate_and_annotation(spark):
    ok = payload(spark, CHAT, "chat", "t", metadata={"amount": "5"}, budget=BUDGET)
    assert (ok["decision"], ok["reasons"], ok["rule_id"]) == ("allow", ["budget_check_passed"], "tool-access")
    assert ok["budget_status"]["reason"] == "budget_ok" and ok["budget_info"]["estimated_purchase"] == 5.0
    warn = payload(spark, CHAT, "chat", "t", metadata={"amount": "85"}, budget=BUDGET)
    assert (warn["decision"], warn["reasons"], warn["rule_id"]) == ("confirm", ["budget_warning"], "budget-check")
    over = payload(spark, CHAT, "chat", "t", metadata={"amount": "91"}, budget=BUDGET)
    assert (over["decision"], over["reasons"], over["rule_id"]) == ("deny", ["budget_exceeded"], "budget-check")


def test_no_budget_check_below_the_guard_or_without_a_user(spark):
    assert payload(spark, CHAT, "chat", "t", metadata={}, budget=BUDGET)["reasons"] is None
    assert payload(spark, CHAT, "chat", "t", metadata={"amount": "91"}, budget=BUDGET, user="")["decision"] == "allow"
    assert payload(spark, CHAT, "chat", "t", metadata={"amount": "91"})["decision"] == "allow"


def test_pass_notes_the_budget_twice(spark):
    r = payload(spark, CHAT, "chat", "t", metadata={"amount": "5"}, budget=BUDGET, check=True)
    assert r["reasons"] == ["budget_check_passed", "budget_check_passed"] and r["pass"] == "input"
    denied = payload(spark, {"deny_tools": ["chat"]}, "chat", "t", metadata={"amount": "5"}, budget=BUDGET, check=True)
    assert denied["reasons"] == ["blocked tool: code/exec", "budget_check_passed"]


def test_explicit_none_reasons_take_no_budget_reason(spark):
    r = payload(spark, {"tool": "web.x"}, "chat", "t", metadata={"amount": "5"}, budget=BUDGET, check=True)
    assert r["reasons"] is None and r["budget_status"]["reason"] == "budget_ok"


def test_fallback_denies_a_payment_over_budget(spark):
    r = payload(spark, {"model": "gpt-4"}, "x", "pay $95 now", metadata={}, budget=BUDGET)
    assert brief(r) == ("deny", "pay $95 now", ["budget_exceeded:budget_exceeded"], "strict-fallback")
    assert payload(spark, {"model": "gpt-4"}, "x", "pay $5 now", metadata={}, budget=BUDGET)["decision"] == "transform"


# -------------------------------------------------------------------------------- documents, joins
def test_document_tables(spark):
    docs = [("a", json.dumps(FILE), "file"), ("b", json.dumps({"deny_tools": [], "network_tools": ["x."]}), "payload"), ("c", "{}", "payload")]
    rules_df, defaults, lists = R.policy_rules(spark.createDataFrame(docs, "policy_key string, doc string, form string"))
    assert {r["tool"] for r in rules_df.collect()} == set(FILE["tool_access"])
    first = rules_df.filter("tool = 'book_courier'").orderBy("pii_type").collect()
    assert [(r["rule_ord"], r["pii_type"], r["pii_action"]) for r in first] == [
        (0, "PII:email_address", "pass_through"),
        (0, "PII:us_ssn", "tokenize"),
    ]
    assert {(r["policy_key"], r["direction"], r["action"]) for r in defaults.collect()} == {
        (k, d, "redact") for k in "ab" for d in ("ingress", "egress")
    }
    entries = {(r["policy_key"], r["list_name"]): [] for r in lists.collect()}
    for r in lists.orderBy("ord").collect():
        entries[r["policy_key"], r["list_name"]].append(r["entry"])
    assert entries["a", "deny_tools"] == list(S.DEFAULT_DENY_TOOLS)
    assert ("b", "deny_tools") not in entries and entries["b", "network_tools"] == ["x."]


def test_policy_as_of(spark):
    versions = spark.createDataFrame([("p", "v1", 10), ("p", "v2", 20)], "policy_key string, v string, valid_from int")
    asked = spark.createDataFrame(
        [("p", 9), ("p", 10), ("p", 19), ("p", 20), ("q", 15)], "policy_key string, ts int"
    )
    out = {(r["policy_key"], r["ts"]): r["v"] for r in R.policy_as_of(asked, versions).collect()}
    assert out == {("p", 9): None, ("p", 10): "v1", ("p", 19): "v1", ("p", 20): "v2", ("q", 15): None}


def test_policy_as_of_equals_a_scan(spark):
    """A key of very many versions, one of most requests, times before all, ties, no key and no time."""
    rng = random.Random(6)
    begin = datetime(2024, 1, 1)
    at = lambda: begin + timedelta(seconds=rng.randrange(0, 40 * 86_400, 900))
    versions = [("many", f"v{i:05}", at()) for i in range(3000)] + [("hot", "h1", begin + timedelta(days=3)), ("hot", "h2", begin + timedelta(days=30))]
    versions += [("hot", "h3", begin + timedelta(days=30)), (None, "n", begin), ("hot", "never", None), ("quiet", "q", begin)]
    asked = [(i, rng.choice(["many", "hot", "hot", "hot", "quiet", "none", None]), None if i % 50 == 0 else at(), "x") for i in range(4000)]
    vs = spark.createDataFrame(versions, "policy_key string, version_id string, valid_from timestamp")
    rs = spark.createDataFrame(asked, "id int, policy_key string, ts timestamp, `_piece` string")
    want = {}
    for i, k, t, _ in asked:
        begun = [(f, v) for key, v, f in versions if None not in (key, f, t) and key == k and f <= t]
        want[i] = max(begun)[1] if begun else None
    for piece in (3600, 86_400, 10**9):
        got = R.policy_as_of(rs, vs, piece_s=piece)
        assert got.columns == ["id", "policy_key", "ts", "_piece", "version_id", "valid_from"]
        assert {r.id: r.version_id for r in got.collect()} == want
    plan = R.policy_as_of(rs, vs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert R.policy_as_of(rs, vs.filter("false")).filter("version_id IS NOT NULL").count() == 0
    assert R.policy_as_of(rs.filter("false"), vs).count() == 0


def test_joins_beyond_the_broadcast_bound_agree(spark, small, monkeypatch):
    from quillguard.functions import sizing
    from quillguard.plans import decisions, inputs

    def run():
        out = decisions._decided(spark, small, "auto").select("request_id", "decision", "rule_id", "raw_text_out")
        return sorted(map(tuple, out.collect())), out

    small_side, _ = run()
    monkeypatch.setattr(D, "broadcast_if_small", lambda df: sizing.broadcast_if_small(df, 0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large_side, df = run()
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert large_side == small_side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filtering_decisions_does_not_repeat_the_scan(spark, small):
    from quillguard.plans import decisions

    denied = decisions.document_decisions(spark, small).filter(F.col("decision") == "transform")
    plan = denied._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)\\+?\\p{Nd}") == decisions.document_decisions(spark, small)._jdf.queryExecution().optimizedPlan().toString().count("(?U)\\+?\\p{Nd}")
