"""Queries over policies and decisions."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions import patterns as P
from quillguard.functions.sizing import spread
from quillguard.operators import analytics, decide, detect
from quillguard.operators import rules as R
from quillguard.plans import inputs as I
from quillguard.plans import sqlkit as K
from quillguard.plans.catalog import query

BARE_DOC = '{"version":"v1"}'


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return spread(I.requests(spark, sf), "request_id")


def _list_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(K.quote(v) for v in values) + "]"


# ------------------------------------------------------------------------------ policy documents
def _policy_steps() -> K.Steps:
    """One row per non-empty policy with its rule names in document order."""
    return (
        K.Steps(f"SELECT * FROM ({I.POLICIES_SQL}) WHERE doc <> '{{}}'")
        .add(ta="json_extract(doc, '$.tool_access')", is_file="form = 'file'")
        .add(
            keys="CASE WHEN json_type(ta) = 'OBJECT' THEN json_keys(ta) ELSE [] END",
            version="coalesce(json_extract_string(doc, '$.version'), 'v1')",
        )
    )


def _own_list(name: str, default: tuple[str, ...], doc: str = "doc", file: str = "is_file") -> str:
    fixed = _list_sql(default)
    return (
        f"CASE WHEN {file} THEN {fixed} ELSE coalesce(CAST(json_extract({doc}, '$.{name}') AS VARCHAR[]), "
        f"{fixed}) END"
    )


def _rules_sql() -> str:
    steps = _policy_steps()
    steps.raw("SELECT policy_key, version, ta, keys, unnest(range(len(keys))) AS rule_ord FROM {prev}")
    steps.add(tool="keys[rule_ord + 1]")
    steps.add(rule="json_extract(ta, '$.\"' || tool || '\"')")
    steps.add(allow="json_extract(rule, '$.allow_pii')")
    steps.add(
        types="CASE WHEN coalesce(len(json_keys(allow)), 0) = 0 THEN [NULL]::VARCHAR[] ELSE json_keys(allow) END"
    )
    steps.raw("SELECT *, unnest(types) AS pii_type FROM {prev}")
    return steps.select(
        "policy_key, version, rule_ord::INTEGER AS rule_ord, tool, json_extract_string(rule, '$.direction') "
        "AS direction, json_extract_string(rule, '$.action') AS action, pii_type, "
        "json_extract_string(allow, '$.\"' || pii_type || '\"') AS pii_action"
    )


@query("policy_rules", _rules_sql())
def policy_rules(spark, sf):
    return R.policy_rules(I.policies(spark, sf))[0]


def _default_action_sql(doc: str, direction: str) -> str:
    return f"coalesce(json_extract_string({doc}, '$.defaults.' || {direction} || '.action'), 'redact')"


def _defaults_sql() -> str:
    steps = _policy_steps()
    steps.raw("SELECT *, unnest(['ingress', 'egress']) AS direction FROM {prev}")
    return steps.select(f"policy_key, direction, {_default_action_sql('doc', 'direction')} AS action")


@query("policy_defaults", _defaults_sql())
def policy_defaults(spark, sf):
    return R.policy_rules(I.policies(spark, sf))[1]


def _lists_sql() -> str:
    steps = _policy_steps()
    names = (
        ("deny_tools", S.DEFAULT_DENY_TOOLS),
        ("network_scopes", S.DEFAULT_NETWORK_SCOPES),
        ("network_tools", S.DEFAULT_NETWORK_TOOLS),
    )
    for n, d in names:
        steps.add(**{n: _own_list(n, d)})
    steps.raw(
        " UNION ALL ".join(
            f"SELECT policy_key, '{n}' AS list_name, unnest(range(len({n})))::INTEGER AS ord, "
            f"unnest({n}) AS entry FROM {{prev}}"
            for n, _ in names
        )
    )
    return steps.select("*")


@query("policy_lists", _lists_sql())
def policy_lists(spark, sf):
    return R.policy_rules(I.policies(spark, sf))[2]


@query(
    "policy_as_of",
    f"WITH v AS (SELECT *, lead(valid_from) OVER (PARTITION BY policy_key ORDER BY valid_from) AS until "
    f"FROM ({I.VERSIONS_SQL})) SELECT r.request_id, r.ts, r.policy_key, v.version_id, v.valid_from "
    f"FROM ({I.REQUESTS_SQL}) r LEFT JOIN v ON r.policy_key = v.policy_key AND r.ts >= v.valid_from "
    "AND (v.until IS NULL OR r.ts < v.until)",
)
def policy_as_of(spark, sf):
    asked = I.requests(spark, sf).select("request_id", "ts", "policy_key")
    return R.policy_as_of(asked, I.policy_versions(spark, sf))


# ---------------------------------------------------------------------------------- rule matching
def _with_policy(sql_select: str, where: str = "") -> str:
    lists = _own_list("deny_tools", S.DEFAULT_DENY_TOOLS)
    return (
        f"WITH r AS ({I.REQUESTS_SQL}), p AS (SELECT *, form = 'file' AS is_file, "
        f"json_extract(doc, '$.tool_access') AS ta FROM ({I.POLICIES_SQL}) WHERE doc <> '{{}}'), "
        f"j AS (SELECT r.*, p.doc, p.ta, CASE WHEN p.doc IS NOT NULL THEN {lists} END AS denies, "
        "CASE WHEN json_type(ta) = 'OBJECT' THEN json_keys(ta) ELSE []::VARCHAR[] END AS keys "
        "FROM r LEFT JOIN p USING (policy_key)) "
        f"SELECT {sql_select} FROM j {where}"
    )


@query(
    "deny_tools",
    _with_policy(
        "request_id, tool, CASE WHEN list_contains(coalesce(denies, []), tool) THEN 'deny' END AS decision"
    ),
)
def deny_tools(spark, sf):
    lists = R.policy_rules(I.policies(spark, sf))[2]
    hits, rest = R.deny_tools(I.requests(spark, sf).select("request_id", "policy_key", "tool"), lists)
    return hits.select("request_id", "tool", "decision").unionByName(
        rest.select("request_id", "tool", F.lit(None).cast("string").alias("decision"))
    )


def _dir(k: str) -> str:
    return f"json_extract_string(ta, '$.\"' || {k} || '\".direction')"


_EXACT_STATIC = f"list_filter(keys, lambda k: k = tool AND {_dir('k')} = direction)[1]"
_EXACT_ANY = f"list_filter(keys, lambda k: k = tool AND {_dir('k')} IN (direction, 'both'))[1]"
_SUFFIX = f"list_filter(keys, lambda k: ends_with(tool, k) AND {_dir('k')} IN (direction, 'both'))[1]"


def _match_sql(key: str) -> str:
    return _with_policy(
        f"request_id, policy_key, tool, direction, {key} AS rule_tool, "
        f"json_extract_string(ta, '$.\"' || {key} || '\".action') AS rule_action, "
        f"(list_position(keys, {key}) - 1)::INTEGER AS rule_ord"
    )


def _match(spark, sf, mode: str) -> DataFrame:
    rules = R.policy_rules(I.policies(spark, sf))[0]
    asked = I.requests(spark, sf).select("request_id", "policy_key", "tool", "direction")
    out = R.match_tool_rule(asked, rules, mode)
    return out.select(
        "request_id", "policy_key", "tool", "direction", "rule_tool", "rule_action", "rule_ord"
    )


@query("match_tool_rule_static", _match_sql(_EXACT_STATIC))
def match_tool_rule_static(spark, sf):
    return _match(spark, sf, "static")


@query("match_tool_rule_payload", _match_sql(f"coalesce({_EXACT_ANY}, {_SUFFIX})"))
def match_tool_rule_payload(spark, sf):
    return _match(spark, sf, "payload")


def _default_action_query(mode: str) -> str:
    action = _default_action_sql("doc", "direction")
    deny_text = "raw_text" if mode == "payload" else "NULL"
    return _with_policy(
        f"request_id, CASE {action} WHEN 'deny' THEN 'deny' WHEN 'pass_through' THEN 'allow' "
        "WHEN 'tokenize' THEN 'transform' END AS decision, "
        f"CASE {action} WHEN 'deny' THEN {deny_text} WHEN 'pass_through' THEN raw_text "
        f"WHEN 'tokenize' THEN {K.token('raw_text')} END AS raw_text_out, "
        f"CASE WHEN {action} <> 'redact' THEN 'default.' || direction || '.' || {action} END AS reasons, "
        f"CASE WHEN {action} <> 'redact' THEN 'defaults' END AS rule_id"
    )


def _default_action(spark, sf, mode: str) -> DataFrame:
    defaults = R.policy_rules(I.policies(spark, sf))[1]
    decided, rest = decide.apply_default_action(I.requests(spark, sf), defaults, mode=mode)
    none = F.lit(None).cast("string")
    return decided.select(
        "request_id", "decision", "raw_text_out", F.array_join("reasons", "|").alias("reasons"), "rule_id"
    ).unionByName(
        rest.select(
            "request_id", *[none.alias(c) for c in ("decision", "raw_text_out", "reasons", "rule_id")]
        )
    )


@query("apply_default_action_static", _default_action_query("static"))
def apply_default_action_static(spark, sf):
    return _default_action(spark, sf, "static")


@query("apply_default_action_payload", _default_action_query("payload"))
def apply_default_action_payload(spark, sf):
    return _default_action(spark, sf, "payload")


_NET = (
    "(starts_with(coalesce(scope, ''), 'net.') OR "
    + " OR ".join(f"starts_with(tool, '{t}')" for t in S.DEFAULT_NETWORK_TOOLS)
    + ")"
)


@query(
    "network_redact",
    K.mask(K.Steps(I.REQUESTS_SQL), "raw_text", "m").select(
        f"request_id, CASE WHEN {_NET} THEN 'transform' END AS decision, CASE WHEN {_NET} THEN m END "
        f"AS raw_text_out, CASE WHEN {_NET} AND len(m_r) > 0 THEN {K.joined('list_sort(m_r)')} END AS reasons"
    ),
)
def network_redact(spark, sf):
    decided, rest = decide.network_redact(_requests(spark, sf))
    none = F.lit(None).cast("string")
    return decided.select(
        "request_id", "decision", "raw_text_out", F.array_join("reasons", "|").alias("reasons")
    ).unionByName(
        rest.select("request_id", *[none.alias(c) for c in ("decision", "raw_text_out", "reasons")])
    )


# --------------------------------------------------------------------------------- the whole chain
def budget_sql(steps: K.Steps, model: str) -> K.Steps:
    """Adds cost, purchase, projected, pct, verdict and whether the check applies (``guarded``)."""
    purchase = ", ".join(
        f"try_cast(metadata['{k}'] AS DOUBLE)" for k in ("purchase_amount", "amount", "price", "cost")
    )
    steps.add(model=model).add(
        cost=K.cost("raw_text", "model"), purchase=f"CASE WHEN has_tool THEN coalesce({purchase}) END"
    )
    steps.add(
        projected="(llm_spend + cost) + (purchase_spend + coalesce(purchase, 0.0::DOUBLE))",
        guarded="has_tool AND has_budget AND (purchase IS NOT NULL OR cost >= 0.01::DOUBLE)",
    )
    return verdict_sql(steps)


def verdict_sql(steps: K.Steps) -> K.Steps:
    steps.add(pct="CASE WHEN monthly_limit > 0 THEN projected / monthly_limit * 100.0::DOUBLE ELSE 0.0::DOUBLE END")
    return steps.add(
        verdict="CASE WHEN projected > monthly_limit THEN 'budget_exceeded' WHEN pct > 90 THEN 'budget_warning' "
        "ELSE 'budget_ok' END"
    )


def decision_steps(mode: str, detector: str = "specific_first") -> K.Steps:
    policy = K.quote(I.STATIC_POLICY_JSON)
    own = "CASE WHEN p.doc <> '{}' THEN p.doc END"
    if mode == "static":
        static, doc = "true", policy
    elif mode == "payload":
        static, doc = "false", f"coalesce({own}, '{BARE_DOC}')"
    else:
        static, doc = f"({own}) IS NULL", f"coalesce({own}, {policy})"
    steps = K.Steps(
        f"SELECT r.*, {static} AS st, {doc} AS doc, coalesce(p.form = 'file', false) AS is_file "
        f"FROM ({I.REQUESTS_SQL}) r LEFT JOIN ({I.POLICIES_SQL}) p USING (policy_key)"
    )
    steps.add(ta="json_extract(doc, '$.tool_access')")
    steps.add(
        keys="CASE WHEN json_type(ta) = 'OBJECT' THEN json_keys(ta) ELSE []::VARCHAR[] END",
        bad="coalesce(json_type(ta) <> 'OBJECT', false)",
        denies=f"CASE WHEN st THEN {_list_sql(S.DEFAULT_DENY_TOOLS)} "
        f"ELSE {_own_list('deny_tools', S.DEFAULT_DENY_TOOLS)} END",
        nets=f"CASE WHEN st THEN {_list_sql(S.DEFAULT_NETWORK_TOOLS)} "
        f"ELSE {_own_list('network_tools', S.DEFAULT_NETWORK_TOOLS)} END",
        net_tool="CASE WHEN st THEN tool ELSE coalesce(json_extract_string(doc, '$.tool'), '') END",
        net_scope="CASE WHEN st THEN coalesce(scope, '') ELSE '' END",
        dact=_default_action_sql("doc", "direction"),
        on_error="CASE WHEN st THEN 'block' ELSE coalesce(json_extract_string(doc, '$.on_error'), 'block') END",
    )
    steps.add(rule_key=f"CASE WHEN st THEN {_EXACT_STATIC} ELSE coalesce({_EXACT_ANY}, {_SUFFIX}) END")
    steps.add(rule="json_extract(ta, '$.\"' || rule_key || '\"')")
    steps.add(
        allow="json_extract(rule, '$.allow_pii')",
        ract="coalesce(json_extract_string(rule, '$.action'), '')",
        net="starts_with(net_scope, 'net.') OR len(list_filter(nets, lambda n: starts_with(net_tool, n))) > 0",
    )
    steps.add(
        route="CASE WHEN list_contains(denies, tool) THEN 'deny' WHEN bad THEN 'error' "
        "WHEN rule_key IS NOT NULL THEN 'rule' WHEN dact <> 'redact' THEN 'default' WHEN net THEN 'network' "
        "ELSE 'fallback' END"
    )
    K.find_all(steps, "raw_text", P.REGEX_PROFILE, "f_re")
    if detector == "none":
        steps.add(f_sp=K.NO_FINDINGS)
    else:
        K.find_all(steps, "raw_text", P.PROFILES[detector], "f_sp")
    steps.add(f_ssn="f_re")
    K.ssn(steps, "raw_text", "f_ssn")
    steps.add(
        found=f"CASE WHEN route = 'rule' AND st THEN f_sp WHEN route = 'rule' THEN f_ssn "
        f"WHEN route = 'fallback' THEN f_re ELSE {K.NO_FINDINGS} END",
        pay=f"CASE WHEN route = 'fallback' THEN {K.beside('raw_text', 'f_re', P.PAYMENT_SPEC)} "
        f"ELSE {K.NO_FINDINGS} END",
        pw=f"CASE WHEN route = 'fallback' THEN {K.beside('raw_text', 'f_re', P.PASSWORD_SPEC)} "
        f"ELSE {K.NO_FINDINGS} END",
    )
    K.mask(steps, "raw_text", "m")
    metadata_model = "CASE WHEN has_tool THEN metadata['model'] END"
    budget_sql(
        steps, f"coalesce({metadata_model}, json_extract_string(doc, '$.model'), '{S.DEFAULT_MODEL}')"
    )
    amount = f"try_cast(regexp_extract(pay[1].text, {K.regex(P.PAYMENT_NUMBER)}, 1) AS DOUBLE)"
    act = "json_extract_string(allow, '$.\"' || f.type || '\"')"
    steps.replace(guarded="guarded AND NOT st")
    steps.add(
        over_pay=f"NOT st AND has_budget AND len(pay) > 0 AND (llm_spend + cost) + "
        f"(purchase_spend + coalesce({amount}, 0.0::DOUBLE)) > monthly_limit",
        every=K.first_listed("found || pw", "pay"),
        blocked=f"CASE WHEN route = 'rule' AND NOT st THEN "
        f"list_filter(found, lambda f: coalesce({act} IN ('block', 'deny'), false))[1].type END",
    )
    steps.add(calm="route = 'rule' AND NOT st AND len(found) = 0", fixed="ract IN ('deny', 'block', 'tokenize')")
    steps.add(v="CASE WHEN calm AND guarded AND NOT fixed THEN verdict END")
    decision = (
        "CASE WHEN route = 'deny' THEN 'deny' "
        "WHEN route = 'error' THEN CASE on_error WHEN 'pass' THEN 'allow' WHEN 'best_effort' THEN 'transform' "
        "ELSE 'deny' END "
        "WHEN blocked IS NOT NULL THEN 'deny' "
        "WHEN calm THEN CASE WHEN ract IN ('deny', 'block') THEN 'deny' WHEN ract = 'tokenize' THEN 'transform' "
        "WHEN v = 'budget_exceeded' THEN 'deny' WHEN v = 'budget_warning' OR ract = 'confirm' THEN 'confirm' "
        "ELSE 'allow' END "
        "WHEN route = 'rule' THEN CASE WHEN len(found) > 0 THEN 'transform' ELSE 'allow' END "
        "WHEN route = 'default' THEN CASE dact WHEN 'deny' THEN 'deny' WHEN 'pass_through' THEN 'allow' "
        "ELSE 'transform' END "
        "WHEN route = 'network' THEN 'transform' WHEN over_pay THEN 'deny' "
        "WHEN len(every) > 0 THEN 'transform' ELSE 'allow' END"
    )
    static_new = (
        f"CASE {act} WHEN 'pass_through' THEN NULL WHEN 'tokenize' THEN {K.token('f.text')} "
        f"ELSE {K.placeholder('f.type')} END"
    )
    payload_new = (
        f"CASE WHEN {act} = 'tokenize' THEN {K.token('f.text')} "
        f"WHEN coalesce({act}, 'redact') IN ('redact', 'deny') THEN '[' || upper(f.type) || ']' END"
    )
    text_out = (
        "CASE WHEN route = 'deny' THEN CASE WHEN NOT st THEN raw_text END "
        "WHEN route = 'error' THEN CASE WHEN on_error = 'best_effort' THEN m ELSE raw_text END "
        "WHEN blocked IS NOT NULL THEN raw_text "
        f"WHEN calm THEN CASE WHEN ract = 'tokenize' THEN {K.token('raw_text')} ELSE raw_text END "
        f"WHEN route = 'rule' AND NOT st THEN {K.splice('raw_text', 'found', payload_new)} "
        f"WHEN route = 'rule' THEN {K.splice('raw_text', 'found', static_new)} "
        "WHEN route = 'default' THEN CASE dact WHEN 'deny' THEN CASE WHEN NOT st THEN raw_text END "
        f"WHEN 'tokenize' THEN {K.token('raw_text')} ELSE raw_text END "
        "WHEN route = 'network' THEN m WHEN over_pay THEN raw_text "
        f"ELSE {K.splice('raw_text', 'every', K.placeholder('f.type'))} END"
    )

    def per_finding(expr: str) -> str:
        return (
            f"list_filter(list_transform({K.right_to_left('found')}, lambda g: list_transform([g.f], "
            f"lambda f: {expr})[1]), lambda r: r IS NOT NULL)"
        )

    static_reason = (
        f"'pii.' || CASE {act} WHEN 'pass_through' THEN 'allowed' WHEN 'tokenize' THEN 'tokenized' "
        "ELSE 'redacted' END || ':' || f.type"
    )
    payload_reason = (
        f"CASE WHEN {act} = 'tokenize' THEN 'tokenized:' || f.type "
        f"WHEN coalesce({act}, 'redact') IN ('redact', 'deny') THEN 'redacted:' || f.type END"
    )
    reasons = (
        "CASE WHEN route = 'deny' THEN ['blocked tool: code/exec'] "
        "WHEN route = 'error' THEN CASE WHEN on_error = 'pass' THEN ['evaluation.bypass'] "
        "WHEN on_error = 'best_effort' THEN CASE WHEN len(m_r) > 0 THEN m_r ELSE ['evaluation.best_effort'] END "
        "ELSE ['evaluation.error'] END "
        f"WHEN blocked IS NOT NULL THEN ['pii.blocked:' || {K.bare('blocked')}] "
        "WHEN calm THEN CASE WHEN ract IN ('deny', 'block') THEN ['tool-specific.block'] "
        "WHEN ract = 'tokenize' THEN ['tool-specific.tokenize'] WHEN v = 'budget_exceeded' THEN ['budget_exceeded'] "
        "WHEN v = 'budget_warning' THEN ['budget_warning'] "
        "WHEN ract = 'confirm' AND v = 'budget_ok' THEN ['tool-specific.confirm', 'budget_check_passed'] "
        "WHEN ract = 'confirm' THEN ['tool-specific.confirm'] WHEN v = 'budget_ok' THEN ['budget_check_passed'] END "
        f"WHEN route = 'rule' AND NOT st THEN {per_finding(payload_reason)} "
        f"WHEN route = 'rule' THEN CASE WHEN len(found) > 0 THEN {per_finding(static_reason)} END "
        "WHEN route = 'default' THEN ['default.' || direction || '.' || dact] "
        "WHEN route = 'network' THEN CASE WHEN len(m_r) > 0 THEN list_sort(m_r) END "
        "WHEN over_pay THEN ['budget_exceeded:budget_exceeded'] "
        f"WHEN len(every) > 0 THEN {K.redaction_reasons('every')} ELSE ['strict_fallback.allow'] END"
    )
    rule_id = (
        "CASE WHEN route = 'deny' THEN 'deny-exec' WHEN route = 'error' THEN CASE WHEN on_error = 'best_effort' "
        "THEN 'error-handler-regex' ELSE 'error-handler' END "
        "WHEN calm AND v IN ('budget_exceeded', 'budget_warning') THEN 'budget-check' "
        "WHEN route = 'rule' THEN 'tool-access' WHEN route = 'default' THEN 'defaults' "
        "WHEN route = 'network' THEN 'net-redact-regex' ELSE 'strict-fallback' END"
    )
    return steps.add(
        decision=decision,
        raw_text_out=text_out,
        reasons=reasons,
        rule_id=rule_id,
        status_reason="v",
        projected_total="CASE WHEN v IS NOT NULL THEN projected END",
    )


def pass_steps(mode: str = "auto") -> K.Steps:
    """The chain followed by the annotation."""
    steps = decision_steps(mode)
    noted = "CASE verdict WHEN 'budget_ok' THEN 'budget_check_passed' ELSE verdict END"
    return steps.replace(
        reasons="CASE WHEN guarded AND NOT (reasons IS NULL AND rule_id = 'net-redact-regex') "
        f"THEN coalesce(reasons, []) || [{noted}] ELSE reasons END",
        status_reason="CASE WHEN guarded THEN verdict ELSE status_reason END",
        projected_total="CASE WHEN guarded THEN projected ELSE projected_total END",
    ).add(**{"pass": "CASE direction WHEN 'ingress' THEN 'input' ELSE 'output' END"})


_OUT = (
    f"request_id, decision, raw_text_out, {K.joined('reasons')} AS reasons, rule_id, status_reason, projected_total"
)


def _flat(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "request_id",
        "decision",
        "raw_text_out",
        F.array_join("reasons", "|").alias("reasons"),
        "rule_id",
        F.col("budget_status.reason").alias("status_reason"),
        F.col("budget_info.projected_total").alias("projected_total"),
        *extra,
    )


def _decided(spark, sf, mode: str, **options) -> DataFrame:
    policies = None if mode == "static" else I.policies(spark, sf)
    return decide.decide(_requests(spark, sf), policies, I.STATIC_POLICY_JSON, mode=mode, **options)


@query("decide_static", decision_steps("static").select(_OUT))
def decide_static(spark, sf):
    return _flat(_decided(spark, sf, "static"))


@query("decide_static_without_detector", decision_steps("static", "none").select(_OUT))
def decide_static_without_detector(spark, sf):
    return _flat(_decided(spark, sf, "static", static_rule_detector="none"))


@query("decide_payload", decision_steps("payload").select(_OUT))
def decide_payload(spark, sf):
    return _flat(_decided(spark, sf, "payload"))


@query("decide", decision_steps("auto").select(_OUT))
def decide_auto(spark, sf):
    return _flat(_decided(spark, sf, "auto"))


def passes(spark: SparkSession, sf: str) -> DataFrame:
    """Both passes over all requests, as one decisions table."""
    return decide.check_pass(_requests(spark, sf), I.policies(spark, sf), I.STATIC_POLICY_JSON)


@query("check_pass", pass_steps().select(_OUT + ", pass"))
def check_pass(spark, sf):
    return _flat(passes(spark, sf), "pass")


def _fallback_sql() -> str:
    steps = K.find_all(K.Steps(I.REQUESTS_SQL), "raw_text", P.REGEX_PROFILE, "found")
    steps.add(
        pw=K.beside("raw_text", "found", P.PASSWORD_SPEC), pay=K.beside("raw_text", "found", P.PAYMENT_SPEC)
    )
    steps.add(every=K.first_listed("found || pw", "pay"))
    amount = f"try_cast(regexp_extract(pay[1].text, {K.regex(P.PAYMENT_NUMBER)}, 1) AS DOUBLE)"
    model = f"coalesce(CASE WHEN has_tool THEN metadata['model'] END, '{S.DEFAULT_MODEL}')"
    steps.add(
        over_pay=f"has_budget AND len(pay) > 0 AND (llm_spend + {K.cost('raw_text', model)}) + "
        f"(purchase_spend + coalesce({amount}, 0.0::DOUBLE)) > monthly_limit"
    )
    return steps.select(
        "request_id, CASE WHEN over_pay THEN 'deny' WHEN len(every) > 0 THEN 'transform' ELSE 'allow' END "
        f"AS decision, CASE WHEN over_pay THEN raw_text ELSE {K.splice('raw_text', 'every', K.placeholder('f.type'))} "
        "END AS raw_text_out, CASE WHEN over_pay THEN 'budget_exceeded:budget_exceeded' WHEN len(every) > 0 THEN "
        f"{K.joined(K.redaction_reasons('every'))} ELSE 'strict_fallback.allow' END AS reasons"
    )


@query("strict_fallback", _fallback_sql())
def strict_fallback(spark, sf):
    found = detect.scan_findings(_requests(spark, sf), "raw_text").withColumn("model", F.lit(S.DEFAULT_MODEL))
    out = decide.strict_fallback(found, budgets=True)
    return out.select(
        "request_id", "decision", "raw_text_out", F.array_join("reasons", "|").alias("reasons")
    )


_BLOCKING = {"PII:us_dea": "block", "PII:phone_number": "deny", "PII:email_address": "pass_through"}


def _block_sql() -> str:
    steps = K.find_all(K.Steps(I.REQUESTS_SQL), "raw_text", P.REGEX_PROFILE, "found")
    steps.add(
        blocked="CASE WHEN length(tool) % 2 = 0 THEN list_filter(found, lambda f: f.type IN "
        "('PII:us_dea', 'PII:phone_number'))[1].type END"
    )
    return steps.select(
        "request_id, CASE WHEN blocked IS NOT NULL THEN 'deny' END AS decision, "
        f"CASE WHEN blocked IS NOT NULL THEN 'pii.blocked:' || {K.bare('blocked')} END AS reasons"
    )


@query("block_on_pii", _block_sql())
def block_on_pii(spark, sf):
    table = F.create_map(*[F.lit(x) for kv in _BLOCKING.items() for x in kv])
    allow = F.when(F.length("tool") % 2 == 0, table)
    found = detect.scan_findings(_requests(spark, sf), "raw_text").withColumn("allow", allow)
    hits, rest = decide.block_on_pii(found, "allow")
    none = F.lit(None).cast("string")
    return hits.select(
        "request_id", "decision", F.array_join("reasons", "|").alias("reasons")
    ).unionByName(rest.select("request_id", none.alias("decision"), none.alias("reasons")))


_RULE_ACTIONS = ("'deny'", "'tokenize'", "'confirm'", "null", "'block'", "'redact'")


def _quiet_sql() -> str:
    steps = K.Steps(I.REQUESTS_SQL)
    steps.add(ract=f"coalesce({I.DUCK.pick(_RULE_ACTIONS, 'length(tool) % 6')}, '')")
    budget_sql(steps, f"coalesce(CASE WHEN has_tool THEN metadata['model'] END, '{S.DEFAULT_MODEL}')")
    steps.add(v="CASE WHEN guarded AND ract NOT IN ('deny', 'block', 'tokenize') THEN verdict END")
    return steps.select(
        "request_id, CASE WHEN ract IN ('deny', 'block') THEN 'deny' WHEN ract = 'tokenize' THEN 'transform' "
        "WHEN v = 'budget_exceeded' THEN 'deny' WHEN v = 'budget_warning' OR ract = 'confirm' THEN 'confirm' "
        "ELSE 'allow' END AS decision, "
        f"CASE WHEN ract = 'tokenize' THEN {K.token('raw_text')} ELSE raw_text END AS raw_text_out, "
        "CASE WHEN ract IN ('deny', 'block') THEN 'tool-specific.block' WHEN ract = 'tokenize' THEN "
        "'tool-specific.tokenize' WHEN v IN ('budget_exceeded', 'budget_warning') THEN v "
        "WHEN ract = 'confirm' AND v IS NOT NULL THEN 'tool-specific.confirm|budget_check_passed' "
        "WHEN ract = 'confirm' THEN 'tool-specific.confirm' WHEN v IS NOT NULL THEN 'budget_check_passed' END "
        "AS reasons, CASE WHEN v IN ('budget_exceeded', 'budget_warning') THEN 'budget-check' ELSE 'tool-access' "
        "END AS rule_id, v AS status_reason, CASE WHEN v IS NOT NULL THEN projected END AS projected_total"
    )


@query("no_finding_action", _quiet_sql())
def no_finding_action(spark, sf):
    asked = I.requests(spark, sf).withColumns(
        {
            "model": F.lit(S.DEFAULT_MODEL),
            "rule_action": F.expr(I.SPARK.pick(_RULE_ACTIONS, "length(tool) % 6")),
        }
    )
    return _flat(decide.no_finding_action(asked, "rule_action"))


_ON_ERROR = ("'block'", "'pass'", "'best_effort'", "'other'")


def _errors_sql(mode: str) -> str:
    steps = K.Steps(I.REQUESTS_SQL)
    steps.add(oe=I.DUCK.pick(_ON_ERROR, "ts % 4"))
    K.mask(steps, "raw_text", "m")
    bypass = "'pass_through'" if mode == "static" else "'allow'"
    bypass_text = "NULL" if mode == "static" else "raw_text"
    return steps.select(
        f"request_id, CASE oe WHEN 'pass' THEN {bypass} WHEN 'best_effort' THEN 'transform' ELSE 'deny' END "
        f"AS decision, CASE oe WHEN 'pass' THEN {bypass_text} WHEN 'best_effort' THEN m ELSE raw_text END "
        "AS raw_text_out, CASE WHEN oe = 'pass' THEN 'evaluation.bypass' WHEN oe = 'best_effort' AND len(m_r) > 0 "
        f"THEN {K.joined('m_r')} WHEN oe = 'best_effort' THEN 'evaluation.best_effort' ELSE 'evaluation.error' END "
        "AS reasons, CASE WHEN oe = 'best_effort' THEN 'error-handler-regex' ELSE 'error-handler' END AS rule_id"
    )


def _errors(spark, sf, mode: str) -> DataFrame:
    failed = _requests(spark, sf).withColumn("on_error", F.expr(I.SPARK.pick(_ON_ERROR, "ts % 4")))
    out = decide.resolve_errors(failed, mode=mode)
    return out.select(
        "request_id", "decision", "raw_text_out", F.array_join("reasons", "|").alias("reasons"), "rule_id"
    )


@query("resolve_errors_static", _errors_sql("static"))
def resolve_errors_static(spark, sf):
    return _errors(spark, sf, "static")


@query("resolve_errors_payload", _errors_sql("payload"))
def resolve_errors_payload(spark, sf):
    return _errors(spark, sf, "payload")


# -------------------------------------------------------------------------------------- documents
def _document_steps() -> K.Steps:
    steps = K.Steps(I.DOCUMENT_REQUESTS_SQL)
    K.find_all(steps, "raw_text", P.REGEX_PROFILE, "found")
    steps.add(
        pw=K.beside("raw_text", "found", P.PASSWORD_SPEC), pay=K.beside("raw_text", "found", P.PAYMENT_SPEC)
    )
    steps.add(every=K.first_listed("found || pw", "pay"), net=_NET)
    K.mask(steps, "raw_text", "m")
    return steps.add(
        decision="CASE WHEN net OR len(every) > 0 THEN 'transform' ELSE 'allow' END",
        raw_text_out=f"CASE WHEN net THEN m ELSE {K.splice('raw_text', 'every', K.placeholder('f.type'))} END",
        reasons="CASE WHEN net THEN CASE WHEN len(m_r) > 0 THEN list_sort(m_r) END "
        f"WHEN len(every) > 0 THEN {K.redaction_reasons('every')} ELSE ['strict_fallback.allow'] END",
        rule_id="CASE WHEN net THEN 'net-redact-regex' ELSE 'strict-fallback' END",
    )


def document_decisions(spark: SparkSession, sf: str) -> DataFrame:
    asked = spread(I.document_requests(spark, sf), "request_id")
    return decide.decide(asked, None, I.STATIC_POLICY_JSON, mode="static")


@query(
    "decide_documents",
    _document_steps().select(
        f"request_id, decision, raw_text_out, {K.joined('reasons')} AS reasons, rule_id"
    ),
)
def decide_documents(spark, sf):
    return document_decisions(spark, sf).select(
        "request_id", "decision", "raw_text_out", F.array_join("reasons", "|").alias("reasons"), "rule_id"
    )


# -------------------------------------------------------------------------------------- analytics
@query(
    "decision_counts",
    pass_steps().select("pass, user_id, tool, decision, rule_id, count(*) AS n", "GROUP BY ALL"),
)
def decision_counts(spark, sf):
    return analytics.decision_counts(passes(spark, sf))


@query(
    "evaluation_counts",
    decision_steps("auto").select("tool, direction, rule_id, count(*) AS n", "GROUP BY ALL"),
)
def evaluation_counts(spark, sf):
    return analytics.evaluation_counts(_decided(spark, sf, "auto"))


def _actions_sql() -> str:
    steps = pass_steps()
    steps.raw("SELECT unnest(reasons) AS r FROM {prev}")
    code = "'^(?:pii\\.)?(allowed|tokenized|redacted|blocked):(?:PII:)?(.+)$'"
    return steps.select(
        f"regexp_extract(r, {code}, 2) AS pii_type, regexp_extract(r, {code}, 1) AS action, count(*) AS n",
        f"WHERE regexp_matches(r, {code}) GROUP BY ALL",
    )


@query("pii_action_counts", _actions_sql())
def pii_action_counts(spark, sf):
    return analytics.pii_action_counts(passes(spark, sf))


