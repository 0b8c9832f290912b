"""Decisions: the precedence chain as one projection over requests joined to their policy.

The cheap routing columns are computed first; text is scanned only on the routes that need it,
because each detection sits in the branch of its route. There is no shuffle apart from the join to
the policies, which is broadcast when their number allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions import money as M
from quillguard.functions import patterns as P
from quillguard.functions import text as X
from quillguard.functions.once import compute_once
from quillguard.functions.sizing import broadcast_if_small
from quillguard.functions.spans import (
    NO_FINDINGS,
    Sql,
    find_all,
    find_beside,
    find_ssn,
    joined_findings,
    keep,
    lit,
    name,
)
from quillguard.operators import rules as R
from quillguard.operators.detect import false_positive

_FINAL_ACTIONS = "('deny', 'pass_through', 'tokenize')"
_NO_LIST = X.NO_REASONS


def _texts(values: tuple[str, ...]) -> Sql:
    return f"array({', '.join(lit(v) for v in values)})"


def network_hit(scope: Sql, tool: Sql, scopes: Sql, tools: Sql) -> Sql:
    in_scope = f"(coalesce({scope}, '') <> '' AND exists({scopes}, p -> startswith({scope}, p)))"
    return f"({in_scope} OR exists({tools}, p -> startswith(coalesce({tool}, ''), p)))"


def default_columns(
    action: Sql, text: Sql, direction: Sql, deny_text: Sql, salt: str = X.DEFAULT_SALT
) -> dict[str, Sql]:
    """Decision columns of the direction's default action; null decision: go on to the next level."""
    return {
        "decision": f"CASE {action} WHEN 'deny' THEN 'deny' WHEN 'pass_through' THEN 'allow' "
        "WHEN 'tokenize' THEN 'transform' END",
        "raw_text_out": f"CASE {action} WHEN 'deny' THEN {deny_text} WHEN 'pass_through' THEN {text} "
        f"WHEN 'tokenize' THEN {X.token(text, salt)} END",
        "reasons": f"CASE WHEN {action} IN {_FINAL_ACTIONS} "
        f"THEN array(concat('default.', {direction}, '.', {action})) END",
        "rule_id": f"CASE WHEN {action} IN {_FINAL_ACTIONS} THEN 'defaults' END",
    }


def error_columns(on_error: Sql, text: Sql, static: Sql, masked: Sql) -> dict[str, Sql]:
    """Decision columns of a row whose evaluation failed; ``masked`` is its masked text."""
    return {
        "decision": f"CASE {on_error} WHEN 'pass' THEN CASE WHEN {static} THEN 'pass_through' ELSE 'allow' END "
        "WHEN 'best_effort' THEN 'transform' ELSE 'deny' END",
        "raw_text_out": f"CASE {on_error} WHEN 'pass' THEN CASE WHEN NOT {static} THEN {text} END "
        f"WHEN 'best_effort' THEN {masked}.text ELSE {text} END",
        "reasons": f"CASE {on_error} WHEN 'pass' THEN array('evaluation.bypass') WHEN 'best_effort' THEN "
        f"CASE WHEN size({masked}.reasons) > 0 THEN {masked}.reasons ELSE array('evaluation.best_effort') END "
        "ELSE array('evaluation.error') END",
        "rule_id": f"CASE WHEN {on_error} = 'best_effort' THEN 'error-handler-regex' ELSE 'error-handler' END",
    }


def _expressions(columns: dict[str, Sql]) -> dict[str, Column]:
    return {c: F.expr(e) for c, e in columns.items()}


def apply_default_action(
    requests: DataFrame, defaults: DataFrame, key: str = "policy_key", mode: str = "payload"
) -> tuple[DataFrame, DataFrame]:
    """Decisions of requests whose direction has a final default action, and the rest."""
    looked_up = requests.join(broadcast_if_small(defaults), [key, "direction"], "left").fillna(
        {"action": S.DEFAULT_ACTION}
    )
    deny_text = "raw_text" if mode == "payload" else "NULL"
    decided = looked_up.filter(f"action IN {_FINAL_ACTIONS}").withColumns(
        _expressions(default_columns("action", "raw_text", "direction", deny_text))
    )
    return decided.drop("action"), looked_up.filter(f"action NOT IN {_FINAL_ACTIONS}").drop("action")


def network_redact(
    requests: DataFrame,
    scopes: tuple[str, ...] = S.DEFAULT_NETWORK_SCOPES,
    tools: tuple[str, ...] = S.DEFAULT_NETWORK_TOOLS,
) -> tuple[DataFrame, DataFrame]:
    """Masked decisions of requests with a network scope or tool, and the rest."""
    hit = network_hit("scope", "tool", _texts(scopes), _texts(tools))
    decided = (
        compute_once(requests.filter(hit), {"_m": X.mask_text("raw_text")})
        .withColumns(
            {
                "decision": F.lit("transform"),
                "raw_text_out": F.col("_m.text"),
                "reasons": F.when(F.size("_m.reasons") > 0, F.array_sort("_m.reasons")),
                "rule_id": F.lit("net-redact-regex"),
            }
        )
        .drop("_m")
    )
    return decided, requests.filter(f"NOT {hit}")


def resolve_errors(failed: DataFrame, on_error_col: str = "on_error", mode: str = "payload") -> DataFrame:
    on_error = name(on_error_col)
    best = f"CASE WHEN {on_error} = 'best_effort' THEN {X.mask_text('raw_text')} END"
    static = "true" if mode == "static" else "false"
    columns = error_columns(on_error, "raw_text", static, "_m")
    return failed.withColumn("_m", F.expr(best)).withColumns(_expressions(columns)).drop("_m")


def fallback_over_budget(policy_model: Sql) -> Sql:
    """A payment is named in the text, a budget is known, and the first amount does not fit it.
    Works on ``_pay``, ``tool_config`` and ``budget_context``."""
    model = f"coalesce({_METADATA_MODEL}, {policy_model})"
    over = M.exceeds_limit(
        "budget_context", M.request_cost("raw_text", model), M.first_payment_amount("_pay")
    )
    return f"CASE WHEN size(_pay) > 0 AND budget_context IS NOT NULL THEN {over} ELSE false END"


_METADATA_MODEL = "try_element_at(tool_config.metadata, 'model')"


def strict_fallback(
    requests: DataFrame, findings_col: str = "findings", budgets: bool = False, overlap: str = "first"
) -> DataFrame:
    """Redact everything found, password phrases and payment amounts included; allow the rest.

    With ``budgets`` the frame carries ``budget_context``, ``tool_config`` and ``model``, and a text
    that names a payment the budget cannot bear is denied. Of a password phrase and a payment that overlap
    the password is redacted; ``overlap="raw"`` splices both with their original offsets, as specified.
    """
    found = name(findings_col)
    df = compute_once(
        requests,
        {
            "_pw": find_beside("raw_text", found, P.PASSWORD_SPEC),
            "_pay": find_beside("raw_text", found, P.PAYMENT_SPEC),
        },
    )
    df = df.withColumns(
        _expressions(
            {
                "_every": joined_findings(overlap, found, "_pw", "_pay"),
                "_over": fallback_over_budget("model") if budgets else "false",
            }
        )
    )
    return df.withColumns(
        _expressions(
            {
                "decision": "CASE WHEN _over THEN 'deny' WHEN size(_every) > 0 THEN 'transform' ELSE 'allow' END",
                "raw_text_out": f"CASE WHEN _over THEN raw_text ELSE {X.redact_placeholders('raw_text', '_every')} END",
                "reasons": "CASE WHEN _over THEN array('budget_exceeded:budget_exceeded') WHEN size(_every) > 0 "
                f"THEN {X.redaction_reasons('_every')} ELSE array('strict_fallback.allow') END",
                "rule_id": "'strict-fallback'",
            }
        )
    ).drop("_pw", "_pay", "_every", "_over")


def first_blocked(findings: Sql, allow_pii: Sql) -> Sql:
    blocked = keep(
        findings, lambda f: f"coalesce(try_element_at({allow_pii}, {f}.type) IN ('block', 'deny'), false)"
    )
    return X.bare_type(f"get({blocked}, 0).type")


def block_on_pii(
    requests: DataFrame, allow_col: str, findings_col: str = "findings"
) -> tuple[DataFrame, DataFrame]:
    """Split off requests with a finding whose type the rule blocks; the first one is named."""
    df = requests.withColumn("_blocked", F.expr(first_blocked(name(findings_col), name(allow_col))))
    hits = df.filter("_blocked IS NOT NULL").withColumns(
        _expressions(
            {
                "decision": "'deny'",
                "raw_text_out": "raw_text",
                "reasons": "array(concat('pii.blocked:', _blocked))",
                "rule_id": "'tool-access'",
            }
        )
    )
    return hits.drop("_blocked"), df.filter("_blocked IS NULL").drop("_blocked")


def budget_columns(df: DataFrame, model: Sql, where: Sql = "true") -> DataFrame:
    """Add ``_check`` (status and info), null where user, tool settings or budget are unknown,
    where neither a purchase nor a significant cost calls for a check, or where not ``where``."""
    known = f"(coalesce(user_id, '') <> '' AND tool_config IS NOT NULL AND budget_context IS NOT NULL AND {where})"
    out = df.withColumns(
        _expressions(
            {
                "_cost": f"CASE WHEN {known} THEN {M.request_cost('raw_text', model)} END",
                "_purchase": f"CASE WHEN {known} THEN {M.purchase_amount('tool_config.metadata')} END",
            }
        )
    )
    check = M.budget_check("budget_context", "_cost", "_purchase")
    guarded = f"CASE WHEN _cost IS NOT NULL AND {M.worth_checking('_cost', '_purchase')} THEN {check} END"
    return out.withColumn("_check", F.expr(guarded)).drop("_cost", "_purchase")


def no_finding_columns(text: Sql, action: Sql, check: Sql, salt: str = X.DEFAULT_SALT) -> dict[str, Sql]:
    """Decision columns of a matched rule when nothing was found: the rule's action, under the
    budget gate. Refusing and tokenising actions need no budget."""
    act = f"coalesce({action}, '')"
    fixed = f"{act} IN ('deny', 'block', 'tokenize')"
    verdict = f"CASE WHEN {fixed} THEN NULL ELSE {check}.status.reason END"
    return {
        "decision": f"CASE WHEN {act} IN ('deny', 'block') THEN 'deny' WHEN {act} = 'tokenize' THEN 'transform' "
        f"WHEN {verdict} = 'budget_exceeded' THEN 'deny' "
        f"WHEN {verdict} = 'budget_warning' OR {act} = 'confirm' THEN 'confirm' ELSE 'allow' END",
        "raw_text_out": f"CASE WHEN {act} = 'tokenize' THEN {X.token(text, salt)} ELSE {text} END",
        "reasons": f"CASE WHEN {act} IN ('deny', 'block') THEN array('tool-specific.block') "
        f"WHEN {act} = 'tokenize' THEN array('tool-specific.tokenize') "
        f"WHEN {verdict} IN ('budget_exceeded', 'budget_warning') THEN array({verdict}) "
        f"WHEN {act} = 'confirm' AND {verdict} IS NOT NULL THEN array('tool-specific.confirm', 'budget_check_passed') "
        f"WHEN {act} = 'confirm' THEN array('tool-specific.confirm') "
        f"WHEN {verdict} IS NOT NULL THEN array('budget_check_passed') END",
        "rule_id": f"CASE WHEN {verdict} IN ('budget_exceeded', 'budget_warning') THEN 'budget-check' "
        "ELSE 'tool-access' END",
        "budget_status": f"CASE WHEN {fixed} THEN NULL ELSE {check}.status END",
        "budget_info": f"CASE WHEN {fixed} THEN NULL ELSE {check}.info END",
    }


def no_finding_action(requests: DataFrame, action_col: str, model_col: str = "model") -> DataFrame:
    df = budget_columns(requests, f"coalesce({_METADATA_MODEL}, {name(model_col)})")
    columns = no_finding_columns("raw_text", name(action_col), "_check")
    return df.withColumns(_expressions(columns)).drop("_check")


def budget_gate(decisions: DataFrame) -> DataFrame:
    """Overlay: deny what exceeds the budget, ask for confirmation above the warning level. Rows
    need ``_check`` from ``budget_columns``."""
    acts = "coalesce(_check.status.reason IN ('budget_exceeded', 'budget_warning'), false)"
    overlay = {
        "decision": "CASE _check.status.reason WHEN 'budget_exceeded' THEN 'deny' ELSE 'confirm' END",
        "reasons": "array(_check.status.reason)",
        "rule_id": "'budget-check'",
        "raw_text_out": "raw_text",
        "budget_status": "_check.status",
        "budget_info": "_check.info",
    }
    return decisions.withColumns(
        {c: F.expr(f"CASE WHEN {acts} THEN {e} ELSE {c} END") for c, e in overlay.items()}
    )


def annotate_budget(decisions: DataFrame) -> DataFrame:
    """Add status and info and append the budget's reason. A decision whose reasons are explicitly
    none (network redaction without a hit) gets status and info only."""
    known = "_check IS NOT NULL"
    explicit_none = "(reasons IS NULL AND startswith(rule_id, 'net-redact'))"
    noted = "CASE _check.status.reason WHEN 'budget_ok' THEN 'budget_check_passed' ELSE _check.status.reason END"
    return decisions.withColumns(
        _expressions(
            {
                "budget_status": f"CASE WHEN {known} THEN _check.status ELSE budget_status END",
                "budget_info": f"CASE WHEN {known} THEN _check.info ELSE budget_info END",
                "reasons": f"CASE WHEN {known} AND NOT {explicit_none} "
                f"THEN concat(coalesce(reasons, {_NO_LIST}), array({noted})) ELSE reasons END",
            }
        )
    )


# -------------------------------------------------------------------------------------------------
# The whole chain
# -------------------------------------------------------------------------------------------------
def _with_optional_columns(df: DataFrame) -> DataFrame:
    wanted = {
        "scope": "string",
        "user_id": "string",
        "tool_config": S.TOOL_CONFIG_DDL,
        "budget_context": S.BUDGET_CONTEXT_DDL,
    }
    missing = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def _route() -> Sql:
    """Which level of the chain decides the row. Levels in order: deny list, tool rule, default
    action, network, fallback; a malformed policy fails where it would first be read."""
    deny = f"array_contains(CASE WHEN _static THEN {_texts(S.DEFAULT_DENY_TOOLS)} ELSE _policy.deny_tools END, tool)"
    net = network_hit(
        "CASE WHEN _static THEN scope ELSE _policy.scope END",
        "CASE WHEN _static THEN tool ELSE _policy.tool END",
        f"CASE WHEN _static THEN {_texts(S.DEFAULT_NETWORK_SCOPES)} ELSE _policy.network_scopes END",
        f"CASE WHEN _static THEN {_texts(S.DEFAULT_NETWORK_TOOLS)} ELSE _policy.network_tools END",
    )
    return (
        f"CASE WHEN {deny} THEN 'deny' WHEN _policy.bad_rules THEN 'error' WHEN _rule IS NOT NULL THEN 'rule' "
        f"WHEN _policy.bad_defaults THEN 'error' WHEN _action IN {_FINAL_ACTIONS} THEN 'default' "
        f"WHEN {net} THEN 'network' ELSE 'fallback' END"
    )


def decide(
    requests: DataFrame,
    policies: DataFrame | None = None,
    static_policy: str = "{}",
    mode: str = "auto",
    static_rule_detector: str = "specific_first",
    static_on_error: str = "block",
    key: str = "policy_key",
    salt: str = X.DEFAULT_SALT,
    overlap: str = "first",
) -> DataFrame:
    """Decide every request.

    ``requests`` needs ``tool, raw_text, direction`` and may carry ``scope, user_id, tool_config,
    budget_context`` and the policy key. ``policies`` has ``(key, doc, form)``. ``mode``:
    ``static`` judges all rows by ``static_policy`` (JSON text of a policy file), ``payload`` all
    rows by their own policy, ``auto`` by their own policy where there is one. ``overlap`` is that of
    ``strict_fallback``.

    The result has the input columns and ``decision, raw_text_out, reasons, rule_id, budget_status,
    budget_info``, and ``_check``, the budget check ``annotate_budget`` uses.
    """
    df = _with_optional_columns(requests)
    inputs = df.columns
    bare = '{"version":"v1"}'
    in_force = bare if static_policy.strip() in ("", "{}", "null") else static_policy
    file_policy = R.policy_struct(F.lit(in_force), F.lit(True))
    if mode == "static" or policies is None:
        df = df.withColumns({"_static": F.lit(True), "_policy": file_policy})
    else:
        table = R.load_policies(policies).select(key, F.col("policy").alias("_own"))
        df = df.join(broadcast_if_small(table), key, "left")
        if mode == "payload":
            fallback, static = R.policy_struct(F.lit(bare)), F.lit(False)
        else:
            fallback, static = file_policy, F.col("_own").isNull()
        df = df.withColumns({"_static": static, "_policy": F.coalesce("_own", fallback)}).drop("_own")
    df = df.withColumns(
        {
            "_rule": F.when(
                F.col("_static"), R.exact_rule(F.col("_policy.rules"), F.col("tool"), F.col("direction"), False)
            ).otherwise(R.payload_rule(F.col("_policy.rules"), F.col("tool"), F.col("direction"))),
            "_action": R.default_action(F.col("_policy"), F.col("direction")),
            "_on_error": F.when(F.col("_static"), F.lit(static_on_error)).otherwise(F.col("_policy.on_error")),
        }
    ).withColumn("_route", F.expr(_route()))
    return _decide_routed(df, inputs, static_rule_detector, salt, overlap)


def _decide_routed(df: DataFrame, inputs: list[str], static_rule_detector: str, salt: str, overlap: str) -> DataFrame:
    own_rule, file_rule, fallback = (
        "(NOT _static AND _route = 'rule')",
        "(_static AND _route = 'rule')",
        "_route = 'fallback'",
    )
    # Detection, each in the branch of the routes that need it.
    specific = NO_FINDINGS
    if static_rule_detector != "none":
        specific = keep(
            find_all("raw_text", P.PROFILES[static_rule_detector]),
            lambda f: f"NOT {false_positive(f + '.type', lit(''), 'raw_text')}",
        )
    masked_route = "(_route = 'network' OR (_route = 'error' AND _on_error = 'best_effort'))"
    df = df.withColumns(
        _expressions(
            {
                "_found": f"CASE WHEN {own_rule} OR {fallback} THEN {find_all('raw_text', P.REGEX_PROFILE)} "
                f"WHEN {file_rule} THEN {specific} ELSE {NO_FINDINGS} END",
                "_m": f"CASE WHEN {masked_route} THEN {X.mask_text('raw_text')} END",
            }
        )
    )
    df = compute_once(
        df,
        {
            "_found": f"CASE WHEN {own_rule} THEN {find_ssn('raw_text', '_found')} ELSE _found END",
            "_pw": f"CASE WHEN {fallback} THEN {find_beside('raw_text', '_found', P.PASSWORD_SPEC)} "
            f"ELSE {NO_FINDINGS} END",
            "_pay": f"CASE WHEN {fallback} THEN {find_beside('raw_text', '_found', P.PAYMENT_SPEC)} "
            f"ELSE {NO_FINDINGS} END",
            "_m": "_m",
        },
    )
    df = budget_columns(df, f"coalesce({_METADATA_MODEL}, _policy.model)", "NOT _static")
    over = f"CASE WHEN NOT _static AND {fallback} THEN {fallback_over_budget('_policy.model')} ELSE false END"
    df = df.withColumns(
        _expressions(
            {
                "_every": joined_findings(overlap, "_found", "_pw", "_pay"),
                "_over": over,
                "_blocked": f"CASE WHEN {own_rule} THEN {first_blocked('_found', '_rule.allow_pii')} END",
                "_calm": f"{own_rule} AND size(_found) = 0",
            }
        )
    )
    redaction = "mask" if static_rule_detector in ("none", "regex") else "placeholder"
    static_text, static_reasons = X.transform_static("raw_text", "_found", "_rule.allow_pii", salt, redaction)
    payload_text, payload_reasons = X.transform_payload("raw_text", "_found", "_rule.allow_pii", salt)
    quiet = no_finding_columns("raw_text", "_rule.action", "_check", salt)
    default = default_columns(
        "_action", "raw_text", "direction", "CASE WHEN NOT _static THEN raw_text END", salt
    )
    error = error_columns("_on_error", "raw_text", "_static", "_m")
    some = "size(_every) > 0"
    decided = {
        "decision": f"CASE WHEN _route = 'deny' THEN 'deny' WHEN _route = 'error' THEN {error['decision']} "
        f"WHEN _blocked IS NOT NULL THEN 'deny' WHEN _calm THEN {quiet['decision']} "
        f"WHEN _route = 'default' THEN {default['decision']} WHEN _route = 'network' THEN 'transform' "
        f"WHEN _over THEN 'deny' WHEN {some} THEN 'transform' ELSE 'allow' END",
        "raw_text_out": "CASE WHEN _route = 'deny' THEN CASE WHEN NOT _static THEN raw_text END "
        f"WHEN _route = 'error' THEN {error['raw_text_out']} WHEN _blocked IS NOT NULL THEN raw_text "
        f"WHEN _calm THEN {quiet['raw_text_out']} WHEN {own_rule} THEN {payload_text} "
        f"WHEN {file_rule} THEN {static_text} WHEN _route = 'default' THEN {default['raw_text_out']} "
        "WHEN _route = 'network' THEN _m.text WHEN _over THEN raw_text "
        f"ELSE {X.redact_placeholders('raw_text', '_every')} END",
        "reasons": "CASE WHEN _route = 'deny' THEN array('blocked tool: code/exec') "
        f"WHEN _route = 'error' THEN {error['reasons']} "
        "WHEN _blocked IS NOT NULL THEN array(concat('pii.blocked:', _blocked)) "
        f"WHEN _calm THEN {quiet['reasons']} WHEN {own_rule} THEN {payload_reasons} "
        f"WHEN {file_rule} THEN CASE WHEN {some} THEN {static_reasons} END "
        f"WHEN _route = 'default' THEN {default['reasons']} "
        "WHEN _route = 'network' THEN CASE WHEN size(_m.reasons) > 0 THEN array_sort(_m.reasons) END "
        f"WHEN _over THEN array('budget_exceeded:budget_exceeded') WHEN {some} "
        f"THEN {X.redaction_reasons('_every')} ELSE array('strict_fallback.allow') END",
        "rule_id": f"CASE WHEN _route = 'deny' THEN 'deny-exec' WHEN _route = 'error' THEN {error['rule_id']} "
        f"WHEN _calm THEN {quiet['rule_id']} WHEN _route = 'rule' THEN 'tool-access' "
        "WHEN _route = 'default' THEN 'defaults' WHEN _route = 'network' THEN 'net-redact-regex' "
        "ELSE 'strict-fallback' END",
        "budget_status": f"CASE WHEN _calm THEN {quiet['budget_status']} END",
        "budget_info": f"CASE WHEN _calm THEN {quiet['budget_info']} END",
    }
    return df.select(*inputs, *[F.expr(e).alias(c) for c, e in decided.items()], "_check")


PASS_NAMES = {"ingress": "input", "egress": "output"}


def check_pass(
    requests: DataFrame,
    policies: DataFrame | None = None,
    static_policy: str = "{}",
    **options,
) -> DataFrame:
    """Decide inputs (``ingress``) and tool outputs (``egress``) in one job, then add the budget
    annotation that follows every evaluation. The reason of a budget that was already noted by the
    rule's own gate appears twice, as specified."""
    decided = decide(requests, policies, static_policy, **options)
    cases = " ".join(f"WHEN {lit(d)} THEN {lit(p)}" for d, p in PASS_NAMES.items())
    return (
        annotate_budget(decided).withColumn("pass", F.expr(f"CASE direction {cases} END")).drop("_check")
    )
