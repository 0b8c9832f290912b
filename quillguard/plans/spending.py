"""Queries over costs, ledgers, budgets, throttling and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions import money as M
from quillguard.functions import patterns as P
from quillguard.functions.sizing import spread
from quillguard.operators import budget, decide, detect, throttle
from quillguard.plans import inputs as I
from quillguard.plans import sqlkit as K
from quillguard.plans.catalog import query
from quillguard.plans.decisions import budget_sql, pass_steps, passes

MONEY = "DECIMAL(28,10)"


# ------------------------------------------------------------------------------------------ cost
_MODELS = tuple(f"'{m}'" for m in (*M.MODEL_PRICES, "some-other-model"))


def _model(d: I.Dialect, key: str) -> str:
    return d.pick((*_MODELS, "null"), f"{key} % {len(_MODELS) + 1}")


@query(
    "estimate_cost",
    f"SELECT doc_id, coalesce(model, '{S.DEFAULT_MODEL}') AS model, {K.tokens('text')} AS tokens, "
    f"{K.cost('text', f'''coalesce(model, '{S.DEFAULT_MODEL}')''')} AS est_cost "
    f"FROM (SELECT *, {_model(I.DUCK, 'doc_id')} AS model FROM documents)",
)
def estimate_cost(spark, sf):
    docs = spread(I.table(spark, sf, "documents"), "doc_id").withColumn(
        "model", F.expr(_model(I.SPARK, "doc_id"))
    )
    out = budget.estimate_cost(docs, text_col="text")
    return out.select(
        "doc_id", F.coalesce("model", F.lit(S.DEFAULT_MODEL)).alias("model"), "tokens", "est_cost"
    )


# Prices of one's own: one model per brand of part, and the fallback model.
_PRICES = "SELECT p_brand AS model, min(p_size) / 1e6 AS price_in, max(p_size) / 1e6 AS price_out FROM {} GROUP BY p_brand"
_OWN_MODEL = "case when {0} % 3 = 0 then 'no-such-model' else concat('Brand#', {0} % 5 + 1, {0} % 7 + 1) end"


def _own_prices_sql() -> str:
    half = f"floor({K.tokens('text')} * 0.5::DOUBLE)::BIGINT"
    cost = f"{half} * coalesce(price_in, 0.002::DOUBLE) + {half} * coalesce(price_out, 0.004::DOUBLE)"
    prices = _PRICES.format("part").replace("1e6", "1e6::DOUBLE")
    return (
        f"SELECT doc_id, d.model, {cost} AS est_cost FROM (SELECT *, {_OWN_MODEL.format('doc_id')} AS model FROM documents) d "
        f"LEFT JOIN ({prices}) p ON d.model = p.model"
    )


@query("estimate_cost_own_prices", _own_prices_sql())
def estimate_cost_own_prices(spark, sf):
    parts = I.table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(
        (F.min("p_size") / F.lit(1e6)).alias("price_in"), (F.max("p_size") / F.lit(1e6)).alias("price_out")
    )
    fallback = spark.range(1).select(F.lit(M.FALLBACK_MODEL).alias("model"), F.lit(0.002).alias("price_in"), F.lit(0.004).alias("price_out"))
    docs = I.table(spark, sf, "documents").withColumn("model", F.expr(_OWN_MODEL.format("doc_id")))
    return budget.estimate_cost(docs, parts.union(fallback), text_col="text").select("doc_id", "model", "est_cost")


_PURCHASE_SQL = ", ".join(f"try_cast(metadata['{k}'] AS DOUBLE)" for k in M.PURCHASE_FIELDS)


@query(
    "purchase_amount",
    f"SELECT request_id, CASE WHEN has_tool THEN coalesce({_PURCHASE_SQL}) END AS est_purchase "
    f"FROM ({I.REQUESTS_SQL})",
)
def purchase_amount(spark, sf):
    asked = I.requests(spark, sf).select("request_id", F.col("tool_config.metadata").alias("metadata"))
    return budget.purchase_amount(asked).select("request_id", "est_purchase")


def _payment_sql() -> str:
    steps = K.find_all(K.Steps(I.REQUESTS_SQL), "raw_text", P.REGEX_PROFILE, "found")
    steps.add(pay=K.beside("raw_text", "found", P.PAYMENT_SPEC))
    return steps.select(
        f"request_id, try_cast(regexp_extract(pay[1].text, {K.regex(P.PAYMENT_NUMBER)}, 1) AS DOUBLE) "
        "AS est_purchase"
    )


@query("payment_amount_from_text", _payment_sql())
def payment_amount_from_text(spark, sf):
    found = detect.scan_findings(spread(I.requests(spark, sf), "request_id"), "raw_text")
    found = detect.scan_password_payment(found, "raw_text")
    return budget.payment_amount_from_text(found).select("request_id", "est_purchase")


def _costed(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with estimated cost and purchase by the model of the tool's metadata."""
    asked = I.requests(spark, sf).withColumns(
        {
            "model": F.expr("try_element_at(tool_config.metadata, 'model')"),
            "metadata": F.col("tool_config.metadata"),
        }
    )
    return budget.purchase_amount(budget.estimate_cost(asked))


def _costed_sql() -> K.Steps:
    return budget_sql(
        K.Steps(I.REQUESTS_SQL), f"coalesce(CASE WHEN has_tool THEN metadata['model'] END, '{S.DEFAULT_MODEL}')"
    )


@query(
    "check_budget_context",
    _costed_sql().select(
        "request_id, cost AS est_cost, purchase AS est_purchase, "
        "CASE WHEN has_budget THEN projected <= monthly_limit END AS allowed, "
        "CASE WHEN has_budget THEN verdict END AS reason, CASE WHEN has_budget THEN projected END AS projected_total, "
        "CASE WHEN has_budget THEN pct END AS percent_used, CASE WHEN has_budget THEN CASE WHEN monthly_limit > 0 "
        "THEN (llm_spend + purchase_spend) / monthly_limit * 100.0::DOUBLE ELSE 0.0::DOUBLE END END AS current_percent, "
        "CASE WHEN has_budget THEN monthly_limit - (llm_spend + purchase_spend) END AS remaining"
    ),
)
def check_budget_context(spark, sf):
    out = budget.check_budget_context(_costed(spark, sf))
    return out.select(
        "request_id",
        "est_cost",
        "est_purchase",
        F.col("budget_status.allowed").alias("allowed"),
        F.col("budget_status.reason").alias("reason"),
        F.col("budget_info.projected_total").alias("projected_total"),
        F.col("budget_info.percent_used").alias("percent_used"),
        F.col("budget_status.percent_used").alias("current_percent"),
        F.col("budget_status.remaining").alias("remaining"),
    )


def _plain_decisions(spark: SparkSession, sf: str) -> DataFrame:
    asked = decide.budget_columns(
        I.requests(spark, sf), f"coalesce(try_element_at(tool_config.metadata, 'model'), '{S.DEFAULT_MODEL}')"
    )
    return asked.withColumns(
        {
            "decision": F.lit("allow"),
            "raw_text_out": F.col("raw_text"),
            "reasons": F.array(F.lit("seen")),
            "rule_id": F.lit("tool-access"),
            "budget_status": F.lit(None).cast(S.BUDGET_STATUS_DDL),
            "budget_info": F.lit(None).cast(S.BUDGET_INFO_DDL),
        }
    )


def _judged(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id",
        "decision",
        F.array_join("reasons", "|").alias("reasons"),
        "rule_id",
        F.col("budget_status.reason").alias("status_reason"),
        F.col("budget_info.projected_total").alias("projected_total"),
    )


@query(
    "budget_gate",
    _costed_sql()
    .add(v="CASE WHEN guarded AND verdict <> 'budget_ok' THEN verdict END")
    .select(
        "request_id, CASE v WHEN 'budget_exceeded' THEN 'deny' WHEN 'budget_warning' THEN 'confirm' ELSE 'allow' END "
        "AS decision, coalesce(v, 'seen') AS reasons, CASE WHEN v IS NULL THEN 'tool-access' ELSE 'budget-check' END "
        "AS rule_id, v AS status_reason, CASE WHEN v IS NOT NULL THEN projected END AS projected_total"
    ),
)
def budget_gate(spark, sf):
    return _judged(decide.budget_gate(_plain_decisions(spark, sf)))


@query(
    "annotate_budget",
    _costed_sql().select(
        "request_id, 'allow' AS decision, CASE WHEN NOT guarded THEN 'seen' WHEN verdict = 'budget_ok' "
        "THEN 'seen|budget_check_passed' ELSE 'seen|' || verdict END AS reasons, 'tool-access' AS rule_id, "
        "CASE WHEN guarded THEN verdict END AS status_reason, CASE WHEN guarded THEN projected END AS projected_total"
    ),
)
def annotate_budget(spark, sf):
    return _judged(decide.annotate_budget(_plain_decisions(spark, sf)))


# ---------------------------------------------------------------------------------------- ledger
def _transactions_sql() -> str:
    steps = pass_steps()
    steps.add(
        bill_model=f"coalesce(CASE WHEN has_tool THEN metadata['model'] END, '{S.DEFAULT_MODEL}')"
    )
    steps.add(bill=K.cost("raw_text", "bill_model"))
    steps.raw(
        "SELECT *, unnest([{{'k': 'llm', 'a': bill, 'd': 'LLM usage for ' || tool}}, "
        "{{'k': 'purchase', 'a': purchase, 'd': 'Purchase via ' || tool}}]) AS e FROM {prev} "
        "WHERE decision IN ('allow', 'transform', 'confirm')"
    )
    return steps.select(
        "user_id, e.k AS transaction_type, e.a AS amount, e.d AS description, tool, request_id AS correlation_id, "
        "ts::BIGINT AS ts",
        "WHERE e.a > 0",
    )


@query("spend_transactions", _transactions_sql())
def spend_transactions(spark, sf):
    decided = passes(spark, sf).withColumns(
        {
            "model": F.expr("try_element_at(tool_config.metadata, 'model')"),
            "metadata": F.col("tool_config.metadata"),
            "corr_id": F.col("request_id"),
        }
    )
    costed = budget.purchase_amount(budget.estimate_cost(decided))
    return budget.spend_transactions(costed).withColumn("ts", F.col("ts").cast("bigint"))


def _balances_sql(spend: str) -> str:
    amount = f"amount::VARCHAR::{MONEY}"
    return (
        f"WITH t AS ({spend}), b AS ({I.BUDGETS_SQL}), m AS (SELECT user_id, date_trunc('month', created_at)::DATE "
        f"AS month, sum({amount}) AS cur, sum(CASE WHEN transaction_type = 'llm' THEN {amount} END) AS llm, "
        f"sum(CASE WHEN transaction_type = 'purchase' THEN {amount} END) AS pur FROM t GROUP BY ALL) "
        "SELECT coalesce(m.user_id, b.user_id) AS user_id, m.month, coalesce(b.monthly_limit, 10.0::DOUBLE) "
        "AS monthly_limit, coalesce(b.budget_type, 'user') AS budget_type, coalesce(cur, 0)::VARCHAR::DOUBLE AS current_spend, "
        "coalesce(llm, 0)::VARCHAR::DOUBLE AS llm_spend, coalesce(pur, 0)::VARCHAR::DOUBLE AS purchase_spend "
        "FROM m FULL JOIN b ON m.user_id = b.user_id"
    )


@query("ledger_balances", _balances_sql(I.SPEND_SQL))
def ledger_balances(spark, sf):
    return budget.ledger_balances(I.spend(spark, sf), I.budgets(spark, sf))


@query("ledger_balances_by_month", _balances_sql(I.LEDGER_SQL))
def ledger_balances_by_month(spark, sf):
    return budget.ledger_balances(I.ledger_history(spark, sf), I.budgets(spark, sf))


def _running_sql(spend: str) -> str:
    frame = (
        "OVER (PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    amount = f"amount::VARCHAR::{MONEY}"

    def total(value: str) -> str:
        return f"coalesce(sum({value}) {frame}, 0)::VARCHAR::DOUBLE"

    return (
        f"SELECT id, user_id, date_trunc('month', created_at)::DATE AS month, {total(amount)} AS spent_before, "
        f"{total(f'''CASE WHEN transaction_type = 'llm' THEN {amount} END''')} AS llm_before, "
        f"{total(f'''CASE WHEN transaction_type = 'purchase' THEN {amount} END''')} AS purchase_before FROM ({spend})"
    )


_RUNNING = ("id", "user_id", "month", "spent_before", "llm_before", "purchase_before")


@query("running_spend", _running_sql(I.SPEND_SQL))
def running_spend(spark, sf):
    return budget.running_spend(I.spend(spark, sf)).select(*_RUNNING)


@query("running_spend_by_month", _running_sql(I.LEDGER_SQL))
def running_spend_by_month(spark, sf):
    return budget.running_spend(I.ledger_history(spark, sf)).select(*_RUNNING)


@query("running_spend_hot_keys", _running_sql(I.SPEND_SQL))
def running_spend_hot_keys(spark, sf):
    """The same in finer pieces, for users whose days outgrow one task."""
    return budget.running_spend(I.spend(spark, sf), piece="minute").select(*_RUNNING)


@query(
    "check_budget_ledger",
    f"WITH bal AS ({_balances_sql(I.SPEND_SQL)}), r AS (SELECT event_id, user_id, "
    "date_trunc('month', ts)::DATE AS month, value * 0.1::DOUBLE AS est_cost, CASE WHEN event_id % 3 = 0 THEN value END "
    "AS est_purchase FROM events), j AS (SELECT r.*, "
    "coalesce(monthly_limit, 10.0::DOUBLE) AS lim, coalesce(current_spend, 0.0::DOUBLE) AS cur, "
    "(coalesce(llm_spend, 0.0::DOUBLE) + est_cost) + (coalesce(purchase_spend, 0.0::DOUBLE) + "
    "coalesce(est_purchase, 0.0::DOUBLE)) AS projected FROM r LEFT JOIN bal ON r.user_id = bal.user_id "
    "AND r.month = bal.month) SELECT event_id, projected <= lim AS allowed, CASE WHEN projected > lim THEN "
    "'budget_exceeded' WHEN projected / lim * 100.0::DOUBLE > 90 THEN 'budget_warning' ELSE 'budget_ok' END AS reason, "
    "projected AS projected_total, cur / lim * 100.0::DOUBLE AS percent_used, lim - cur AS remaining FROM j",
)
def check_budget_ledger(spark, sf):
    asked = I.table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.col("ts").alias("created_at"),
        (F.col("value") * F.lit(0.1)).alias("est_cost"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("est_purchase"),
    )
    balances = budget.ledger_balances(I.spend(spark, sf), I.budgets(spark, sf)).filter("month is not null")
    out = budget.check_budget_ledger(asked, balances)
    return out.select(
        "event_id",
        F.col("budget_status.allowed").alias("allowed"),
        F.col("budget_status.reason").alias("reason"),
        F.col("budget_info.projected_total").alias("projected_total"),
        F.col("budget_status.percent_used").alias("percent_used"),
        F.col("budget_status.remaining").alias("remaining"),
    )


# ------------------------------------------------------------------------------------- throttling
LIMIT, WINDOW_S = 3, 86_400

_ATTEMPTS_SQL = f"""SELECT id, key, endpoint, ts, count(*) OVER (PARTITION BY key ORDER BY epoch_us(ts)
  RANGE BETWEEN {WINDOW_S * 1_000_000 - 1} PRECEDING AND 1 PRECEDING)
  + row_number() OVER (PARTITION BY key, ts ORDER BY id) - 1 AS prior FROM ({I.REQUEST_LOG_SQL})"""


@query("throttle_attempts", f"SELECT id, key, prior::BIGINT AS prior, prior < {LIMIT} AS allowed FROM ({_ATTEMPTS_SQL})")
def throttle_attempts(spark, sf):
    out = throttle.throttle_attempts(I.request_log(spark, sf), "key", limit=LIMIT, window_s=WINDOW_S)
    return out.select("id", "key", F.col("prior").cast("bigint").alias("prior"), "allowed")


@query(
    "throttle_attempts_hot_keys",
    f"SELECT id, key, prior::BIGINT AS prior, prior < {LIMIT} AS allowed FROM ({_ATTEMPTS_SQL})",
)
def throttle_attempts_hot_keys(spark, sf):
    """Under its earlier name: keys of all sizes go one way."""
    out = throttle.throttle_attempts(I.request_log(spark, sf), "key", limit=LIMIT, window_s=WINDOW_S)
    return out.select("id", "key", F.col("prior").cast("bigint").alias("prior"), "allowed")


# Admitted times per key, folded over the key's sorted log: state is the list of admissions.
_ADMITTED_SQL = f"""WITH l AS (SELECT key, list({{'id': id, 'us': epoch_us(ts)}} ORDER BY ts, id) AS log
  FROM ({I.REQUEST_LOG_SQL}) GROUP BY key),
f AS (SELECT key, log, list_reduce(list_prepend([]::BIGINT[], list_transform(log, lambda e: [e.us])),
  lambda adm, e: CASE WHEN len(list_filter(adm, lambda a: a > e[1] - {WINDOW_S * 1_000_000})) < {LIMIT}
  THEN adm || e ELSE adm END) AS adm FROM l),
u AS (SELECT key, unnest(log) AS e, adm FROM f)
SELECT e.id AS id, key, list_contains(adm, e.us) AS allowed FROM u"""


@query("throttle_admitted", _ADMITTED_SQL)
def throttle_admitted(spark, sf):
    out = throttle.throttle_admitted(I.request_log(spark, sf), "key", limit=LIMIT, window_s=WINDOW_S)
    return out.select("id", "key", "allowed")


@query("throttle_admitted_hot_keys", _ADMITTED_SQL)
def throttle_admitted_hot_keys(spark, sf):
    """Under its earlier name: keys of all sizes go one way."""
    out = throttle.throttle_admitted(I.request_log(spark, sf), "key", limit=LIMIT, window_s=WINDOW_S)
    return out.select("id", "key", "allowed")


_REPORT_SQL = (
    "WITH l AS (SELECT event_id AS id, ts, concat(event_type, ':', CASE WHEN user_id % 4 = 0 THEN concat('key:k', "
    "user_id % 40) ELSE concat('u', user_id) END) AS throttle_key FROM events), a AS (SELECT *, count(*) OVER "
    f"(PARTITION BY throttle_key ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_S * 1_000_000 - 1} PRECEDING AND "
    "1 PRECEDING) + row_number() OVER (PARTITION BY throttle_key, ts ORDER BY id) - 1 AS prior FROM l) "
    "SELECT throttle_key, count(*) AS attempts, count(*) FILTER (prior >= 1) AS rejected, "
    "count(*) FILTER (prior >= 1) / count(*) AS rejected_share FROM a GROUP BY 1"
)


def _report(spark, sf, top: int | None) -> DataFrame:
    log = I.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        throttle.throttle_key(
            F.col("event_type"),
            F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("u"), F.col("user_id"))),
            F.concat(F.lit("k"), F.col("user_id") % 40),
        ).alias("throttle_key"),
    )
    attempts = throttle.throttle_attempts(log, "throttle_key", limit=1, window_s=WINDOW_S)
    return throttle.throttle_report(attempts, "throttle_key", top)


@query("throttle_report", _REPORT_SQL)
def throttle_report(spark, sf):
    return _report(spark, sf, None)


@query("throttle_top_offenders", f"{_REPORT_SQL} ORDER BY rejected DESC, throttle_key LIMIT 10")
def throttle_top_offenders(spark, sf):
    return _report(spark, sf, 10)


@query(
    "quota_usage",
    f"WITH q AS ({I.QUOTAS_SQL}), d AS (SELECT user_id, date_trunc('month', ts)::DATE AS month, ts::DATE AS day, "
    "count(*) AS daily FROM events GROUP BY ALL), m AS (SELECT *, (sum(daily) OVER (PARTITION BY user_id, month "
    "ORDER BY day))::BIGINT AS monthly FROM d) SELECT m.user_id, month, day, daily, monthly, "
    "coalesce(daily_limit, 1000) AS daily_limit, coalesce(monthly_limit, 30000) AS monthly_limit, "
    "daily > coalesce(daily_limit, 1000) AS over_daily, monthly > coalesce(monthly_limit, 30000) AS over_monthly "
    "FROM m LEFT JOIN q USING (user_id)",
)
def quota_usage(spark, sf):
    return throttle.quota_usage(I.table(spark, sf, "events"), I.quotas(spark, sf), time_col="ts")
