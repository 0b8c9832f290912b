"""Spend: cost estimates, ledgers, balances and budget checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions import money as M
from quillguard.functions.once import compute_once
from quillguard.functions.spans import lit, name
from quillguard.functions.sizing import broadcast_if_small
from quillguard.operators.ordered import running_totals
from quillguard.schemas import BUDGET_CONTEXT_DDL, DEFAULT_MODEL

MONEY = M.MONEY

# The budget of a user who has none.
DEFAULT_MONTHLY_LIMIT = 10.0
DEFAULT_BUDGET_TYPE = "user"


def estimate_cost(
    requests: DataFrame, prices: DataFrame | None = None, model_col: str = "model", text_col: str = "raw_text"
) -> DataFrame:
    """Add ``tokens`` and ``est_cost``. A model without a price is billed at the fallback model's.

    Without ``prices`` the fixed price table is used, with no join. A table of one's own has
    ``(model, price_in, price_out)``, one row a model; where it does not price the fallback model either,
    the cost is null.
    """
    wanted = f"coalesce({name(model_col)}, {lit(DEFAULT_MODEL)})"
    counted = compute_once(requests, {"tokens": M.estimate_tokens(name(text_col))})
    if prices is None:
        return counted.withColumn("est_cost", F.expr(M.token_cost("tokens", *M.model_prices(wanted))))
    fallback = prices.filter(F.col("model") == M.FALLBACK_MODEL)
    table = broadcast_if_small(prices.withColumnRenamed("model", "_model"))
    priced = {f"_{c}": F.coalesce(c, fallback.select(c).scalar()) for c in ("price_in", "price_out")}
    return (
        counted.join(table, F.expr(wanted) == F.col("_model"), "left")
        .withColumns(priced)
        .withColumn("est_cost", F.expr(M.token_cost("tokens", "_price_in", "_price_out")))
        .drop("_model", "price_in", "price_out", *priced)
    )


def purchase_amount(requests: DataFrame, metadata_col: str = "metadata") -> DataFrame:
    return requests.withColumn("est_purchase", F.expr(M.purchase_amount(name(metadata_col))))


def payment_amount_from_text(df: DataFrame, findings_col: str = "payment_findings") -> DataFrame:
    return df.withColumn("est_purchase", F.expr(M.first_payment_amount(name(findings_col))))


def check_budget_context(
    requests: DataFrame,
    context_col: str = "budget_context",
    cost_col: str = "est_cost",
    purchase_col: str = "est_purchase",
) -> DataFrame:
    """Add ``budget_status`` and ``budget_info``; rows without a context get null."""
    check = F.expr(M.budget_check(name(context_col), name(cost_col), name(purchase_col)))
    return (
        requests.withColumn("_check", F.when(F.col(context_col).isNotNull(), check))
        .withColumns({"budget_status": F.col("_check.status"), "budget_info": F.col("_check.info")})
        .drop("_check")
    )


def spend_transactions(decisions: DataFrame) -> DataFrame:
    """Ledger rows of decided requests: one for a positive cost, one for a positive purchase.

    Needs ``user_id, tool, corr_id, ts, decision, est_cost, est_purchase``.
    """

    def entry(kind: str, amount: Column, text: str) -> Column:
        return F.struct(
            F.lit(kind).alias("transaction_type"),
            amount.alias("amount"),
            F.concat(F.lit(text), F.col("tool")).alias("description"),
        )

    entries = F.array(
        entry("llm", F.col("est_cost"), "LLM usage for "),
        entry("purchase", F.col("est_purchase"), "Purchase via "),
    )
    paid = decisions.filter(F.col("decision").isin("allow", "transform", "confirm"))
    return paid.select(
        "user_id", "tool", F.col("corr_id").alias("correlation_id"), "ts", F.explode_outer(entries).alias("e")
    ).filter("e.amount > 0").select("user_id", "e.*", "tool", "correlation_id", "ts")


def _spend(kind: str | None = None) -> Column:
    amount = F.col("amount").cast(MONEY)
    return amount if kind is None else F.when(F.col("transaction_type") == kind, amount)


def monthly_spend(transactions: DataFrame, user: str = "user_id", time_col: str = "created_at") -> DataFrame:
    return transactions.groupBy(user, F.trunc(time_col, "month").alias("month")).agg(
        F.sum(_spend()).alias("current_spend"),
        F.coalesce(F.sum(_spend("llm")), F.lit(0)).alias("llm_spend"),
        F.coalesce(F.sum(_spend("purchase")), F.lit(0)).alias("purchase_spend"),
    )


def ledger_balances(
    transactions: DataFrame, budgets: DataFrame, user: str = "user_id", time_col: str = "created_at"
) -> DataFrame:
    """Spend per user and month beside the user's budget. Spend starts again each month; a user
    without a budget row gets the default one; a budget nobody used shows with no month."""
    joined = monthly_spend(transactions, user, time_col).join(
        budgets.select(user, "monthly_limit", "budget_type"), user, "full"
    )
    zero = F.lit(0).cast(MONEY)
    return joined.select(
        user,
        "month",
        F.coalesce(F.col("monthly_limit"), F.lit(DEFAULT_MONTHLY_LIMIT)).alias("monthly_limit"),
        F.coalesce(F.col("budget_type"), F.lit(DEFAULT_BUDGET_TYPE)).alias("budget_type"),
        *[
            F.coalesce(F.col(c), zero).cast("double").alias(c)
            for c in ("current_spend", "llm_spend", "purchase_spend")
        ],
    )


def running_spend(
    transactions: DataFrame,
    user: str = "user_id",
    time_col: str = "created_at",
    id_col: str = "id",
    piece: str = "day",
) -> DataFrame:
    """Spend of the user in the month before each row. ``piece`` is the unit of time by which a
    user's month is spread over tasks: a day, or an hour or a minute for busier users."""
    zero = F.lit(0).cast(MONEY)
    with_month = transactions.withColumn("month", F.trunc(time_col, "month"))
    values = {
        "spent_before": F.coalesce(_spend(), zero),
        "llm_before": F.coalesce(_spend("llm"), zero),
        "purchase_before": F.coalesce(_spend("purchase"), zero),
    }
    totals = running_totals(with_month, [user, "month"], [time_col, id_col], values, F.date_trunc(piece, time_col))
    return totals.withColumns({c: F.col(c).cast("double") for c in values})


def check_budget_ledger(
    requests: DataFrame,
    balances: DataFrame,
    user: str = "user_id",
    time_col: str = "created_at",
    cost_col: str = "est_cost",
    purchase_col: str = "est_purchase",
) -> DataFrame:
    """Budget check against ledger balances instead of a supplied context. Balances hold one row
    per user and month; a request of a user or month without one meets an untouched default
    budget. A limit of zero has no percentages."""
    context = F.struct(
        F.col("monthly_limit"),
        F.col("current_spend"),
        F.col("llm_spend"),
        F.col("purchase_spend"),
        (F.col("monthly_limit") - F.col("current_spend")).alias("remaining_budget"),
        F.col("budget_type"),
    ).cast(BUDGET_CONTEXT_DDL)
    wide = requests.withColumn("month", F.trunc(time_col, "month")).join(
        balances, [user, "month"], "left"
    )
    wide = wide.fillna(
        {
            "monthly_limit": DEFAULT_MONTHLY_LIMIT,
            "budget_type": DEFAULT_BUDGET_TYPE,
            "current_spend": 0.0,
            "llm_spend": 0.0,
            "purchase_spend": 0.0,
        }
    )
    check = M.budget_check("_context", name(cost_col), name(purchase_col), guard_zero_limit=False)
    return (
        wide.withColumn("_context", context)
        .withColumn("_check", F.expr(check))
        .withColumns({"budget_status": F.col("_check.status"), "budget_info": F.col("_check.info")})
        .drop("_check", "_context", "monthly_limit", "budget_type", "current_spend", "llm_spend", "purchase_spend")
    )
