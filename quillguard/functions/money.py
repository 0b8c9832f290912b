"""Cost, purchase and budget expressions, as SQL text (see ``spans``)."""

from __future__ import annotations

from quillguard.functions import patterns as P
from quillguard.functions.spans import Sql, each, let, lit
from quillguard.functions.text import word_count
from quillguard.schemas import BUDGET_INFO_DDL, BUDGET_STATUS_DDL

# Price per token (input, output) by model, the model used for unknown names, the
# least cost that is worth a budget check, where a purchase may be named, and the warning level.
MODEL_PRICES = {
    "gpt-4": (0.00003, 0.00006),
    "gpt-4-turbo": (0.00001, 0.00003),
    "gpt-3.5-turbo": (0.0000015, 0.000002),
    "claude-3-opus": (0.000015, 0.000075),
    "claude-3-sonnet": (0.000003, 0.000015),
    "claude-3-haiku": (0.00000025, 0.00000125),
}
FALLBACK_MODEL = "gpt-3.5-turbo"
SIGNIFICANT_COST = 0.01
PURCHASE_FIELDS = ("purchase_amount", "amount", "price", "cost")
WARNING_PERCENT = 90

# All sums of money and durations are of this type, so that totals do not depend on the order of addition:
# amounts below 10^18, exact to ten decimals (smaller parts are rounded).
MONEY_DECIMALS = 10
MONEY = f"decimal(28,{MONEY_DECIMALS})"

_NUMBER = r"(?i)^[+-]?(?:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)$"


def estimate_tokens(text: Sql) -> Sql:
    """The larger of a character and a word estimate, at least 1."""
    return f"greatest(1L, CAST(floor(greatest(length({text}) / 4.0D, {word_count(text)} * 1.3D)) AS BIGINT))"


def token_cost(tokens: Sql, price_in: Sql, price_out: Sql) -> Sql:
    half = f"CAST(floor({tokens} * 0.5D) AS BIGINT)"
    return f"({half} * {price_in} + {half} * {price_out})"


def model_prices(model: Sql) -> tuple[Sql, Sql]:
    """Prices by the fixed table; an unknown model is billed as the fallback."""

    def side(k: int) -> Sql:
        cases = " ".join(f"WHEN {lit(m)} THEN {p[k]!r}D" for m, p in MODEL_PRICES.items())
        return f"CASE {model} {cases} ELSE {MODEL_PRICES[FALLBACK_MODEL][k]!r}D END"

    return side(0), side(1)


def request_cost(text: Sql, model: Sql) -> Sql:
    return let(estimate_tokens(text), lambda t: token_cost(t, *model_prices(model)))


def to_number(value: Sql) -> Sql:
    """Number written in ``value``, or null."""
    return f"CASE WHEN trim({value}) RLIKE {lit(_NUMBER)} THEN try_cast(trim({value}) AS DOUBLE) END"


def purchase_amount(metadata: Sql) -> Sql:
    return "coalesce(" + ", ".join(to_number(f"try_element_at({metadata}, {lit(k)})") for k in PURCHASE_FIELDS) + ")"


def first_payment_amount(payment_findings: Sql) -> Sql:
    """First number of the first payment span that has one."""
    number = lit(P.java(P.PAYMENT_NUMBER))
    amounts = each(payment_findings, lambda f: f"try_cast(regexp_extract({f}.text, {number}, 1) AS DOUBLE)")
    return f"get(array_compact({amounts}), 0)"


def projected_total(context: Sql, cost: Sql, purchase: Sql) -> Sql:
    """Spend of the month if the request goes ahead."""
    llm, bought = (f"coalesce({context}.{c}, 0.0D)" for c in ("llm_spend", "purchase_spend"))
    return f"(({llm} + {cost}) + ({bought} + coalesce({purchase}, 0.0D)))"


def exceeds_limit(context: Sql, cost: Sql, purchase: Sql) -> Sql:
    return f"({projected_total(context, cost, purchase)} > coalesce({context}.monthly_limit, 0.0D))"


def budget_check(context: Sql, cost: Sql, purchase: Sql, guard_zero_limit: bool = True) -> Sql:
    """``struct(status, info)`` of a request against a budget context.

    With ``guard_zero_limit`` percentages are 0 for limits of zero or less, otherwise null for a
    limit of zero.
    """
    limit, current, llm, bought, remaining = (
        f"coalesce({context}.{c}, 0.0D)"
        for c in ("monthly_limit", "current_spend", "llm_spend", "purchase_spend", "remaining_budget")
    )
    projected = projected_total(context, cost, purchase)

    def percent(amount: Sql) -> Sql:
        share = f"try_divide({amount}, {limit}) * 100.0D"
        return f"CASE WHEN {limit} > 0 THEN {share} ELSE 0.0D END" if guard_zero_limit else share

    def build(b: Sql) -> Sql:
        status = (
            f"named_struct('allowed', {b}.projected <= {limit}, 'current_spend', {current}, 'limit', {limit}, "
            f"'remaining', {limit} - {current}, 'percent_used', {percent(current)}, 'reason', "
            f"CASE WHEN {b}.projected > {limit} THEN 'budget_exceeded' WHEN {b}.pct > {WARNING_PERCENT} "
            "THEN 'budget_warning' ELSE 'budget_ok' END)"
        )
        info = (
            f"named_struct('monthly_limit', {limit}, 'current_spend', {current}, 'llm_spend', {llm}, "
            f"'purchase_spend', {bought}, 'remaining_budget', {remaining}, 'estimated_cost', {cost}, "
            f"'estimated_purchase', {purchase}, 'projected_total', {b}.projected, 'percent_used', {b}.pct, "
            f"'budget_type', coalesce({context}.budget_type, 'user'))"
        )
        return (
            f"named_struct('status', CAST({status} AS {BUDGET_STATUS_DDL}), "
            f"'info', CAST({info} AS {BUDGET_INFO_DDL}))"
        )

    return let(f"named_struct('projected', {projected}, 'pct', {percent(projected)})", build)


def worth_checking(cost: Sql, purchase: Sql) -> Sql:
    """Budgets are looked at only for a purchase or a significant cost."""
    return f"({purchase} IS NOT NULL OR {cost} >= {SIGNIFICANT_COST}D)"
