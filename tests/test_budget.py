import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions import money as M
from quillguard.operators import budget


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.expr(M.estimate_tokens("t")).alias("n")).first()["n"]


@pytest.mark.parametrize(
    "text, n", [("I am a cat", 5), ("a" * 400, 100), ("", 1), ("a\x1cb c d", 5), ("  x  ", 1)]
)
def test_tokens(spark, text, n):
    assert n == max(1, int(max(len(text) / 4, len(text.split()) * 1.3)))
    assert tokens(spark, text) == n


def test_cost_by_model(spark):
    df = spark.createDataFrame([("a" * 400, m) for m in ("gpt-4", "claude-3-haiku", "nobody", None)], "raw_text string, model string")
    costs = {r["model"]: r["est_cost"] for r in budget.estimate_cost(df).collect()}
    assert costs["gpt-4"] == costs[None] == 50 * 0.00003 + 50 * 0.00006
    assert costs["claude-3-haiku"] == 50 * 0.00000025 + 50 * 0.00000125
    assert costs["nobody"] == 50 * 0.0000015 + 50 * 0.000002
    table = spark.createDataFrame([("gpt-3.5-turbo", 1.0, 2.0), ("mine", 0.5, 0.5)], "model string, price_in double, price_out double")
    own = spark.createDataFrame([("a" * 400, "mine"), ("a" * 400, "gpt-4")], "raw_text string, model string")
    assert {r["model"]: r["est_cost"] for r in budget.estimate_cost(own, table).collect()} == {"mine": 50.0, "gpt-4": 150.0}


def test_purchase_amount(spark):
    cases = [
        ({"amount": "5", "purchase_amount": "7.5"}, 7.5),
        ({"purchase_amount": "abc", "price": " 12.5 "}, 12.5),
        ({"cost": "1e3"}, 1000.0),
        ({"cost": "12d"}, None),
        ({"purchase_amount": None, "amount": "-.5"}, -0.5),
        ({}, None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, metadata map<string,string>")
    out = [r["est_purchase"] for r in budget.purchase_amount(df).orderBy("i").collect()]
    assert out == [want for _, want in cases]


def check(spark, limit, llm, purchase_spend, cost, purchase):
    ctx = (limit, llm + purchase_spend, llm, purchase_spend, limit - llm - purchase_spend, "user")
    df = spark.createDataFrame(
        [(ctx, cost, purchase)], f"budget_context {S.BUDGET_CONTEXT_DDL}, est_cost double, est_purchase double"
    )
    r = budget.check_budget_context(df).first()
    return r["budget_status"], r["budget_info"]


@pytest.mark.parametrize(
    "args, allowed, reason",
    [
        ((10.0, 9.5, 0.0, 1.0, None), False, "budget_exceeded"),
        ((10.0, 0.0, 9.0, 0.0, 2.0), False, "budget_exceeded"),
        ((10.0, 8.5, 0.0, 0.7, None), True, "budget_warning"),
        ((10.0, 8.5, 0.0, 0.5, None), True, "budget_ok"),
        ((10.0, 2.0, 0.0, 0.1, None), True, "budget_ok"),
        ((0.0, 0.0, 0.0, 0.0, None), True, "budget_ok"),
        ((0.0, 0.0, 0.0, 999.0, None), False, "budget_exceeded"),
    ],
)
def test_context_check(spark, args, allowed, reason):
    status, info = check(spark, *args)
    assert (status["allowed"], status["reason"]) == (allowed, reason)
    limit, llm, pur, cost, purchase = args
    assert info["projected_total"] == (llm + cost) + (pur + (purchase or 0.0))
    assert status["remaining"] == limit - (llm + pur)
    if limit == 0:
        assert status["percent_used"] == info["percent_used"] == 0


def test_no_context_no_status(spark):
    df = spark.createDataFrame([(None, 1.0, None)], f"budget_context {S.BUDGET_CONTEXT_DDL}, est_cost double, est_purchase double")
    assert budget.check_budget_context(df).first()["budget_status"] is None


def test_transactions(spark):
    rows = [("u", "t", "c1", 1, "allow", 0.5, 3.0), ("u", "t", "c2", 2, "deny", 0.5, 3.0), ("u", "t", "c3", 3, "confirm", 0.0, None)]
    df = spark.createDataFrame(rows, "user_id string, tool string, corr_id string, ts int, decision string, est_cost double, est_purchase double")
    out = sorted((r["correlation_id"], r["transaction_type"], r["amount"], r["description"]) for r in budget.spend_transactions(df).collect())
    assert out == [("c1", "llm", 0.5, "LLM usage for t"), ("c1", "purchase", 3.0, "Purchase via t")]


LEDGER = "id int, user_id string, transaction_type string, amount double, created_at timestamp"


def test_balances_restart_each_month(spark):
    rows = [
        (1, "a", "llm", 1.0, datetime(2024, 1, 31, 23)),
        (2, "a", "purchase", 2.0, datetime(2024, 2, 1)),
        (3, "a", "llm", 0.1, datetime(2024, 2, 2)),
        (4, "b", "llm", 0.2, datetime(2024, 2, 2)),
    ]
    budgets = spark.createDataFrame([("a", 50.0, "organization"), ("z", 5.0, "user")], "user_id string, monthly_limit double, budget_type string")
    out = budget.ledger_balances(spark.createDataFrame(rows, LEDGER), budgets).collect()
    got = {(r["user_id"], r["month"] and r["month"].month): (r["monthly_limit"], r["budget_type"], r["current_spend"], r["llm_spend"], r["purchase_spend"]) for r in out}
    assert got == {
        ("a", 1): (50.0, "organization", 1.0, 1.0, 0.0),
        ("a", 2): (50.0, "organization", 2.1, 0.1, 2.0),
        ("b", 2): (10.0, "user", 0.2, 0.2, 0.0),
        ("z", None): (5.0, "user", 0.0, 0.0, 0.0),
    }


@pytest.mark.parametrize("piece", ["day", "hour", "month"])
def test_running_spend_equals_a_sequential_ledger(spark, piece):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        user = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        when = datetime(2024, rng.choice([1, 2]), rng.randint(1, 3), rng.randint(0, 2))
        rows.append((i, user, rng.choice(["llm", "purchase"]), rng.randint(1, 999) / 100, when))
    df = spark.createDataFrame(rows, LEDGER).repartition(5)
    out = {r["id"]: (r["spent_before"], r["llm_before"], r["purchase_before"]) for r in budget.running_spend(df, piece=piece).collect()}
    seen: dict = {}
    for i, user, kind, amount, when in sorted(rows, key=lambda r: (r[4], r[0])):
        state = seen.setdefault((user, when.month), {"llm": Decimal(0), "purchase": Decimal(0)})
        assert out[i] == (float(sum(state.values())), float(state["llm"]), float(state["purchase"]))
        state[kind] += Decimal(str(amount))
    assert len(out) == len(rows)


def test_ledger_check(spark):
    balances = spark.createDataFrame(
        [("a", datetime(2024, 1, 1).date(), 100.0, "user", 95.0, 95.0, 0.0), ("z", datetime(2024, 1, 1).date(), 0.0, "user", 0.0, 0.0, 0.0)],
        "user_id string, month date, monthly_limit double, budget_type string, current_spend double, llm_spend double, purchase_spend double",
    )
    asked = spark.createDataFrame(
        [("a", datetime(2024, 1, 9), 1.0), ("a", datetime(2024, 2, 9), 1.0), ("n", datetime(2024, 1, 9), 9.5), ("z", datetime(2024, 1, 9), 1.0)],
        "user_id string, created_at timestamp, est_cost double",
    ).withColumn("est_purchase", F.lit(None).cast("double"))
    out = {(r["user_id"], r["created_at"].month): r for r in budget.check_budget_ledger(asked, balances).collect()}
    assert out["a", 1]["budget_status"]["reason"] == "budget_warning"
    assert out["a", 1]["budget_info"]["remaining_budget"] == 5.0
    assert out["a", 2]["budget_status"]["reason"] == "budget_ok"
    assert out["n", 1]["budget_status"]["reason"] == "budget_warning"
    assert out["z", 1]["budget_info"]["percent_used"] is None
