"""Counters and histograms over decisions and outcomes: partial then final hash aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions.money import MONEY
from pyspark.sql import Window

# Upper bounds of the duration buckets, in seconds.
DURATION_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def decision_counts(
    decisions: DataFrame, by: Sequence[str] = ("pass", "user_id", "tool", "decision", "rule_id")
) -> DataFrame:
    return decisions.groupBy(*by).agg(F.count("*").alias("n"))


def evaluation_counts(decisions: DataFrame) -> DataFrame:
    return decision_counts(decisions, ("tool", "direction", "rule_id"))


def latency_histogram(
    df: DataFrame, value: str, labels: Sequence[str], bounds: Sequence[float] = DURATION_BOUNDS
) -> DataFrame:
    """Cumulative counts per label set and upper bound (null bound: infinity), with sum and count.
    One aggregation row per label set is shuffled, then unfolded into its buckets."""
    counts = [
        F.count(F.when(F.col(value) <= bound, 1)).alias(f"_b{i}") for i, bound in enumerate(bounds)
    ]
    grouped = df.groupBy(*labels).agg(
        *counts,
        F.sum(F.col(value).cast(MONEY)).cast("double").alias("total"),
        F.count(value).alias("n"),
    )
    buckets = F.array(
        *[
            F.struct(F.lit(bound).alias("le"), F.col(f"_b{i}").alias("cum_count"))
            for i, bound in enumerate(bounds)
        ],
        F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("cum_count")),
    )
    return grouped.select(*labels, F.explode(buckets).alias("b"), "total", "n").select(
        *labels, "b.le", "b.cum_count", "total", "n"
    )


def outcome_counts(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.count("*").alias("n"))


def dead_letter_backlog(dead_letters: DataFrame, time_col: str = "ts") -> DataFrame:
    """Dead letters per day and the backlog at the end of each day. The running sum goes over one
    row per day, so its single window partition stays small whatever the number of letters."""
    daily = dead_letters.groupBy(F.to_date(time_col).alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("backlog", F.sum("n").over(w))


def pii_action_counts(decisions: DataFrame, reasons_col: str = "reasons") -> DataFrame:
    """Detections by type and action, read from reason codes such as ``pii.redacted:us_npi`` or
    ``tokenized:PII:us_ssn``."""
    code = r"^(?:pii\.)?(allowed|tokenized|redacted|blocked):(?:PII:)?(.+)$"
    return (
        decisions.select(F.explode_outer(reasons_col).alias("r"))
        .filter(F.col("r").rlike(code))
        .groupBy(
            F.regexp_extract("r", code, 2).alias("pii_type"), F.regexp_extract("r", code, 1).alias("action")
        )
        .agg(F.count("*").alias("n"))
    )
