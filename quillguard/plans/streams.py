"""Streaming jobs replayed over the given tables, compared with their batch twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.functions.lineage import shared_dir
from quillguard.operators import events as E
from quillguard.plans import inputs as I
from quillguard.plans.catalog import query
from quillguard.plans.decisions import pass_steps
from quillguard.plans.records import _OUTCOMES_SQL
from quillguard.plans.spending import _ADMITTED_SQL, LIMIT, WINDOW_S
from quillguard.sources import sinks
from quillguard.streaming import jobs


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files. A stream reads folders only, but
    takes a pattern for either; this one matches that table alone."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


_SLICES = 3


def _replayed(spark: SparkSession, sf: str, job: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Run ``job`` over the events as they would arrive: slices of time are added to its source one
    after the other, and it is started again for each, so state crosses batches and restarts."""
    folder = _folder(spark)
    events = I.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    out = None
    for i in range(_SLICES):
        at = F.coalesce(F.floor((us - F.lit(lo)) * _SLICES / F.lit((hi or 0) - (lo or 0) + 1)), F.lit(0))
        events.filter(at == i).write.mode("append").parquet(f"{folder}/source")
        out = job(spark.readStream.schema(events.schema).parquet(f"{folder}/source"), folder)
    return out


@query("stream_throttle", _ADMITTED_SQL)
def stream_throttle(spark, sf):
    def job(events: DataFrame, folder: str) -> DataFrame:
        log = events.select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("u"), F.col("user_id")).alias("key"))
        judged = jobs.stream_throttle(log, "key", "ts", "id", LIMIT, WINDOW_S, idle_ms=None)
        return jobs.run_to_files(judged, folder).select("id", "key", "allowed")

    return _replayed(spark, sf, job)


_MONEY = "DECIMAL(28,10)"


@query(
    "stream_budget",
    f"WITH t AS (SELECT id, user_id, amount::VARCHAR::{_MONEY} AS a, created_at, 200 + (user_id % 7) * 100 AS lim "
    f"FROM ({I.SPEND_SQL})), r AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY user_id, date_trunc('month', created_at) "
    "ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) "
    "SELECT id, user_id, before::VARCHAR::DOUBLE AS spent_before, CASE WHEN before + a > lim THEN 'budget_exceeded' "
    "WHEN before + a > lim * 0.9 THEN 'budget_warning' ELSE 'budget_ok' END AS verdict FROM r",
)
def stream_budget(spark, sf):
    is_purchase = F.col("event_type") == "purchase"

    def job(events: DataFrame, folder: str) -> DataFrame:
        spend = events.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.when(is_purchase, "purchase").otherwise("llm").alias("transaction_type"),
            F.when(is_purchase, F.col("value")).otherwise(F.col("value") * F.lit(0.01)).alias("amount"),
            F.col("ts").alias("created_at"),
            (200 + (F.col("user_id") % 7) * 100).cast("double").alias("monthly_limit"),
        )
        return jobs.run_to_files(jobs.stream_budget(spend, "user_id", "created_at", "id"), folder)

    return _replayed(spark, sf, job)


_DAYS = "(SELECT *, date_trunc('day', ts) AS window_start FROM events)"


@query(
    "stream_counts",
    f"SELECT window_start, event_type, count(*) AS n FROM {_DAYS} GROUP BY ALL",
)
def stream_counts(spark, sf):
    def job(events: DataFrame, folder: str) -> DataFrame:
        return jobs.run_updates(jobs.stream_counts(events, "ts", ["event_type"]), folder, ["window_start", "event_type"])

    return _replayed(spark, sf, job)


@query(
    "stream_histogram",
    "WITH b AS (SELECT unnest([5.0, 25.0, NULL]::DOUBLE[]) AS le), g AS (SELECT window_start, "
    f"event_type, count(*) AS n, count(*) FILTER (value <= 5) AS b5, count(*) FILTER (value <= 25) AS b25 FROM {_DAYS} "
    "GROUP BY ALL) SELECT window_start, event_type, le, "
    "CASE WHEN le IS NULL THEN n WHEN le = 5 THEN b5 ELSE b25 END AS cum_count FROM g CROSS JOIN b",
)
def stream_histogram(spark, sf):
    def job(events: DataFrame, folder: str) -> DataFrame:
        buckets = jobs.stream_histogram(events, "ts", "value", ["event_type"], bounds=(5.0, 25.0))
        keys = ["window_start", "event_type", "le"]
        return jobs.run_updates(buckets, folder, keys).select(*keys, "cum_count")

    return _replayed(spark, sf, job)


@query("stream_dedupe", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(spark, sf):
    """One survivor per key; which one arrives first depends on how the files are split."""
    rows = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = jobs.stream_dedupe(rows, ["user_id", "event_type"], "ts", "60 days")
    out = jobs.run_to_files(kept, _folder(spark))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_decisions",
    pass_steps().select("request_id, pass, decision, rule_id"),
)
def stream_decisions(spark, sf):
    """Decisions written per micro-batch, with the policy table read again for each."""
    folder = _folder(spark)
    requests = I.request_frame(_stream(spark, sf, "conversations"))

    def write(decided: DataFrame, batch_id: int) -> None:
        decided.select("request_id", "pass", "decision", "rule_id").write.mode("overwrite").parquet(
            f"{folder}/rows/batch={batch_id}"
        )

    writer = jobs.stream_decisions(requests, lambda: (I.policies(spark, sf), I.STATIC_POLICY_JSON), write)
    run = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


@query(
    "stream_sinks",
    f"{_OUTCOMES_SQL} SELECT event_id, status, coalesce(err, '') AS err FROM outcomes",
)
def stream_sinks(spark, sf):
    """Events and dead letters as read back from the folders the stream wrote."""
    folder = _folder(spark)
    sent = _stream(spark, sf, "events").select("event_id", "ts", "event_type")
    outcomes, _ = E.delivery_outcomes(sent, I.attempts(spark, sf))
    shaped = outcomes.select(F.struct("event_id", "event_type").alias("event"), "status", "err")
    run = (
        jobs.stream_sinks(shaped, folder)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    good = sinks.read_committed(spark, folder, "events", "json", "event_id bigint, event_type string")
    bad = sinks.read_committed(spark, folder, "dead_letters", "json", "err string, event struct<event_id:bigint>")
    return good.select("event_id", F.lit("success").alias("status"), F.lit("").alias("err")).unionByName(
        bad.select("event.event_id", F.lit("failed").alias("status"), "err")
    )
