"""Writing decisions, dead letters, audit lines and usage rows.

Writers append. With ``run``, the rows of that run are a folder of their own that a second attempt
replaces, so a job that is run again repeats nothing.

Several sinks of one run are written together by ``commit_together``: each attempt writes into folders
of its own, and a manifest that names the attempt comes last. Readers follow the manifests, so of a job
that is killed between two sinks neither shows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _target(path: str, run: str | None) -> tuple[str, str]:
    """Folder and save mode."""
    return (path, "append") if run is None else (f"{path}/run={run}", "overwrite")


def write_decision_events(events: DataFrame, path: str, fmt: str = "json", run: str | None = None) -> None:
    """One event per decision, in one folder per date. Rebalancing gives each date files of a good
    size: small dates are written by one task, a large one is split over several."""
    flat = events.select("event.*", "event_date").hint("rebalance", F.col("event_date"))
    folder, mode = _target(path, run)
    writer = flat.write.mode(mode).partitionBy("event_date")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(fmt).save(folder)


def dead_letter_lines(failed: DataFrame, err_col: str = "err", event_col: str = "event") -> DataFrame:
    line = F.to_json(
        F.struct(F.col(err_col).alias("err"), F.col(event_col).alias("event")), {"ignoreNullFields": "false"}
    )
    return failed.select(line.alias("value"))


def write_dead_letters(
    failed: DataFrame, path: str, err_col: str = "err", event_col: str = "event", run: str | None = None
) -> None:
    folder, mode = _target(path, run)
    dead_letter_lines(failed, err_col, event_col).write.mode(mode).text(folder)


def audit_records(decisions: DataFrame) -> DataFrame:
    """Fields of the audit trail, in the order they are written."""
    explicit_none = F.startswith(F.col("rule_id"), F.lit("net-redact"))
    no_list = F.array().cast("array<string>")
    return decisions.select(
        F.col("ts").cast("bigint").alias("t"),
        F.col("pass").alias("event"),
        "user_id",
        "tool",
        "decision",
        "corr_id",
        F.col("rule_id").alias("policy_id"),
        F.when(F.col("reasons").isNull() & ~explicit_none, no_list).otherwise(F.col("reasons")).alias("reasons"),
    )


def audit_lines(decisions: DataFrame) -> DataFrame:
    records = audit_records(decisions)
    line = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    return records.select(line.alias("value"))


def write_audit_trail(decisions: DataFrame, path: str, run: str | None = None) -> None:
    folder, mode = _target(path, run)
    audit_lines(decisions).write.mode(mode).text(folder)


def usage_events(decisions: DataFrame) -> DataFrame:
    """Usage row per decision, with the payload's hash."""
    return decisions.select(
        "user_id",
        "tool",
        "scope",
        "decision",
        F.col("rule_id").alias("policy_id"),
        F.timestamp_seconds("ts").alias("created_at"),
        F.sha2("raw_text", 256).alias("payload_hash"),
    )


def write_usage(decisions: DataFrame, path: str, run: str | None = None) -> None:
    folder, mode = _target(path, run)
    dated = usage_events(decisions).withColumn("usage_date", F.to_date("created_at"))
    dated.hint("rebalance", F.col("usage_date")).write.mode(mode).partitionBy("usage_date").parquet(folder)


# Sinks below a folder lie in run=R/attempt=A; a manifest of run R names the attempt that counts.
_MANIFESTS = "_manifests"


def commit_together(spark: SparkSession, path: str, run: str, writers: Mapping[str, Callable[[str], None]]) -> None:
    """Write all sinks of one run, or none that a reader sees.

    ``writers`` maps each sink's name to a function that writes into the folder it is given. A run that
    is written again replaces what it wrote before; what an earlier or killed attempt has left is never
    read.
    """
    attempt = uuid.uuid4().hex
    for name, write in writers.items():
        write(f"{path}/{name}/run={run}/attempt={attempt}")
    manifest = spark.range(1).select(F.lit(attempt).alias("attempt"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{_MANIFESTS}/run={run}")


def read_committed(spark: SparkSession, path: str, name: str, fmt: str, schema: str) -> DataFrame:
    """Rows of a sink from committed runs, each with its ``run``. Only their folders are read."""
    manifests = spark.read.schema("attempt string, run string").option("mode", "DROPMALFORMED").json(f"{path}/{_MANIFESTS}")
    rows = spark.read.schema(f"{schema}, run string, attempt string").format(fmt).load(f"{path}/{name}")
    return rows.join(manifests, ["run", "attempt"], "left_semi").select(*[c for c in rows.columns if c != "attempt"])
