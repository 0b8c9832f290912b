"""Headline queries on local cores. Prints one JSON line; each time is the full query, planning
included, with its result written to a no-op sink: the median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from quillguard.plans import catalog

HEADLINE = (
    "scan_findings_documents",
    "scan_findings_specific_first_documents",
    "corpus_pii_profile",
    "mask_text_documents",
    "redact_placeholders_documents",
    "redact_nested",
    "decide_documents",
    "decide",
    "decision_counts",
    "estimate_cost",
    "ledger_balances_by_month",
    "running_spend_by_month",
    "throttle_attempts",
    "throttle_admitted",
    "decision_events",
    "delivery_outcomes",
    "auth_outcomes",
    "dedupe_by_payload",
    "latency_histogram",
)

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executor threads
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(median(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
