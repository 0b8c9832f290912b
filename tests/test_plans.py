"""Shapes of physical plans that must hold at scale."""

import re

import pytest

from quillguard.plans import catalog

catalog.load()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("stream")))
def test_no_query_compares_all_pairs(spark, small, name):
    plan = physical(catalog.QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["scan_findings_documents", "mask_text_documents", "decide_documents"])
def test_text_jobs_shuffle_nothing_beyond_the_spread(spark, small, name):
    plan = physical(catalog.QUERIES[name](spark, small))
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")


def test_large_inputs_are_not_spread(spark, small, monkeypatch):
    from quillguard.functions import sizing

    df = spark.read.parquet(f"{small}/documents.parquet")
    assert sizing.spread(df).rdd.getNumPartitions() == 8
    monkeypatch.setattr(sizing, "MAX_SPREAD_BYTES", 1)
    assert sizing.spread(df) is df


def test_only_needed_columns_are_read(spark, small):
    plan = physical(catalog.QUERIES["corpus_pii_profile"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


def test_filters_reach_the_scan(spark, small):
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in physical(catalog.QUERIES["ledger_balances"](spark, small))


@pytest.mark.parametrize("name", ["match_tool_rule_payload", "throttle_admitted", "running_spend", "policy_as_of", "auth_outcomes", "decide"])
def test_building_a_query_reads_schemas_only(spark, small, name):
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    catalog.QUERIES[name](spark, small)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    tracker = spark.sparkContext.statusTracker()
    names = [tracker.getStageInfo(s).name for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert all(name.startswith("parquet at") for name in names)


def test_counting_is_linear_in_the_window(spark, small):
    """Frames of the attempts throttle only grow; none slides."""
    plan = physical(catalog.QUERIES["throttle_attempts"](spark, small))
    assert "unboundedpreceding" in plan.lower() and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["redact_nested", "redact_paths"])
def test_payload_work_is_dealt_out_by_size(spark, small, monkeypatch, name):
    from quillguard.plans import inputs

    monkeypatch.setattr(inputs, "_EVENT_BYTES", 1 << 10, raising=False)
    plan = physical(catalog.QUERIES[name](spark, small))
    dealt = re.findall(r"hashpartitioning\(event_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)
    assert dealt and all(int(n) > 8 for n in dealt)
