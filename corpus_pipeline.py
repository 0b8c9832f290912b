"""The corpus pipeline: quality rules, near-duplicate removal, removal of repeated passages,
decontamination, packing. Each stage works on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm import decontaminate, packing, passages, quality_rules, simhash
from quillguard.llm.common import work_dir, written


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as ``rest``: operators may then add columns of any name."""
    return docs.select("doc_id", "text", F.struct(F.lit(None).alias(""), *[c for c in _quoted(docs) if c not in ("`doc_id`", "`text`")]).alias("rest"))


def _quoted(docs: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def _together(rows: DataFrame, docs: DataFrame, **made: Column) -> DataFrame:
    """The columns of ``docs``, those in ``made`` anew."""
    own = {"`doc_id`": F.col("doc_id"), "`text`": F.col("text")}
    return rows.select(*[made.get(c, own.get(quoted, F.col(f"rest.{quoted}"))).alias(c) for c, quoted in zip(docs.columns, _quoted(docs))])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _together(quality_rules.assess(_apart(docs)).filter("quality.kept"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints over 3-word shingles link at three bits or fewer,
    the one of the smallest doc_id."""
    return simhash.representatives(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents, n_chars to match where there is such a column;
    documents that lose all their words go."""
    cut = passages.drop_repeats(_apart(docs), keep_spacing=True).filter("n_removed = 0 OR n_removed < n_words")
    made = {}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("rest.n_chars"))
    return _together(cut, docs, **made)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and places."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Fingerprints, components and tokens are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    work = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{work}/{i}")
    return docs
