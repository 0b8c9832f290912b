"""Importance resampling: documents drawn by how much likelier a target model makes them than the corpus.

Both models are bags of hashed n-grams: words, pairs of words and the last three bytes of words, in
``BUCKETS`` buckets. The corpus model counts every document; the target model a bounded sample of
labelled good ones (``max_target``). A document's log weight is the sum, over its n-grams, of the log
ratio of the two, each bucket's ratio shrunk to one by ``prior`` n-grams. Adding Gumbel noise that
depends on doc_id and seed alone and keeping the k largest draws k documents without replacement with
chances in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import lower_ascii, small_batches, words_of, work_dir, written

BUCKETS = 1 << 20
SLICES = 64  # rows in which a task sends its counts
MAX_TARGET = 20_000
PRIOR = 10.0
SURE = 4.0
BINS = 4096
FEW = 10_000  # keys that may be read to settle the threshold
_MUL = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and how many each text has: of n words, 3 n - 1."""
    words, counts = words_of(texts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter(map(digest, distinct), np.uint64, len(distinct))[at]
    tail = np.fromiter((digest(w[-3:], 1) for w in distinct), np.uint64, len(distinct))[at]
    pair = np.empty_like(word)
    if len(word):
        pair[:-1] = word[:-1] * _MUL + word[1:]
        pair[-1] = 0
        pair ^= pair >> np.uint64(32)
    paired = np.ones(len(word), bool)
    paired[np.cumsum(counts)[counts > 0] - 1] = False
    grid = np.column_stack([word, tail, pair]) & np.uint64(buckets - 1)
    flat = grid[np.column_stack([np.ones((len(word), 2), bool), paired])]
    return flat.astype(np.int64), np.maximum(3 * counts - 1, 0)


def _counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each slice of buckets, the n-grams of all documents and of the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), np.int64)
        for batch in small_batches(batches):
            found, sizes = ngram_buckets(batch.column("text"), buckets)
            totals[0] += np.bincount(found, minlength=buckets)
            aim = np.repeat(batch.column("target").to_numpy(zero_copy_only=False).astype(bool), sizes)
            totals[1] += np.bincount(found[aim], minlength=buckets)
        slices = np.split(totals.astype("<i8"), SLICES, axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([s[0].tobytes() for s in slices], pa.binary()), pa.array([s[1].tobytes() for s in slices], pa.binary())],
            ["slice", "raw", "target"],
        )

    return docs.mapInArrow(run, "slice int, raw binary, target binary")


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for c in ("raw", "target"):
            for value in batch.column(c):
                counts = np.frombuffer(value.as_buffer(), "<i8")
                totals[c] = totals[c] + counts if c in totals else counts
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *[pa.array([totals[c].tobytes()], pa.binary()) for c in ("raw", "target")]], ["slice", "raw", "target"])


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR, sure: float = SURE) -> np.ndarray:
    """Log of what the target holds of each bucket against what the corpus makes one expect.

    What to expect is measured at the median bucket, so that the mere length of a text does not count;
    a bucket within ``sure`` standard deviations of it has ratio one, so that a text's own rare n-grams
    do not either.
    """
    held = raw >= min(20, raw.max(initial=0))
    share = float(np.median(target[held] / np.maximum(raw[held], 1))) if held.any() else 0.0
    expected = raw * (share or target.sum() / max(1, raw.sum()))
    ratios = np.log((target + prior) / (expected + prior))
    return np.where(np.abs(target - expected) > sure * np.sqrt(expected + 1), ratios, 0).astype(np.float32)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id and log_weight; null and empty texts have weight 0 on this scale."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one float per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found, sizes = ngram_buckets(batch.column("text"), len(shared.value))
            sums = np.r_[0.0, np.cumsum(shared.value[found], dtype=np.float64)]
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums[ends] - sums[ends - sizes])], ["doc_id", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by histograms of ever narrower ranges; None without that many rows."""
    ends = rows.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if k < 1 or ends.n < k:
        return None
    low, high, above, inside = ends.low, ends.high, 0, ends.n
    value = F.col(column)
    while inside > FEW and low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.lit(BINS - 1), F.floor((value - low) / width)) if width > 0 else F.lit(0)
        found = rows.filter((value >= low) & (value <= high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r.bin):  # at most BINS rows
            if above + r.n >= k:
                break
            above += r.n
        low, high, inside = r.low, r.high, r.n
    if low == high:
        return low
    values = sorted((r[0] for r in rows.filter((value >= low) & (value <= high)).select(column).collect()), reverse=True)
    return values[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.75, seed: int = 7, max_target: int = MAX_TARGET, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """The drawn documents: doc_id, log_weight, gumbel_key and kept (true).

    ``labels`` has doc_id, quality and toxic; good ones (1 and 0) are the target, at most
    ``max_target`` of them, by the order of a hash. ``fraction`` of all rows with a doc_id is drawn, rounded up. Rows of
    one key (repeated rows) are drawn together. Null labels are no target; without any target all
    weights are equal; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    work = work_dir(spark, "resampling")
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    target = written(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).withColumn("target", F.lit(True)), f"{work}/target")
    base = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), lower_ascii(F.col("text")).alias("text"))
    marked = base.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    rows = _counts(marked, buckets).groupBy("slice").applyInArrow(_added, "slice int, raw binary, target binary").collect()  # SLICES rows
    raw, aim = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    size = buckets // SLICES
    for r in rows:
        raw[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.raw, "<i8")
        aim[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.target, "<i8")
    ratios = log_ratios(raw, aim, prior) if aim.sum() else np.zeros(buckets, np.float32)
    # 53 bits of a hash give a number strictly between 0 and 1
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = log_weights(base, ratios).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    scored = written(scored, f"{work}/scored")
    n = scored.count()
    least = kth_largest(scored, "gumbel_key", -int(-n * fraction // 1))
    drawn = scored.filter(F.col("gumbel_key") >= least) if least is not None else scored.filter("false")
    return drawn.withColumn("kept", F.lit(True))
