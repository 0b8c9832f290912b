"""Shared folders, bounded text batches and white-space words for the operators of this package."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.functions.lineage import shared_dir
from quillguard.functions.shipping import ship

# Characters that part words, as a class of Java, Python and RE2 patterns alike.
SPACE = r"[\x20\x09-\x0D]"

# Text bytes that a task turns into arrays at once; a longer single text is taken alone.
BATCH_BYTES = 4 << 20


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables that cut the lineage of a job."""
    ship(spark)
    return f"{shared_dir(spark).rstrip('/')}/quillguard-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: a lost executor repeats no earlier step."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, and let the driver find the shuffle files that no
    table needs: executors drop those once the driver has collected its garbage, the second time after
    its listeners have let go of the last job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(conf).delete(path, True)
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all other characters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes in ``column``, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text (null: none)."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pieces.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), out=bounds[1:])
    seen = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=seen[1:])
    return flat.filter(pa.array(full)), np.diff(seen[bounds])


def joined(flat: pa.Array, counts: np.ndarray) -> list[bytes]:
    """The words of each text joined by one space, as UTF-8."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
    return pc.cast(pc.binary_join(lists, " "), pa.binary()).to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total, dtype=out.dtype)
    return out


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
