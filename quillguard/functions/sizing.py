"""Size checks that decide between physical strategies before a large job starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A broadcast side may have at most this many bytes by the plan's own estimate; beyond it no hint is
# given: adaptive execution decides by the bytes measured, and splits skewed partitions.
MAX_BROADCAST_BYTES = 16 << 20

# Inputs up to this estimated size may be shuffled once to use all cores.
MAX_SPREAD_BYTES = 1 << 30

# A task of heavy per-row work gets at most about this much of its input, as the plan estimates it.
TASK_BYTES = 4 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the plan's own estimate. Starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(*inputs: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for heavy work over given tables: one per core, and more as they grow, so that the
    work of one task does not grow with them."""
    cores = inputs[0].sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-sum(map(estimated_bytes, inputs)) // task_bytes))


def broadcast_if_small(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast by the estimated bytes of a given table. Starts no job."""
    return F.broadcast(small) if estimated_bytes(small) <= max_bytes else small


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give heavy per-row work over a small input one partition per core, or more (``pieces``).

    A scan with fewer splits than cores (one small file, one row group) would run the text
    expressions in a few tasks. Inputs above ``MAX_SPREAD_BYTES`` have splits enough and are never
    shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) > MAX_SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(pieces(df), *keys)
