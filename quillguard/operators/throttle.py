"""Sliding-window throttling and quotas over request logs."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quillguard.functions.shipping import ship
from quillguard.functions.sizing import broadcast_if_small
from quillguard.functions.times import micros

# Fixed values.
DEFAULT_LIMIT = 100
DEFAULT_WINDOW_S = 60
DEFAULT_DAILY_LIMIT = 1000
DEFAULT_MONTHLY_LIMIT = 30000

# The place of rows without a time, before all others.
NO_TIME = -(1 << 62)


def throttle_key(endpoint: Column, user: Column, api_key: Column) -> Column:
    """Endpoint and user, or endpoint and API key where the user is unknown."""
    known = F.coalesce(user, F.lit("")) != ""
    return F.concat(endpoint, F.lit(":"), F.when(known, user).otherwise(F.concat(F.lit("key:"), api_key)))


def _slotted(log: DataFrame, key: str, ts_col: str, width: int) -> DataFrame:
    """Rows by time slots as long as the window, each row (``_lag`` 0) beside a copy of its key and
    time in the slot after (``_lag`` 1): the window before a row lies within its slot. A hot key is
    thus spread over its slots. Rows without a time share a slot of their own."""
    at = F.coalesce(micros(log, ts_col), F.lit(NO_TIME))
    own = F.col("_lag") == 0
    both = log.withColumns({"_us": at, "_lag": F.explode(F.array(F.lit(0), F.lit(1)))})
    slot = F.expr(f"(_us - pmod(_us, {width}L)) div {width}L + _lag")
    return both.select(
        *[F.col(c) if c == key else F.when(own, F.col(c)).alias(c) for c in log.columns],
        "_us",
        "_lag",
        slot.alias("_slot"),
    )


def _prior(slotted: DataFrame, key: str, id_col: str, width: int) -> DataFrame:
    """Attempts so far in the slot minus those that have left the window. Both frames only ever
    grow, so the work is linear however many rows a window holds; a sliding frame would be read
    again per row."""
    so_far = Window.partitionBy(key, "_slot").orderBy("_us", id_col)
    gone = Window.partitionBy(key, "_slot").orderBy("_us").rangeBetween(Window.unboundedPreceding, -width)
    return slotted.withColumn("_n", F.row_number().over(so_far)).withColumn(
        "prior", F.col("_n") - 1 - F.count("*").over(gone)
    )


def throttle_attempts(
    log: DataFrame,
    key: str,
    ts_col: str = "ts",
    id_col: str = "id",
    limit: int = DEFAULT_LIMIT,
    window_s: int = DEFAULT_WINDOW_S,
) -> DataFrame:
    """Count every attempt in the window before each row, rejected ones included; allow below
    ``limit``. Rows of one instant count in ``id`` order, those of one ``id`` in any. A row without
    a time has no ``prior`` and is not allowed."""
    if window_s <= 0:
        return log.withColumns({"prior": F.lit(0).cast("bigint"), "allowed": F.lit(False)})
    width = int(window_s * 1_000_000)
    counted = _prior(_slotted(log, key, ts_col, width), key, id_col, width).filter("_lag = 0")
    prior = F.when(F.col("_us") != NO_TIME, F.col("prior"))
    allowed = F.lit(limit > 0) & F.coalesce(prior < limit, F.lit(False))
    return counted.select(*log.columns, prior.alias("prior"), allowed.alias("allowed"))


def throttle_admitted(
    log: DataFrame,
    key: str,
    ts_col: str = "ts",
    id_col: str = "id",
    limit: int = DEFAULT_LIMIT,
    window_s: int = DEFAULT_WINDOW_S,
) -> DataFrame:
    """Allow a row while fewer than ``limit`` admitted rows lie in the window before it.

    What is judged is how many rows of a key and instant are admitted, so rows are first counted by
    instant, combined in each task. An instant before whose last row fewer than ``limit`` attempts lie
    is admitted whatever came earlier. Slots that hold others are busy; only runs of consecutive busy
    slots must be read in order, beginning with the instants of the calm slot before, all of them
    admitted. Each run is read as a stream in time order; a task holds the last ``limit`` admissions and
    one batch, never a whole group. The rows themselves stay spread by key and instant, and the first
    ones by ``id`` take what their instant was given. A row without a time is not allowed.

    A key over the limit without a break is one run, whose counts (not rows) go through one task: the
    window's phase carries over from each admission to the next, however far.
    """
    if limit <= 0 or window_s <= 0:
        return log.withColumn("allowed", F.lit(False))
    ship(log.sparkSession)
    width = int(window_s * 1_000_000)
    at = F.coalesce(micros(log, ts_col), F.lit(NO_TIME))
    instants = log.select(F.col(key).alias("_key"), at.alias("_us")).groupBy("_key", "_us").agg(F.count("*").alias("_n"))
    given = _given(instants.filter(F.col("_us") != NO_TIME), limit, width).withColumnRenamed("_key", key)

    # what an instant was given enters as a row beside its own, so rows are dealt out once
    met = log.withColumns({"_us": at, "_own": F.lit(True)}).unionByName(given, allowMissingColumns=True)
    instant = Window.partitionBy(key, "_us")
    nth = F.row_number().over(instant.orderBy(F.col("_own").desc_nulls_last(), id_col))
    counted = met.withColumns({"_nth": nth, "_given": F.max("_given").over(instant)}).filter("_own")
    allowed = (F.col("_us") != NO_TIME) & F.coalesce(F.col("_nth") <= F.col("_given"), F.lit(True))
    return counted.select(*log.columns, allowed.alias("allowed"))


def _given(instants: DataFrame, limit: int, width: int) -> DataFrame:
    """How many rows are admitted of each instant in a busy slot."""
    slot = F.expr(f"(_us - pmod(_us, {width}L)) div {width}L + _lag")
    slotted = instants.withColumn("_lag", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slot", slot)
    in_slot = Window.partitionBy("_key", "_slot").orderBy("_us")
    so_far = F.sum("_n").over(in_slot)
    gone = F.coalesce(F.sum("_n").over(in_slot.rangeBetween(Window.unboundedPreceding, -width)), F.lit(0))
    counted = slotted.withColumn("_prior", so_far - 1 - gone)  # attempts before the last row of the instant

    busy = counted.filter(f"_lag = 0 AND _prior >= {limit}").select("_key", "_slot").distinct()
    island = F.col("_slot") - F.row_number().over(Window.partitionBy("_key").orderBy("_slot"))
    runs = busy.withColumn("_island", island)
    runs = runs.select("_key", "_slot", F.min("_slot").over(Window.partitionBy("_key", "_island")).alias("_first"))

    marked = slotted.unionByName(runs.withColumn("_lag", F.lit(2)), allowMissingColumns=True)
    placed = (
        marked.withColumn("_run", F.max("_first").over(Window.partitionBy("_key", "_slot")))
        .filter("_run IS NOT NULL AND (_lag = 0 OR (_lag = 1 AND _slot = _run))")
        .select("_key", "_run", "_us", "_n", "_lag")
    )
    ordered = placed.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_us")
    schema = T.StructType([placed.schema["_key"], placed.schema["_us"], placed.schema["_lag"], T.StructField("_given", T.LongType())])
    judged = ordered.mapInArrow(_admit(limit, width), schema).filter("_lag = 0")
    return judged.select("_key", "_us", "_given")


def admit_stretch(times: np.ndarray, recent: deque, limit: int, width: int) -> np.ndarray:
    """Admissions of one sorted run of times. ``recent`` holds up to ``limit`` earlier admissions
    and is updated. Jumps straight to the next time the window has room."""
    allowed = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        if len(recent) < limit or recent[0] + width <= times[i]:
            allowed[i] = True
            if len(recent) == limit:
                recent.popleft()
            recent.append(int(times[i]))
            i += 1
        else:
            i = bisect_left(times, recent[0] + width, i + 1)
    return allowed


def _admit(limit: int, width: int):
    """Admissions of each instant, for sorted instants of keys and runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, deque()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            given = np.zeros(batch.num_rows, np.int64)
            times, runs = batch.column("_us").to_numpy(), batch.column("_run").to_numpy()
            tried = np.minimum(batch.column("_n").to_numpy(), limit)  # of an instant, no more can be admitted
            keys = batch.column("_key")
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((codes[1:] != codes[:-1]) | (runs[1:] != runs[:-1])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                if (keys[lo].as_py(), runs[lo]) != current:
                    current, recent = (keys[lo].as_py(), runs[lo]), deque()
                allowed = admit_stretch(np.repeat(times[lo:hi], tried[lo:hi]), recent, limit, width)
                given[lo:hi] = np.add.reduceat(allowed, np.cumsum(tried[lo:hi]) - tried[lo:hi], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([keys, batch.column("_us"), batch.column("_lag"), pa.array(given)], ["_key", "_us", "_lag", "_given"])

    return run


def throttle_report(attempts: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Attempts, rejections and rejected share per key; with ``top``, the worst offenders only."""
    summary = attempts.groupBy(key).agg(
        F.count("*").alias("attempts"),
        F.count(F.when(~F.col("allowed"), 1)).alias("rejected"),
    )
    summary = summary.withColumn("rejected_share", F.col("rejected") / F.col("attempts"))
    return summary if top is None else summary.orderBy(F.desc("rejected"), key).limit(top)


def quota_usage(
    usage: DataFrame, quotas: DataFrame, user: str = "user_id", time_col: str = "created_at"
) -> DataFrame:
    """Requests per user and day, the month's running count, and whether either passes its limit.
    The running count runs over daily totals, at most 31 rows per user and month."""
    day, month = F.to_date(time_col), F.trunc(time_col, "month")
    daily = usage.groupBy(user, month.alias("month"), day.alias("day")).agg(F.count("*").alias("daily"))
    w = Window.partitionBy(user, "month").orderBy("day")
    counted = daily.withColumn("monthly", F.sum("daily").over(w))
    joined = counted.join(
        broadcast_if_small(quotas.select(user, "daily_limit", "monthly_limit")), user, "left"
    ).fillna({"daily_limit": DEFAULT_DAILY_LIMIT, "monthly_limit": DEFAULT_MONTHLY_LIMIT})
    return joined.withColumns(
        {
            "over_daily": F.col("daily") > F.col("daily_limit"),
            "over_monthly": F.col("monthly") > F.col("monthly_limit"),
        }
    )


__all__: Sequence[str] = (
    "admit_stretch",
    "quota_usage",
    "throttle_admitted",
    "throttle_attempts",
    "throttle_key",
    "throttle_report",
)
