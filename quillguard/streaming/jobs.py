"""Structured Streaming jobs: decisions, throttling, budgets, counts, deduplication and sinks.

Stateless steps reuse the batch operators. The two jobs with order-dependent state are stateful
processors: one value per key in the state store, dropped when its time to live is over. It is asked
for once and set once in each batch that has rows of the key, as each request goes to another process. They
judge the rows of a micro-batch in time order, and hold a few numbers for each of a key's rows; the
trigger's input limits (files or offsets per batch) bound how many one key can bring at once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from quillguard.functions.money import MONEY, MONEY_DECIMALS
from quillguard.functions.shipping import ship
from quillguard.functions.times import micros
from quillguard.operators import analytics
from quillguard.operators.decide import check_pass
from quillguard.operators.throttle import NO_TIME, admit_stretch
from quillguard.sources import sinks

# Fixed value: throttle state of a key is dropped after this long without a row.
IDLE_MS = 3_600_000

# Longer than any month.
MONTH_MS = 32 * 86_400_000

# Rows that a stateful job sends on at once.
PART_ROWS = 50_000

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The budget of a user who has none, and the warning level.
_DEFAULT_LIMIT = 10.0
_WARNING_SHARE = 0.9


def stream_decisions(
    requests: DataFrame,
    load_policies: Callable[[], tuple[DataFrame | None, str]],
    write: Callable[[DataFrame, int], None],
    **options,
) -> DataStreamWriter:
    """Decide a stream of requests. ``load_policies`` is called for every micro-batch and returns the
    policy table and the static policy then in force; ``write`` stores the batch's decisions."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        policies, static_policy = load_policies()
        write(check_pass(batch, policies, static_policy, **options), batch_id)

    return requests.writeStream.foreachBatch(judge)


class _Ordered(StatefulProcessor):
    """Judges the rows of a key in time order. Parts of a micro-batch are read one by one; of each only
    the numbers that are judged by are kept, and the rows come out again in parts of ``PART_ROWS``."""

    def __init__(self, key: str, numbers: Sequence[str], idle_ms: int | None):
        self.key, self.numbers, self.idle_ms = key, tuple(numbers), idle_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts: dict[str, list[np.ndarray]] = {c: [] for c in ("id", *self.numbers)}
        for part in rows:
            for c, held in parts.items():
                held.append(part[c].to_numpy())
        held = {c: np.concatenate(parts.pop(c)) for c in tuple(parts)}
        ids = held["id"]
        places = pd.factorize(ids, sort=True)[0] if ids.dtype == object else ids
        order = np.lexsort((places, held[self.numbers[0]]))
        for c in tuple(held):
            held[c] = held[c][order]
        judged = self.judge({c: held[c] for c in self.numbers})
        for at in range(0, len(order), PART_ROWS):
            part = slice(at, at + PART_ROWS)
            n = len(held["id"][part])
            yield pd.DataFrame({self.key: [key[0]] * n, "id": held["id"][part], **{c: v[part] for c, v in judged.items()}})

    def judge(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """New columns for rows in time order; brings the state up to date."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Throttle(_Ordered):
    def __init__(self, key: str, limit: int, window_s: int, idle_ms: int | None):
        super().__init__(key, ["us"], idle_ms)
        self.limit, self.width = limit, int(window_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "at binary", self.idle_ms)

    def judge(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        times = rows["us"]
        allowed = np.zeros(len(times), bool)
        timed = times != NO_TIME
        if self.limit > 0 and self.width > 0 and timed.any():
            held = self.recent.get()
            recent = deque(np.frombuffer(held[0], np.int64).tolist() if held else ())
            allowed[timed] = admit_stretch(times[timed], recent, self.limit, self.width)
            self.recent.update((np.array(recent, np.int64).tobytes(),))
        return {"us": times, "allowed": allowed}


class _Budget(_Ordered):
    def __init__(self, user: str, idle_ms: int | None):
        super().__init__(user, ["us", "month", "whole", "part", "monthly_limit"], idle_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "month bigint, whole bigint, part bigint", self.idle_ms)

    def judge(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        unit = 10**MONEY_DECIMALS
        month, *kept = self.spent.get() or (-1, 0, 0)
        months = rows["month"]
        latest = np.maximum.accumulate(np.maximum(months, month))  # the month that is current at each row
        current = months == latest
        before, after = [], []
        for own, held in zip((rows["whole"], rows["part"]), kept):
            sums = pd.Series(np.where(current, own, 0)).groupby(latest).cumsum().to_numpy()
            before.append(np.where(current, np.where(latest == month, held, 0) + sums - own, 0))
            after.append(before[-1] + own)
        projected, limits = _as_float(*after), rows["monthly_limit"]
        verdicts = np.select([projected > limits, projected > _WARNING_SHARE * limits], ["budget_exceeded", "budget_warning"], "budget_ok")
        if latest[-1] != month:
            month, kept = int(latest[-1]), (0, 0)
        of_month = current & (latest == month)
        total = [held + int(rows[c][of_month].sum()) for c, held in zip(("whole", "part"), kept)]
        self.spent.update((month, total[0] + total[1] // unit, total[1] % unit))
        return {"spent_before": _as_float(*before), "verdict": verdicts}


def _with_state(rows: DataFrame, key: str, processor: _Ordered, columns: str) -> DataFrame:
    """Run ``processor`` for each key of a stream. Times to live need the store that keeps
    state on disk; it is set for the session's queries that start from here on."""
    ship(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    key_type, id_type = (rows.schema[c].dataType.simpleString() for c in (key, "id"))
    schema = f"`{key}` {key_type}, id {id_type}, {columns}"
    time_mode = "None" if processor.idle_ms is None else "ProcessingTime"
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode)


def stream_throttle(
    log: DataFrame, key: str, ts_col: str, id_col: str, limit: int, window_s: int, idle_ms: int | None = IDLE_MS
) -> DataFrame:
    """Throttle by admitted rows. State per key: the times of the last ``limit`` admissions, as one value. Rows of a batch
    are judged in time order; a row older than those of earlier batches meets the state as it is, one
    without a time is not allowed.

    The value lives ``idle_ms``, or a whole window if that is longer, from its last change. Times to live
    keep a query alive, so pass None where the query should end by itself (``availableNow``).
    """
    narrow = log.select(key, F.col(id_col).alias("id"), F.coalesce(micros(log, ts_col), F.lit(NO_TIME)).alias("us"))
    alive = None if idle_ms is None else max(idle_ms, int(window_s * 1000))
    judged = _with_state(narrow, key, _Throttle(key, limit, window_s, alive), "us bigint, allowed boolean")
    return judged.withColumn("us", F.when(F.col("us") != NO_TIME, F.col("us")))


def stream_budget(transactions: DataFrame, user: str, time_col: str, id_col: str, idle_ms: int | None = None) -> DataFrame:
    """Running spend of the month per user, and what a budget check says when each row arrives.

    Needs ``amount`` and ``monthly_limit``. State per user: the current month and its spend, as whole
    and decimal parts in integers, so that sums are exact over the range of ``MONEY``. A row of an earlier
    month is judged against nothing spent and leaves the current month alone; one without a time counts
    for month 0. With ``idle_ms`` the state of a user without rows for so long is dropped; let it be
    longer than a month (``MONTH_MS``). Times to live keep a query alive, as for ``stream_throttle``.
    """
    unit = 10**MONEY_DECIMALS
    exact = F.coalesce(F.col("amount").cast(MONEY), F.lit(0).cast(MONEY))
    whole = F.floor(exact)
    narrow = transactions.select(
        user,
        F.col(id_col).alias("id"),
        F.coalesce(micros(transactions, time_col), F.lit(NO_TIME)).alias("us"),
        F.coalesce(F.year(time_col) * 12 + F.month(time_col) - 1, F.lit(0)).cast("bigint").alias("month"),
        whole.cast("bigint").alias("whole"),
        ((exact - whole) * F.lit(unit)).cast("bigint").alias("part"),
        F.coalesce("monthly_limit", F.lit(_DEFAULT_LIMIT)).alias("monthly_limit"),
    )
    return _with_state(narrow, user, _Budget(user, idle_ms), "spent_before double, verdict string")


def _as_float(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Amounts of whole and decimal parts; small ones are divided once, so that they round once."""
    unit = 10**MONEY_DECIMALS
    whole, part = whole + part // unit, part % unit
    small = np.abs(whole) < 2**53 // unit
    return np.where(small, (np.where(small, whole, 0) * unit + part) / unit, whole + part / unit)


def stream_counts(
    rows: DataFrame, time_col: str, by: Sequence[str], width: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Counts per label set in tumbling windows; rows past the watermark are dropped."""
    return (
        rows.withWatermark(time_col, lateness)
        .groupBy(F.window(time_col, width).alias("w"), *by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), *by, "n")
    )


def stream_histogram(
    rows: DataFrame,
    time_col: str,
    value: str,
    by: Sequence[str],
    width: str = "1 day",
    lateness: str = "1 hour",
    bounds: Sequence[float] = analytics.DURATION_BOUNDS,
) -> DataFrame:
    """Cumulative bucket counts, sum and count per label set in tumbling windows."""
    windowed = rows.withWatermark(time_col, lateness).withColumn("w", F.window(time_col, width))
    buckets = analytics.latency_histogram(windowed, value, ["w", *by], bounds)
    return buckets.select(F.col("w.start").alias("window_start"), *by, "le", "cum_count", "total", "n")


def stream_dedupe(events: DataFrame, keys: Sequence[str], time_col: str, lateness: str = "1 day") -> DataFrame:
    """First arrival per key within the watermark."""
    return events.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(list(keys))


def stream_sinks(outcomes: DataFrame, path: str) -> DataStreamWriter:
    """Write delivered events and dead letters of each micro-batch, both or neither: readers take the
    committed ones (``sinks.read_committed``). A batch that is run again repeats nothing.

    ``outcomes`` has ``event`` (struct), ``status`` and ``err``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        good = kept.filter("status = 'success'").select("event.*")
        failed = sinks.dead_letter_lines(kept.filter("status = 'failed'"))
        writers = {
            "events": lambda folder: good.write.option("ignoreNullFields", "false").json(folder),
            "dead_letters": lambda folder: failed.write.text(folder),
        }
        try:
            sinks.commit_together(batch.sparkSession, path, str(batch_id), writers)
        finally:
            kept.unpersist()

    return outcomes.writeStream.foreachBatch(write)


def run_to_files(df: DataFrame, path: str) -> DataFrame:
    """Run an append-mode stream over everything available, into a folder, and read it back."""
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{path}/rows")
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def run_updates(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Run an update-mode stream over everything available and read its result back: of each key the
    row of the last micro-batch that changed it, open windows included."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/state")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return newest.select(*keys, "last.*").select(*df.columns)
