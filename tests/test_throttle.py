import random
import re
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillguard.operators import throttle

START = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(
        [(i, k, START + timedelta(microseconds=us)) for i, (k, us) in enumerate(rows)], "id int, key string, ts timestamp"
    )


def random_rows(n=1200, hot=0.6, span=40_000_000, seed=5):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < hot else f"k{rng.randint(0, 3)}", rng.randint(0, span) // 250_000 * 250_000)
        for _ in range(n)
    ]


def attempts(rows, limit, width):
    out, seen = {}, {}
    for i, (k, us) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        past = seen.setdefault(k, [])
        prior = sum(t > us - width for t in past)
        out[i] = (prior, prior < limit)
        past.append(us)
    return out


def admitted(rows, limit, width):
    out, seen = {}, {}
    for i, (k, us) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        q = seen.setdefault(k, deque())
        while q and q[0] <= us - width:
            q.popleft()
        out[i] = len(q) < limit
        if out[i]:
            q.append(us)
    return out


def test_window_expiry(spark):
    df = log(spark, [("k", 1000_000_000), ("k", 1000_000_000), ("k", 1011_000_000), ("k", 1021_000_000)])
    out = throttle.throttle_admitted(df, "key", limit=1, window_s=10).orderBy("id").collect()
    assert [r["allowed"] for r in out] == [True, False, True, True]


def test_rejected_attempts_count_only_in_the_attempts_log(spark):
    df = log(spark, [("k", s * 1_000_000) for s in (0, 6, 12, 18)])
    by_attempts = throttle.throttle_attempts(df, "key", limit=1, window_s=10).orderBy("id").collect()
    by_admitted = throttle.throttle_admitted(df, "key", limit=1, window_s=10).orderBy("id").collect()
    assert [r["allowed"] for r in by_attempts] == [True, False, False, False]
    assert [r["allowed"] for r in by_admitted] == [True, False, True, False]


@pytest.mark.parametrize("limit, window", [(0, 10), (-1, 10), (5, 0), (5, -1)])
def test_no_limit_or_window_rejects_all(spark, limit, window):
    df = log(spark, [("k", 0), ("k", 1)])
    for run in (throttle.throttle_attempts, throttle.throttle_admitted):
        assert not any(r["allowed"] for r in run(df, "key", limit=limit, window_s=window).collect())


@pytest.mark.parametrize("limit, window", [(1, 2), (3, 5), (7, 1), (40, 3)])
def test_against_brute_force(spark, limit, window):
    rows = random_rows()
    df = log(spark, rows).repartition(3)
    width = window * 1_000_000
    got = throttle.throttle_attempts(df, "key", limit=limit, window_s=window).collect()
    assert {r["id"]: (r["prior"], r["allowed"]) for r in got} == attempts(rows, limit, width)
    got = throttle.throttle_admitted(df, "key", limit=limit, window_s=window).collect()
    assert {r["id"]: r["allowed"] for r in got} == admitted(rows, limit, width)


def test_a_stretch_may_span_many_batches(spark):
    rows = random_rows(n=700, hot=1.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = throttle.throttle_admitted(log(spark, rows), "key", limit=3, window_s=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: r["allowed"] for r in got} == admitted(rows, 3, 4_000_000)


def test_calm_and_busy_times_of_one_key(spark):
    rng = random.Random(8)
    rows = [("k", rng.randint(0, 3_000) * 100_000 if rng.random() < 0.3 else rng.choice([20, 21, 150, 290]) * 1_000_000 + rng.randint(0, 2_000_000)) for _ in range(600)]
    got = throttle.throttle_admitted(log(spark, rows), "key", limit=5, window_s=3).collect()
    assert {r["id"]: r["allowed"] for r in got} == admitted(rows, 5, 3_000_000)


def test_null_and_repeated_ids_keys_and_missing_times(spark):
    rows = [(None, "a", 1), (None, "a", 2), (7, "a", 3), (7, "a", 3), (2**60 + 1, None, 1), (2**60 + 3, None, 2), (9, "a", None)]
    df = spark.createDataFrame(
        [(i, k, s if s is None else START + timedelta(seconds=s), "x") for i, k, s in rows], "id bigint, key string, ts timestamp, note string"
    )
    out = throttle.throttle_attempts(df, "key", limit=2, window_s=10).collect()
    assert sorted((r["key"] or "", r["prior"], r["allowed"]) for r in out if r["ts"]) == [
        ("", 0, True), ("", 1, True), ("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 3, False)
    ]
    assert [(r["prior"], r["allowed"]) for r in out if r["ts"] is None] == [(None, False)]
    got = throttle.throttle_admitted(df, "key", limit=2, window_s=10).collect()
    assert sorted((str(r["id"]), r["allowed"]) for r in got) == [
        ("1152921504606846977", True), ("1152921504606846979", True), ("7", False), ("7", False), ("9", False), ("None", True), ("None", True)
    ]
    assert {r["note"] for r in got} == {"x"} and got[0].__fields__ == ["id", "key", "ts", "note", "allowed"]


def test_admit_stretch_carries_its_state():
    times = np.array(sorted(random.Random(1).randint(0, 10_000) for _ in range(500)), dtype=np.int64)
    whole = throttle.admit_stretch(times, deque(), 5, 700)
    recent: deque = deque()
    parts = [throttle.admit_stretch(times[i : i + 37], recent, 5, 700) for i in range(0, 500, 37)]
    assert np.array_equal(np.concatenate(parts), whole) and len(recent) <= 5


def test_report_and_key(spark):
    df = spark.createDataFrame([("e", "u", "k"), ("e", None, "k"), ("e", "", "k")], "e string, u string, k string")
    keys = [r[0] for r in df.select(throttle.throttle_key(F.col("e"), F.col("u"), F.col("k"))).collect()]
    assert keys == ["e:u", "e:key:k", "e:key:k"]
    judged = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", False)], "key string, allowed boolean")
    rows = throttle.throttle_report(judged, "key", top=2).collect()
    assert [tuple(r) for r in rows] == [("a", 2, 1, 0.5), ("c", 1, 1, 1.0)]


def test_quota(spark):
    days = [datetime(2024, 1, 30), datetime(2024, 1, 31), datetime(2024, 1, 31), datetime(2024, 2, 1)]
    usage = spark.createDataFrame([("u", d) for d in days] + [("v", days[0])], "user_id string, created_at timestamp")
    quotas = spark.createDataFrame([("u", 1, 2)], "user_id string, daily_limit int, monthly_limit int")
    out = {(r["user_id"], r["day"].day): (r["daily"], r["monthly"], r["over_daily"], r["over_monthly"]) for r in throttle.quota_usage(usage, quotas).collect()}
    assert out == {
        ("u", 30): (1, 1, False, False),
        ("u", 31): (2, 3, True, True),
        ("u", 1): (1, 1, False, False),
        ("v", 30): (1, 1, False, False),
    }


def test_rows_of_a_hot_key_stay_spread(spark):
    """Only counts by instant meet in the run of a key; its rows, with all they carry, are dealt by instant."""
    rng = random.Random(3)
    rows = [("hot", rng.randint(0, 50_000) * 1000) for _ in range(6000)]
    df = log(spark, rows).withColumn("payload", F.lit("x" * 50))
    out = throttle.throttle_admitted(df, "key", limit=9, window_s=2)
    assert {r["id"]: r["allowed"] for r in out.collect()} == admitted(rows, 9, 2_000_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    judged = re.search(r"MapInArrow run\(([^)]*)\)", plan).group(1)
    assert "_run" in judged and "payload" not in judged
    assert out.filter("allowed").count() < 400
