import random
import uuid
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillguard.functions.lineage import cut, shared_dir
from quillguard.operators import throttle
from quillguard.plans import catalog
from quillguard.sources import sinks
from quillguard.streaming import jobs

START = datetime(2024, 1, 1)


def folder(spark):
    return f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"


def write_batches(df, path, order, n):
    """``n`` files in time order, so that a stream of one file per batch sees them in order."""
    total = df.count()
    rows = sorted(df.collect(), key=lambda r: r[order])
    for i in range(n):
        part = rows[i * total // n : (i + 1) * total // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_throttle_over_several_batches(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), START + timedelta(seconds=rng.randint(0, 300), microseconds=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    path = folder(spark)
    write_batches(df, path, "ts", 4)
    out = jobs.stream_throttle(source(spark, df, path), "key", "ts", "id", 3, 20, idle_ms=None)
    got = {r["id"]: r["allowed"] for r in jobs.run_to_files(out, folder(spark)).collect()}
    batch = throttle.throttle_admitted(df, "key", limit=3, window_s=20)
    assert got == {r["id"]: r["allowed"] for r in batch.collect()}


def test_throttle_state_expires(spark):
    df = spark.createDataFrame([(1, "a", START)], "id int, key string, ts timestamp")
    path = folder(spark)
    write_batches(df, path, "ts", 1)
    judged = jobs.stream_throttle(source(spark, df, path), "key", "ts", "id", 1, 1, idle_ms=1)
    query = judged.writeStream.format("noop").outputMode("append").start()
    totals = []
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            if 1 in totals and totals[-1] == 0:
                break
    finally:
        query.stop()
    assert 1 in totals and totals[-1] == 0


def test_budget_restarts_with_the_month_and_ignores_older_rows(spark):
    rows = [
        (1, "u", "llm", 6.0, datetime(2024, 1, 30), 10.0),
        (2, "u", "llm", 3.5, datetime(2024, 1, 31), 10.0),
        (3, "u", "purchase", 2.0, datetime(2024, 2, 1), 10.0),
        (4, "u", "llm", 8.5, datetime(2024, 2, 2), 10.0),
    ]
    late = [(5, "u", "llm", 9.5, datetime(2024, 1, 1), 10.0), (6, "u", "llm", 0.1, datetime(2024, 2, 3), None)]
    ddl = "id int, user_id string, transaction_type string, amount double, created_at timestamp, monthly_limit double"
    df = spark.createDataFrame(rows, ddl)
    path = folder(spark)
    write_batches(df, path, "id", 2)
    write_batches(spark.createDataFrame(late, ddl), path, "id", 1)
    out = jobs.stream_budget(source(spark, df, path), "user_id", "created_at", "id")
    got = {r["id"]: (r["spent_before"], r["verdict"]) for r in jobs.run_to_files(out, folder(spark)).collect()}
    assert got == {
        1: (0.0, "budget_ok"),
        2: (6.0, "budget_warning"),
        3: (0.0, "budget_ok"),
        4: (2.0, "budget_exceeded"),
        5: (0.0, "budget_warning"),
        6: (10.5, "budget_exceeded"),
    }


def test_dedupe_across_batches(spark):
    rows = [(k, START + timedelta(seconds=i)) for i, k in enumerate("aabca")]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    path = folder(spark)
    write_batches(df, path, "ts", 3)
    out = jobs.run_to_files(jobs.stream_dedupe(source(spark, df, path), ["k"], "ts", "1 hour"), folder(spark))
    assert sorted(r["k"] for r in out.collect()) == ["a", "b", "c"]


def test_counts_drop_rows_past_the_watermark(spark):
    day = timedelta(days=1)
    rows = [("x", START), ("x", START + day), ("x", START + 3 * day), ("x", START + 3 * day + day / 24)]
    late = [("x", START + timedelta(minutes=1)), ("x", START + 4 * day)]
    ddl = "k string, ts timestamp"
    df = spark.createDataFrame(rows, ddl)
    path = folder(spark)
    write_batches(df, path, "ts", 4)
    write_batches(spark.createDataFrame(late, ddl), path, "ts", 1)
    out = jobs.run_to_files(jobs.stream_counts(source(spark, df, path), "ts", ["k"]), folder(spark))
    assert {(r["window_start"], r["n"]) for r in out.collect()} == {(START, 1), (START + day, 1)}


def test_large_amounts_are_exact(spark):
    rows = [(1, 7, "purchase", 3e12, START, 1e13), (2, 7, "llm", 0.1, START, 1e13), (3, 7, "llm", 0.2, START, 1e13)]
    df = spark.createDataFrame(rows, "id int, user int, transaction_type string, amount double, at timestamp, monthly_limit double")
    path = folder(spark)
    write_batches(df, path, "id", 3)
    out = jobs.run_to_files(jobs.stream_budget(source(spark, df, path), "user", "at", "id"), folder(spark))
    assert {r["id"]: (r["spent_before"], r["verdict"]) for r in out.collect()} == {
        1: (0.0, "budget_ok"), 2: (3e12, "budget_ok"), 3: (3000000000000.1, "budget_ok"),
    }


def test_decisions_follow_the_policy_of_their_batch(spark):
    rows = [(i, "chat", "ingress", "t", "p") for i in range(4)]
    df = spark.createDataFrame(rows, "id int, tool string, direction string, raw_text string, policy_key string")
    path, out = folder(spark), folder(spark)
    write_batches(df, path, "id", 2)
    versions = iter(['{"defaults":{"ingress":{"action":"deny"}}}', '{"defaults":{"ingress":{"action":"pass_through"}}}'])

    def load():
        table = spark.createDataFrame([("p", next(versions), "payload")], "policy_key string, doc string, form string")
        return table, "{}"

    def write(batch, batch_id):
        batch.select("id", "decision").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = jobs.stream_decisions(source(spark, df, path), load, write)
    writer.option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: r["decision"] for r in spark.read.parquet(out).collect()}
    assert got == {0: "deny", 1: "deny", 2: "allow", 3: "allow"}


def test_a_batch_run_again_replaces_its_files(spark):
    df = spark.createDataFrame(
        [(1, "success", None), (2, "failed", "e")], "id int, status string, err string"
    ).select(F.struct("id").alias("event"), "status", "err")
    path, out = folder(spark), folder(spark)
    df.write.parquet(path)
    for _ in range(2):  # a fresh checkpoint makes the same batch number run twice
        writer = jobs.stream_sinks(spark.readStream.schema(df.schema).parquet(path), out)
        writer.option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    assert read_sinks(spark, out) == ([(1, "0")], [("e", 2, "0")])


def read_sinks(spark, out):
    good = sinks.read_committed(spark, out, "events", "json", "id int")
    bad = sinks.read_committed(spark, out, "dead_letters", "json", "err string, event struct<id:int>").select("err", "event.id", "run")
    return sorted(map(tuple, good.collect())), sorted(map(tuple, bad.collect()))


def test_a_job_killed_between_two_sinks_shows_neither(spark):
    out = folder(spark)
    good = lambda n: lambda where: spark.createDataFrame([(n,)], "id int").write.json(where)
    bad = lambda n: lambda where: spark.createDataFrame([("e", (n,))], "err string, event struct<id:int>").write.json(where)

    def killed(where):
        raise KeyboardInterrupt

    sinks.commit_together(spark, out, "0", {"events": good(1), "dead_letters": bad(2)})
    with pytest.raises(KeyboardInterrupt):
        sinks.commit_together(spark, out, "1", {"events": good(3), "dead_letters": killed})
    assert read_sinks(spark, out) == ([(1, "0")], [("e", 2, "0")])
    with pytest.raises(KeyboardInterrupt):  # a second attempt at a committed run
        sinks.commit_together(spark, out, "0", {"events": good(7), "dead_letters": killed})
    assert read_sinks(spark, out) == ([(1, "0")], [("e", 2, "0")])
    sinks.commit_together(spark, out, "1", {"events": good(3), "dead_letters": bad(4)})
    assert read_sinks(spark, out) == ([(1, "0"), (3, "1")], [("e", 2, "0"), ("e", 4, "1")])


def test_checkpoint_goes_where_the_session_says(spark):
    where = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == where
    kept = cut(spark.range(5).repartition(2))
    assert kept.count() == 5 and kept.rdd is not None


@pytest.mark.parametrize("name", ["stream_throttle", "stream_budget", "stream_counts"])
def test_replay_equals_batch(spark, small, name):
    catalog.load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    got = catalog.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    plain = lambda r: tuple(x.replace(tzinfo=None) if isinstance(x, datetime) else x for x in r)
    assert sorted(map(plain, got.select(*columns).collect())) == sorted(map(plain, want)) and want


def test_a_million_rows_of_one_key_in_one_batch(spark):
    n = 1_000_000
    rows = spark.range(n).select("id", F.lit("hot").alias("key"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000).alias("ts"))
    path = folder(spark)
    rows.repartition(4, F.xxhash64("id")).write.parquet(path)
    log = spark.readStream.schema(rows.schema).parquet(path)
    out = jobs.run_to_files(jobs.stream_throttle(log, "key", "ts", "id", 7, 1, idle_ms=None), folder(spark))
    assert out.count() == n
    assert [r.id for r in out.filter("allowed AND id < 3000").orderBy("id").collect()] == [*range(7), *range(1000, 1007), *range(2000, 2007)]
    assert out.filter("allowed").count() == 7 * (n // 1000)


def test_budget_state_expires(spark):
    df = spark.createDataFrame([(1, "u", 6.0, START, 10.0)], "id int, user string, amount double, at timestamp, monthly_limit double")
    path = folder(spark)
    write_batches(df, path, "id", 1)
    query = jobs.stream_budget(source(spark, df, path), "user", "at", "id", idle_ms=1).writeStream.format("noop").outputMode("append").start()
    totals = []
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            if 1 in totals and totals[-1] == 0:
                break
    finally:
        query.stop()
    assert 1 in totals and totals[-1] == 0


def test_rows_without_a_time(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", START), (3, None, START)], "id int, key string, ts timestamp")
    path = folder(spark)
    write_batches(df, path, "id", 1)
    out = jobs.run_to_files(jobs.stream_throttle(source(spark, df, path), "key", "ts", "id", 1, 20, idle_ms=None), folder(spark))
    assert sorted((r.id, r.key, r.us is None, r.allowed) for r in out.collect()) == [(1, "a", True, False), (2, "a", False, True), (3, None, False, True)]


@pytest.mark.parametrize("name,tables", [("stream_decisions", ["conversations", "supplier"]), ("stream_dedupe", ["events"])])
def test_streams_read_tables_that_are_folders(spark, small, tmp_path, name, tables):
    for table in tables:
        spark.read.parquet(f"{small}/{table}.parquet").repartition(2).write.parquet(str(tmp_path / f"{table}.parquet"))
    catalog.load()
    run = catalog.QUERIES[name]
    got, want = (sorted(map(tuple, run(spark, sf).collect())) for sf in (str(tmp_path), small))
    assert got == want and got


def test_state_of_a_key_is_read_and_set_once_a_batch():
    held, asked = {}, []

    class Value:
        def __init__(self, name):
            self.name = name

        def get(self):
            asked.append("get")
            return held.get(self.name)

        def update(self, value):
            asked.append("update")
            held[self.name] = value

    class Handle:
        def getValueState(self, name, schema, ttl=None):
            return Value(name)

    processor = jobs._Throttle("key", 3, 10, None)
    processor.init(Handle())
    allowed = []
    for us in ([0, 1, 2, 3], [4, 10_000_000, 10_000_001]):
        part = pd.DataFrame({"key": "a", "id": us, "us": us})
        for out in processor.handleInputRows(("a",), iter([part]), None):
            allowed += out["allowed"].tolist()
    assert allowed == [True, True, True, False, False, True, True]
    assert asked == ["get", "update"] * 2
