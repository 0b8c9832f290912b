"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows become a hash set that every task holds; one projection turns each text into
its words, looks up the hash of every window and keeps the few that hit, with their words. Hits are
verified by joining the words themselves with the benchmark's windows. The set holds at most
``MAX_SET`` windows, which is counted first; above, all windows are joined by hash instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.llm.common import lower_ascii, work_dir, written
from quillguard.llm.quality_rules import let

WINDOW = 10
# Windows that a task holds as a set and that a join broadcasts: some 20 MB.
MAX_SET = 200_000
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD, _GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _PARTS), "")


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(n)])


def _gram(words: Column, at: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + j) for j in range(n)])


def _starts(words: Column, n: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(words) < n, none).otherwise(F.sequence(F.lit(0), F.size(words) - n))


def _windows(words: Column, n: int, *fields: str) -> Column:
    """The windows of n words, as structs of: at, n, gram, hash."""

    def of(i: Column) -> Column:
        made = {"at": i, "n": F.lit(n), "gram": _gram(words, i, n), "hash": _hash(words, i, n)}
        return F.struct(*[made[f].alias(f) for f in fields])

    return F.transform(_starts(words, n), of)


def _known_windows(words: Column, n: int, known: list[int]) -> Column:
    """at, n and gram of the windows of n words whose hash is in the set."""
    at = F.filter(_starts(words, n), lambda i: _hash(words, i, n).isin(known))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), _gram(words, i, n).alias("gram")))


def _row_key() -> Column:
    """The hash that a row of documents is known by, whatever the type of its doc_id."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n, gram, hash: distinct windows of the items. An item of fewer words is one window;
    one without words has none. Repeated items count once, a null item_id is dropped."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("w"))
    parts = []
    for n in range(1, window + 1):
        fit = F.size("w") == n if n < window else F.size("w") >= n
        parts.append(F.when(fit, _windows(F.col("w"), n, "gram", "hash")).otherwise(F.array().cast("array<struct<gram:string,hash:bigint>>")))
    size = F.least(F.size("w"), F.lit(window)).alias("n")
    return items.select("item_id", size, F.inline(F.concat(*parts))).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key (hash of doc_id and text), n_words, n_hit, spans
    (merged hit ranges of words), item_ids (as strings, sorted), contaminated.

    A null text has no words. Rows of one doc_id are judged by their own text; equal rows alike. An
    empty table, or a benchmark without words, gives no hits.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "contamination")
    windows = written(benchmark_windows(benchmark, window), f"{work}/windows")
    sizes = {r.n: r.k for r in windows.groupBy("n").agg(F.count_distinct("hash").alias("k")).collect()}  # at most ten
    small = sum(sizes.values()) <= max_set
    base = docs.select(F.col("doc_id").cast("long"), _row_key(), words_of(F.col("text")).alias("w"))
    if small:
        hashes = {n: [r.hash for r in windows.filter(F.col("n") == n).select("hash").distinct().collect()] for n in sizes}

        def hits(w: Column) -> Column:
            none = F.array().cast("array<struct<at:int,n:int,gram:string>>")
            return F.concat(none, *[_known_windows(w, n, known) for n, known in sorted(hashes.items())])

        looked = let(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits(w).alias("hits")))
        scanned = written(base.select("doc_id", "row_key", F.inline(F.array(looked))), f"{work}/scan")
        found = scanned.select("row_key", F.inline("hits"))
    else:
        scanned = written(base.select("doc_id", "row_key", F.size("w").cast("long").alias("n_words")), f"{work}/scan")
        parts = []
        for n in sorted(sizes):
            known = windows.filter(F.col("n") == n).select("hash").distinct()
            at = _windows(F.col("w"), n, "at", "hash", "gram")
            parts.append(base.select("row_key", F.inline(at)).join(known, "hash", "left_semi").select("row_key", "at", F.lit(n).alias("n"), "gram"))
        found = scanned.filter("false").select("row_key", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("gram"))
        for part in parts:
            found = found.union(part)
    hint = F.broadcast if small else (lambda df: df)
    real = written(found.join(hint(windows.select("n", "gram").distinct()), ["n", "gram"], "left_semi").distinct(), f"{work}/hits")
    items = real.select("row_key", "n", "gram").distinct().join(hint(windows.select("n", "gram", "item_id")), ["n", "gram"])
    named = items.groupBy("row_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    ranges = real.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("ranges"))
    spans = ranges.select("row_key", merged("ranges").alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["at"])
    all_ = scanned.select("doc_id", "row_key", "n_words").join(spans, "row_key", "left").join(named, "row_key", "left")
    return all_.select(
        "doc_id", "row_key", "n_words", F.coalesce(hit, F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,to:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def merged(ranges: str) -> Column:
    """Sorted ranges [at, to) joined where they touch."""
    none = F.array().cast("array<struct<at:int,to:int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["at"].alias("at"), F.greatest(last["to"], r["to"]).alias("to"))
        return F.when((F.size(done) > 0) & (r["at"] <= last["to"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, none, add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without what the benchmark holds: whole ``documents`` with a hit, or the hit ``spans``,
    each with the characters after its words; other characters stay. All columns are kept."""
    found = contamination(docs, benchmark, window).filter("contaminated").select("row_key", "spans").dropDuplicates(["row_key"])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row_key())
    if mode == "documents":
        return keyed.join(found.select("row_key"), "row_key", "left_anti").select("doc.*")
    if mode != "spans":
        raise ValueError(mode)
    head = F.regexp_extract(F.col("doc.text"), f"^{_GAP}*", 0)
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(f"{_WORD}+{_GAP}*"), F.lit(0))
    hit = F.col("hit_spans")
    clean = F.filter(pieces, lambda p, i: ~F.exists(hit, lambda s: (i >= s["at"]) & (i < s["to"])))
    text = F.when(hit.isNull(), F.col("doc.text")).otherwise(F.concat(head, F.array_join(clean, "")))
    cut = keyed.join(found.withColumnRenamed("spans", "hit_spans"), "row_key", "left").select("doc", text.alias("clean"))
    return cut.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) JOIN grams USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""
