"""Shards of near-equal bytes by a k-d tree over metadata, with DataFrame functions only.

A node that has to hold k shards is cut in two that hold k // 2 and k - k // 2, along its widest
metadata dimension, at the value below which the matching share of its bytes lies. Widths are measured
against the whole table. A coordinate is the value (32 bits; strings by CRC-32) followed by 31 bits
that order equal values: 16 of the text's hash, so that equal texts stand together, 15 of the row's. So
a hot value is cut as well as any other.

The weighted median of every node of a level is found by histograms: bytes summed by node and bin,
combined in each task; then the bin that holds the median is cut into bins again, until it is light
enough. The rows themselves are never moved, and the driver sees a row per node.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillguard.llm.common import text_bytes, work_dir, written
from quillguard.llm.quality_rules import let

ROW_BYTES = 8
BINS = 1 << 12
TIE_BITS = 31
# A bin is not cut further once it holds at most this share of a shard.
LIGHT = 1e-4
SLOT_ROWS = 1 << 14  # rows numbered by one window partition, about


@dataclass
class Level:
    """For each node of a level its dimension and cut, and the numbers of its two children."""

    dims: list[int]
    cuts: list[int]
    left: list[int]
    right: list[int]


def coordinates(docs: DataFrame, dims: Sequence[str], text: str = "text") -> list[Column]:
    tie = F.xxhash64(text).bitwiseAND(0xFFFF) * (1 << 15) + F.xxhash64("doc_id", text).bitwiseAND((1 << 15) - 1)
    out = []
    for d in dims:
        if isinstance(docs.schema[d].dataType, T.StringType):
            value = F.crc32(F.coalesce(F.col(d), F.lit("")).cast("binary"))
        else:
            value = F.greatest(F.lit(0), F.least(F.lit((1 << 32) - 1), F.coalesce(F.col(d).cast("long"), F.lit(0))))
        out.append(value * (1 << TIE_BITS) + tie)
    return out


def _of(values: Sequence[int], index: Column, kind: str = "long") -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index)


def node_of(levels: Sequence[Level], coords: Sequence[Column]) -> Column:
    """The node, after these levels, of a row with these coordinates."""
    node = F.lit(0)
    for level in levels:
        node = let(node, _below(level, F.array(*coords)))
    return node


def _below(level: Level, coords: Column) -> Callable[[Column], Column]:
    def child(n: Column) -> Column:
        low = F.get(coords, _of(level.dims, n, "int")) <= _of(level.cuts, n)
        return F.when(low, _of(level.left, n, "int")).otherwise(_of(level.right, n, "int"))

    return child


class KdTree:
    """Cuts that put the rows of ``meta`` (size, c0, c1, ...) into ``shards`` leaves."""

    def __init__(self, meta: DataFrame, n_dims: int, shards: int):
        self.levels: list[Level] = []
        self.coords = [F.col(f"c{i}") for i in range(n_dims)]
        parts, root = [shards], None
        while max(parts) > 1:
            placed = meta.select(node_of(self.levels, self.coords).alias("node"), "size", *self.coords)
            open_ = placed.filter(F.get(F.array(*[F.lit(p > 1) for p in parts]), F.col("node")))
            spans = [F.struct(F.min(c), F.max(c)).alias(f"s{i}") for i, c in enumerate(self.coords)]
            stats = {r.node: r for r in open_.groupBy("node").agg(F.sum("size").alias("size"), *spans).collect()}
            root = root or stats.get(0)
            dims, lows, highs, wants = [], [], [], []
            for n, k in enumerate(parts):
                s = stats.get(n)
                dim = max(range(n_dims), key=lambda i: self._width(s[f"s{i}"], root[f"s{i}"])) if s else 0
                dims.append(dim)
                lows.append(s[f"s{dim}"][0] if s else 0)
                highs.append(s[f"s{dim}"][1] + 1 if s else 1)
                wants.append(s.size * (k // 2) // k if s else 0)
            light = max(1, int(root.size / shards * LIGHT)) if root else 1
            cuts = self._cuts(open_, parts, dims, lows, highs, wants, light)
            left, right, next_parts = [], [], []
            for k in parts:
                left.append(len(next_parts))
                next_parts += [k // 2, k - k // 2] if k > 1 else [1]
                right.append(len(next_parts) - 1)
            self.levels.append(Level(dims, cuts, left, right))
            parts = next_parts

    @staticmethod
    def _width(span: tuple[int, int], whole: tuple[int, int]) -> float:
        width = lambda s: (s[1] >> TIE_BITS) - (s[0] >> TIE_BITS)
        return width(span) / max(1, width(whole))

    def _cuts(self, rows: DataFrame, parts: list[int], dims: list[int], lows: list[int], highs: list[int], wants: list[int], light: int) -> list[int]:
        """The coordinate of each node at which the rows up to it hold ``wants`` bytes."""
        rows = rows.select("node", "size", F.get(F.array(*self.coords), _of(dims, F.col("node"), "int")).alias("c"))
        cuts, todo = list(highs), {n for n, k in enumerate(parts) if k > 1}
        before = [0] * len(parts)
        while todo:
            widths = [max(1, -(-(h - l) // BINS)) for l, h in zip(lows, highs)]
            inside = rows.filter(F.get(F.array(*[F.lit(n in todo) for n in range(len(parts))]), F.col("node")))
            inside = inside.filter((F.col("c") >= _of(lows, F.col("node"))) & (F.col("c") < _of(highs, F.col("node"))))
            bin_ = F.expr("(c - low) div width").alias("bin")
            sums = (
                inside.withColumn("low", _of(lows, F.col("node"))).withColumn("width", _of(widths, F.col("node")))
                .groupBy("node", bin_).agg(F.sum("size").alias("w"))
            )
            upto = F.sum("w").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
            reached = sums.withColumn("upto", upto + _of(before, F.col("node"))).filter(F.col("upto") >= _of(wants, F.col("node")))
            found = {r.node: r.b for r in reached.groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("b")).collect()}
            for n in list(todo):
                if n not in found:  # an empty node
                    todo.discard(n)
                    continue
                b = found[n]
                lows[n] += b.bin * widths[n]
                highs[n] = min(highs[n], lows[n] + widths[n])
                before[n] = b.upto - b.w
                if widths[n] == 1 or b.w <= light:
                    nearer = wants[n] - before[n] < b.upto - wants[n]  # without the bin
                    cuts[n] = lows[n] - 1 if nearer else highs[n] - 1
                    todo.discard(n)
        return cuts

    def leaf(self, coords: Sequence[Column]) -> Column:
        return node_of(self.levels, coords)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: Sequence[str] = ("source", "lang", "n_chars")) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    size is the text's UTF-8 bytes (null: none) plus 8. The number of shards is given, or follows from
    the target bytes. slot numbers a shard's rows from 0 without gaps: rows are numbered within
    buckets by the hash of doc_id, and a bucket starts after the rows of those before it. Null
    metadata counts as empty or 0, a null doc_id is a value like any other, repeated rows are placed
    each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "kd")
    size = (text_bytes(F.col("text")) + ROW_BYTES).alias("size")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    coords = [c.alias(f"c{i}") for i, c in enumerate(coordinates(docs, dims))]
    meta = written(docs.select(F.col("doc_id").cast("long"), size, crc, *coords), f"{work}/meta")
    total = meta.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if shards is None:
        shards = max(1, -(-total.bytes // target_bytes))
    tree = KdTree(meta, len(dims), shards)
    buckets = max(1, total.n // (shards * SLOT_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    placed = written(meta.select("doc_id", "size", "text_crc32", tree.leaf(tree.coords).cast("int").alias("shard"), bucket), f"{work}/placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("nth", nth - 1).join(firsts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, dims: Sequence[str] = ("source", "lang", "n_chars")) -> None:
    """Write ``docs`` with a folder per shard. The tree is an expression over the row, so each task
    writes what it reads; no row is moved."""
    size = (text_bytes(F.col("text")) + ROW_BYTES).alias("size")
    coords = coordinates(docs, dims)
    meta = written(docs.select(size, *[c.alias(f"c{i}") for i, c in enumerate(coords)]), f"{work_dir(docs.sparkSession, 'kd')}/meta")
    leaf = KdTree(meta, len(dims), shards).leaf(coords)
    docs.drop("shard").withColumn("shard", leaf).write.partitionBy("shard").parquet(path)
