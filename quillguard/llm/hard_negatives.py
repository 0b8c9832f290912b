"""Hard negatives by inner product, from cover trees over norm-augmented vectors.

Each vector gets one more component that brings all of a piece to one length M, a query gets zero there:
inner products stay, and vectors lie on a sphere, where the angle between a query and a centre bounds
the angle to all that is near the centre. A piece holds at most ``PIECE`` vectors, dealt by a hash of
their ids, as a cover tree: the children of a node are centres more than half its covering radius
apart that together cover its vectors. A node knows the widest angle from its centre to its vectors.

An anchor descends each tree best-first. A node whose inner products cannot reach the window asked
for, or not the best rows found so far, is skipped; rows of leaves are verified with integers. Trees
are built once and written; anchors are broadcast to them in blocks of bounded size, and every task
sends the best rows of all its trees for each anchor, so what is shuffled is a few rows an anchor and
task. Nothing is cut off: every window is searched in every tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import work_dir, written

PIECE = 4096
LEAF = 12
BLOCK_BYTES = 16 << 20  # of the vectors of anchors that are broadcast at once
CENTRES = 64  # centres that are tried at once while a node is covered
LARGEST = 1 << 24  # of a component

TREE = "piece long, dim int, ids binary, labels binary, vectors binary, nodes binary, angles binary"


def cover(points: np.ndarray, rows: np.ndarray, angle: np.ndarray) -> list[np.ndarray]:
    """Rows of each child of a node: its centre first, then what is at most half the node's angle away.
    ``rows`` starts with the node's centre, ``angle`` are the angles of its rows to it."""
    half = angle.max() / 2
    near = angle <= half
    children = [rows[near]]
    rest = rows[~near]
    while len(rest):
        tried = rest[:CENTRES]
        angles = _angles(points[tried], points[rest])
        free = np.ones(len(rest), bool)
        for i in range(len(tried)):
            if free[i]:
                own = free & (angles[i] <= half)
                own[i] = False
                children.append(np.r_[tried[i], rest[own]])
                free &= ~own
                free[i] = False
        rest = rest[free]
    return children


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def cover_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, angles): rows in the order of the leaves, and for each node its centre's row, the
    places of its rows (from, to) and of its children (from, to; none for a leaf). Rows of a node are
    at most its angle away from its centre."""
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    longest = norms.max() if len(norms) and norms.max() > 0 else 1.0
    points = np.c_[vectors / longest, np.sqrt(np.clip(1 - (norms / longest) ** 2, 0, None))]
    order, nodes, angles = np.arange(len(vectors)), [[0, 0, len(vectors), 0, 0]], [0.0]
    at = 0
    while at < len(nodes):
        centre, begin, end = nodes[at][:3]
        rows = order[begin:end]
        angle = _angles(points[centre : centre + 1], points[rows])[0]
        angles[at] = float(angle.max())
        # equal vectors make angles of rounding size, and need no children
        if len(rows) > LEAF and angles[at] > 1e-6:
            first = np.flatnonzero(rows == centre)[0]
            rows[[0, first]], angle[[0, first]] = rows[[first, 0]], angle[[first, 0]]
            children = cover(points, rows, angle)
            nodes[at][3:] = [len(nodes), len(nodes) + len(children)]
            for child in children:
                order[begin : begin + len(child)] = child
                nodes.append([int(child[0]), begin, begin + len(child), 0, 0])
                angles.append(0.0)
                begin += len(child)
        at += 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.array(nodes, np.int64)
    table[:, 0] = place[table[:, 0]]
    return order, table, np.array(angles)


class Tree:
    """A cover tree with its rows in the order of its leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, angles: np.ndarray):
        self.ids, self.labels, self.vectors, self.nodes, self.angles = ids, labels, vectors, nodes, angles
        self.real = vectors.astype(float)
        self.longest = float(np.sqrt((self.real**2).sum(axis=1)).max()) if len(ids) else 0.0
        self.leaf = nodes[:, 3] == nodes[:, 4]
        self.centres = self.real[nodes[:, 0]]

    def search(self, query: np.ndarray, best: Best, opened: dict[int, tuple] | None = None) -> None:
        """Offer to ``best`` all rows that could be among them. ``opened`` keeps what the nodes hold for
        this query, for further searches by it."""
        opened = {} if opened is None else opened
        real = query.astype(float)
        reach = float(np.sqrt((real**2).sum())) * self.longest
        order = count()
        heap: list[tuple[float, int, int]] = [(-np.inf, next(order), 0)]
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < best.floor():
                return
            if node not in opened:
                opened[node] = self._open(node, query, real, reach)
            rows, scores, children, low, high = opened[node]
            self._verify(rows, scores, best)
            seen = (high >= best.floor()) & (low <= best.ceiling)
            for child, top in zip(children[seen].tolist(), high[seen].tolist()):
                heapq.heappush(heap, (-min(top, best.ceiling), next(order), child))

    def _open(self, node: int, query: np.ndarray, real: np.ndarray, reach: float) -> tuple:
        """Rows of a leaf, or of the children that are leaves, with their scores; the other children and the
        bounds of their scores."""
        _, begin, end, first, last = self.nodes[node].tolist()
        rows, children = np.arange(begin, end), np.arange(first, last)
        low = high = np.zeros(0)
        if first < last:
            leaf = self.leaf[first:last]
            sizes = self.nodes[first:last, 2] - self.nodes[first:last, 1]
            rows, children = rows[np.repeat(leaf, sizes)], children[~leaf]
        if len(children):
            slack = 0.25 + 1e-6 * reach  # scores are whole numbers; angles are rounded
            to_centre = np.arccos(np.clip(self.centres[children] @ real / (reach or 1.0), -1.0, 1.0))
            wide = self.angles[children]
            low, high = reach * np.cos(np.minimum(to_centre + wide, np.pi)) - slack, reach * np.cos(np.maximum(to_centre - wide, 0.0)) + slack
        own = self.real[begin:end] if len(rows) == end - begin else self.real[rows]
        return rows, self._scores(rows, own @ real, query, reach), children, low, high

    def _scores(self, rows: np.ndarray, dots: np.ndarray, query: np.ndarray, reach: float) -> np.ndarray:
        """Exact inner products: no partial sum of ``dots`` passes ``reach``, so below 2^52 none is rounded."""
        return dots.astype(np.int64) if reach < 1 << 52 else self.vectors[rows] @ query

    def _verify(self, rows: np.ndarray, scores: np.ndarray, best: Best) -> None:
        fit = np.flatnonzero((scores >= best.floor()) & (scores <= best.ceiling))
        fit = fit[best.accepts(self.labels[rows[fit]], self.ids[rows[fit]])]
        if len(fit):
            best.offer(scores[fit], self.ids[rows[fit]])


class Best:
    """The ``k`` highest scores from ``low`` to ``ceiling``, of equal ones the smaller ids, among rows of
    the anchor's label (without the anchor) or of the others."""

    def __init__(self, k: int, anchor: int, label: int, same: bool, low: float = -np.inf, ceiling: float = np.inf):
        self.k, self.anchor, self.label, self.same, self.low, self.ceiling = k, anchor, label, same, low, ceiling
        self.rows: list[tuple[int, int]] = []  # (-score, id), ascending

    def floor(self) -> float:
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low

    def accepts(self, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (labels == self.label) & (ids != self.anchor) if self.same else labels != self.label

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) > self.k:
            high = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[high], ids[high]
            top = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[top], ids[top]
        self.rows = sorted([*self.rows, *zip((-scores).tolist(), ids.tolist())])[: self.k]


def whole_vectors(vectors: DataFrame, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label and v (components times ``scale``, rounded down) of the rows that take part, one for
    each vec_id: of rows that share one, the smallest label and vector."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(fit)
    # the bound keeps inner products exact in 64 bits
    v = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) <= LARGEST, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large"))))
    kept = rows.select(F.col("vec_id").cast("long"), F.struct(F.col(label).cast("long").alias("label"), v.cast("array<long>").alias("v")).alias("row"))
    return kept.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` components; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _plant(table: pa.Table, dim: int) -> pa.Table:
    """The cover tree of a piece, as one row."""
    vectors = _matrix(table.column("v"), dim)
    order, nodes, angles = cover_tree(vectors)
    ids, labels = (table.column(c).to_numpy()[order].astype("<i8") for c in ("vec_id", "label"))
    blobs = [ids, labels, vectors[order].astype("<i4"), nodes.astype("<i8"), angles.astype("<f8")]
    fields = ("ids", "labels", "vectors", "nodes", "angles")
    return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), **{f: pa.array([b.tobytes()], pa.binary()) for f, b in zip(fields, blobs)}})


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
            vectors = np.frombuffer(row["vectors"], "<i4").reshape(len(ids), row["dim"]).astype(np.int64)
            yield Tree(ids, labels, vectors, np.frombuffer(row["nodes"], "<i8").reshape(-1, 5), np.frombuffer(row["angles"], "<f8"))


def _searched(trees: DataFrame, wanted: list[tuple], vectors: np.ndarray) -> DataFrame:
    """The best rows of each task for every wanted search (arguments of ``Best`` after a key)."""
    sc = trees.sparkSession.sparkContext
    sent = sc.broadcast((wanted, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, vectors = sent.value
        found = [Best(*args) for _, _, *args in wanted]
        for tree in _trees(batches):
            last, opened = None, {}
            for (_, row, *_), best in zip(wanted, found):
                if row != last:  # searches of one anchor follow each other
                    last, opened = row, {}
                tree.search(vectors[row], best, opened)
        for (key, *_), best in zip(wanted, found):
            if best.rows:
                keys = pa.array([key] * len(best.rows), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([-s for s, _ in best.rows], pa.int64()), pa.array([i for _, i in best.rows], pa.int64())], ["key", "score", "id"])

    return trees.mapInArrow(run, "key long, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(anchors: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the anchors, in blocks of at most ``BLOCK_BYTES`` of vectors."""
    most = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    n = 1
    while n == 1 or largest > most:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n))
        largest = anchors.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            break
        n *= 2
    for b in range(n if largest else 0):
        own = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).toArrow()
        if own.num_rows:
            yield own.column("vec_id").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("v"), dim)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, lowest_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Scores are inner products of the components times ``scale``, rounded down. For each row of
    ``is_anchor`` (a condition on vec_id) its positives are the ``positives`` best other rows of its
    label; for each of them follow the ``negatives`` best rows of other labels that score at least
    ``lowest_percent`` hundredths of the positive and not above it. Equal scores go by vec_id; fewer rows
    give fewer. Rows with a null vec_id, label or vector, or a component that is null or not finite,
    take no part; rows of one vec_id count once, by the smallest label and vector. Shorter vectors end
    in zeros. An empty table gives no rows; more columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    ship(spark)
    work = work_dir(spark, "negatives")
    rows = written(whole_vectors(vectors, vector, label, scale), f"{work}/rows")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    pieces = max(1, -(-n // PIECE))
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "vec_id"), F.lit(pieces)))
    trees = written(dealt.groupBy("piece").applyInArrow(lambda table: _plant(table, dim), TREE), f"{work}/trees")
    out = None
    for b, (ids, labels, own) in enumerate(_blocks(rows.filter(is_anchor), dim)):
        wanted = [(i, i, positives, int(a), int(y), True) for i, (a, y) in enumerate(zip(ids, labels))]
        near = _ranked(_searched(trees, wanted, own), positives).collect()  # a few rows for each anchor of the block
        windows = {(r.key, r.score) for r in near if r.score >= 0}  # below zero the window is empty
        keys = {window: k for k, window in enumerate(sorted(windows))}
        wanted = [(k, i, negatives, int(ids[i]), int(labels[i]), False, -(-lowest_percent * s // 100), s) for (i, s), k in keys.items()]
        pairs = [(keys[r.key, r.score], int(ids[r.key]), r.id, r.score) for r in near if (r.key, r.score) in keys]
        if not pairs:
            continue
        asked = spark.createDataFrame(pairs, "key long, anchor_id long, positive_id long, positive_score long")
        found = _ranked(_searched(trees, wanted, own), negatives)
        joined = asked.join(found, "key").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        joined = written(joined, f"{work}/found-{b}")
        out = joined if out is None else out.union(joined)
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return out if out is not None else spark.createDataFrame([], columns)


ORACLE_SQL = r"""
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
