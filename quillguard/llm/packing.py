"""Packing documents into sequences of a fixed number of tokens, by sums of squares.

Only documents longer than a sequence are cut: into full pieces, after a first piece that holds the
remainder. Full pieces are sequences of their own. Every other piece goes where it makes the sum of
``open[g] ** 2`` smallest, ``open[g]`` being the number of open sequences with ``g`` tokens left: that
keeps gaps of all sizes at hand, so that late pieces close sequences exactly.

Documents are dealt by doc_id to chunks of about ``CHUNK_DOCS``, whose number follows the table; each
chunk is packed by one task, which reads its documents sorted by the size of the first piece, largest
first, and keeps nothing but the open sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import binary_array
from quillguard.llm.token_files import encode_documents
from quillguard.llm.vocab import loaded

CHUNK_DOCS = 1 << 16
_PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class SquaresPacker:
    """Open sequences by gap; ``place`` returns the sequence and the offset of a piece."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.open = np.zeros(capacity + 1, np.int64)
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        b, n = self.capacity, self.open
        if size == b:
            return self.new(), 0
        # moving a sequence from gap g to g - size changes the sum by 2 (n[g - size] - n[g] + 1);
        # a gap of 0 is closed and not counted
        left = n[: b - size + 1] * 2 + 2
        left[0] = 0
        change = left - 2 * n[size:]
        change[0] += 1
        change[n[size:] == 0] = np.iinfo(np.int64).max
        change[b - size] = 2 * n[b - size] + 1  # a new sequence
        to = int(np.argmin(change))
        gap = to + size
        if gap == b:
            at = self.new()
        else:
            at = self.by_gap[gap].pop()
            n[gap] -= 1
        if to:
            self.by_gap[to].append(at)
            n[to] += 1
        return at, b - gap


def pieces(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document; only the first may be shorter than a sequence."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    starts = [0, *range(first, n_tokens, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n_tokens])]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = None, capacity: int = 1024, split: str = "space", chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty: with an end id it
    is a piece of one token, without one it has no piece. Rows of one doc_id are documents of their
    own. An empty table gives no rows. Sequence numbers are unique, not gapless.
    """
    spark = docs.sparkSession
    ship(spark)
    chunks = max(1, -(-docs.count() // chunk_docs))
    width = loaded(tokenizer, split).dtype.itemsize
    encoded = encode_documents(docs, tokenizer, end_id, split).filter("n_tokens > 0")
    first = F.expr(f"if(n_tokens % {capacity} = 0, {capacity}, n_tokens % {capacity})")
    # a null doc_id is dealt by its ids
    dealt = encoded.withColumn("first", first).repartition(chunks, F.coalesce("doc_id", F.xxhash64("ids")))
    ordered = dealt.sortWithinPartitions(F.desc("first"), "doc_id", "n_tokens", F.xxhash64("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = SquaresPacker(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                data = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                for i, (start, length) in enumerate(pieces(n, capacity)):
                    at, offset = packer.place(length)
                    out.append((doc_id, i, start, length, data[4 * start : 4 * (start + length)], base + at, offset))
                size += len(data)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, _PACKED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([binary_array(c) if k == pa.binary() else pa.array(c, k) for c, k in zip(columns, kinds)], names)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and the pieces' places; a sequence has at most its capacity of rows."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), rows.alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda done, r: F.concat(done, r["ids"]))
    places = F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["piece"].alias("piece"), r["offset"].alias("offset"), r["length"].alias("length")))
    return whole.select("sequence_id", "n_tokens", ids.alias("ids"), places.alias("places"))
