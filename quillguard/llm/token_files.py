"""Token ids in files of canonical, length-limited Huffman codes.

A file set is a folder with two Parquet tables. ``codebook`` holds the code length of every id that
occurs, from which the canonical codes follow. ``blocks`` holds, in ascending order of doc_id,
blocks of whole documents: the documents' ids and token counts, the bit string of their codes (each
document starts on a byte) and a checkpoint, the bit offset of every ``GROUP`` tokens. A block is
decoded on its own: all stretches between checkpoints advance together, one table look-up a token.

Writing takes four steps, each a table in the shared folder: ids of the texts; counts of ids over all
documents (at most one row per id of the vocabulary reaches the driver); codes per document; blocks
after a range sort by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillguard.llm.common import binary_array, ragged, small_batches, work_dir, written
from quillguard.llm.vocab import loaded

GROUP = 64  # tokens between checkpoints
BLOCK_TOKENS = 1 << 18
MAX_BITS = 16  # longest code; a window of 24 bits holds one at any bit of a byte


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for symbols of these counts (package merge)."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    merged, is_leaf = [leaves], [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        last = merged[-1]
        packages = last[: len(last) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        merged.append(both[by])
        is_leaf.append(by < n)
    lengths = np.zeros(n, np.int64)
    taken = 2 * n - 2
    for level in reversed(is_leaf):
        chosen = int(level[:taken].sum())  # leaves are taken in ascending order of their counts
        lengths[:chosen] += 1
        taken = 2 * (taken - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of ids, from their lengths alone."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, max_bits: int = MAX_BITS):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths, self.max_bits = ids[order], lengths[order], max_bits
        room = np.int64(1) << (max_bits - self.lengths)
        self.firsts = np.cumsum(room) - room  # each code, followed by zeros

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        codes, lengths = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        codes[self.ids] = self.firsts >> (self.max_bits - self.lengths)
        lengths[self.ids] = self.lengths
        return codes, lengths

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the code length for every ``max_bits`` bits that can follow."""
        room = 1 << (self.max_bits - self.lengths)
        ids, lengths = np.zeros(1 << self.max_bits, np.uint32), np.ones(1 << self.max_bits, np.uint8)
        ids[: room.sum()] = np.repeat(self.ids, room)
        lengths[: room.sum()] = np.repeat(self.lengths, room)
        return ids, lengths


def pack_bits(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each document its bit string and the bits (uint16) of each of its groups."""
    odd = np.cumsum(counts)[counts % 2 == 1]  # filled up with a code of no bits: codes are laid down in pairs
    value, used = codes[ids], lengths[ids]
    if len(odd):
        value, used = np.insert(value, odd, 0), np.insert(used, odd, 0)
    pairs = (counts + 1) // 2
    firsts = np.cumsum(pairs) - pairs
    value = (value[::2].astype(np.uint64) << used[1::2].astype(np.uint64)) | value[1::2]
    used = used[::2].astype(np.int64) + used[1::2]
    before = np.cumsum(used) - used
    sizes = (np.add.reduceat(used, firsts) + 7) // 8 if len(counts) else counts
    at = np.cumsum(sizes) - sizes
    offset = before + np.repeat(at * 8 - before[firsts], pairs)
    value <<= (64 - (offset & 31) - used).astype(np.uint64)
    word, total = offset >> 5, int(sizes.sum()) // 4 + 2
    out = np.bincount(word, value >> np.uint64(32), total)
    out += np.bincount(word + 1, value & np.uint64(0xFFFFFFFF), total)
    data = out.astype(">u4").tobytes()
    groups = -(-counts // GROUP)
    starts = np.repeat(firsts, groups) + GROUP // 2 * ragged(np.zeros(len(counts), np.int64), groups)
    per_group = np.add.reduceat(used, starts).astype("<u2").tobytes() if len(starts) else b""
    ends = np.cumsum(groups)
    return (
        [data[a : a + n] for a, n in zip(at.tolist(), sizes.tolist())],
        [per_group[2 * (e - g) : 2 * e] for e, g in zip(ends.tolist(), groups.tolist())],
    )


def unpack_bits(payload: bytes, checkpoints: np.ndarray, taken: np.ndarray, table: tuple[np.ndarray, np.ndarray], max_bits: int = MAX_BITS) -> np.ndarray:
    """Ids of a block. Lane i starts at bit ``checkpoints[i]`` and holds ``taken[i]`` tokens."""
    ids, lengths = table
    b = np.frombuffer(payload + bytes(GROUP * max_bits // 8 + 3), np.uint8).astype(np.uint32)
    window = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    at = checkpoints.astype(np.int64)
    out = np.empty((GROUP, len(at)), np.uint32)
    mask = (1 << max_bits) - 1
    for step in range(int(taken.max()) if len(taken) else 0):
        seen = (window[at >> 3] >> (24 - max_bits - (at & 7)).astype(np.uint32)) & mask
        out[step] = ids[seen]
        at += lengths[seen]
    return out.T[np.arange(GROUP) < taken[:, None]]


_ENCODED = "doc_id long, n_tokens long, ids binary"
_BLOCKS = (
    "part int, block long, part_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "doc_bytes array<long>, payload binary, checkpoints binary"
)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None, split: str = "word") -> DataFrame:
    """doc_id, n_tokens, ids: little-endian, two bytes each if the vocabulary allows, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = loaded(tokenizer, split)
        for batch in small_batches(batches):
            ids, counts = texts.batch(batch.column("text"), end_id)
            ends = np.cumsum(counts) * ids.itemsize
            data = ids.tobytes()
            parts = [data[a:b] for a, b in zip((ends - counts * ids.itemsize).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), binary_array(parts)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ENCODED)


def id_counts(encoded: DataFrame, width: int) -> DataFrame:
    """Occurrences of each id over all documents, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                seen = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, split: str = "word") -> None:
    """Write the ids of ``docs`` (doc_id, text; other columns are ignored) as a file set at ``path``.

    A null text is empty; ``end_id`` follows every document. Documents stand in ascending order of
    doc_id, null first; rows of one doc_id in order of their ids. An empty table gives an empty set.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "tokens")
    width = loaded(tokenizer, split).dtype.itemsize
    encoded = written(encode_documents(docs, tokenizer, end_id, split), f"{work}/ids")
    rows = id_counts(encoded, width).collect()  # at most one row per id of the vocabulary
    ids = np.array([r.id for r in rows], np.int64)
    lengths = code_lengths(np.array([r.n for r in rows], np.int64))
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, lengths)], "id long, n_bits int").coalesce(1).write.parquet(f"{path}/codebook")
    codes, bits = Codebook(ids, lengths).encoder()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "ids", 1 << 21):
            counts = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            held = counts > 0
            flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}")
            some = pack_bits(flat, counts[held], codes, bits) if held.any() else ([], [])
            full = [[b""] * len(counts), [b""] * len(counts)]
            for column, parts in zip(full, some):
                for i, part in zip(np.flatnonzero(held), parts):
                    column[i] = part
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *map(binary_array, full)], ["doc_id", "n_tokens", "payload", "group_bits"])

    # ids are dealt out, not codes: ranges are sampled from the rows dealt, which would then be coded twice
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(lambda batches: _blocks(code(batches)), _BLOCKS).write.parquet(f"{path}/blocks")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, start = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    tokens = 0

    def flush() -> pa.RecordBatch:
        sizes = np.array([len(r[2]) for r in held], np.int64)
        points = []
        for r, at in zip(held, (np.cumsum(sizes) - sizes) * 8):
            bits = np.frombuffer(r[3], "<u2").astype(np.int64)
            points.append(at + np.cumsum(bits) - bits)
        row = {
            "part": part, "block": block, "part_start": start, "n_tokens": tokens,
            "doc_ids": [r[0] for r in held], "doc_tokens": [r[1] for r in held], "doc_bytes": sizes.tolist(),
            "payload": b"".join(r[2] for r in held), "checkpoints": np.concatenate(points).astype("<u8").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "payload", "group_bits"))):
            held.append(row)
            tokens += row[1]
            if tokens >= BLOCK_TOKENS or len(held) >= BLOCK_TOKENS // GROUP:
                yield flush()
                block, start, tokens = block + 1, start + tokens, 0
                held.clear()
    if held:
        yield flush()


_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("doc_bytes", pa.list_(pa.int64())),
        ("payload", pa.binary()), ("checkpoints", pa.binary()),
    ]
)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (little-endian uint32).

    Positions follow from one total per written partition; that table has a row per partition of the
    writing job, so it is broadcast.
    """
    rows = spark.read.parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    table = Codebook(np.array([r.id for r in rows], np.int64), np.array([r.n_bits for r in rows], np.int64)).decoder()
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["doc_tokens"], np.int64)
                groups = -(-counts // GROUP)
                lane = GROUP * ragged(np.zeros(len(counts), np.int64), groups)
                taken = np.minimum(GROUP, np.repeat(counts, groups) - lane)
                ids = unpack_bits(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), taken, table)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                first = ends - counts
                parts = [data[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(counts), pa.int32()), pa.array(first + row["part_start"]), pa.array(counts), binary_array(parts)],
                    ["doc_id", "part", "in_part", "n_tokens", "ids"],
                )

    decoded = blocks.drop("block", "n_tokens", "doc_bytes").mapInArrow(run, "doc_id long, part int, in_part long, n_tokens long, ids binary")
    placed = decoded.join(F.broadcast(starts), "part")
    return placed.select("doc_id", (F.col("part_first") + F.col("in_part")).alias("start"), "n_tokens", "ids")
