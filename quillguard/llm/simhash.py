"""Near duplicates by SimHash fingerprints, compared as vertical bit planes.

Fingerprints at most ``RADIUS`` bits apart agree in two of five blocks of bits at least (three bits
spoil three blocks), so each distinct fingerprint is dealt to ten buckets, one for each pair of blocks.
A task reads its buckets sorted and holds them as bit planes: plane b has bit b of 64 fingerprints in
a word. Row i is compared with row i + j of its bucket for all i at once: the planes, one shifted by j
rows, are combined by exclusive or and added up in carry-save counters of three bits, in which four or
more differences set a bit that stays. Words whose pairs all are beyond the radius are abandoned every
few planes.

A bucket above ``MAX_BUCKET`` fingerprints is passed on as it streams by and dealt anew by the bits that
its rows do not share yet (one of four parts must agree); that ends, as its rows are distinct. Of a
bucket, only links that join two of its groups come out, so dense buckets give few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import joined, lower_ascii, small_batches, words_of, work_dir, written
from quillguard.llm.components import connected_components

BITS = 64
RADIUS = 3
SHINGLE = 3
BLOCKS = 5
MAX_BUCKET = 1 << 15
SEED = 42
TILE = 1 << 16  # fingerprints held as planes at once, unless one bucket has more
CHECK_EVERY = 8  # planes between looks for words to abandon

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def shingle_hashes(words: pa.Array, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of the texts, and their number for each text. A text of fewer words is
    one shingle; one without words has none."""
    hashes: list[int] = []
    numbers = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    digest = xxhash.xxh64_intdigest
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)).astype(np.int64) + 1
    at = 0
    for text, n in zip(joined(words, counts), counts.tolist()):
        if n:
            ends = np.cumsum(lengths[at : at + n])
            at += n
            span = min(n, size)
            starts = (ends[: n - span + 1] - lengths[at - n : at - span + 1]).tolist()
            hashes += [digest(text[a:b], SEED) for a, b in zip(starts, (ends[span - 1 :] - 1).tolist())]
    return np.array(hashes, np.uint64), numbers


def fingerprints(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Bit i of a text's fingerprint is set if it is in over half of the text's hashes."""
    out = np.zeros(len(numbers), np.uint64)
    full = np.flatnonzero(numbers)
    if not len(full):
        return out
    # eight bits of up to 255 hashes are added in the eight bytes of a word
    some = numbers[full]
    runs = -(-some // 255)
    firsts = np.cumsum(some) - some
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(firsts, runs) + 255 * nth
    each = np.cumsum(runs) - runs
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], starts)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), each)
        byte = np.packbits(ones * 2 > some[:, None], axis=1, bitorder="little")[:, 0]
        out[full] |= byte.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; 0 for texts without words (null: none)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = fingerprints(*shingle_hashes(*words_of(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), lower_ascii(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cut(bits: tuple[int, ...], parts: int) -> list[tuple[int, ...]]:
    bounds = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(bounds, bounds[1:])]


def _mask(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def first_masks() -> list[int]:
    """Bits that a bucket shares, for each pair of blocks."""
    blocks = _cut(tuple(range(BITS)), BLOCKS)
    return [_mask(blocks[i] + blocks[j]) for i in range(BLOCKS) for j in range(i)]


def finer_masks(mask: int) -> list[int]:
    """Of the other bits, one of ``RADIUS`` + 1 parts agrees as well."""
    rest = tuple(b for b in range(BITS) if not mask >> b & 1)
    return [mask | _mask(part) for part in _cut(rest, RADIUS + 1) if part]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of row i in bit i % 64 of word i // 64."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def _words(flags: np.ndarray, n_words: int) -> np.ndarray:
    out = np.zeros(n_words * 64, np.uint8)
    out[: len(flags)] = flags
    return np.packbits(out, bitorder="little").view("<u8")


def close_pairs(planes: np.ndarray, alive: np.ndarray, shift: int, radius: int = RADIUS) -> np.ndarray:
    """Rows i, of those set in ``alive``, with row i + ``shift`` at most ``radius`` (3) bits away."""
    at = np.flatnonzero(alive)
    alive = alive[at]
    low, high = divmod(shift, 64)[::-1]
    ones = np.zeros_like(alive)
    twos, over = np.zeros_like(alive), np.zeros_like(alive)
    wide = np.pad(planes, ((0, 0), (0, high + 2)))
    down, up = np.uint64(low), np.uint64(64 - low)
    for b in range(BITS):
        other = wide[b, at + high]
        if low:
            other = other >> down | wide[b, at + high + 1] << up
        carry = planes[b, at] ^ other
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        over |= carry
        if b % CHECK_EVERY == CHECK_EVERY - 1:
            alive &= ~over
            kept = alive != 0
            if not kept.all():
                at, alive, ones, twos, over = (x[kept] for x in (at, alive, ones, twos, over))
                if not len(at):
                    break
    if radius < 3:
        raise ValueError("the counters tell three differences from four")
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return at[word] * 64 + bit


def bucket_links(fps: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows i, k) that join close fingerprints of a bucket; ``bucket`` ascends. Rows that are
    joined already get no further link."""
    n = len(fps)
    planes = planes_of(fps)
    n_words = planes.shape[1]
    group = np.arange(n)
    left, right = [], []
    for shift in range(1, n):
        same = bucket[shift:] == bucket[:-shift]
        if not same.any():
            break
        fresh = same & (group[shift:] != group[:-shift])
        if not fresh.any():
            continue
        i = close_pairs(planes, _words(fresh, n_words), shift)
        for a, b in zip(i.tolist(), (i + shift).tolist()):
            x, y = _root(group, a), _root(group, b)
            if x != y:
                group[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
        if len(i):
            while (group[group] != group).any():
                group = group[group]
    return np.array(left, np.int64), np.array(right, np.int64)


def _root(group: np.ndarray, i: int) -> int:
    while group[i] != i:
        i = int(group[i])
    return i


def fingerprint_links(spark: SparkSession, prints: DataFrame, path: str) -> DataFrame:
    """(a, b): ids of fingerprints at most RADIUS bits apart, enough to join all that are linked.

    ``prints`` has distinct (fp long, id long). Rounds after the first hold the rows of over-full
    buckets only; ``path`` takes a table for each.
    """
    ship(spark)
    masks = {m: i for i, m in enumerate(first_masks())}
    dealt, found, step = prints.select("fp", "id", F.lit(0).cast("long").alias("mask")), None, 0
    limit = MAX_BUCKET

    while True:
        finer = {0: list(masks)} if step == 0 else {m: finer_masks(m) for m in masks}
        signed = {m: [x - (x >> 63 << 64) for x in ms] for m, ms in finer.items()}
        if step:
            masks = {x: 0 for ms in finer.values() for x in ms}
        options = F.create_map(*[c for m, ms in signed.items() for c in (F.lit(m - (m >> 63 << 64)), F.array(*[F.lit(x) for x in ms]))])
        keyed = dealt.select("fp", "id", F.explode(options[F.col("mask")]).alias("mask"))
        keyed = keyed.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        sorted_ = keyed.repartition("key").sortWithinPartitions("key", "mask", "fp")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _bucket_stream(batches, limit)

        out = written(sorted_.mapInArrow(run, "link boolean, a long, b long, mask long"), f"{path}/{step}")
        links = out.filter("link").select("a", "b")
        found = links if found is None else found.union(links)
        dealt = out.filter("NOT link").select(F.col("a").alias("fp"), F.col("b").alias("id"), "mask")
        step += 1
        if dealt.isEmpty():
            return found


def _bucket_stream(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []  # rows (key, mask, fp, id) of whole buckets and of the last one
    n, passing = 0, None

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        changed = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        bucket = np.r_[0, np.cumsum(changed)]
        size = np.bincount(bucket)
        rows, bucket = rows[size[bucket] > 1], bucket[size[bucket] > 1]
        if len(rows):
            i, k = bucket_links(rows[:, 2].view(np.uint64), bucket)
            yield _links(np.ones(len(i), bool), rows[i, 3], rows[k, 3], np.zeros(len(i), np.int64))

    def same(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (rows[:, 0] == row[0]) & (rows[:, 1] == row[1])

    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy() for c in ("key", "mask", "fp", "id")])
        if not len(rows):
            continue
        if passing is not None:
            on = same(rows, passing)
            yield _links(np.zeros(on.sum(), bool), rows[on, 2], rows[on, 3], rows[on, 1])
            rows = rows[~on]
            if not len(rows):
                continue
            passing = None
        held.append(rows)
        n += len(rows)
        if n < TILE:
            continue
        rows = np.concatenate(held)
        last = same(rows, rows[-1])
        open_, whole = rows[last], rows[~last]
        if len(whole):
            yield from _tiles(whole, linked, limit)
        if len(open_) > limit:
            passing = open_[0]
            yield _links(np.zeros(len(open_), bool), open_[:, 2], open_[:, 3], open_[:, 1])
            open_ = open_[:0]
        held, n = [open_], len(open_)
    if n:
        yield from _tiles(np.concatenate(held), linked, limit)


def _tiles(rows: np.ndarray, linked, limit: int) -> Iterator[pa.RecordBatch]:
    """Large buckets are passed on or taken alone, so that small ones need few shifts."""
    firsts = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
    sizes = np.diff(np.r_[firsts, len(rows)])
    each = np.repeat(sizes, sizes)
    large = firsts[sizes > 64]
    for at in large.tolist():
        own = rows[at : at + sizes[np.searchsorted(firsts, at)]]
        if len(own) > limit:
            yield _links(np.zeros(len(own), bool), own[:, 2], own[:, 3], own[:, 1])
        else:
            yield from linked(own)
    small = rows[each <= 64]
    if len(small):
        yield from linked(small)


def _links(kind: np.ndarray, a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mask, pa.int64())], ["link", "a", "b", "mask"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text; more columns are ignored).

    component_id is the smallest doc_id that links reach, over fingerprints at most three bits apart;
    equal fingerprints are linked. Null and empty texts, and all others without words, have
    fingerprint zero and are linked like any other. Rows without doc_id take part in no component and
    have none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "simhash")
    prints = written(fingerprint_documents(docs), f"{work}/prints")
    named = prints.filter("doc_id IS NOT NULL")
    distinct = written(named.groupBy("fp").agg(F.min("doc_id").alias("id")), f"{work}/distinct")
    groups = connected_components(fingerprint_links(spark, distinct, f"{work}/links"))
    joined_ = distinct.join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = joined_.select("fp", F.coalesce("component", "id").alias("component_id"))
    both = prints.join(component, "fp", "left")
    return both.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component, that of the smallest doc_id (the first of repeated
    rows in the order of all columns); rows without doc_id stay."""
    found = near_duplicates(docs)
    heads = found.filter("doc_id = component_id").select("doc_id").distinct()
    stay = docs.filter("doc_id IS NOT NULL").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns]).union(docs.filter("doc_id IS NULL"))
