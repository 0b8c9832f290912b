"""Removal of passages that an earlier document holds already, with Aho-Corasick automata over words.

A window is 13 words. It is removed from a document if it also starts in one of a smaller doc_id.

1. *Anchors.* Of each window the smallest hash of its nine 5-word grams is taken: equal windows have
   equal anchors, and there are few of them. Which anchors are in two documents or more is found by
   exchanging, between chunks of documents and parts of the hash range, sorted arrays one way and bits
   the other.
2. *Passages.* Stretches of windows whose anchor recurs are cut out, and the same exchange finds, for
   each window, the smallest doc_id, the number of places and what precedes it. In the document that
   has a window first, neighbours that go together at all their places form one passage.
3. *Automata.* Passages are dealt to shards by that document, and so are the stretches of later
   documents that it owns. Each shard compiles its passages into one automaton over words and streams
   the stretches through it; an occurrence is confirmed on the words. A shard with much to read is
   read by several tasks, each with the same automaton.

Copies of a whole text are settled before, by the hash of their words: all but the first lose all
words, and only the first goes through the steps. Hashes only choose what is looked at. Tables between
the steps are written to the shared folder and deleted once the next one stands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.llm.common import forget, joined, ragged, small_batches, text_bytes, words_of, work_dir, written

WINDOW = 13
GRAM = 5
CHUNK = 1 << 19  # anchors or windows that a task gathers before it sends them
PART_BYTES = 512 << 20  # text bytes for each part of the hash range
MIN_PARTS = 32
SHARDS_PER_PART = 16
LEAST_READ = 20_000  # words that a shard may always read in one task

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def _rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= _MUL
        out += hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """The smallest gram hash of every window."""
    low = _rolling(hashes, GRAM)
    reach = WINDOW - GRAM + 1
    width = 1
    while 2 * width <= reach:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = reach - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _inside(doc: np.ndarray) -> np.ndarray:
    """Whether a window that starts at each word ends in the same document."""
    return doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]


def _chunk_id(n: int) -> int:
    return TaskContext.get().partitionId() << 24 | n


def _by_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part ends in keys sorted by part << 32 | value."""
    return np.searchsorted(keys >> np.uint64(32), np.arange(parts, dtype=np.uint64), "right").astype("<u4")


_SCANNED = (
    "kind string, doc_id long, tkey long, n_words long, sequence binary, chunk long, doc_ids binary, tkeys binary, "
    "sizes binary, at binary, keys binary, multi binary, part_ends binary"
)
_SCANNED_ARROW = pa.schema(
    [("kind", pa.string()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_words", pa.int64()), ("sequence", pa.binary()), ("chunk", pa.int64())]
    + [(c, pa.binary()) for c in ("doc_ids", "tkeys", "sizes", "at", "keys", "multi", "part_ends")]
)


def _scan(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows for chunks of documents with their distinct anchors."""
    held: list[tuple[np.ndarray, ...]] = []
    n = made = 0

    def flush() -> pa.RecordBatch:
        docs, tkeys, sizes, keys = (np.concatenate(x) for x in zip(*held))
        values, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        row = {
            "kind": "chunk", "chunk": _chunk_id(made), "doc_ids": docs.astype("<i8"), "tkeys": tkeys.astype("<i8"), "sizes": sizes.astype("<u4"),
            "at": at.astype("<u4"), "keys": values.astype("<u4"), "multi": np.packbits(times > 1), "part_ends": _by_part(values, parts),
        }
        return pa.RecordBatch.from_pylist([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()}], _SCANNED_ARROW)

    for batch in small_batches(batches):
        words, counts = words_of(batch.column("text"))
        texts = joined(words, counts)
        size = batch.num_rows
        blank = pa.nulls(size, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(["doc"] * size), batch.column("doc_id"), batch.column("tkey"), pa.array(counts), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.nulls(size, pa.int64()), *[blank] * 7],
            schema=_SCANNED_ARROW,
        )
        if len(words) < WINDOW:
            continue
        doc = np.repeat(np.arange(size), counts)
        inside = _inside(doc)
        anchor = _anchors(_word_hashes(words))[inside]
        doc = doc[: len(inside)][inside]
        key = (anchor >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        doc, key = doc[new], key[new]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        doc, key = doc[new], key[new]
        has, sizes = np.unique(doc, return_counts=True)
        held.append((batch.column("doc_id").to_numpy()[has], batch.column("tkey").to_numpy()[has], sizes, key))
        n += len(key)
        if n >= CHUNK:
            yield flush()
            held.clear()
            n, made = 0, made + 1
    if held:
        yield flush()


def _sent(fields: dict[str, int]):
    """Cuts each chunk's arrays (bytes per value; 0: bits) into a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["part_ends"], "<u4").tolist()
                bits = {f: np.unpackbits(np.frombuffer(row[f], np.uint8)) for f, w in fields.items() if not w}
                rows = []
                for part, (a, b) in enumerate(zip([0, *ends], ends)):
                    if b > a:
                        cut = {f: row[f][a * w : b * w] if w else bits[f][a:b].tobytes() for f, w in fields.items()}
                        rows.append({"part": part, "chunk": row["chunk"], **cut})
                schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *[(f, pa.binary()) for f in fields]])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _recurring(table: pa.Table) -> pa.Table:
    """For each chunk's anchors of a part one bit: in two documents or more."""
    parts = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(parts), "<u4")
    multi = np.frombuffer(b"".join(table.column("multi").to_pylist()), np.uint8).astype(bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    recurs = np.zeros(len(keys), bool)
    recurs[order] = np.r_[same, False] | np.r_[False, same] | multi[order]
    ends = np.cumsum([len(p) // 4 for p in parts])
    bits = [np.packbits(x).tobytes() for x in np.split(recurs, ends[:-1])]
    return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "bits": pa.array(bits, pa.binary())})


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The recurring anchors of each document."""
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.frombuffer(row["part_ends"], "<u4").astype(np.int64)
            sizes_of = np.diff(ends, prepend=0)
            values = np.frombuffer(row["keys"], "<u4")
            recurs = np.zeros(len(values), bool)
            for reply in row["replies"]:
                p = reply["part"]
                recurs[ends[p] - sizes_of[p] : ends[p]] = np.unpackbits(np.frombuffer(reply["bits"], np.uint8))[: sizes_of[p]]
            at = np.frombuffer(row["at"], "<u4")
            sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            hit = recurs[at]
            n = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
            found = values[at[hit]]
            parts = np.split(found, np.cumsum(n)[:-1])
            keep = n > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8")[keep]),
                    pa.array(np.frombuffer(row["tkeys"], "<i8")[keep]),
                    pa.array([p.tobytes() for p, k in zip(parts, keep) if k], pa.binary()),
                ],
                ["doc_id", "tkey", "anchors"],
            )


_STRETCHES = (
    "chunk long, doc_ids binary, tkeys binary, starts binary, sizes binary, texts array<string>, at binary, hashes binary, "
    "first binary, times binary, before binary, flags binary, part_ends binary"
)
_STRETCHES_ARROW = pa.schema(
    [("chunk", pa.int64())] + [(c, pa.binary()) for c in ("doc_ids", "tkeys", "starts", "sizes")] + [("texts", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("at", "hashes", "first", "times", "before", "flags", "part_ends")]
)
_MANY_DOCS, _MANY_BEFORE = 1, 2


def _reduced(order: np.ndarray, firsts: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray, before: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per window: the smallest document, its places, what precedes it, and whether these differ."""
    least = np.minimum.reduceat(low[order], firsts)
    most = np.maximum.reduceat(high[order], firsts)
    pre = before[order]
    pre_low, pre_high = np.minimum.reduceat(pre, firsts), np.maximum.reduceat(pre, firsts)
    any_flags = np.bitwise_or.reduceat(flags[order], firsts)
    any_flags |= np.where(least != most, _MANY_DOCS, 0).astype(np.uint8) | np.where(pre_low != pre_high, _MANY_BEFORE, 0).astype(np.uint8)
    return least, np.add.reduceat(times[order], firsts), pre_low, any_flags


def _stretches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches of windows with recurring anchors, in chunks with their distinct windows."""
    held: list[tuple] = []
    n = made = 0

    def flush() -> pa.RecordBatch:
        docs, tkeys, starts, sizes, hashes, before = (np.concatenate([h[i] for h in held]) for i in range(6))
        part = (hashes >> np.uint64(40)) % np.uint64(parts)
        order = np.lexsort((hashes, part))
        ordered = hashes[order]
        firsts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        at = np.empty(len(hashes), np.int64)
        at[order] = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(ordered)]))
        doc = np.repeat(docs, sizes)
        first, times, pre, flags = _reduced(order, firsts, doc, doc, np.ones(len(doc), np.int64), before, np.zeros(len(doc), np.uint8))
        ends = np.searchsorted(part[order][firsts], np.arange(parts, dtype=np.uint64), "right")
        row = {
            "chunk": _chunk_id(made), "doc_ids": docs.astype("<i8"), "tkeys": tkeys.astype("<i8"), "starts": starts.astype("<u4"), "sizes": sizes.astype("<u4"),
            "texts": [t for h in held for t in h[6]], "at": at.astype("<u4"), "hashes": ordered[firsts].astype("<u8"), "first": first.astype("<i8"),
            "times": times.astype("<u4"), "before": pre.astype("<u4"), "flags": flags, "part_ends": ends.astype("<u4"),
        }
        return pa.RecordBatch.from_pylist([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()}], _STRETCHES_ARROW)

    for batch in small_batches(batches):
        words, counts = words_of(batch.column("text"))
        if len(words) < WINDOW:
            continue
        hashes = _word_hashes(words)
        doc = np.repeat(np.arange(batch.num_rows), counts)
        anchor = _anchors(hashes) & np.uint64(0xFFFFFFFF)
        known = [np.frombuffer(a, "<u4") for a in batch.column("anchors").to_pylist()]
        wanted = np.sort(np.concatenate([k.astype(np.uint64) | np.uint64(i << 32) for i, k in enumerate(known)]))
        key = doc[: len(anchor)].astype(np.uint64) << np.uint64(32) | anchor
        found = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        take = (wanted[found] == key) & _inside(doc)
        at = np.flatnonzero(take)
        if not len(at):
            continue
        fresh = np.r_[True, (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])]
        firsts = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[firsts, len(at)])
        window = _rolling(hashes, WINDOW)[at]
        before = np.r_[np.uint64(0), window[:-1]] & np.uint64(0xFFFFFFFF)
        before[firsts] = 0
        texts = joined(words.take(pa.array(ragged(at[firsts], sizes + WINDOW - 1))), sizes + WINDOW - 1)
        of = doc[at[firsts]]
        doc_first = np.cumsum(counts) - counts
        held.append((batch.column("doc_id").to_numpy()[of], batch.column("tkey").to_numpy()[of], at[firsts] - doc_first[of], sizes, window, before, [t.decode() for t in texts]))
        n += len(at)
        if n >= CHUNK:
            yield flush()
            held.clear()
            n, made = 0, made + 1
    if held:
        yield flush()


def _owners(table: pa.Table) -> pa.Table:
    """For each chunk's windows of a part: the smallest document, the places, and the flags."""
    parts = table.column("hashes").to_pylist()
    whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    hashes, first = np.frombuffer(b"".join(parts), "<u8"), whole("first", "<i8")
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    firsts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    least, times, _, flags = _reduced(order, firsts, first, first, whole("times", "<u4").astype(np.int64), whole("before", "<u4"), whole("flags", np.uint8))
    back = np.empty(len(hashes), np.int64)
    back[order] = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(ordered)]))
    cuts = np.cumsum([len(p) // 8 for p in parts])[:-1]
    cut = lambda values: pa.array([x.tobytes() for x in np.split(values[back], cuts)], pa.binary())
    least = np.where(flags & _MANY_DOCS, least, 0)  # of no use for others
    return pa.table({
        "part": table.column("part"), "chunk": table.column("chunk"),
        "first": cut(least.astype("<i8")), "times": cut(times.astype("<u4")), "flags": cut(flags),
    })


_DEALT = "shard int, kind int, doc_id long, tkey long, at long, n_words long, words string"


def _dealt(shards: int):
    """Passages (kind 0), and stretches to be read (kind 1), each with the shard of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _deal_chunk(row, shards)

    return run


def _deal_chunk(row: dict, shards: int) -> Iterator[pa.RecordBatch]:
    whole = lambda c, kind: np.frombuffer(row[c], kind).astype(np.int64)
    ends, sizes, at = whole("part_ends", "<u4"), whole("sizes", "<u4"), whole("at", "<u4")
    begins = np.r_[0, ends[:-1]]
    n = int(ends[-1])
    first, times, flags = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint8)
    for r in row["replies"]:
        a, b = begins[r["part"]], ends[r["part"]]
        first[a:b], times[a:b], flags[a:b] = np.frombuffer(r["first"], "<i8"), np.frombuffer(r["times"], "<u4"), np.frombuffer(r["flags"], np.uint8)
    first, times, flags = first[at], times[at], flags[at]
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    docs, tkeys, starts = whole("doc_ids", "<i8"), whole("tkeys", "<i8"), whole("starts", "<u4")
    doc = docs[stretch]
    shared = (flags & _MANY_DOCS) > 0
    nth = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    follows = nth > 0
    prior = lambda x: np.r_[x[:1], x[:-1]]
    own, later = shared & (first == doc), shared & (first < doc)
    tied = follows & own & prior(own) & ((flags & _MANY_BEFORE) == 0) & (times == prior(times))
    along = follows & later & prior(later) & (first == prior(first))
    out: list[tuple] = []
    words_at, words = -1, []
    for kind, rows, joins in ((0, own, tied), (1, later, along)):
        heads = np.flatnonzero(rows & ~joins)
        member = np.cumsum(rows & ~joins)[rows] - 1
        lengths = np.bincount(member, minlength=len(heads)) + WINDOW - 1
        for i, size in zip(heads.tolist(), lengths.tolist()):
            s = int(stretch[i])
            if s != words_at:
                words_at, words = s, row["texts"][s].split(" ")
            a = int(nth[i])
            shard = xxhash.xxh64_intdigest(int(first[i]).to_bytes(8, "little", signed=True)) % shards
            out.append((shard, kind, int(docs[s]), int(tkeys[s]), int(starts[s]) + a, size, " ".join(words[a : a + size])))
    if out:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["shard", "kind", "doc_id", "tkey", "at", "n_words", "words"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _symbols(words: list[str]) -> tuple[int, ...]:
    return tuple(zlib.crc32(w.encode()) for w in words)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of passages in stretches. Rows come by shard, passages before stretches."""
    import ahocorasick

    shard, automaton, ready = None, None, False
    for batch in batches:
        out: list[tuple] = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "kind", "doc_id", "tkey", "at", "words")))
        for shard_, salt, kind, doc_id, tkey, start, text in rows:
            if (shard_, salt) != shard:
                shard, ready = (shard_, salt), False
                automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            words = text.split(" ")
            symbols = _symbols(words)
            if kind == 0:
                known = automaton.get(symbols, ())
                if text not in known:  # other words of the same symbols stay beside each other
                    automaton.add_word(symbols, (*known, text))
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            covered: list[list[int]] = []
            for last, passages in automaton.iter(symbols):
                size = passages[0].count(" ") + 1
                a = last - size + 1
                if " ".join(words[a : last + 1]) not in passages:
                    continue
                while covered and covered[-1][1] >= a:  # ends ascend
                    a = min(a, covered.pop()[0])
                covered.append([a, last + 1])
            out += [(doc_id, tkey, start + a, start + b) for a, b in covered]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "tkey", "at", "to"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, copy, spans) for the rows of ``docs`` that lose words.

    tkey is xxhash64 of the text; ``copy`` marks texts of 13 words and more whose words are those of a
    document with a smaller doc_id; spans are ranges [at, to) of words. Null and short texts have no
    windows; rows without doc_id lose nothing and count for nothing; rows of the same doc_id never
    count as earlier for each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "passages")
    base = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), "text")
    total = base.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    parts = max(MIN_PARTS, -(-total // PART_BYTES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(batches, parts)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stretches(batches, parts)

    scanned = written(base.mapInArrow(scan, _SCANNED), f"{work}/scan")
    known = scanned.filter(f"kind = 'doc' AND n_words >= {WINDOW}").select("doc_id", "tkey", "sequence")
    heads = known.groupBy("sequence").agg(F.min("doc_id").alias("head"))
    copies = written(known.join(heads, "sequence").filter("doc_id > head").select("doc_id", "tkey").distinct(), f"{work}/copies")

    chunks = scanned.filter("kind = 'chunk'").drop("kind", "doc_id", "tkey", "n_words", "sequence")
    sent = chunks.select("chunk", "keys", "multi", "part_ends").mapInArrow(_sent({"keys": 4, "multi": 0}), "part int, chunk long, keys binary, multi binary")
    bits = sent.groupBy("part").applyInArrow(_recurring, "part int, chunk long, bits binary")
    replies = bits.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("replies"))  # a row per part
    answered = chunks.drop("multi").join(replies, "chunk").mapInArrow(_answered, "doc_id long, tkey long, anchors binary")
    wanted = written(answered.join(copies, ["doc_id", "tkey"], "left_anti"), f"{work}/wanted")
    forget(spark, f"{work}/scan")

    stretches = written(base.join(wanted, ["doc_id", "tkey"]).mapInArrow(cut_out, _STRETCHES), f"{work}/stretches")
    forget(spark, f"{work}/wanted")
    fields = {"hashes": 8, "first": 8, "times": 4, "before": 4, "flags": 1}
    kinds = ", ".join(f"{f} binary" for f in fields)
    sent = stretches.select("chunk", *fields, "part_ends").mapInArrow(_sent(fields), f"part int, chunk long, {kinds}")
    owners = sent.groupBy("part").applyInArrow(_owners, "part int, chunk long, first binary, times binary, flags binary")
    replies = owners.groupBy("chunk").agg(F.collect_list(F.struct("part", "first", "times", "flags")).alias("replies"))
    chunks = stretches.drop(*fields).join(replies, "chunk")
    shards = parts * SHARDS_PER_PART
    dealt = written(chunks.mapInArrow(_dealt(shards), _DEALT), f"{work}/dealt")

    forget(spark, f"{work}/stretches")
    to_read = dealt.filter("kind = 1")
    most = max(LEAST_READ, (to_read.agg(F.sum("n_words")).first()[0] or 0) // (2 * shards))
    loads = to_read.groupBy("shard").agg(F.sum("n_words").alias("load"))  # a row per shard
    salts = loads.select("shard", F.ceil(F.col("load") / most).cast("int").alias("salts"))
    salted = dealt.join(salts, "shard")
    all_salts = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("salts") - 1))
    salt = F.explode(F.coalesce(all_salts, F.array(F.pmod(F.xxhash64("doc_id", "at"), "salts").cast("int")))).alias("salt")
    streams = salted.select("shard", salt, "kind", "doc_id", "tkey", "at", "words").repartition("shard", "salt")
    places = written(streams.sortWithinPartitions("shard", "salt", "kind").mapInArrow(_located, "doc_id long, tkey long, at long, to long"), f"{work}/places")
    forget(spark, f"{work}/dealt")
    spans = places.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set(F.struct("at", "to"))).alias("spans"))
    none = F.array().cast("array<struct<at:bigint,to:bigint>>")
    return spans.select("doc_id", "tkey", F.lit(False).alias("copy"), "spans").union(copies.select("doc_id", "tkey", F.lit(True), none))


def drop_repeats(docs: DataFrame, keep_spacing: bool = False) -> DataFrame:
    """``docs`` with the words that an earlier document has taken out of ``text``, and n_words and
    n_removed added (columns of these names are replaced).

    Kept words are joined by one space; with ``keep_spacing``, a text that loses nothing stays as it
    is, null included. Columns and rows are kept otherwise.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    own = docs.select(*[F.col(f"`{c}`") for c in columns])
    lost = repeated_spans(docs).toDF("lost_doc_id", "lost_tkey", "lost_copy", "lost_spans")
    same = (F.col("doc_id").cast("long") == F.col("lost_doc_id")) & (F.xxhash64("text") == F.col("lost_tkey"))
    both = own.join(lost, same, "left").drop("lost_doc_id", "lost_tkey")
    schema = own.schema.add("n_words", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, counts = words_of(batch.column("text"))
            ends = np.cumsum(counts)
            keep = np.ones(len(words), bool)
            first = (ends - counts).tolist()
            for i, (copy, spans) in enumerate(zip(batch.column("lost_copy").to_pylist(), batch.column("lost_spans").to_pylist())):
                if copy:
                    keep[first[i] : ends[i]] = False
                for span in spans or ():
                    keep[first[i] + span["at"] : first[i] + span["to"]] = False
            seen = np.r_[0, np.cumsum(keep)]
            left = seen[ends] - seen[ends - counts]
            texts = pa.array(joined(words.filter(pa.array(keep)), left), pa.binary()).cast(pa.string())
            if keep_spacing:
                import pyarrow.compute as pc

                texts = pc.if_else(pa.array(left == counts), batch.column("text"), texts)
            arrays = [texts if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts), pa.array(counts - left)], [*columns, "n_words", "n_removed"])

    return both.mapInArrow(run, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM windows) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
