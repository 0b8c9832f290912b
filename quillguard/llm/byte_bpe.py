"""Byte-level BPE with Spark's own higher-order functions.

Texts are cut into words by the pattern given; a task numbers the words it meets, and each new one
goes on once, with the pieces of the vocabulary that stand in it anywhere, in order of rank. Higher-order
functions fold them: the state is one long with a bit for each boundary between the parts of the word, and
a piece joins two parts if they are what it is made of, that is, if one boundary only is left in it. Pieces
that have no boundary within and one at each end are the word's ids. (A word of the vocabulary starts
without boundaries.) Then the ids of a text are put together from those of its words, and decoding looks
the pieces up by id.

One pass in order of rank joins what merging by lowest rank joins if each piece of the vocabulary, merged
by itself, becomes one in steps of rising rank: two parts that make up a piece of lower rank than the last
step would have been joined within that piece before. ``joins_in_order`` tests it. For other vocabularies,
and for words that are too long for a long, each step of the fold joins the leftmost pair of lowest rank,
until no neighbours have a rank: such a word is held as its ids and the ranks of all neighbouring pairs, and
a step asks for two new ranks only. The rank of a pair of ids, which is the id of the joined piece too,
stands in literal arrays at a place that no other pair has: look-ups in lambdas are interpreted, so one has
few expressions.

What a task has numbered is forgotten once it is too much, and then numbered anew. No step shuffles
texts, words or ids.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import ragged, small_batches
from quillguard.llm.vocab import _Rows

# Words that a task keeps the ids of; beyond it the numbering starts anew.
KEPT_WORDS = 1 << 19
# Text bytes that a task cuts at once.
CUT_BYTES = 128 << 10
# Bytes of words whose boundaries a long holds.
LONG_BYTES = 62

_BYTES = "ISO-8859-1"  # one character for each byte
_NO_RANK = 1 << 40

_WORD = "struct<marks: long, spans: array<long>, places: array<long>, parts: array<long>>"
_CUT = f"doc_ids array<long>, counts array<int>, numbers binary, first int, words array<{_WORD}>"
# A place is the first byte of a piece and its id.
_ID_BITS = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a file with a base64 piece and a rank in each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(piece): int(rank) for piece, rank in lines if piece}


def joins_in_order(ranks: dict[bytes, int]) -> bool:
    """Whether there is a piece for each byte and every piece, merged by itself, becomes one by rising ranks."""
    if any(bytes([b]) not in ranks for b in range(256)):
        return False
    for piece in ranks:
        parts, last = [piece[i : i + 1] for i in range(len(piece))], -1
        while len(parts) > 1:
            beside = [ranks.get(a + b, _NO_RANK) for a, b in zip(parts, parts[1:])]
            low = min(beside)
            if low == _NO_RANK or low < last:
                return False
            at, last = beside.index(low), low
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Pieces:
    """Finds the pieces of a vocabulary in words, along a trie: the node below another by a byte stands in a
    hash table, at its home or the next free place."""

    def __init__(self, ranks: dict[bytes, int]):
        nodes = {b"": 0}
        for piece in ranks:
            for i in range(1, len(piece) + 1):
                nodes.setdefault(piece[:i], len(nodes))
        self.ids = np.full(len(nodes), -1, np.int64)
        self.ids[[nodes[p] for p in ranks]] = list(ranks.values())
        self.bits = (4 * len(nodes)).bit_length()
        self.keys, self.below = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([nodes[p[:-1]] << 8 | p[-1] for p in nodes if p], np.int64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            here = self.keys[at[left]] == keys[left]
            self.below[at[left[here]]] = left[here] + 1
            left = left[~here]
            at[left] = self._behind(at[left])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def _behind(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & (1 << self.bits) - 1

    def _step(self, nodes: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The nodes below ``nodes`` by the bytes ``by``, 0 where there is none."""
        keys = nodes << 8 | by
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.below[at], 0)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            at[left] = self._behind(at[left])
            seen, wanted = self.keys[at[left]], keys[left]
            here = seen == wanted
            out[left[here]] = self.below[at[left[here]]]
            left = left[~here & (seen >= 0)]
        return out

    def within(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many pieces stand in each word (of ``LONG_BYTES`` at most); their spans, a bit for each boundary
        from a piece's first to its last, and their places. Pieces of a word are in order of rank and start."""
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        word, rest = np.repeat(np.arange(len(words)), lengths), np.repeat(ends, lengths) - np.arange(len(text))
        at, nodes, n, found = np.arange(len(text)), np.zeros(len(text), np.int64), 0, []
        while len(at):
            nodes = self._step(nodes, text[at + n])
            n += 1
            at, nodes = at[nodes > 0], nodes[nodes > 0]
            ids = self.ids[nodes]
            found.append((at[ids >= 0], ids[ids >= 0], np.full(np.count_nonzero(ids >= 0), n)))
            more = rest[at] > n
            at, nodes = at[more], nodes[more]
        at, ids, sizes = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        of, first = word[at], lengths[word[at]] - rest[at]
        order = np.argsort((of * (self.ids.max() + 1) + ids) * 64 + first)
        spans = (np.left_shift(2, sizes) - 1) << first
        return np.bincount(of, minlength=len(words)), spans[order], (first << _ID_BITS | ids)[order]


@functools.cache
def _pieces(path: str) -> tuple[dict[bytes, int], Pieces]:
    """Once per worker, whatever its tasks."""
    ranks = read_ranks(path)
    return ranks, Pieces(ranks)


def _only(values: Column) -> Column:
    """The one element of an array. (Indexing would derive the array's type again for every row.)"""
    return F.array_min(values)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return _only(F.transform(F.array(value), use))


class PairRanks:
    """Ranks of pairs of ids: any two pieces that make up a piece, as merging takes them. The key of a pair
    is ``left * ids + right``; it stands ``shift[key % groups]`` places behind ``key % places``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = max(ranks.values(), default=0) + 1
        found: dict[int, int] = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    found[left * self.ids + right] = rank
        # keys of a group have different homes: groups and places have no common divisor
        self.groups = len(found) // 2 + 1 | 1
        self.places = 1 << max(1 + (2 * len(found)).bit_length(), (self.ids**2 // self.groups).bit_length())
        grouped: dict[int, list[int]] = {}
        for key in found:
            grouped.setdefault(key % self.groups, []).append(key)
        free = bytearray(b"\1") * self.places
        self.shift, self.keys, self.ranks = [0] * self.groups, [-1] * self.places, [-1] * self.places
        for group, keys in sorted(grouped.items(), key=lambda g: -len(g[1])):
            shift, homes = 0, [k % self.places for k in keys]
            while not all(free[(h + shift) % self.places] for h in homes):
                shift += 1
            self.shift[group] = shift
            for home, key in zip(homes, keys):
                at = (home + shift) % self.places
                free[at], self.keys[at], self.ranks[at] = 0, key, found[key]
        # places behind the last one take the shifts that would pass it
        behind = max(self.shift)
        self.keys += self.keys[:behind]
        self.ranks += self.ranks[:behind]


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _in_order(word: Column) -> Column:
    """Ids of a word that is given by its boundaries and pieces, joined in order of rank."""

    def left_in(marks: Column, span: Column, n: int) -> Column:
        """Whether ``n`` boundaries are left in a span, the first and the last one among them."""
        left = marks.bitwiseAND(span)
        return (F.bit_count(left) == n) & (left > F.shiftright(span, 1)) & (left.bitwiseAND(-span) != 0)

    def step(marks: Column, span: Column) -> Column:
        inner = marks.bitwiseAND(F.shiftleft(span, 1)).bitwiseAND(F.shiftright(span, 1))
        return F.when(left_in(marks, span, 3), marks.bitwiseXOR(inner.bitwiseAND(span))).otherwise(marks)

    def ids(marks: Column) -> Column:
        kept = F.filter(word["places"], lambda _, i: left_in(marks, F.get(word["spans"], i), 2))
        return F.transform(F.sort_array(kept), lambda place: place.bitwiseAND((1 << _ID_BITS) - 1))

    return F.flatten(F.transform(F.array(F.aggregate(word["spans"], word["marks"], step)), ids))  # the marks are computed once


class Vocabulary:
    """Expressions over the ranks of a file; ``pattern`` cuts texts into words."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        ranks = read_ranks(path)
        by_id = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            by_id[rank] = piece.decode("latin-1")
        self._by_id = _literal(by_id, "string")
        self._pairs = PairRanks(ranks)

    def fold(self, words: Column) -> Column:
        """Ids of words (array<array<long>>), as ``cut`` gives them."""

        pairs = self._pairs
        tables = F.struct(*[_literal(values, kind).alias(c) for c, values, kind in (("shift", pairs.shift, "int"), ("keys", pairs.keys, "long"), ("ranks", pairs.ranks, "long"))])

        def all_folded(t: Column) -> Column:
            def rank(left: Column, right: Column) -> Column:
                key = left * F.lit(pairs.ids) + right
                at = F.get(t["shift"], (key % F.lit(pairs.groups)).cast("int")) + key.bitwiseAND(F.lit(pairs.places - 1)).cast("int")
                return F.when(F.get(t["keys"], at) == key, F.get(t["ranks"], at)).otherwise(F.lit(_NO_RANK))

            def step(state: Column, _: Column) -> Column:
                """state: ids, and the ranks of their neighbouring pairs between two that are none."""
                ids, ranks = state["ids"], state["ranks"]

                def at_lowest(low: Column) -> Column:
                    def joined(p: Column) -> Column:
                        now = F.concat(F.slice(ids, F.lit(1), p - 2), F.array(low), F.slice(ids, p + 1, F.size(ids)))
                        beside = F.array(rank(F.get(ids, p - 3), low), rank(low, F.get(ids, p)))
                        return F.struct(now.alias("ids"), F.concat(F.slice(ranks, F.lit(1), p - 2), beside, F.slice(ranks, p + 2, F.size(ids))).alias("ranks"))

                    return F.when(low == _NO_RANK, state).otherwise(_bound(F.array_position(ranks, low).cast("int"), joined))

                return _bound(F.array_min(ranks), at_lowest)

            def folded(word: Column) -> Column:
                n = F.size(word) - 1
                none = F.array(F.lit(_NO_RANK))
                beside = F.zip_with(F.slice(word, F.lit(1), n), F.slice(word, F.lit(2), n), rank)
                start = F.struct(word.alias("ids"), F.concat(none, beside, none).alias("ranks"))
                return F.when(n < 1, word).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda state: state["ids"]))

            return F.transform(words, lambda word: F.when(word["marks"] == 0, folded(word["parts"])).otherwise(_in_order(word)))

        return _bound(tables, all_folded)

    def bytes_of(self, ids: Column) -> Column:
        """The bytes that ids stand for; ids outside the vocabulary have none."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self._by_id, i)), ""), _BYTES)


class _Numbers(dict):
    """Numbers of words in the order they are met; ``new`` are those met since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def cut(docs: DataFrame, ranks: str, pattern: str, most: int) -> DataFrame:
    """Words of the texts of ``docs`` (doc_id, text), a row for some documents: their ids and counts of
    words, the numbers of all their words, the number of the first new word and all new ones. A word has marks,
    a bit for each boundary that it starts with, and the spans and places of the pieces in it; one that is not
    folded in order of rank has no marks but the ids of its parts. Numbers start anew with a row whose
    ``first`` is 0."""
    in_order = joins_in_order(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        found, (pieces, trie) = regex.compile(pattern).findall, _pieces(ranks)
        of_byte = [pieces.get(bytes([b])) for b in range(256)]
        numbers = _Numbers()
        for batch in small_batches(batches, limit=CUT_BYTES):
            if len(numbers) > most:
                numbers = _Numbers()
            first = len(numbers)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            words = [found((t or b"").decode("utf-8", "replace")) for t in texts]
            taken = np.concatenate([np.zeros(0, "<i4"), *(np.fromiter(map(numbers.__getitem__, w), "<i4", len(w)) for w in words)])
            new = [w.encode() for w in numbers.new]
            numbers.new.clear()
            short = [in_order and len(w) <= LONG_BYTES for w in new]
            marks = [(1 | 1 << len(w) if w in pieces else (2 << len(w)) - 1) if s else 0 for w, s in zip(new, short)]
            parts = [[] if s else [pieces[w]] if w in pieces else [of_byte[b] for b in w] for w, s in zip(new, short)]
            counts, spans, places = trie.within([w if s else b"" for w, s in zip(new, short)])
            ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (spans, places)]
            row = [
                batch.column("doc_id").cast(pa.int64()), pa.array([len(w) for w in words], pa.int32()), pa.array([taken.tobytes()], pa.binary()), pa.array([first], pa.int32()),
                pa.StructArray.from_arrays([pa.array(marks, pa.int64()), *lists, pa.array(parts, pa.list_(pa.int64()))], ["marks", "spans", "places", "parts"]),
            ]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (row[0], row[1], row[4])]
            yield pa.RecordBatch.from_arrays([*whole[:2], row[2], row[3], whole[2]], ["doc_ids", "counts", "numbers", "first", "words"])

    return docs.mapInArrow(run, _CUT)


def put_together(folded: DataFrame) -> DataFrame:
    """doc_id and ids of all documents of rows as ``cut`` gives them, in their order, with words folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends = _Rows(np.int32), _Rows(np.int64, [0])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if row["first"].as_py() == 0:
                    ids.n, ends.n = 0, 1
                words = row["words"].values
                last = ends.seen()[-1]
                if len(words):
                    bounds = words.offsets.to_numpy().astype(np.int64)
                    ids.extend(words.flatten().to_numpy(zero_copy_only=False))
                    ends.extend(last + bounds[1:] - bounds[0])
                at = np.frombuffer(row["numbers"].as_buffer(), "<i4")
                starts = ends.seen()[at]
                lengths = ends.seen()[at + 1] - starts
                counts = row["counts"].values.to_numpy()
                before = np.r_[0, np.cumsum(lengths)]
                offsets = before[np.r_[0, np.cumsum(counts, dtype=np.int64)]]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.seen()[ragged(starts, lengths)]))
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, lists], ["doc_id", "ids"])

    return folded.mapInArrow(run, "doc_id long, ids array<int>")


def encode(docs: DataFrame, ranks: str, pattern: str, most: int = KEPT_WORDS) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary, the bytes that the ids stand for) of every row of
    ``docs`` (doc_id, text; more columns are ignored).

    Ids are those of the vocabulary in the file ``ranks``, each match of ``pattern`` encoded by itself;
    strings of special tokens are ordinary text. A null or empty text has no ids and decodes to no
    bytes; repeated rows are encoded each. A task forgets its words when it has met more than ``most``;
    results do not depend on it.
    """
    ship(docs.sparkSession)
    vocabulary = Vocabulary(ranks, pattern)
    words = cut(docs.select(F.col("doc_id").cast("long"), "text"), ranks, pattern, most)
    coded = put_together(words.withColumn("words", vocabulary.fold(F.col("words"))))
    return coded.select("doc_id", "ids", vocabulary.bytes_of(F.col("ids")).alias("decoded"))
