"""Token counts by rank-synchronous merging over arrays.

The tokenizer's merges are a table of pairs with ranks. Words that a worker meets for the first time
are held together as one ragged array of symbols; in every round each word's pair of lowest rank is
merged at all its places, in all words at once, until no word has a pair left. What counts is the
number of symbols that survive. A merge never brings up a pair of lower rank than its own, so this
gives the library's result. A worker keeps the counts of words, in a table of bounded size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import small_batches, text_bytes
from quillguard.llm.vocab import byte_letters

# Words, and parts of words, that a worker keeps.
KEPT_WORDS = 1 << 20
_NONE = np.iinfo(np.int32).max

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile("[\\x00!-~À-ÖØ-öø-ÿ]*")
_PLAIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s\\x000-9{_LETTERS}]+|\\x00")


class MergeTable:
    """Ranks and products of pairs, for a byte-level vocabulary with marked ends of words."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], np.int64)
        self.size = max(vocab.values()) + 1
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.products = keys[order], order.astype(np.int32), pairs[order, 2]
        self.special = [t["content"] for t in spec["added_tokens"]]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` if it is not merged."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def product_of(self) -> np.ndarray:
        out = np.empty(len(self.ranks), np.int64)
        out[self.ranks] = self.products
        return out

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word, none empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        product = self.product_of()
        word = np.repeat(np.arange(len(words)), lengths)  # of each symbol
        rank = np.full(len(symbols), _NONE, np.int32)  # of the pair that starts at each symbol
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.look_up(symbols[inside], symbols[inside + 1])
        while len(symbols):
            firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[firsts, len(word)])
            lowest = np.minimum.reduceat(rank, firsts)
            done = lowest == _NONE
            counts[word[firsts[done]]] = sizes[done]
            here = rank == np.repeat(np.where(done, -1, lowest), sizes)
            at = np.flatnonzero(here)
            # a symbol repeated, as in "aaa": every other of adjacent places, from the left
            fresh = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = product[rank[at]]
            keep = np.repeat(~done, sizes)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            before = at[at > 0] - 1
            changed[before] = True
            # the symbol before may itself be the second of a pair merged in this round
            changed[np.maximum(before - 1, 0)] = True
            symbols, word, rank, changed = symbols[keep], word[keep], rank[keep], changed[keep]
            again = np.flatnonzero(changed)
            rank[again] = _NONE
            again = again[again + 1 < len(symbols)]
            again = again[word[again] == word[again + 1]]
            rank[again] = self.look_up(symbols[again], symbols[again + 1])
        return counts


class TextCounts:
    """Token counts of batches of texts."""

    def __init__(self, path: str, limit: int = KEPT_WORDS):
        import regex

        self.table, self.limit = MergeTable(path), limit
        self.special = re.compile("|".join(map(re.escape, self.table.special)))
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.kept: dict[str, int] = {}
        self.part_kept: dict[str, int] = {}

    def _parts_of(self, word: str) -> tuple[list[str], int]:
        """Parts of any word, and the special tokens in it."""
        found = len(self.special.findall(word))
        parts: list[str] = []
        for piece in self.special.split(word):
            normal = "".join(c.lower() for c in unicodedata.normalize("NFC", piece))
            parts += self.parts.findall(normal)
        return parts, found

    def _count_parts(self, parts: list[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self.part_kept]
        if new:
            self.part_kept.update(zip(new, self.table.survivors([p.encode() for p in new]).tolist()))

    def _add(self, words: list[str]) -> None:
        whole = "".join(words)
        if _PLAIN.fullmatch(whole) and "<|" not in whole and "\0" not in whole:
            plain, other = words, []
        else:
            fit = [bool(_PLAIN.fullmatch(w)) and "<|" not in w and "\0" not in w for w in words]
            plain, other = [w for w, f in zip(words, fit) if f], [w for w, f in zip(words, fit) if not f]
        if plain:
            parts = _PLAIN_PARTS.findall("\0".join(plain).lower()) + ["\0"]
            closing = np.fromiter((p == "\0" for p in parts), bool, len(parts))  # only parts the words
            self._count_parts([p for p in parts if p != "\0"])
            counts = np.fromiter((0 if p == "\0" else self.part_kept[p] for p in parts), np.int64, len(parts))
            totals = np.cumsum(counts)[closing]
            self.kept.update(zip(plain, np.diff(totals, prepend=0).tolist()))
        split = [self._parts_of(w) for w in other]
        self._count_parts([p for parts, _ in split for p in parts])
        for word, (parts, found) in zip(other, split):
            self.kept[word] = found + sum(map(self.part_kept.__getitem__, parts))

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null has none."""
        if len(self.kept) + len(self.part_kept) > self.limit:
            self.kept, self.part_kept = {}, {}
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.kept]
        if new:
            self._add(new)
        each = np.fromiter(map(self.kept.__getitem__, distinct), np.int64, len(distinct))
        ends = np.cumsum(counts)
        return np.add.reduceat(each[coded.indices.to_numpy(zero_copy_only=False)], ends - counts) if len(counts) else counts


_LOADED: dict[str, TextCounts] = {}


def loaded(path: str) -> TextCounts:
    if path not in _LOADED:
        _LOADED[path] = TextCounts(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of ``docs`` (doc_id, text; more columns are
    ignored). A null text is empty and has no tokens; repeated rows are counted each."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(tokenizer)
        for batch in small_batches(batches):
            counts = pa.array(counter.batch(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", text_bytes(F.col("text")).alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
