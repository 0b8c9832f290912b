"""Ids of whole texts by a public tokenizer, each distinct piece encoded once per worker.

Both vocabularies treat a text as a row of pieces that do not touch each other: white space is
dropped by one (``split="word"``), and the other never joins what stands before a space to the space
(``split="space"``). So a text's ids are those of its pieces in order, and a worker keeps the ids of
the pieces it has met in one pool of bounded size. A piece of plain Latin letters, digits and ASCII
signs is cut by the tokenizer's own pattern and given to the library's model; every other piece,
and every text whose spaces run together, goes through the library's full path.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillguard.llm.common import ragged

# Pieces that a worker keeps; beyond it the pool starts anew.
POOL_PIECES = 1 << 19

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = {
    "word": re.compile("[\\x00!-~À-ÖØ-öø-ÿ]*"),
    "space": re.compile("[\\x00 \\n!-~À-ÖØ-öø-ÿ]*"),
}
# The tokenizers' patterns on plain characters; pieces stand in one string, parted by NUL, which a
# look ahead takes for white space.
_PARTS = {
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s\\x000-9{_LETTERS}]+|\\x00"),
    "space": re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s\\x000-9{_LETTERS}]+"
        "|\\s+(?![^\\s\\x00])|\\s+|\\x00"
    ),
}

# A space between white space (or before the end) may not be a cut; other blanks than ASCII ones
# are left to the library.
_BLANK = r"\x09-\x0D\x20"
_RUN_OF_SPACES = f"[{_BLANK}] (?:[{_BLANK}]|\\z)"
_ODD_BLANK = "[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextIds:
    """Encodes batches of texts with the tokenizer file at ``path``."""

    def __init__(self, path: str, split: str, limit: int = POOL_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.split, self.limit = split, limit
        self.letters = {**byte_letters(), 0: "\0"}
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}  # of pieces
        self.ids, self.ends = _Rows(np.uint32), _Rows(np.int64, [0])
        self.part_slot: dict[str, int] = {}
        self.part_ids, self.part_ends = _Rows(np.uint32), _Rows(np.int64, [0])

    def slots(self, pieces: list[str]) -> np.ndarray:
        """Where the pool keeps the ids of each piece; unknown ones are encoded."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.slot]
        if new:
            plain, other = self._sorted_out(new)
            coded = [self.tokenizer.encode(piece, add_special_tokens=False).ids for piece in other]
            first = len(self.slot)
            if plain:
                self._add_plain(plain)
            for ids in coded:
                self._add(ids)
            self.slot.update(zip(plain + other, range(first, first + len(new))))
        return np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))

    def _sorted_out(self, pieces: list[str]) -> tuple[list[str], list[str]]:
        plain = _PLAIN[self.split].fullmatch
        whole = "".join(pieces)
        if plain(whole) and "<|" not in whole and "\0" not in whole:
            return pieces, []
        kept = [bool(plain(p)) and "<|" not in p and "\0" not in p for p in pieces]
        return [p for p, k in zip(pieces, kept) if k], [p for p, k in zip(pieces, kept) if not k]

    def _add(self, ids: list[int]) -> None:
        self.ids.extend(ids)
        self.ends.extend([self.ids.n])

    def _add_plain(self, pieces: list[str]) -> None:
        text = "\0".join(pieces)
        parts = _PARTS[self.split].findall(text.lower() if self.split == "word" else text)
        parts.append("\0")
        known = self.part_slot
        new = [p for p in dict.fromkeys(parts) if p not in known]
        spelled = iter("\0".join([p for p in new if p != "\0"]).encode().decode("latin-1").translate(self.letters).split("\0"))
        tokenize = self.model.tokenize
        coded = [[] if p == "\0" else [t.id for t in tokenize(next(spelled))] for p in new]  # "\0" ends a piece and has no ids
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self.part_ids.extend([i for ids in coded for i in ids])
        self.part_ends.extend(self.part_ends.seen()[-1] + np.cumsum([len(ids) for ids in coded]))
        slot = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        ends = self.part_ends.seen()
        starts, lengths = ends[slot], ends[slot + 1] - ends[slot]
        self.ids.extend(self.part_ids.seen()[ragged(starts, lengths)])
        closing = np.flatnonzero(slot == known["\0"])
        self.ends.extend(self.ends.seen()[-1] + np.cumsum(lengths)[closing])

    def batch(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has. Null is empty."""
        if len(self.slot) > self.limit:
            self.clear()
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        if self.split == "word":
            lists = pc.ascii_split_whitespace(texts)
        else:
            odd = pc.or_(pc.match_substring_regex(texts, _RUN_OF_SPACES), pc.match_substring_regex(texts, _ODD_BLANK))
            whole = odd.to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        firsts = np.cumsum(counts) - counts
        if self.split == "word":
            slot = self.slots(distinct)[at]
        else:
            slot = self.slots([" " + p for p in distinct])[at]
            head = at[firsts]
            needed = np.unique(head)
            bare = np.zeros(len(distinct), np.int64)
            bare[needed] = self.slots([distinct[i] for i in needed])
            slot[firsts] = bare[head]
        held = self.ids.n, self.ends.n
        for i in np.flatnonzero(whole):  # such a text is one piece, and is not kept
            slot[firsts[i]] = self.ends.n - 1
            self._add(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids)
        if end_id is not None:
            slot = np.insert(slot, firsts + counts, self.ends.n - 1)
            self._add([end_id])
            counts = counts + 1
            firsts = np.cumsum(counts) - counts
        ends = self.ends.seen()
        starts = ends[slot]
        lengths = ends[slot + 1] - starts
        ids = self.ids.seen()[ragged(starts, lengths)].astype(self.dtype)
        self.ids.n, self.ends.n = held
        return ids, np.add.reduceat(lengths, firsts) if len(counts) else counts


class _Rows:
    """An array that grows at its end."""

    def __init__(self, dtype: type, values: list[int] = ()):
        self.held, self.n = np.zeros(1024, dtype), 0
        self.extend(values)

    def extend(self, values: np.ndarray | list[int]) -> None:
        to = self.n + len(values)
        if to > len(self.held):
            grown = np.zeros(2 * to, self.held.dtype)
            grown[: self.n] = self.seen()
            self.held = grown
        self.held[self.n : to] = values
        self.n = to

    def seen(self) -> np.ndarray:
        return self.held[: self.n]


_LOADED: dict[tuple[str, str], TextIds] = {}


def loaded(path: str, split: str) -> TextIds:
    """The worker's encoder for a file; workers serve many tasks."""
    if (path, split) not in _LOADED:
        _LOADED[path, split] = TextIds(path, split)
    return _LOADED[path, split]
