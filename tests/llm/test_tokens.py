"""Token files, counts and packing against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillguard.llm import packing, token_counts, token_files
from quillguard.llm.token_counts import TextCounts
from quillguard.llm.vocab import TextIds

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path, text, end=()):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, *end]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab theTHE \n\t'sé1.<|Z\xa0́　!\0", max_size=40), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    for path, split in ((WORD, "word"), (BYTE, "space")):
        ids, counts = _cached(path, split).batch(pa.array(texts, pa.string()), None)
        tk = _library(path)
        want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert _counter().batch(pa.array(texts, pa.string())).tolist() == [len(_library(WORD).encode(t, add_special_tokens=False).ids) for t in texts]


_HELD: dict = {}


def _cached(path, split):
    if path not in _HELD:
        _HELD[path] = TextIds(path, split)
    return _HELD[path]


def _library(path):
    if ("lib", path) not in _HELD:
        _HELD["lib", path] = Tokenizer.from_file(path)
    return _HELD["lib", path]


def _counter():
    if "counts" not in _HELD:
        _HELD["counts"] = TextCounts(WORD)
    return _HELD["counts"]


def test_code_lengths_are_limited_and_complete():
    counts = np.array([2**i for i in range(30)])
    lengths = token_files.code_lengths(counts, 8)
    assert lengths.max() == 8 and (2.0**-lengths).sum() == 1 and (np.diff(lengths) <= 0).all()
    assert token_files.code_lengths(np.array([5])).tolist() == [1]
    assert token_files.code_lengths(np.array([], np.int64)).tolist() == []


def test_token_files_round_trip(spark, odd, odd_rows, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "t"), WORD, end_id=2)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in odd_rows)
    at, want = 0, defaultdict(list)
    for r in odd_rows:
        want[r[0]].append(library(WORD, r[1], [2]))
    for r in got:
        assert r.start == at and np.frombuffer(bytes(r.ids), "<u4").tolist() in want[r.doc_id]
        at += r.n_tokens


def test_token_files_of_nothing(spark, none, tmp_path):
    token_files.write_token_files(none, str(tmp_path / "t"), WORD)
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_token_counts(odd, odd_rows, none):
    got = sorted(map(tuple, token_counts.token_counts(odd, WORD).collect()))
    assert got == sorted((r[0], len((r[1] or "").encode()), len(library(WORD, r[1]))) for r in odd_rows)
    assert token_counts.token_counts(none, WORD).count() == 0


def test_packing(odd, odd_rows, none):
    rows = packing.pack_documents(odd, BYTE, end_id=2, capacity=64).collect()
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for r in odd_rows:
        want[r[0]].append(library(BYTE, r[1], [2]))
    for doc_id, all_ids in want.items():
        found = sorted(r.ids for r in docs[doc_id])
        assert found == sorted(np.array(ids[s : s + n], "<u4").tobytes() for ids in all_ids for s, n in packing.pieces(len(ids), 64))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    tokens = sum(len(i) for x in want.values() for i in x)
    assert len(places) <= 1.1 * tokens / 64 + 2
    whole = packing.sequences(packing.pack_documents(odd, BYTE, end_id=2, capacity=64))
    assert whole.filter(F.length("ids") != 4 * F.col("n_tokens")).count() == 0
    assert packing.pack_documents(none, BYTE, end_id=2).count() == 0


def test_checksum_is_of_little_endian_words(odd):
    row = packing.pack_documents(odd, BYTE, end_id=2).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids))


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 8, 200])
def test_ids_do_not_depend_on_batches(small, rows):
    """A long-lived encoder that is fed a few rows at a time, among them pieces of known parts only."""
    texts = ["a 1", "a1", "b", "1a", "1", *pq.read_table(f"{small}/documents.parquet", columns=["text"])["text"].to_pylist()]
    for path, split in ((WORD, "word"), (BYTE, "space")):
        coder, tk = TextIds(path, split), _library(path)
        for at in range(0, len(texts), rows):
            part = texts[at : at + rows]
            ids, counts = coder.batch(pa.array(part, pa.string()), None)
            want = [tk.encode(t or "", add_special_tokens=False).ids for t in part]
            assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want
        assert coder.ends.n == len(coder.slot) + 1 and coder.part_ends.n == len(coder.part_slot) + 1
