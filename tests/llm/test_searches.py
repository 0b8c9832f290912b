"""Periodic runs, hard negatives and byte-level BPE against brute force and the library."""

import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quillguard.llm import byte_bpe, hard_negatives, periodic_runs

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def every_run(w, shortest=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(shortest, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 9, 40])) for _ in range(rng.choice([0, 1, 2, 14, 60, 130]))]
            if len(w) > 10 and rng.random() < 0.6:
                p, a = rng.randint(1, 9), rng.randrange(len(w))
                w[a:] = [w[a:][i % p] for i in range(len(w) - a)]
            texts.append(w)
        shortest = rng.choice([12, 12, 2, 5, 25])
        codes = np.array([x for w in texts for x in w], np.int64)
        got = [tuple(r) for r in np.column_stack(periodic_runs.runs_of(codes, np.array([len(w) for w in texts]), shortest)).tolist()]
        assert got == [(i, *r) for i, w in enumerate(texts) for r in every_run(w, shortest)]


def test_runs_of_long_texts_are_cheap():
    for period in (1, 2, 1000):
        codes = np.arange(60_000) % period
        assert [x.tolist() for x in periodic_runs.runs_of(codes, np.array([60_000]))] == [[0], [0], [60_000], [period]]


def test_collapsed_texts(spark, odd, odd_rows, none):
    planted = [(500_000 + i, " ".join(["start", *["a", "b", "c"] * n, "end"]), "en", "s", 1, "i", "s", "q") for i, n in enumerate((1, 3, 4, 9))]
    rows = odd_rows + planted
    got = periodic_runs.collapse(odd.union(spark.createDataFrame(planted, odd.schema))).collect()
    want = []
    for r in rows:
        w = BLANK.findall(r[1] or "")
        runs = every_run(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((r[0], len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert sum(bool(x[2]) for x in want) >= 3
    best = spark.createDataFrame([([(4, 12, 3), (2, 12, 6), (2, 12, 5)],), ([],), (None,)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r.b and tuple(r.b) for r in best.select(periodic_runs.longest_run(F.col("runs")).alias("b")).collect()] == [(2, 12, 5), None, None]
    assert periodic_runs.collapse(none).count() == 0


def test_repeated_tails(odd, odd_rows):
    got = sorted((r.doc_id, BLANK.findall(r.text or "")) for r in periodic_runs.repeated_tails(odd).collect())
    want = []
    for r in odd_rows:
        w, h = BLANK.findall(r[1] or ""), zlib.crc32(str(r[0]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want.append((r[0], w))
    assert got == sorted(want) and got != sorted((r[0], BLANK.findall(r[1] or "")) for r in odd_rows)


def test_cover_tree_covers():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8)) * 100
    vectors = np.floor(np.r_[centres[rng.integers(0, 5, 300)] + rng.normal(size=(300, 8)) * 8, np.zeros((3, 8)), np.tile(centres[0], (40, 1))]).astype(np.int64)
    order, nodes, angles = hard_negatives.cover_tree(vectors)
    assert sorted(order.tolist()) == list(range(len(vectors))) and len(nodes) > 10
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    points = np.c_[vectors / norms.max(), np.sqrt(1 - (norms / norms.max()) ** 2)][order]
    for (centre, begin, end, first, last), angle in zip(nodes.tolist(), angles):
        assert begin <= centre < end
        assert (np.arccos(np.clip(points[begin:end] @ points[centre], -1, 1)) <= angle + 1e-6).all()
        if first < last:  # children share out the rows and cover at most half the angle
            assert [n[1] for n in nodes[first:last].tolist()] == [begin, *[n[2] for n in nodes[first : last - 1].tolist()]] and nodes[last - 1][2] == end
            assert (angles[first:last] <= angle / 2 + 1e-6).all()


def mined(rows):
    kept = {}
    for i, v, y in rows:
        if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v):
            row = (y, [int(np.floor(256 * x)) for x in v])
            kept[i] = min(kept.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in (i for i in kept if i % 10 == 0):
        scored = sorted((-dot(kept[a][1], v), i, y) for i, (y, v) in kept.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == kept[a][0]][:5]:
            fit = [r for r in scored if r[2] != kept[a][0] and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit[:5], 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rng = random.Random(9)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.choice([0, 0.1, 0.3]) * rng.uniform(-1, 1) for x in rng.choice(centres)], rng.randrange(3)) for i in range(250)]
    rows += [(250 + i, centres[0], i % 2) for i in range(60)] + rows[:20]  # equal vectors, repeated rows
    rows += [(400, None, 1), (401, [None] * 6, 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 2), (None, centres[1], 1), (404, centres[1], None)]
    rows += [(410, [0.5, 0.5], 1), (420, [], 2), (430, [0.0] * 6, 1), (30, [9.0] * 6, 2), (440, centres[1], 7)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, v string, row string")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    for piece, block in ((4096, 16 << 20), (64, 512)):  # the second has several trees and blocks of anchors
        monkeypatch.setattr(hard_negatives, "PIECE", piece)
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
        got = hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == mined(single)
    assert hard_negatives.hard_negatives(table.filter("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(table.filter("vec_id = 7"), F.col("vec_id") % 10 == 0).count() == 0


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, odd, odd_rows, none, library):
    rng = random.Random(4)
    texts = [r[1] for r in odd_rows] + ["a\u0085b c　d​e", "\x1c\x1d x", "don't I'LL we've  it's", "日本語テキスト 123４５", "ab" * 2000, "\0\0a\0", "🙂🙂 👩‍👩‍👧", "é ĀŁł", "\t\r\n \t"]
    texts += ["".join(rng.choices("abcdefghijklmnop", k=300)), *("".join(rng.choices(" ab'st\n\té1. 日\0́🙂", k=rng.randint(0, 40))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)]
    for most in (0, 60):  # words folded ahead change nothing
        got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, most)
        assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in got.collect()) == want
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_folds_a_word_of_a_task_once(spark, library):
    texts = ["theheonand qzxj", "qzxj theheonand", "theheonand theheonand qzxj \U00011f04\U00011f05", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = byte_bpe.cut(docs, RANKS, public_tokenizers.PATTERN, 100).collect()
    assert sum(map(len, (r.words for r in rows))) == len(set(regex.findall(public_tokenizers.PATTERN, "|".join(t or "" for t in texts))) - {"|"})
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == [(i, library.encode_ordinary(t or "")) for i, t in enumerate(texts)]


def test_byte_bpe_folds_words_of_a_long_in_order_of_rank(spark, library):
    texts = ["a" * n for n in (1, 2, 3, 61, 62, 63, 130)] + ["thesat" * 10 + "it", "thesat" * 10 + "its", "the", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = [w for r in byte_bpe.cut(docs, RANKS, public_tokenizers.PATTERN, 100).collect() for w in r.words]
    assert [w.marks.bit_length() - 1 for w in words if w.marks] == [len(t) for t in texts if 0 < len(t) <= 62]
    assert [bool(w.marks) for w in words] == [not w.parts for w in words] == [bool(w.spans) for w in words]
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == [(i, library.encode_ordinary(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("pieces, in_order", [(["ab", "bc", "abc", "aa", "aaa", "aaaa"], True), (["abc", "ab", "cab", "aa"], False), (["abcd", "bc"], False)])
def test_byte_bpe_of_other_vocabularies(spark, tmp_path, pieces, in_order):
    """Pieces whose parts come later are met by the lowest rank of all neighbours, not in one pass."""
    ranks = {bytes([b]): 255 - b for b in range(256)} | {p.encode(): 256 + i for i, p in enumerate(pieces)}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(b"%s %d\n" % (base64.b64encode(p), r) for p, r in ranks.items()))
    assert byte_bpe.joins_in_order(ranks) == in_order
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcd ", [6, 4, 3, 1, 1], k=rng.randint(0, 90))) for _ in range(150)]
    own = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = byte_bpe.encode(docs, str(path), public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.ids, bytes(r.decoded).decode()) for r in got.collect()) == [(i, own.encode_ordinary(t), t) for i, t in enumerate(texts)]


def test_bytes_of_unknown_ids(spark):
    vocabulary = byte_bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    row = spark.createDataFrame([([262, -1, 10**6, None, 278],)], "ids array<int>").select(vocabulary.bytes_of(F.col("ids")).alias("b")).first()
    assert bytes(row.b) == b" theing"


def test_searches_of_one_anchor_open_a_node_once(monkeypatch):
    rng = np.random.default_rng(5)
    for largest in (200, hard_negatives.LARGEST):  # products of the second are not exact as floats
        vectors = rng.integers(-largest, largest + 1, (600, 64))
        order, nodes, angles = hard_negatives.cover_tree(vectors)
        tree = hard_negatives.Tree(order, order % 3, vectors[order], nodes, angles)
        scores = vectors[order] @ vectors[0]
        opened, calls = {}, []
        one = hard_negatives.Tree._open
        monkeypatch.setattr(hard_negatives.Tree, "_open", lambda self, node, *args: calls.append(node) or one(self, node, *args))
        for ceiling in sorted(scores.tolist())[-40::8]:
            best = hard_negatives.Best(5, 0, 0, False, 0, ceiling)
            tree.search(vectors[0], best, opened)
            assert best.rows == sorted((-s, i) for s, i in zip(scores.tolist(), order.tolist()) if i % 3 and 0 <= s <= ceiling)[:5]
        assert calls and len(calls) == len(set(calls))
        monkeypatch.undo()
