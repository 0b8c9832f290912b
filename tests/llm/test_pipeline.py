"""All stages of the corpus pipeline against brute force, on planted rows."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillguard.llm import packing, quality_rules
from test_duplicates import BLANK, fingerprint, groups, lowered

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, n_chars int, quality string, n_words string, `n_removed` int, `a.b` string, row string, rest string"


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(12)
    vocabulary = ["the", "of", "and", "to", "in", "is", *[f"word{i}" for i in range(300)]]
    prose = lambda n: rng.choices(vocabulary[:6], k=n // 4) + rng.choices(vocabulary[6:], k=n - n // 4)
    mixed = lambda n: " ".join(rng.sample(w := prose(n), len(w)))
    texts = [mixed(rng.randint(40, 300)) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), texts[4] + " word1", texts[5] + " " + mixed(3)]  # exact and near copies
    passage = mixed(60)
    texts += [f"{mixed(80)} {passage} {mixed(70)}" for _ in range(4)]
    texts += [None, "", "too short", "$ % & " * 30, "again and again " * 30]
    item = " ".join(f"leak{i} the" for i in range(12))
    texts += [f"{mixed(60)} {item} {mixed(60)}", f"{mixed(90)}\n{item.upper()}"]
    texts += [long := mixed(2500), long + " word1", long + " word2 word3", " ".join(vocabulary[6:30] * 2 + ["the", "of"] * 6)]
    texts += [texts[0]]  # a repeated row, below
    rows = [(3 * i, t, "en", len(t or ""), "q", "w", i, "x", "r", "rest") for i, t in enumerate(texts)]
    return [*rows[:-1], (None, mixed(50), None, None, None, None, None, None, None, None)], [(1, item), (2, None), (3, mixed(12))]


def test_stages_and_brute_force(spark, planted, tmp_path):
    rows, items = planted
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = [r for r in rows if r[1]]

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (k BIGINT, doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, i, r[1]) for i, r in enumerate(rows)])
    result = con.execute(quality_rules.oracle_sql())
    at = [d[0] for d in result.description].index("kept"), [d[0] for d in result.description].index("doc_id")
    kept = {r[at[1]] for r in result.fetchall() if r[at[0]]}
    expected = [r for i, r in enumerate(rows) if i in kept]
    assert 0 < len(expected) < len(rows) - 4

    stages = iter(corpus_pipeline.STAGES)
    docs = check(spark, next(stages), docs, expected, tmp_path)

    prints = np.array([fingerprint(r[1]) for r in expected], np.uint64)
    links = [(i, k) for i, k in np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3) if None not in (expected[i][0], expected[k][0])]
    of = groups(len(expected), links)
    least = {}
    for r, g in zip(expected, of):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    before = len(expected)
    expected = [r for r, g in zip(expected, of) if r[0] is None or least[g] == r[0]]
    assert before - len(expected) >= 3
    docs = check(spark, next(stages), docs, expected, tmp_path)

    first = defaultdict(lambda: 10**9)
    words = [BLANK.findall(r[1]) for r in expected]
    for r, w in zip(expected, words):
        for i in range(len(w) - 12):
            if r[0] is not None:
                first[tuple(w[i : i + 13])] = min(first[tuple(w[i : i + 13])], r[0])
    cut = []
    for r, w in zip(expected, words):
        gone = {j for i in range(len(w) - 12) if r[0] is not None and first[tuple(w[i : i + 13])] < r[0] for j in range(i, i + 13)}
        if len(gone) < len(w):
            text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
            cut.append((r[0], text, r[2], len(text) if gone else r[3], *r[4:]))
    assert sum(a != b for a, b in zip(cut, expected)) >= 3
    docs = check(spark, next(stages), docs, cut, tmp_path)

    windows = set()
    for _, t in items:
        w = PART.findall(lowered(t))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    clean = [r for r in cut if not any(tuple(w[i : i + 10]) in windows for w in [PART.findall(lowered(r[1]))] for i in range(len(w)))]
    assert len(cut) - len(clean) == 2
    docs = check(spark, next(stages), docs, clean, tmp_path)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, places = defaultdict(list), defaultdict(list)
    for r in next(stages)[1](spark, docs, str(tmp_path)).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        places[r.sequence_id].append((r.offset, r.length))
    want = {}
    for r in clean:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
        want[r[0]] = [(k, s, n, np.array(ids[s : s + n], "<u4").tobytes()) for k, (s, n) in enumerate(packing.pieces(len(ids), 1024))]
    assert {d: sorted(p) for d, p in got.items()} == want
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert next(stages, None) is None


def check(spark, stage, docs, expected, folder):
    name, fn = stage
    path = f"{folder}/{name.replace(' ', '-')}"
    fn(spark, docs, str(folder)).write.parquet(path)
    made = spark.read.parquet(path)
    assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr), name
    return made


def test_stages_of_nothing(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, documents, small).columns == documents.columns
        assert stage(spark, documents, small).count() == 0
