"""Near duplicates, repeated passages and decontamination against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillguard.llm import decontaminate, passages, simhash
from quillguard.llm.components import connected_components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def fingerprint(text):
    words = BLANK.findall(lowered(text))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def ball(rng, centres, near):
    out = set()
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64).tolist():
        out.add(c)
        for _ in range(near):
            x = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def test_links_join_what_is_close(spark, tmp_path, monkeypatch):
    fps = ball(np.random.default_rng(2), 6, 150)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = groups(len(fps), near)
    prints = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, id long")
    for limit in (1 << 15, 64):  # the second deals large buckets anew
        monkeypatch.setattr(simhash, "MAX_BUCKET", limit)
        monkeypatch.setattr(simhash, "TILE", 4 * limit)
        links = simhash.fingerprint_links(spark, prints, str(tmp_path / str(limit))).collect()
        assert all(np.bitwise_count(fps[r.a] ^ fps[r.b]) <= 3 for r in links)
        assert groups(len(fps), [(r.a, r.b) for r in links]) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(300, 300), (None, 4), (201, 200), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200, 300: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(odd, odd_rows, none):
    prints = [fingerprint(r[1]) for r in odd_rows]
    arr = np.array(prints, np.uint64)
    of = groups(len(arr), np.argwhere(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3))
    least = defaultdict(lambda: 10**9)
    for r, g in zip(odd_rows, of):
        least[g] = min(least[g], r[0])
    want = sorted((r[0], p, least[g]) for r, p, g in zip(odd_rows, prints, of))
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == want
    stay = simhash.representatives(odd)
    assert stay.columns == odd.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(none).count() == 0


def test_passages(odd, odd_rows, none):
    split = [(r[0], BLANK.findall(r[1] or "")) for r in odd_rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    want = []
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = passages.drop_repeats(odd).select("doc_id", "n_words", "n_removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(0 < w[2] < w[1] for w in want)
    spaced = {r.text for r in passages.drop_repeats(odd, keep_spacing=True).filter("n_removed = 0").select("text").collect()}
    assert spaced <= {r[1] for r in odd_rows}
    assert passages.drop_repeats(none).count() == 0


def test_decontamination(spark, odd, odd_rows, none):
    part = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, " ".join(f"P{i}" for i in range(5, 25))), (2, "One two"), (10, None), (11, ""), (12, "No such passage in any of the given texts at all here"), (1, "W1 W2 w3"), (30, "été")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = defaultdict(set)
    for i, t in items:
        w = part.findall(lowered(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k : k + n])].add(i)
    want = []
    for r in odd_rows:
        w = part.findall(lowered(r[1]))
        hits = [(k, n) for n in {len(g) for g in known} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in known]
        ids = {i for k, n in hits for i in known[tuple(w[k : k + n])]}
        want.append((r[0], len(w), len({j for k, n in hits for j in range(k, k + n)}), sorted(map(str, ids)), bool(hits)))
    for most in (1000, 0):  # the second joins all windows
        got = decontaminate.contamination(odd, benchmark, max_set=most).select("doc_id", "n_words", "n_hit", "item_ids", "contaminated")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    clean = decontaminate.decontaminate(odd, benchmark, "spans")
    assert clean.count() == len(odd_rows) and decontaminate.contamination(clean, benchmark).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(odd, benchmark).count() == sum(not w[4] for w in want)
    empty = benchmark.filter("false")
    assert decontaminate.contamination(odd, empty).filter("contaminated").count() == 0
    assert decontaminate.contamination(none, benchmark).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_decontamination_of_other_ids(spark, kind):
    docs = spark.createDataFrame([(1, "a clean text"), (2, "one two three")], "doc_id long, text string")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    benchmark = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert [r.text for r in decontaminate.decontaminate(docs, benchmark).collect()] == ["a clean text"]


def test_kept_digest(odd):
    row = passages.drop_repeats(odd).select("text", F.sha2("text", 256).alias("s")).filter("text <> ''").first()
    assert row.s == hashlib.sha256(row.text.encode()).hexdigest()
