"""Periodic runs of words, from maximal pairs of a bottom-up LCP-interval tree.

A run of period q is a stretch of words that repeats itself every q words, at least twice. Two
positions make a maximal pair if what follows them agrees for some length and the words before and
behind differ; those whose distance is at most that length are exactly the runs, so none is extended.

A task turns a batch of texts into one array of word codes, every text with codes of its own and a
closing code that occurs once. Ranks of windows of 1, 2, 4, ... words are refined by sorting only
what still has an equal; they give the suffix order and, read from the widest down, the common
lengths of neighbours. Stretches of the order that share ``SEED_WORDS`` words form the intervals;
those with one left word only, or whose positions are all farther apart than they agree, hold no such
pair and are passed over. The others are walked bottom-up: each interval keeps its positions by left
word, and the smaller of two children looks its partners up in the larger one within the distance.
The pairs found are at most as many as the exponents of all runs add up to, so they are linear in the
words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import SPACE, joined, small_batches, words_of

MIN_LENGTH = 12
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def window_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For windows of 1, 2, 4, ... codes: equal numbers where windows are equal, in suffix order. The
    last code of the array and of every text must occur once."""
    order = np.argsort(codes)
    fresh = np.r_[True, codes[order[1:]] != codes[order[:-1]]]
    rank = np.empty(len(codes), np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
    levels, width = [rank], 1
    held = order[~fresh | ~np.r_[fresh[1:], True]]  # what has an equal
    while len(held):
        rank = rank.copy()
        old = levels[-1][held].astype(np.int64)
        key = old * len(codes) + levels[-1][held + width]
        by = np.argsort(key)
        held, key, old = held[by], key[by], old[by]
        n = np.arange(len(held))
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], n, 0))
        rank[held] = old + np.maximum.accumulate(np.where(fresh, n, 0)) - group
        levels.append(rank)
        width *= 2
        held = held[~fresh | ~np.r_[fresh[1:], True]]
    return levels


def common_lengths(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many codes agree from each position of ``left`` and ``right`` on."""
    length = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][left + length] == levels[k][right + length]).astype(np.int64) << k
    return length


def candidate_intervals(levels: list[np.ndarray], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in suffix order, and their common lengths with the one before, of each stretch that
    shares ``seed`` words or more, has several left words and two positions as near as they agree."""
    k = min(len(levels) - 1, max(0, seed.bit_length() - 1))
    rank, last = levels[k], levels[-1]
    sizes = np.bincount(rank)
    some = np.flatnonzero(sizes[rank] > 1)
    if len(some) < 2:
        return
    some = some[np.argsort(last[some])]
    common = np.r_[0, common_lengths(levels, some[:-1], some[1:])]
    starts = common < seed
    group = np.cumsum(starts) - 1
    firsts = np.flatnonzero(starts)
    word_before = np.where(some > 0, levels[0][some - 1], -1)
    several = np.minimum.reduceat(word_before, firsts) != np.maximum.reduceat(word_before, firsts)
    deepest = np.maximum.reduceat(np.where(starts, 0, common), firsts)
    by = np.lexsort((some, group))
    gaps = np.r_[np.iinfo(np.int64).max, np.diff(some[by])]
    gaps[firsts] = np.iinfo(np.int64).max
    nearest = np.minimum.reduceat(gaps, firsts)
    bounds = np.r_[firsts, len(some)]
    for g in np.flatnonzero(several & (nearest <= deepest)).tolist():
        yield some[bounds[g] : bounds[g + 1]], common[bounds[g] : bounds[g + 1]]


class Interval:
    """Positions of an LCP interval, all in order and by left word."""

    __slots__ = ("classes", "places")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}


def _merge(into: list[int], other: list[int]) -> None:
    if other[0] > into[-1]:
        into += other
    elif len(other) < 8:
        for x in other:
            insort(into, x)
    else:
        into += other
        into.sort()


def _pairs(a: Interval, b: Interval, depth: int, before: list[int], shortest: int, out: list) -> Interval:
    """Report pairs of a place of each with different left words, at most ``depth`` apart; unite both."""
    if len(a.places) < len(b.places):
        a, b = b, a
    nearest = max(1, shortest - depth)
    for left, places in b.classes.items():
        for x in places:
            lo, hi = bisect_left(a.places, x - depth), bisect_right(a.places, x + depth)
            if hi - lo <= 4 * len(a.classes):
                near = [y for y in a.places[lo:hi] if before[y] != left]
            else:
                near = [y for c, own in a.classes.items() if c != left for y in own[bisect_left(own, x - depth) : bisect_right(own, x + depth)]]
            out += [(min(x, y), abs(x - y), depth) for y in near if abs(x - y) >= nearest]
    _merge(a.places, b.places)
    for left, places in b.classes.items():
        if left in a.classes:
            _merge(a.classes[left], places)
        else:
            a.classes[left] = places
    return a


def maximal_pairs(places: list[int], common: list[int], before: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """(start, distance, agreeing words) of the maximal pairs of one stretch of the suffix order that
    are at most as far apart as they agree and cover ``shortest`` words."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, Interval]] = []
    done = Interval(places[0], before[places[0]])
    for place, depth in zip(places[1:], common[1:]):
        while stack and stack[-1][0] >= depth:
            at, rest = stack.pop()
            done = _pairs(rest, done, at, before, shortest, out)
        stack.append((depth, done))
        done = Interval(place, before[place])
    while stack:
        at, rest = stack.pop()
        done = _pairs(rest, done, at, before, shortest, out)
    return out


def runs_of(codes: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in texts of ``counts`` codes each, in order."""
    n = len(counts)
    text = np.repeat(np.arange(n), counts)
    size = int(codes.max()) + 1 if len(codes) else 1
    own = np.insert(codes + text * (size + 1), np.cumsum(counts), np.arange(n) * (size + 1) + size)
    levels = window_ranks(own) if len(own) else []
    seed = max(1, -(-min_length // 2))  # agreeing words of a run of that length, at least
    pairs: list[tuple[int, int, int]] = []
    before: dict[int, int] = {}
    for places, common in candidate_intervals(levels, seed) if levels else ():
        firsts = places - 1
        before = dict(zip(places.tolist(), np.where(firsts >= 0, levels[0][firsts], -1).tolist()))
        pairs += maximal_pairs(places.tolist(), common.tolist(), before, min_length)
    found = np.array(pairs, np.int64).reshape(-1, 3)
    start, period, length = found[:, 0], found[:, 1], found[:, 1] + found[:, 2]
    by = np.lexsort((period, length, start))
    start, period, length = start[by], period[by], length[by]
    least = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, period, length = start[least], period[least], length[least]
    begins = np.cumsum(counts + 1) - (counts + 1)
    of = np.searchsorted(begins, start, "right") - 1
    start = start - begins[of]
    by = np.lexsort((period, start, of))
    return of[by], start[by], length[by], period[by]


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start word, length, period; by start and period) and the collapsed text
    of every row of ``docs`` (doc_id, text; more columns are ignored).

    A run is a stretch of at least ``min_length`` words and two periods that no neighbouring word
    extends, with its smallest period. The collapsed text keeps of every run its first period, words
    joined by one space; a word that any run drops goes. A null or empty text has no words, no runs
    and an empty collapsed text; repeated rows are judged each. A text is held as a whole, about 100
    bytes for each of its words.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, counts = words_of(batch.column("text"))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            of, start, length, period = runs_of(codes, counts, min_length)
            firsts = np.cumsum(counts) - counts
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, firsts[of] + start + period, 1)
            np.add.at(change, firsts[of] + start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            seen = np.r_[0, np.cumsum(kept)]
            text = pa.array(joined(words.filter(pa.array(kept)), seen[firsts + counts] - seen[firsts]), pa.binary())
            own = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            ends = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), runs, text.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def longest_run(runs: Column) -> Column:
    """Of the runs the longest, of those the first, of those the one with the smaller period."""
    ordered = F.transform(runs, lambda r: F.struct(-r.length, r.start, r.period))
    best = F.array_min(ordered)
    return F.when(F.size(runs) > 0, F.struct(best.start.alias("start"), (-best.col1).alias("length"), best.period.alias("period")))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten goes on repeating a stretch of its words: with h the
    checksum of the decimal doc_id and g its tens, a text with h % 10 = 0 repeats from word a = g % n on
    the next 1 + (n - a) / (3 + g % 8) words."""
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        bound = F.struct((g % n).alias("a"), g.alias("g"), n.alias("n"))

        def place(b: Column) -> Column:
            p = 1 + F.floor((b.n - b.a) / (3 + b.g % 8))
            return F.struct(b.a.alias("a"), p.alias("p"), b.n.alias("n"))

        def text(b: Column) -> Column:
            at = lambda i: F.when(i < b.a, i).otherwise(b.a + (i - b.a) % b.p)
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), b.n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")

        return F.get(F.transform(F.transform(F.array(bound), place), text), F.lit(0))

    full = F.filter(F.array(words), lambda w: F.size(w) > 0)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(F.get(F.transform(full, repeated), F.lit(0)), "text")).otherwise(F.col("text")).alias("text"))


# Equal windows of six words, joined within a text and strung together along equal distances.
ORACLE_SQL = r"""
WITH checked AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents),
sized AS (SELECT k, doc_id, w, h, h // 10 AS g, len(w) AS n FROM checked),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
spun AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
texts AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM spun),
places AS (SELECT k, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
windows AS (SELECT k, unnest(range(n - 5)) AS i, w FROM texts WHERE n >= 6),
grams AS (SELECT k, i, array_to_string(w[i + 1 : i + 6], ' ') AS gram FROM windows),
pairs AS (SELECT x.k, x.i, y.i - x.i AS d FROM grams x JOIN grams y ON x.k = y.k AND x.gram = y.gram AND x.i < y.i),
strung AS (SELECT k, d, i, i - row_number() OVER (PARTITION BY k, d ORDER BY i) AS chain FROM pairs),
stretches AS (SELECT k, d, min(i) AS start, count(*) + 5 + d AS length FROM strung GROUP BY k, d, chain),
runs AS (SELECT k, start, length, min(d) AS period FROM stretches WHERE length >= 2 * d AND length >= 12 GROUP BY k, start, length),
digests AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT p.k, string_agg(word, ' ' ORDER BY p.i) AS text FROM places p LEFT JOIN gone g ON p.k = g.k AND p.i = g.i WHERE g.i IS NULL GROUP BY p.k)
SELECT t.doc_id, coalesce(d.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(d.listed, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN digests d ON t.k = d.k LEFT JOIN kept c ON t.k = c.k
LEFT JOIN (SELECT k, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length DESC, start, period) = 1) b ON t.k = b.k
"""
