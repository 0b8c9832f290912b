"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule bounds the ratio of two counts, in hundredths, by whole-number arithmetic. The counts come
from the text in the same projection; the words and their windows are bound once, as arguments of
higher-order functions, so nothing is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.llm.common import SPACE

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on with as by at from this be or "
    "le la les de des du et en un une que pour dans est pas sur par avec au "
    "der die das und ist nicht ein eine zu mit von den auf für sich dem im es "
    "el los las y del se no una su con al lo más como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` <= 100 * ``count`` / ``of`` <= ``high``; a bound may be absent. The rule holds for any
    row whose ``of`` is below ``least``."""

    name: str
    count: str
    of: str
    low: int | None = None
    high: int | None = None
    least: int = 1


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 250, 1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=4, least=30),
    Rule("capitals", "n_capitals", "word_chars", high=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("cut_off_lines", "n_ellipsis_lines", "n_lines", high=30),
    Rule("list_lines", "n_bullet_lines", "n_lines", high=90),
)

METRICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capitals",
    "n_lines", "n_ellipsis_lines", "n_bullet_lines",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _removed(text: Column, characters: str) -> Column:
    """How many of these characters the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hash. Where all differ, that is the end of it; else the hashes are
    sorted with their places, and the places of equal neighbours are joined into stretches.
    """

    def stretches(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    def among_equal(ordered: Column) -> Column:
        same = lambda x, k: x["h"].eqNullSafe(F.get(ordered, k)["h"])
        found = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), stretches)

    def of(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, among_equal))

    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(window)]))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashes, of))


def text_counts(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> dict[str, Column]:
    """The counts that rules can name. A null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    stop = [form for w in stop_words for form in dict.fromkeys((w, w.capitalize()))]
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    of_lines = let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(ls, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•"))).cast("long").alias("n_bullet_lines"),
        ),
    )
    return {
        "of_words": of_words,
        "of_lines": of_lines,
        "word_chars": (F.length(text) - _removed(text, " \t\n\x0b\f\r")).cast("long"),
        "n_symbols": _removed(text, "#*$%&|<>").cast("long"),
        "n_capitals": _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
    }


def compile_rules(rules: Sequence[Rule], counts: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in the order of the table."""
    broken = []
    for r in rules:
        share, of = counts[r.count] * 100, counts[r.of]
        out = F.lit(False)
        if r.low is not None:
            out = out | (share < of * r.low)
        if r.high is not None:
            out = out | (share > of * r.high)
        broken.append(F.when((of >= r.least) & out, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def assess(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with one struct column ``quality``: the counts, base_failed, broken_rules and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows of five. kept: not
    base_failed and no rule broken. A null or empty text has no words and fails. Columns of ``docs``
    are kept, but for one of the name ``quality``. Repeated rows are judged each.
    """
    made = text_counts(F.col(text))

    def judged(of_words: Column, of_lines: Column) -> Column:
        counts = {m: of_words[m] for m in ("n_words", "n_stop_words", "n_repeat_words")}
        counts |= {m: of_lines[m] for m in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}
        counts |= {m: made[m] for m in ("word_chars", "n_symbols", "n_capitals")}
        failed = (counts["n_words"] < MIN_WORDS) | (counts["n_repeat_words"] * 100 > counts["n_words"] * MAX_REPEAT_PCT)
        fields = [counts[m].alias(m) for m in METRICS] + [failed.alias("base_failed")]
        return let(
            F.struct(*fields),
            lambda c: let(
                compile_rules(rules, {m: c[m] for m in METRICS}),
                lambda broken: F.struct(
                    *[c[m].alias(m) for m in METRICS],
                    c["base_failed"].alias("base_failed"),
                    broken.alias("broken_rules"),
                    (~c["base_failed"] & (F.size(broken) == 0)).alias("kept"),
                ),
            ),
        )

    both = let(F.struct(made["of_words"].alias("w"), made["of_lines"].alias("l")), lambda x: judged(x["w"], x["l"]))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "quality"]
    return docs.select(*others, F.inline(F.array(F.struct(both.alias("quality")))))


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """The contract's columns in DuckDB's SQL."""
    stop = ", ".join(f"'{form}'" for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize())))
    blank = r"[\x20\x09-\x0D]"
    tests = ["NOT base_failed"]
    for r in rules:
        tests += [f"({r.of} < {r.least} OR 100 * {r.count} >= {r.low} * {r.of})"] if r.low is not None else []
        tests += [f"({r.of} < {r.least} OR 100 * {r.count} <= {r.high} * {r.of})"] if r.high is not None else []
    return f"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM documents),
    windows AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts)),
    repeated AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows WHERE n > 1)
      GROUP BY doc_id),
    counts AS (
      SELECT doc_id, len(w) AS n_words,
        length(regexp_replace(t, '{blank}', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(repeated.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
        len(l) AS n_lines,
        len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
        len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '•'))) AS n_bullet_lines
      FROM texts LEFT JOIN repeated USING (doc_id)),
    judged AS (
      SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM counts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      {' AND '.join(tests)} AS kept
    FROM judged"""
