"""Span expressions: where patterns match, which spans survive, and how text is spliced.

These expressions nest deeply, so they are composed as Spark SQL text and handed over with one
``F.expr`` each; building them call by call takes seconds of driver time per query. Arguments and
results named ``Sql`` are SQL expressions. A findings column is
``array<struct<type,start,end,score,text>>`` with code point offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from quillguard.functions import patterns as P
from quillguard.schemas import FINDING_TYPE, FINDINGS_DDL

Sql = str
_numbers = count()


def fresh(prefix: str) -> str:
    """A lambda variable name used nowhere else."""
    return f"{prefix}_{next(_numbers)}"


def name(column: str) -> Sql:
    """A column reference; dots reach into structs."""
    return ".".join(f"`{part}`" for part in column.split("."))


def lit(value: str) -> Sql:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    var = fresh("v")
    return f"get(transform(array({value}), {var} -> {body(var)}), 0)"


def each(items: Sql, body: Callable[[Sql], Sql]) -> Sql:
    var = fresh("x")
    return f"transform({items}, {var} -> {body(var)})"


def keep(items: Sql, test: Callable[[Sql], Sql]) -> Sql:
    var = fresh("k")
    return f"filter({items}, {var} -> {test(var)})"


NO_FINDINGS: Sql = f"CAST(array() AS {FINDINGS_DDL})"


_GATES = {"digit": "{t}.has_digit", "at": "contains({x}, '@')", "underscore": "contains({x}, '_')"}


def _gate(spec: P.PatternSpec, text: Sql, traits: Sql) -> Sql:
    tests = []
    for part in spec.gate.split():
        if part.startswith("words:"):
            words = part.removeprefix("words:").split(",")
            hits = [f"contains({traits}.lowered, {lit(w)})" for w in words]
            tests.append("(" + " OR ".join([*hits, f"{traits}.folds"]) + ")")
        else:
            tests.append(_GATES[part].format(t=traits, x=text))
    return "(" + " AND ".join(tests or ["true"]) + ")"


# The letters outside ASCII that a case-blind pattern takes for an ASCII one and lower() does not
# turn into it.
_FOLDING = ("\u0130", "\u0131", "\u017f", "\u212a")


def _traits(text: Sql) -> Sql:
    """What the gates look at. Most texts are ASCII, where no letter folds."""
    folds = " OR ".join(f"contains({text}, {lit(c)})" for c in _FOLDING)
    return (
        f"named_struct('has_digit', {text} RLIKE {lit(chr(92) + 'p{Nd}')}, 'lowered', lower({text}), "
        f"'folds', length({text}) <> octet_length({text}) AND ({folds}))"
    )


def _digits(text: Sql) -> Sql:
    return f"regexp_replace({text}, {lit('[^' + chr(92) + 'p{Nd}]')}, '')"


def luhn_ok(text: Sql) -> Sql:
    """Mod-10 checksum over the digits of ``text``."""

    def checksum(reversed_digits: Sql) -> Sql:
        def weight(i: Sql) -> Sql:
            return let(
                f"ascii(substring({reversed_digits}, {i}, 1)) - 48",
                lambda v: f"CASE WHEN {i} % 2 = 1 THEN {v} WHEN {v} * 2 > 9 THEN {v} * 2 - 9 ELSE {v} * 2 END",
            )

        weights = each(f"sequence(1, length({reversed_digits}))", weight)
        return (
            f"CASE WHEN length({reversed_digits}) = 0 THEN true "
            f"ELSE aggregate({weights}, 0, (a, w) -> a + w) % 10 = 0 END"
        )

    return let(f"reverse({_digits(text)})", checksum)


def card_ok(text: Sql) -> Sql:
    return f"(length({_digits(text)}) BETWEEN 13 AND 19 AND {luhn_ok(text)})"


def ipv4_ok(text: Sql) -> Sql:
    return f"forall(split({text}, '[.]'), o -> CAST(o AS INT) <= 255)"


def iban_ok(text: Sql) -> Sql:
    """ISO 13616 mod-97 test, folded character by character so no big number is needed."""

    def residue(compact: Sql) -> Sql:
        moved = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
        step = (
            "CASE WHEN ascii(c) >= 65 THEN (a * 100 + ascii(c) - 55) % 97 "
            "ELSE (a * 10 + ascii(c) - 48) % 97 END"
        )
        return (
            f"(length({compact}) BETWEEN 15 AND 34 AND "
            f"aggregate(filter(split({moved}, ''), c -> c <> ''), 0, (a, c) -> {step}) = 1)"
        )

    return let(f"replace({text}, ' ', '')", residue)


VALIDATORS: dict[str, Callable[[Sql], Sql]] = {"card": card_ok, "ipv4": ipv4_ok, "iban": iban_ok}


# Two private-use letters no pattern can tell apart: one marks matches, the other stands in for it
# where a text contains it.
_MARK, _STAND_IN = "\ue000", "\ue001"


def pattern_spans(text: Sql, spec: P.PatternSpec, score: Sql | None = None) -> Sql:
    """All non-overlapping matches of one pattern, left to right, validator applied.

    Spark's regex functions return matched text but no positions. One replacement pass puts a mark
    on both sides of each match; split at the marks, the odd pieces are the matches, and running
    lengths give the offsets.
    """
    score = f"{spec.score}D" if score is None else score
    has_mark = f"contains({text}, {lit(_MARK)})"
    clean = f"CASE WHEN {has_mark} THEN translate({text}, {lit(_MARK)}, {lit(_STAND_IN)}) ELSE {text} END"
    ends = f"{_MARK}$0{_MARK}" if spec.scan is None else f"$1{_MARK}$2{_MARK}"
    marked = f"regexp_replace({clean}, {lit(P.java(spec.scan or spec.pattern))}, {lit(ends)})"

    def locate(marks: Sql) -> Sql:
        acc, piece = fresh("a"), fresh("p")
        end = f"{acc}.pos + length({piece})"
        own = f"CASE WHEN {has_mark} THEN substring({text}, {acc}.pos + 1, length({piece})) ELSE {piece} END"
        found = (
            f"named_struct('type', {lit(spec.label)}, 'start', {acc}.pos, 'end', {end}, "
            f"'score', {score}, 'text', {own})"
        )
        step = (
            f"named_struct('pos', {end}, 'hit', NOT {acc}.hit, 'found', CASE WHEN {acc}.hit "
            f"THEN array_append({acc}.found, CAST({found} AS {FINDING_TYPE})) ELSE {acc}.found END)"
        )
        start = f"named_struct('pos', 0, 'hit', false, 'found', {NO_FINDINGS})"
        return (
            f"CASE WHEN contains({marks}, {lit(_MARK)}) THEN aggregate(split({marks}, {lit(_MARK)}, -1), {start}, "
            f"({acc}, {piece}) -> {step}, z -> z.found) ELSE {NO_FINDINGS} END"
        )

    found = let(marked, locate)
    if spec.validator is not None:
        found = keep(found, lambda f: VALIDATORS[spec.validator](f"{f}.text"))
    return found


def overlaps(finding: Sql, others: Sql) -> Sql:
    o = fresh("o")
    return f"exists({others}, {o} -> {finding}.`end` > {o}.`start` AND {finding}.`start` < {o}.`end`)"


def disjoint(findings: Sql) -> Sql:
    """True if no two findings overlap: sorted, each start lies at or behind the end before it."""
    starts = f"array_sort({each(findings, lambda f: f'{f}.`start`')})"
    ends = f"array_sort({each(findings, lambda f: f'{f}.`end`')})"
    n = f"size({findings}) - 1"
    return f"forall(zip_with(slice({starts}, 2, {n}), slice({ends}, 1, {n}), (s, e) -> s >= e), ok -> ok)"


def keep_first_come(candidates: Sql) -> Sql:
    """Drop each candidate that overlaps one kept before it; the order stays.

    Candidates that are all disjoint, as in most texts, need no comparison. Others are swept by their
    starts: a candidate that begins behind all ends so far closes a cluster, and only candidates of one
    cluster are compared with each other.
    """
    return f"CASE WHEN size({candidates}) <= 1 THEN {candidates} WHEN {disjoint(candidates)} THEN {candidates} ELSE {_swept(candidates)} END"


def _swept(candidates: Sql) -> Sql:
    state, c, x = fresh("s"), fresh("c"), fresh("x")
    entry = f"array<struct<start:int,ord:int,of:{FINDING_TYPE}>>"
    none = f"CAST(array() AS {entry})"
    placed = f"transform({candidates}, ({x}, i) -> named_struct('start', CAST({x}.`start` AS INT), 'ord', i, 'of', {x}))"

    def settled(cluster: Sql) -> Sql:
        """Of a cluster, what is kept in order of precedence."""
        kept, one, other = fresh("kept"), fresh("c"), fresh("o")
        meets = f"exists({kept}, {other} -> {one}.of.`end` > {other}.of.`start` AND {one}.of.`start` < {other}.of.`end`)"
        by_rank = f"array_sort({cluster}, (l, r) -> l.ord - r.ord)"
        return f"CASE WHEN size({cluster}) <= 1 THEN {cluster} ELSE aggregate({by_rank}, {none}, ({kept}, {one}) -> CASE WHEN {meets} THEN {kept} ELSE array_append({kept}, {one}) END) END"

    opened = f"named_struct('done', concat({state}.done, {settled(state + '.open')}), 'open', array({c}), 'until', {c}.of.`end`)"
    joined = f"named_struct('done', {state}.done, 'open', array_append({state}.open, {c}), 'until', greatest({state}.until, {c}.of.`end`))"
    start = f"named_struct('done', {none}, 'open', {none}, 'until', CAST(0 AS INT))"
    step = f"CASE WHEN {c}.of.`start` >= {state}.until THEN {opened} ELSE {joined} END"
    finish = f"z -> array_sort(concat(z.done, {settled('z.open')}), (l, r) -> l.ord - r.ord)"
    kept = f"aggregate(array_sort({placed}, (l, r) -> CASE WHEN l.start <> r.start THEN l.start - r.start ELSE l.ord - r.ord END), {start}, ({state}, {c}) -> {step}, {finish})"
    return f"transform({kept}, e -> e.of)"


def joined_findings(overlap: str, *findings: Sql) -> Sql:
    """Findings to splice: of overlapping ones the first listed stays (``first``), or all do (``raw``)."""
    if overlap not in ("first", "raw"):
        raise ValueError(f"overlap must be first or raw, not {overlap!r}")
    every = f"concat({', '.join(findings)})"
    return let(every, keep_first_come) if overlap == "first" else every


def find_all(text: Sql, specs: Sequence[P.PatternSpec]) -> Sql:
    """Findings of several patterns in precedence order. A null text has no findings."""

    def scan(traits: Sql) -> Sql:
        parts = [
            f"CASE WHEN {_gate(s, text, traits)} THEN {pattern_spans(text, s)} ELSE {NO_FINDINGS} END"
            for s in specs
        ]
        return let(f"concat({', '.join(parts)})", keep_first_come)

    if not specs:
        return NO_FINDINGS
    return f"CASE WHEN {text} IS NULL THEN {NO_FINDINGS} ELSE {let(_traits(text), scan)} END"


def near_words(text: Sql, finding: Sql, before: int, after: int) -> Sql:
    """The words around a finding in lower case, each between blanks. Only ``CONTEXT_CHARS`` characters
    on each side are read, so that the work is bounded for each finding."""
    reach = P.CONTEXT_CHARS

    def words(part: Sql) -> Sql:
        return f"regexp_extract_all(lower({part}), {lit(P.CONTEXT_WORD)}, 0)"

    left = words(f"substring({text}, greatest(1, {finding}.`start` + 1 - {reach}), least({finding}.`start`, {reach}))")
    last = let(left, lambda w: f"slice({w}, greatest(1, size({w}) - {before - 1}), {before})") if before else "CAST(array() AS array<string>)"
    first = f"slice({words(f'substring({text}, {finding}.`end` + 1, {reach})')}, 1, {after})"
    return f"concat(' ', array_join(concat({last}, {first}), ' '), ' ')"


def raise_by_context(
    text: Sql, findings: Sql, specs: Sequence[P.PatternSpec], before: int = P.CONTEXT_BEFORE, after: int = P.CONTEXT_AFTER
) -> Sql:
    """Findings with higher scores where a context word of their type stands near them."""
    told = {s.label: s.context for s in specs if s.context}
    if not told:
        return findings

    def raised(f: Sql) -> Sql:
        def score(near: Sql) -> Sql:
            hits = " OR ".join(
                f"({f}.type = {lit(label)} AND ({' OR '.join(f'contains({near}, {lit(chr(32) + word.lower() + chr(32))})' for word in words)}))"
                for label, words in told.items()
            )
            higher = f"least(1D, greatest({P.CONTEXT_FLOOR}D, {f}.score + {P.CONTEXT_RAISE}D))"
            return f"CASE WHEN {hits} THEN {higher} ELSE {f}.score END"

        labels = ", ".join(map(lit, told))
        new = f"CASE WHEN {f}.type IN ({labels}) THEN {let(near_words(text, f, before, after), score)} ELSE {f}.score END"
        return f"CAST(named_struct('type', {f}.type, 'start', {f}.`start`, 'end', {f}.`end`, 'score', {new}, 'text', {f}.text) AS {FINDING_TYPE})"

    return f"CASE WHEN size({findings}) = 0 THEN {findings} ELSE {each(findings, raised)} END"


def find_beside(text: Sql, findings: Sql, spec: P.PatternSpec) -> Sql:
    """Matches of one pattern that overlap none of ``findings``."""

    def scan(traits: Sql) -> Sql:
        return f"CASE WHEN {_gate(spec, text, traits)} THEN {pattern_spans(text, spec)} ELSE {NO_FINDINGS} END"

    found = keep(let(_traits(text), scan), lambda f: f"NOT {overlaps(f, findings)}")
    return f"CASE WHEN {text} IS NULL THEN {NO_FINDINGS} ELSE {found} END"


def find_ssn(text: Sql, findings: Sql) -> Sql:
    """``findings`` plus at most one SSN span per pattern: it must overlap nothing kept so far, and
    either the text mentions social security or tax ids, or the span is written with dashes."""

    def add(found: Sql, spec: P.PatternSpec, context: Sql) -> Sql:
        def first(kept: Sql) -> Sql:
            score = f"CASE WHEN {context} THEN 0.9D ELSE 0.7D END"
            eligible = keep(
                pattern_spans(text, spec, score),
                lambda f: f"NOT {overlaps(f, kept)} AND ({context} OR contains({f}.text, '-'))",
            )
            return let(
                f"get({eligible}, 0)",
                lambda f: f"CASE WHEN {f} IS NULL THEN {kept} ELSE array_append({kept}, {f}) END",
            )

        return let(found, first)

    def with_context(context: Sql) -> Sql:
        found = findings
        for spec in P.SSN_SPECS:
            found = add(found, spec, context)
        return found

    mentioned = f"{text} RLIKE {lit(P.java(P.SSN_CONTEXT))}"
    has_digit = f"{text} RLIKE {lit(chr(92) + 'p{Nd}')}"
    return f"CASE WHEN {has_digit} THEN {let(mentioned, with_context)} ELSE {findings} END"


def right_to_left(findings: Sql) -> Sql:
    """Findings by start position, last first."""
    return (
        f"array_sort({findings}, (l, r) -> CASE WHEN l.`start` > r.`start` THEN -1 "
        f"WHEN l.`start` < r.`start` THEN 1 ELSE 0 END)"
    )


def splice(text: Sql, findings: Sql, replacement: Callable[[Sql], Sql]) -> Sql:
    """Replace each finding. A null replacement leaves the span as it is.

    Disjoint findings are spliced in one pass: what stands between them and what replaces them is
    joined once. Overlapping ones are replaced one after the other, rightmost first, by the offsets that
    they had in the text.
    """
    acc, f, e = fresh("acc"), fresh("f"), fresh("e")

    def cut(edit: Sql) -> Sql:
        return f"concat(substring({acc}, 1, {edit}.a), {edit}.new, substring({acc}, {edit}.b + 1))"

    new = f"transform({right_to_left(findings)}, {f} -> named_struct('a', {f}.`start`, 'b', {f}.`end`, 'new', {replacement(f)}))"

    def spliced(edits: Sql) -> Sql:
        one_by_one = f"aggregate({edits}, {text}, ({acc}, {e}) -> {cut(e)})"
        return f"CASE size({edits}) WHEN 0 THEN {text} WHEN 1 THEN {_in_one_pass(text, edits)} ELSE CASE WHEN {_apart(edits)} THEN {_in_one_pass(text, edits)} ELSE {one_by_one} END END"

    return f"CASE WHEN size({findings}) = 0 THEN {text} ELSE {let(f'filter({new}, e -> e.new IS NOT NULL)', spliced)} END"


def _apart(edits: Sql) -> Sql:
    """True if edits, sorted from the right, do not overlap."""
    n = f"size({edits}) - 1"
    return f"forall(zip_with(slice({edits}, 1, {n}), slice({edits}, 2, {n}), (r, l) -> r.a >= l.b), ok -> ok)"


# Characters of the blocks that a text with many edits is cut into, and the edits that need none.
_BLOCK, _FEW_EDITS = 256, 8


def _in_one_pass(text: Sql, edits: Sql) -> Sql:
    """Join the text between disjoint edits, sorted from the right, with what replaces them.

    A substring is found by counting characters from the front; a text with many edits is cut into
    blocks first, so that counting starts in the block and all is linear.
    """
    e, i = fresh("e"), fresh("i")

    def joined(parts: Sql) -> Sql:
        def between(a: Sql, b: Sql) -> Sql:
            first = f"{a} div {parts}.width"
            own = f"array_join(slice({parts}.blocks, CAST({first} + 1 AS INT), CAST(({b} - 1) div {parts}.width - {first} + 1 AS INT)), '')"
            return f"CASE WHEN {b} > {a} THEN substring({own}, CAST({a} % {parts}.width + 1 AS INT), CAST({b} - {a} AS INT)) ELSE '' END"

        def piece(left: Sql) -> Sql:
            begin = f"CASE WHEN {i} = 0 THEN 0 ELSE get({left}, {i} - 1).b END"
            return f"transform({left}, ({e}, {i}) -> concat({between(begin, e + '.a')}, {e}.new))"

        tail = between(f"get({edits}, 0).b", f"{parts}.size")
        return f"concat(array_join({let(f'reverse({edits})', piece)}, ''), {tail})"

    few = f"size({edits}) <= {_FEW_EDITS}"
    parts = (
        f"named_struct('size', length({text}), 'width', CASE WHEN {few} THEN length({text}) + 1 ELSE {_BLOCK} END, "
        f"'blocks', CASE WHEN {few} THEN array({text}) ELSE regexp_extract_all({text}, {lit(f'(?s).{{1,{_BLOCK}}}')}, 0) END)"
    )
    return let(parts, joined)
