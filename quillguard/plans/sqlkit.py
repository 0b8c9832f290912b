"""SQL text for the checks: the span, masking and splice steps as DuckDB expressions.

Each helper returns an expression over named columns; ``Steps`` chains them as CTEs. The engine
behind these has no lookaround, so the one pattern that needs it is relaxed and filtered here.
"""

from __future__ import annotations

from collections.abc import Sequence

from quillguard.functions import patterns as P
from quillguard.functions.text import _MASK_STEPS, DEFAULT_SALT

FINDING = 'STRUCT("type" VARCHAR, "start" INTEGER, "end" INTEGER, score DOUBLE, "text" VARCHAR)'
NO_FINDINGS = f"[]::{FINDING}[]"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def regex(pattern: str) -> str:
    return quote(P.portable(pattern))


class Steps:
    """CTEs, each adding columns to the one before."""

    def __init__(self, source: str, name: str = "s0") -> None:
        self.parts = [f"{name} AS ({source})"]
        self.last, self.n = name, 0

    def add(self, **columns: str) -> "Steps":
        self.n += 1
        name = f"s{self.n}"
        listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        self.parts.append(f"{name} AS (SELECT *, {listed} FROM {self.last})")
        self.last = name
        return self

    def replace(self, **columns: str) -> "Steps":
        self.n += 1
        name = f"s{self.n}"
        listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        self.parts.append(f"{name} AS (SELECT * REPLACE ({listed}) FROM {self.last})")
        self.last = name
        return self

    def raw(self, body: str) -> "Steps":
        """A step of its own; ``{prev}`` names the one before."""
        self.n += 1
        name = f"s{self.n}"
        self.parts.append(f"{name} AS ({body.format(prev=self.last)})")
        self.last = name
        return self

    def cte(self, name: str, body: str) -> "Steps":
        self.parts.insert(0, f"{name} AS ({body})")
        return self

    def select(self, body: str, where: str = "") -> str:
        return f"WITH {', '.join(self.parts)} SELECT {body} FROM {self.last} {where}"


def lengths(list_expr: str) -> str:
    return f"coalesce(list_sum(list_transform({list_expr}, lambda x: length(x))), 0)"


def digits(text: str) -> str:
    return rf"regexp_replace({text}, '[^\p{{Nd}}]', '', 'g')"


def luhn(text: str) -> str:
    rev = f"reverse({digits(text)})"
    v = f"(unicode(({rev})[i]) - 48)"
    return (
        f"coalesce(list_sum(list_transform(range(1, length({rev}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {v} "
        f"WHEN {v} * 2 > 9 THEN {v} * 2 - 9 ELSE {v} * 2 END)), 0) % 10 = 0"
    )


def iban(text: str) -> str:
    compact = f"replace({text}, ' ', '')"
    moved = f"({compact}[5:] || {compact}[1:4])"
    chars = f"string_split({moved}, '')"
    code = "unicode(c)"
    fold = (
        f"list_reduce(list_prepend(0, list_transform({chars}, lambda c: CASE WHEN {code} >= 65 "
        f"THEN 100000 + {code} - 55 ELSE {code} - 48 END)), lambda a, c: CASE WHEN c >= 100000 "
        f"THEN (a * 100 + c - 100000) % 97 ELSE (a * 10 + c) % 97 END)"
    )
    return f"(length({compact}) BETWEEN 15 AND 34 AND {fold} = 1)"


def valid(spec: P.PatternSpec, text: str) -> str:
    if spec.validator == "card":
        return f"(length({digits(text)}) BETWEEN 13 AND 19 AND {luhn(text)})"
    if spec.validator == "ipv4":
        return f"len(list_filter(string_split({text}, '.'), lambda o: o::INTEGER > 255)) = 0"
    if spec.validator == "iban":
        return iban(text)
    return "true"


RELAXED = {
    P.SSN_OPTIONAL_DASH: r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    P.SSN_PLAIN: r"\b\d{9}\b",
}


def lookaround(pattern: str, hit: str) -> str:
    """What the relaxed pattern does not say itself."""
    if pattern not in RELAXED:
        return "true"
    d = digits(hit)
    area = f"({d}[1:3] NOT IN ('000', '666') AND {d}[1:1] <> '9')"
    if pattern == P.SSN_PLAIN:
        return area
    return f"({area} AND {d}[4:5] <> '00' AND {d}[6:9] <> '0000')"


def spans(text: str, spec: P.PatternSpec, score: str | None = None) -> str:
    p = regex(RELAXED.get(spec.pattern, spec.pattern))
    m, s = f"regexp_extract_all({text}, {p})", f"string_split_regex({text}, {p})"
    build = (
        f"list_transform(range(1, len(z.m) + 1), lambda i: {{'type': {quote(spec.label)}, "
        f"'start': ({lengths('z.s[1:i]')} + {lengths('z.m[1:i-1]')})::INTEGER, "
        f"'end': ({lengths('z.s[1:i]')} + {lengths('z.m[1:i]')})::INTEGER, "
        f"'score': {score or spec.score}::DOUBLE, 'text': z.m[i]}})"
    )
    bound = f"list_transform([{{'m': {m}, 's': {s}}}], lambda z: {build})[1]"
    checks = [c for c in (valid(spec, "v.text"), lookaround(spec.pattern, "v.text")) if c != "true"]
    if checks:
        bound = f"list_filter({bound}, lambda v: {' AND '.join(checks)})"
    return f"({bound})::{FINDING}[]"


def overlap(f: str, others: str) -> str:
    return f'len(list_filter({others}, lambda o: {f}."end" > o."start" AND {f}."start" < o."end")) > 0'


def first_listed(first: str, later: str) -> str:
    """Findings of two lists; of overlapping ones those of the first stay."""
    return f"({first}) || list_filter({later}, lambda f: NOT ({overlap('f', f'({first})')}))"


def fold(candidates: str) -> str:
    return (
        f"list_reduce(list_prepend({NO_FINDINGS}, list_transform({candidates}, lambda c: [c])), "
        f"lambda acc, x: CASE WHEN {overlap('x[1]', 'acc')} THEN acc ELSE acc || x END)"
    )


def find_all(steps: Steps, text: str, specs: Sequence[P.PatternSpec], out: str) -> Steps:
    names = {f"{out}_c{i}": spans(text, s) for i, s in enumerate(specs)}
    steps.add(**names)
    return steps.add(**{out: fold(" || ".join(names))})


def beside(text: str, findings: str, spec: P.PatternSpec) -> str:
    return f"list_filter({spans(text, spec)}, lambda f: NOT ({overlap('f', findings)}))"


def ssn(steps: Steps, text: str, found: str) -> Steps:
    steps.add(_ctx=f"regexp_matches({text}, {regex(P.SSN_CONTEXT)})")
    for i, spec in enumerate(P.SSN_SPECS):
        score = "CASE WHEN _ctx THEN 0.9 ELSE 0.7 END"
        steps.add(**{f"_ssn{i}": spans(text, spec, f"({score})")})
        first = (
            f"list_filter(_ssn{i}, lambda f: NOT ({overlap('f', found)}) AND "
            f"(_ctx OR contains(f.text, '-')))[1:1]"
        )
        steps.replace(**{found: f"{found} || {first}"})
    return steps


def token(value: str) -> str:
    return f"'pii_' || sha256({quote(DEFAULT_SALT)} || {value})[1:8]"


def bare(label: str) -> str:
    return f"replace({label}, 'PII:', '')"


def placeholder(label: str) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in P.PLACEHOLDERS.items())
    return f"CASE {bare(label)} {cases} ELSE '<USER_' || upper({bare(label)}) || '>' END"


def right_to_left(findings: str) -> str:
    return f'list_reverse_sort(list_transform({findings}, lambda f: {{\'s\': f."start", \'f\': f}}))'


def splice(text: str, findings: str, replacement: str) -> str:
    """``replacement`` is an expression over ``f``; null keeps the span. Pairs of (start, end, new)
    ride in a list whose first element carries the text."""
    pieces = (
        f"list_transform({right_to_left(findings)}, lambda g: list_transform([g.f], lambda f: "
        f"{{'a': f.\"start\", 'b': f.\"end\", 't': {replacement}}})[1])"
    )
    return (
        f"list_reduce(list_prepend({{'a': 0, 'b': 0, 't': {text}}}, list_filter({pieces}, lambda x: x.t IS NOT NULL)), "
        "lambda acc, x: {'a': 0, 'b': 0, 't': left(acc.t, x.a) || x.t || acc.t[x.b + 1:]}).t"
    )


def redaction_reasons(findings: str) -> str:
    return f"list_sort(list_distinct(list_transform({findings}, lambda f: 'pii.redacted:' || {bare('f.type')})))"


def mask(steps: Steps, text: str, out: str) -> Steps:
    """Adds ``out`` (masked text) and ``out_r`` (reasons)."""
    hits = {f"{out}_h{i}": f"regexp_matches({text}, {regex(s.pattern)})" for i, (_, s, _) in enumerate(_MASK_STEPS)}
    steps.add(**hits).add(**{out: text})
    for i, (_, spec, replacement) in enumerate(_MASK_STEPS):
        if replacement is None:
            new = splice(out, spans(out, spec), quote(P.MASKED_CARD))
        else:
            new = f"regexp_replace({out}, {regex(spec.pattern)}, {quote(replacement.replace('$', chr(92)))}, 'g')"
        steps.replace(**{out: f"CASE WHEN {out}_h{i} THEN {new} ELSE {out} END"})
    listed = ", ".join(
        f"CASE WHEN {out}_h{i} THEN 'pii.redacted:{name}' END" for i, (name, _, _) in enumerate(_MASK_STEPS)
    )
    return steps.add(**{f"{out}_r": f"list_filter([{listed}], lambda r: r IS NOT NULL)"})


def mask_scalar(steps: Steps, text: str, out: str) -> Steps:
    return mask(steps, text, out)


def joined(list_expr: str) -> str:
    return f"CASE WHEN {list_expr} IS NOT NULL THEN coalesce(array_to_string({list_expr}, '|'), '') END"


SPACE_RUN = regex(r"\S+")


def tokens(text: str) -> str:
    chars = f"length({text}) / 4.0::DOUBLE"
    words = f"len(regexp_extract_all({text}, {SPACE_RUN})) * 1.3::DOUBLE"
    return f"greatest(1, floor(greatest({chars}, {words})))::BIGINT"


def cost(text: str, model: str) -> str:
    from quillguard.functions.money import FALLBACK_MODEL, MODEL_PRICES

    def price(k: int) -> str:
        cases = " ".join(f"WHEN {quote(m)} THEN {p[k]!r}::DOUBLE" for m, p in MODEL_PRICES.items())
        return f"(CASE {model} {cases} ELSE {MODEL_PRICES[FALLBACK_MODEL][k]!r}::DOUBLE END)"

    half = f"floor({tokens(text)} * 0.5::DOUBLE)::BIGINT"
    return f"({half} * {price(0)} + {half} * {price(1)})"
