"""Discovery of personal, health, payment and credential data in text columns.

Every job here is a projection: no shuffle, one pass over the text, whole texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions import patterns as P
from quillguard.functions.once import compute_once
from quillguard.functions.shipping import ship
from quillguard.functions.spans import VALIDATORS, Sql, find_all, find_beside, find_ssn, let, lit, name, raise_by_context
from quillguard.functions.text import is_password_field
from quillguard.schemas import FINDINGS_DDL


def pattern_specs(table: DataFrame) -> list[P.PatternSpec]:
    """Specs from a table of settings ``(type, pattern, score, priority, validator, placeholder)``, in
    order of priority; the last two may be null. A column ``context`` (array of words or phrases, may be
    null) names what raises a score nearby. It is read when the query is built, as the patterns are part
    of the plan."""
    context = F.col("context") if "context" in table.columns else F.lit(None).cast("array<string>").alias("context")
    rows = table.select("type", "pattern", "score", "priority", "validator", "placeholder", context).collect()
    unknown = {r["validator"] for r in rows} - {None, *VALIDATORS}
    if unknown:
        raise ValueError(f"no such validator: {sorted(unknown)}")
    return [
        P.PatternSpec(r["type"], r["pattern"], float(r["score"]), "", r["validator"], placeholder=r["placeholder"], context=tuple(w for w in r["context"] or () if w))
        for r in sorted(rows, key=lambda r: (r["priority"], r["type"]))
    ]


def scan_findings(
    df: DataFrame,
    text_col: str,
    profile: str | Sequence[P.PatternSpec] = "regex",
    engine: str = "native",
    out: str = "findings",
    context_before: int = P.CONTEXT_BEFORE,
    context_after: int = P.CONTEXT_AFTER,
) -> DataFrame:
    """Add a findings column. ``profile`` is ``regex`` (phone before card and NPI, as specified),
    ``specific_first`` or a list of pattern specs in order of precedence; ``engine`` is
    ``native`` (column expressions) or ``arrow`` (batched Python, without context words). The score of
    a finding rises where a context word of its spec is among the ``context_before`` words before it or
    the ``context_after`` words behind it."""
    specs = P.PROFILES[profile] if isinstance(profile, str) else tuple(profile)
    if engine == "arrow":
        ship(df.sparkSession)
        return df.withColumn(out, _arrow_finder(specs)(F.col(text_col)))
    found = find_all(name(text_col), specs)
    if any(s.context for s in specs):
        found = let(found, lambda f: raise_by_context(name(text_col), f, specs, context_before, context_after))
    return compute_once(df, {out: found})


def scan_ssn_context(df: DataFrame, text_col: str, findings_col: str = "findings") -> DataFrame:
    """Add at most one SSN span per SSN pattern to the findings (see ``find_ssn``)."""
    return compute_once(df, {findings_col: find_ssn(name(text_col), name(findings_col))})


def scan_password_payment(df: DataFrame, text_col: str, findings_col: str = "findings") -> DataFrame:
    """Password phrases and payment amounts beside the standard findings. The two lists are not
    checked against each other."""
    text, findings = name(text_col), name(findings_col)
    return compute_once(
        df,
        {
            "password_findings": find_beside(text, findings, P.PASSWORD_SPEC),
            "payment_findings": find_beside(text, findings, P.PAYMENT_SPEC),
        },
    )


def scan_credentials(df: DataFrame, text_col: str, out: str = "findings") -> DataFrame:
    """API keys and JSON web tokens."""
    return compute_once(df, {out: find_all(name(text_col), P.CREDENTIAL_SPECS)})


def false_positive(pii_type: Sql, field: Sql, value: Sql) -> Sql:
    """True for SSN findings whose field or whole value shows they are none."""
    nine_equal = lit(r"^(\p{Nd})\1{8}$")
    words = ", ".join(lit(w) for w in P.PASSWORD_WORDS)
    signs = (
        f"coalesce({is_password_field(field)}, false) OR coalesce(lower({value}) IN ({words}), false) "
        f"OR coalesce({value} RLIKE {nine_equal}, false)"
    )
    return f"(replace({pii_type}, 'PII:', '') = 'us_ssn' AND ({signs}))"


def drop_false_positives(
    findings: DataFrame, field_col: str, value_col: str, type_col: str = "type"
) -> DataFrame:
    return findings.filter(f"NOT {false_positive(name(type_col), name(field_col), name(value_col))}")


def findings_long(df: DataFrame, keep: Sequence[str], findings_col: str = "findings") -> DataFrame:
    """One row per finding. ``explode_outer`` keeps the optimizer from inferring a filter that
    would evaluate the detection a second time below the scan."""
    return (
        df.select(*keep, F.explode_outer(findings_col).alias("f"))
        .filter(F.col("f.type").isNotNull())
        .select(*keep, "f.type", "f.start", "f.end", "f.score", "f.text")
    )


def corpus_pii_profile(df: DataFrame, by: Sequence[str], findings_col: str = "findings") -> DataFrame:
    """Findings and affected rows by type. Rows are reduced to (type, count) pairs first, so the
    row count needs no distinct and the shuffle carries partial sums only."""
    types = F.transform(F.col(findings_col), lambda f: f["type"])
    per_row = F.transform(
        F.array_distinct(types),
        lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).alias("n")),
    )
    return (
        df.select(*by, F.explode_outer(per_row).alias("p"))
        .filter(F.col("p.type").isNotNull())
        .groupBy(*by, F.col("p.type").alias("type"))
        .agg(F.sum(F.col("p.n").cast("bigint")).alias("n_findings"), F.count("*").alias("n_rows"))
    )


# -------------------------------------------------------------------------------------------------
# Arrow variant: the same scan as a batched Python function, used to cross-check the native one.
# -------------------------------------------------------------------------------------------------
def _card_valid(text: str) -> bool:
    digits = [ord(c) - 48 for c in text if c.isdecimal()]
    if not 13 <= len(digits) <= 19:
        return False
    total = 0
    for i, n in enumerate(reversed(digits)):
        n = n * 2 if i % 2 else n
        total += n - 9 if i % 2 and n > 9 else n
    return total % 10 == 0


def _ipv4_valid(text: str) -> bool:
    return all(int(part) <= 255 for part in text.split("."))


def _iban_valid(text: str) -> bool:
    compact = text.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


_PY_VALIDATORS = {"card": _card_valid, "ipv4": _ipv4_valid, "iban": _iban_valid}


def _find_in_python(text: str | None, compiled: list[tuple[P.PatternSpec, re.Pattern[str]]]) -> list[dict]:
    found: list[dict] = []
    for spec, regex in compiled:
        check = _PY_VALIDATORS.get(spec.validator or "")
        for m in regex.finditer(text or ""):
            start, end = m.span()
            if (check and not check(m.group())) or any(end > f["start"] and start < f["end"] for f in found):
                continue
            found.append(
                {"type": spec.label, "start": start, "end": end, "score": spec.score, "text": m.group()}
            )
    return found


def _arrow_finder(specs: Sequence[P.PatternSpec]):
    @F.pandas_udf(FINDINGS_DDL)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(s, P.python_regex(s.pattern)) for s in specs]
        for texts in batches:
            yield pd.Series([_find_in_python(t, compiled) for t in texts])

    return find
