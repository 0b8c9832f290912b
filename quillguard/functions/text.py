"""Text expressions: masking, placeholder redaction, pseudonyms, per-type transformation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillguard.functions import patterns as P
from quillguard.functions.spans import (
    Sql,
    _gate,
    _traits,
    each,
    let,
    lit,
    pattern_spans,
    right_to_left,
    splice,
)

# Fixed value: pseudonyms only agree when the salt does. Pass your own in production.
DEFAULT_SALT = "default-salt-change-in-production"

MASKED_DDL = "struct<text:string,reasons:array<string>>"
NO_REASONS: Sql = "CAST(array() AS array<string>)"

# Masking steps in order: (reason suffix, spec, replacement); the card step is conditional per span.
_MASK_STEPS = (
    ("email", P.EMAIL_SPEC, "$1***$2"),
    ("phone", P.PHONE_SPEC, P.MASKED_PHONE),
    ("card", P.CARD_SPEC, None),
    *((s.pii_type, s, P.PLACEHOLDERS[s.pii_type]) for s in P.HEALTH_AND_PAYMENT_SPECS),
)


def mask_text(text: Sql) -> Sql:
    """``struct(text, reasons)``: each reason is decided on the original text, each replacement
    works on what the steps before it left. The card reason does not ask for a valid checksum."""

    def hit_flags(traits: Sql) -> Sql:
        flags = [
            f"{lit(n)}, {_gate(spec, text, traits)} AND {text} RLIKE {lit(P.java(spec.scan or spec.pattern))}"
            for n, spec, _ in _MASK_STEPS
        ]
        return f"named_struct({', '.join(flags)})"

    def replaced(current: Sql, spec: P.PatternSpec, replacement: str | None) -> Sql:
        if replacement is None:
            return splice(current, pattern_spans(current, spec), lambda _: lit(P.MASKED_CARD))
        if spec.scan is not None:  # groups of the pattern come after those of the scan
            replacement = "$1" + re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2}", replacement)
        return f"regexp_replace({current}, {lit(P.java(spec.scan or spec.pattern))}, {lit(replacement)})"

    def apply(hits: Sql) -> Sql:
        def from_step(i: int, current: Sql) -> Sql:
            if i == len(_MASK_STEPS):
                return current
            n, spec, replacement = _MASK_STEPS[i]
            done = f"CASE WHEN {hits}.{n} THEN {replaced(current, spec, replacement)} ELSE {current} END"
            return let(done, lambda c: from_step(i + 1, c))

        any_hit = " OR ".join(f"{hits}.{n}" for n, _, _ in _MASK_STEPS)
        listed = ", ".join(f"CASE WHEN {hits}.{n} THEN {lit('pii.redacted:' + n)} END" for n, _, _ in _MASK_STEPS)
        return (
            f"named_struct('text', CASE WHEN {any_hit} THEN {from_step(0, text)} ELSE {text} END, "
            f"'reasons', array_compact(array({listed})))"
        )

    return f"CAST({let(let(_traits(text), hit_flags), apply)} AS {MASKED_DDL})"


def token(value: Sql, salt: str = DEFAULT_SALT) -> Sql:
    """Stable pseudonym of a value."""
    return f"concat('pii_', substring(sha2(concat({lit(salt)}, {value}), 256), 1, 8))"


def bare_type(label: Sql) -> Sql:
    return f"replace({label}, 'PII:', '')"


def placeholder(label: Sql, own: Mapping[str, str] | None = None) -> Sql:
    """Placeholder of a finding label such as ``PII:us_npi``; ``own`` adds to the fixed ones."""
    cases = " ".join(f"WHEN {lit('PII:' + k)} THEN {lit(v)}" for k, v in {**P.PLACEHOLDERS, **(own or {})}.items())
    return (
        f"CASE {label} {cases} ELSE CASE WHEN startswith({label}, 'PII:') "
        f"THEN concat('<USER_', upper({bare_type(label)}), '>') ELSE '<REDACTED>' END END"
    )


def redact_placeholders(text: Sql, findings: Sql, own: Mapping[str, str] | None = None) -> Sql:
    return splice(text, findings, lambda f: placeholder(f"{f}.type", own))


def redaction_reasons(findings: Sql) -> Sql:
    labels = each(findings, lambda f: f"concat('pii.redacted:', {bare_type(f + '.type')})")
    return f"array_sort(array_distinct({labels}))"


def _action(f: Sql, allow_pii: Sql) -> Sql:
    return f"coalesce(try_element_at({allow_pii}, {f}.type), 'redact')"


def transform_static(
    text: Sql, findings: Sql, allow_pii: Sql, salt: str = DEFAULT_SALT, redaction: str = "mask"
) -> tuple[Sql, Sql]:
    """Keep, tokenise or redact each finding as the tool's rule says; anything unknown is redacted.
    ``redaction`` is ``mask`` (the span's own text is masked) or ``placeholder``."""

    def replacement(f: Sql) -> Sql:
        redacted = placeholder(f"{f}.type") if redaction == "placeholder" else mask_text(f"{f}.text") + ".text"
        return (
            f"CASE {_action(f, allow_pii)} WHEN 'pass_through' THEN NULL "
            f"WHEN 'tokenize' THEN {token(f + '.text', salt)} ELSE {redacted} END"
        )

    def reason(f: Sql) -> Sql:
        verb = (
            f"CASE {_action(f, allow_pii)} WHEN 'pass_through' THEN 'allowed' "
            "WHEN 'tokenize' THEN 'tokenized' ELSE 'redacted' END"
        )
        return f"concat('pii.', {verb}, ':', {f}.type)"

    return splice(text, findings, replacement), each(right_to_left(findings), reason)


def transform_payload(
    text: Sql, findings: Sql, allow_pii: Sql, salt: str = DEFAULT_SALT
) -> tuple[Sql, Sql]:
    """As ``transform_static`` with bracketed labels; kept spans and unknown actions give no reason."""

    def replacement(f: Sql) -> Sql:
        label = f"concat('[', upper({f}.type), ']')"
        return (
            f"CASE {_action(f, allow_pii)} WHEN 'tokenize' THEN {token(f + '.text', salt)} "
            f"WHEN 'redact' THEN {label} WHEN 'deny' THEN {label} END"
        )

    def reason(f: Sql) -> Sql:
        return (
            f"CASE {_action(f, allow_pii)} WHEN 'tokenize' THEN concat('tokenized:', {f}.type) "
            f"WHEN 'redact' THEN concat('redacted:', {f}.type) WHEN 'deny' THEN concat('redacted:', {f}.type) END"
        )

    return splice(text, findings, replacement), f"array_compact({each(right_to_left(findings), reason)})"


def is_password_field(field: Sql) -> Sql:
    return "(" + " OR ".join(f"contains(lower({field}), {lit(w)})" for w in P.PASSWORD_FIELD_WORDS) + ")"


def is_password_name(field: str) -> bool:
    return any(word in field.lower() for word in P.PASSWORD_FIELD_WORDS)


def word_count(text: Sql) -> Sql:
    """Number of runs of non-space characters."""
    return f"regexp_count({text}, {lit(P.java(chr(92) + 'S+'))})"


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 out of two plain hashes over the padded key (RFC 2104)."""
    raw = key.encode()
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in raw))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in raw))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)
