"""Masking, placeholder redaction, pseudonyms and nested payload redaction. All map-only, except
the collision report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quillguard.functions import json_text as J
from quillguard.functions import text as X
from quillguard.functions.once import compute_once
from quillguard.functions.patterns import PatternSpec
from quillguard.functions.spans import Sql, each, fresh, joined_findings, keep, let, lit, name, splice


def mask_text(df: DataFrame, text_col: str, out: str = "masked", reasons: str = "reasons") -> DataFrame:
    return (
        compute_once(df, {"_m": X.mask_text(name(text_col))})
        .withColumns({out: F.col("_m.text"), reasons: F.col("_m.reasons")})
        .drop("_m")
    )


def redact_placeholders(
    df: DataFrame,
    text_col: str,
    findings_cols: Sequence[str] = ("findings",),
    out: str = "redacted",
    overlap: str = "first",
    specs: Sequence[PatternSpec] = (),
) -> DataFrame:
    """Replace findings by the placeholders of their types; ``specs`` bring those of types of one's own.
    Of overlapping findings the one listed first stays; ``overlap="raw"`` splices all of them with their
    original offsets, as specified for password phrases and payments."""
    own = {s.pii_type: s.placeholder for s in specs if s.placeholder is not None}
    findings = joined_findings(overlap, *map(name, findings_cols))
    done = compute_once(df, {"_every": findings})
    return done.withColumns(
        {
            out: F.expr(X.redact_placeholders(name(text_col), "_every", own)),
            "reasons": F.expr(X.redaction_reasons("_every")),
        }
    ).drop("_every")


def transform_by_tool(
    df: DataFrame,
    text_col: str,
    allow_col: str,
    mode: str = "static",
    findings_col: str = "findings",
    salt: str = X.DEFAULT_SALT,
    redaction: str = "mask",
) -> DataFrame:
    """Keep, tokenise or redact each finding by the row's ``allow_pii`` map."""
    args = (name(text_col), name(findings_col), name(allow_col), salt)
    if mode == "static":
        text_out, reasons = X.transform_static(*args, redaction=redaction)
    elif mode == "payload":
        text_out, reasons = X.transform_payload(*args)
    else:
        raise ValueError(f"mode must be static or payload, not {mode!r}")
    return df.withColumns({"text_out": F.expr(text_out), "reasons": F.expr(reasons)})


def tokenize_column(
    df: DataFrame, cols: Sequence[str], salt: str = X.DEFAULT_SALT, suffix: str = "_token"
) -> DataFrame:
    return df.withColumns(
        {f"{c}{suffix}": F.expr(X.token(f"CAST({name(c)} AS STRING)", salt)) for c in cols}
    )


def token_collisions(df: DataFrame, value_col: str, token_col: str, parts: int | None = None) -> DataFrame:
    """Tokens shared by several distinct values; a 32-bit token space collides at scale.

    Nearly all tokens stand for one value, so combining before the shuffle would fill memory and
    disk for nothing: pairs are dealt out by token once, into ``parts`` partitions or as many as the
    session says, and values are numbered in order there. Only numbers above one are counted further.
    """
    pairs = df.select(F.col(token_col).alias("token"), F.col(value_col).alias("value")).filter(F.col("value").isNotNull())
    dealt = pairs.repartition("token") if parts is None else pairs.repartition(parts, "token")
    nth = F.dense_rank().over(Window.partitionBy("token").orderBy("value"))
    more = dealt.select("token", nth.cast("bigint").alias("n")).filter("n > 1")
    return more.groupBy("token").agg(F.max("n").alias("n_values"))


# -------------------------------------------------------------------------------------------------
# Nested payloads
# -------------------------------------------------------------------------------------------------
FIELD_REASON = "field.redacted:password"
_JSON_SPACE = " \t\r\n"
_REASON_SET = "array_sort(array_distinct(_done.r))"


def _result(value: Sql, reasons: Sql) -> Sql:
    return f"named_struct('v', {value}, 'r', {reasons})"


def _mask_leaf(value: Sql) -> Sql:
    """Masked string; its reasons count only where the masking changed something."""
    return let(
        X.mask_text(value),
        lambda m: _result(f"{m}.text", f"CASE WHEN {m}.text <> {value} THEN {m}.reasons ELSE {X.NO_REASONS} END"),
    )


def _hidden(value: Sql) -> Sql:
    present = f"{value} IS NOT NULL"
    return _result(
        f"CASE WHEN {present} THEN '<PASSWORD>' END",
        f"CASE WHEN {present} THEN array({lit(FIELD_REASON)}) ELSE {X.NO_REASONS} END",
    )


def _redact_value(value: Sql, dtype: T.DataType, key: str) -> Sql:
    """``struct(v, r)``: the redacted value of type ``dtype`` found under ``key``, and the reasons.
    Each level is evaluated once and taken apart afterwards."""
    if isinstance(dtype, T.StringType):
        return _hidden(value) if X.is_password_name(key) else _mask_leaf(value)
    if isinstance(dtype, T.StructType):
        parts = ", ".join(
            f"{lit(f.name)}, {_redact_value(f'{value}.`{f.name}`', f.dataType, f.name)}" for f in dtype.fields
        )

        def rebuild(done: Sql) -> Sql:
            values = ", ".join(f"{lit(f.name)}, {done}.`{f.name}`.v" for f in dtype.fields)
            reasons = ", ".join(f"{done}.`{f.name}`.r" for f in dtype.fields)
            return _result(
                f"CASE WHEN {value} IS NOT NULL THEN named_struct({values}) END",
                f"CASE WHEN {value} IS NOT NULL THEN concat({reasons}) ELSE {X.NO_REASONS} END",
            )

        return let(f"named_struct({parts})", rebuild)
    if isinstance(dtype, T.ArrayType):  # elements lose the key name
        done = each(value, lambda x: _redact_value(x, dtype.elementType, ""))
        return let(done, lambda xs: _result(each(xs, lambda x: f"{x}.v"), _gathered(xs)))
    if isinstance(dtype, T.MapType):
        return _redact_map(value, dtype)
    if isinstance(dtype, T.VariantType):
        return _redact_variant(value, key)
    return _result(value, X.NO_REASONS)


def _redact_variant(value: Sql, key: str) -> Sql:
    """A value of no fixed type: a string is masked as one, any other value by its JSON text."""
    is_text = f"schema_of_variant({value}) = 'STRING'"
    own = _hidden(f"CAST({value} AS STRING)") if X.is_password_name(key) else _mask_leaf(f"CAST({value} AS STRING)")

    def as_variant(done: Sql) -> Sql:
        return _result(f"CASE WHEN size({done}.r) = 0 THEN {value} ELSE try_parse_json({done}.v) END", f"{done}.r")

    whole = let(let(f"to_json({value})", _redact_document), as_variant)
    text = let(own, lambda m: _result(f"CAST({m}.v AS VARIANT)", f"{m}.r"))
    return f"CASE WHEN {value} IS NULL THEN {_result(value, X.NO_REASONS)} WHEN {is_text} THEN {text} ELSE {whole} END"


def _redact_document(doc: Sql) -> Sql:
    """``struct(v, r)`` of JSON text with every string value redacted."""

    def masked(value: Sql) -> Sql:
        return let(_mask_leaf(value), lambda m: _result(f"CASE WHEN size({m}.r) > 0 THEN {m}.v END", f"{m}.r"))

    def edit(value: Sql, key: Sql) -> Sql:
        hidden = _result("'<PASSWORD>'", f"array({lit(FIELD_REASON)})")
        is_password = f"coalesce({X.is_password_field(key)}, false)"
        return f"CASE WHEN {is_password} THEN {hidden} ELSE {let(value, masked)} END"

    return J.edit_strings(doc, edit, X.NO_REASONS)


def _gathered(results: Sql) -> Sql:
    return f"coalesce(flatten({each(results, lambda x: f'{x}.r')}), {X.NO_REASONS})"


def _redact_map(value: Sql, dtype: T.MapType) -> Sql:
    def by_key(k: Sql, v: Sql) -> Sql:
        plain = _redact_value(v, dtype.valueType, "")
        if not isinstance(dtype.valueType, T.StringType):
            return plain
        return f"CASE WHEN {X.is_password_field(k)} THEN {_hidden(v)} ELSE {plain} END"

    k, v = fresh("k"), fresh("v")
    return let(
        f"transform_values({value}, ({k}, {v}) -> {by_key(k, v)})",
        lambda m: _result(f"transform_values({m}, (_, x) -> x.v)", _gathered(f"map_values({m})")),
    )


def redact_nested(df: DataFrame, col: str) -> DataFrame:
    """Redact every string leaf of a nested column or of JSON text.

    JSON text is read token by token: rows may differ in shape, nothing but the redacted strings
    changes, and absent keys stay absent. Text that is no JSON object, array or string (a bare number,
    bad syntax, repeated keys, anything behind the document) is masked as it stands.
    """
    column, dtype = name(col), df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        masked = f"CASE WHEN {column} IS NULL THEN {_result(column, X.NO_REASONS)} ELSE {_mask_leaf(column)} END"
        value = f"CASE WHEN {J.is_document(column)} THEN {_redact_document(column)} ELSE {masked} END"
    else:
        value = _redact_value(column, dtype, col)
    done = compute_once(df, {"_done": value})
    return done.withColumns({f"{col}_out": F.col("_done.v"), "reasons": F.expr(_REASON_SET)}).drop("_done")


# -------------------------------------------------------------------------------------------------
# Findings addressed by path
# -------------------------------------------------------------------------------------------------
def _str_of(literal: Sql) -> Sql:
    """Text a token is made of: a string's value, True and False, anything else as it is written."""
    return (
        f"CASE WHEN startswith({literal}, '\"') THEN {J.string_value(literal)} "
        f"WHEN {literal} = 'true' THEN 'True' WHEN {literal} = 'false' THEN 'False' ELSE {literal} END"
    )


def redact_paths(
    payloads: DataFrame,
    path_findings: DataFrame,
    key: str,
    doc_col: str,
    allow_col: str,
    salt: str = X.DEFAULT_SALT,
) -> DataFrame:
    """Transform only the values the findings point at, in the row's own document; all else in it
    stays as written. A text that is no JSON document has no paths and is masked whole.

    ``path_findings`` has ``(key, ord, type, path)`` and is gathered per payload: one output row
    lists one reason per finding. The last edit of a path wins, and an edit of a parent hides edits
    below it. ``allow_col`` maps type to action.
    """
    grouped = path_findings.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ord", "type", "path"))).alias("_path_findings")
    )
    none = "CAST(array() AS array<struct<ord:int,type:string,path:string>>)"
    spans = "CAST(array() AS array<struct<path:string,start:int,end:int,text:string>>)"
    doc, allow = name(doc_col), name(allow_col)
    joined = payloads.join(grouped, key, "left").withColumn(
        "_path_findings", F.expr(f"coalesce(_path_findings, {none})")
    )
    readable = compute_once(joined, {"_readable": f"coalesce({J.is_document(doc)}, false)"})
    with_text = each(
        J.locate(doc, "_path_findings.path"),
        lambda s: f"named_struct('path', {s}.path, 'start', {s}.start, 'end', {s}.end, "
        f"'text', trim({lit(_JSON_SPACE)} FROM substring({doc}, {s}.start + 1, {s}.end - {s}.start)))",
    )
    wanted = "_readable AND size(_path_findings) > 0"
    located = compute_once(
        readable, {"_at": f"CASE WHEN {wanted} THEN {keep(with_text, lambda s: f'{s}.text <> {lit('null')}')} ELSE {spans} END"}
    )

    def found(f: Sql) -> Sql:
        return (
            f"named_struct('type', {f}.type, 'path', {f}.path, 'present', array_contains(_at.path, {f}.path), "
            f"'action', coalesce(try_element_at({allow}, {f}.type), 'redact'))"
        )

    def reason(f: Sql) -> Sql:
        return (
            f"CASE WHEN {f}.action = 'pass_through' THEN concat('pii.allowed:', {f}.type) "
            f"WHEN NOT {f}.present THEN NULL WHEN {f}.action = 'tokenize' THEN concat('pii.tokenized:', {f}.type) "
            f"ELSE concat('pii.redacted:', {f}.type) END"
        )

    def last_action(s: Sql) -> Sql:
        edits = keep("_found", lambda f: f"{f}.path = {s}.path AND {f}.action <> 'pass_through'")
        return f"try_element_at({edits}, -1).action"

    def new_text(s: Sql) -> Sql:
        masked = f"CASE WHEN startswith({s}.text, '\"') THEN {let(J.string_value(f'{s}.text'), lambda v: X.mask_text(v) + '.text')} ELSE '<REDACTED>' END"
        return J.string_literal(f"CASE WHEN {s}.action = 'tokenize' THEN {X.token(_str_of(f'{s}.text'), salt)} ELSE {masked} END")

    judged = compute_once(located, {"_found": each("_path_findings", found)})
    acted = each("_at", lambda s: f"named_struct('start', {s}.start, 'end', {s}.end, 'text', {s}.text, 'action', {last_action(s)})")
    edits = let(
        keep(acted, lambda s: f"{s}.action IS NOT NULL"),
        lambda all_: keep(all_, lambda s: f"NOT exists({all_}, o -> o.start <= {s}.start AND {s}.`end` < o.`end`)"),
    )
    planned = compute_once(judged, {"_edits": edits, "reasons": f"array_compact({each('_found', reason)})"})
    unread = f"CASE WHEN {doc} IS NOT NULL THEN {X.mask_text(doc)}.text END"
    out = f"CASE WHEN _readable THEN {splice(doc, '_edits', new_text)} ELSE {unread} END"
    return compute_once(planned, {f"{doc_col}_out": out}).drop("_path_findings", "_readable", "_at", "_found", "_edits")
