"""Queries over findings and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.functions import patterns as P
from quillguard.functions import text as X
from quillguard.functions.sizing import TASK_BYTES, pieces, spread
from quillguard.operators import detect, redact
from quillguard.plans import inputs as I
from quillguard.plans import sqlkit as K
from quillguard.plans.catalog import query


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return spread(I.requests(spark, sf), "request_id")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(I.table(spark, sf, "documents"), "doc_id")


def _long(df: DataFrame, key: str, col: str = "findings") -> DataFrame:
    return (
        df.select(key, F.explode_outer(col).alias("f"))
        .filter("f.type is not null")
        .select(
            key,
            F.col("f.type").alias("pii_type"),
            F.col("f.start").alias("span_start"),
            F.col("f.end").alias("span_end"),
            F.col("f.score").alias("score"),
            F.col("f.text").alias("span_text"),
        )
    )


def _long_sql(steps: K.Steps, key: str, col: str = "findings") -> str:
    steps.raw(f"SELECT {key}, unnest({col}) AS f FROM {{prev}}")
    return steps.select(
        f'{key}, f."type" AS pii_type, f."start" AS span_start, f."end" AS span_end, f.score AS score, '
        'f."text" AS span_text'
    )


def _found(source: str, text: str, specs=P.REGEX_PROFILE, out: str = "findings") -> K.Steps:
    return K.find_all(K.Steps(source), text, specs, out)


@query("scan_findings", _long_sql(_found(I.REQUESTS_SQL, "raw_text"), "request_id"))
def scan_findings(spark, sf):
    return _long(detect.scan_findings(_requests(spark, sf), "raw_text"), "request_id")


@query("scan_findings_documents", _long_sql(_found("SELECT * FROM documents", "text"), "doc_id"))
def scan_findings_documents(spark, sf):
    return _long(detect.scan_findings(_documents(spark, sf), "text"), "doc_id")


@query("scan_findings_arrow", _long_sql(_found("SELECT * FROM documents", "text"), "doc_id"))
def scan_findings_arrow(spark, sf):
    return _long(detect.scan_findings(_documents(spark, sf), "text", engine="arrow"), "doc_id")


@query("scan_findings_pages", _long_sql(_found("SELECT * FROM pages", "html"), "page_id"))
def scan_findings_pages(spark, sf):
    pages = spread(I.table(spark, sf, "pages"), "page_id")
    return _long(detect.scan_findings(pages, "html"), "page_id")


@query(
    "scan_findings_specific_first",
    _long_sql(_found(I.REQUESTS_SQL, "raw_text", P.SPECIFIC_FIRST_PROFILE), "request_id"),
)
def scan_findings_specific_first(spark, sf):
    return _long(
        detect.scan_findings(_requests(spark, sf), "raw_text", profile="specific_first"), "request_id"
    )


@query(
    "scan_findings_specific_first_documents",
    _long_sql(_found("SELECT * FROM documents", "text", P.SPECIFIC_FIRST_PROFILE), "doc_id"),
)
def scan_findings_specific_first_documents(spark, sf):
    return _long(detect.scan_findings(_documents(spark, sf), "text", profile="specific_first"), "doc_id")


@query(
    "scan_ssn_context",
    _long_sql(
        K.ssn(_found(I.REQUESTS_SQL, "raw_text", (P.EMAIL_SPEC,)), "raw_text", "findings"), "request_id"
    ),
)
def scan_ssn_context(spark, sf):
    """After the email scan only: the phone pattern would take every SSN first."""
    found = detect.scan_findings(_requests(spark, sf), "raw_text", profile=(P.EMAIL_SPEC,))
    return _long(detect.scan_ssn_context(found, "raw_text"), "request_id")


@query(
    "scan_ssn_after_all_types",
    _long_sql(K.ssn(_found(I.REQUESTS_SQL, "raw_text"), "raw_text", "findings"), "request_id"),
)
def scan_ssn_after_all_types(spark, sf):
    found = detect.scan_findings(_requests(spark, sf), "raw_text")
    return _long(detect.scan_ssn_context(found, "raw_text"), "request_id")


def _beside_sql() -> str:
    steps = _found(I.REQUESTS_SQL, "raw_text")
    steps.add(
        other=f"{K.beside('raw_text', 'findings', P.PASSWORD_SPEC)} || "
        f"{K.beside('raw_text', 'findings', P.PAYMENT_SPEC)}"
    )
    return _long_sql(steps, "request_id", "other")


@query("scan_password_payment", _beside_sql())
def scan_password_payment(spark, sf):
    found = detect.scan_findings(_requests(spark, sf), "raw_text")
    both = detect.scan_password_payment(found, "raw_text").withColumn(
        "other", F.concat("password_findings", "payment_findings")
    )
    return _long(both, "request_id", "other")


@query("scan_credentials", _long_sql(_found(I.REQUESTS_SQL, "raw_text", P.CREDENTIAL_SPECS), "request_id"))
def scan_credentials(spark, sf):
    return _long(detect.scan_credentials(_requests(spark, sf), "raw_text"), "request_id")


_CANDIDATE_FIELDS = ("'ssn'", "'user_password'", "''", "'tax'", "'API_KEY'")
_CANDIDATE_VALUES = ("'123-45-6789'", "'111111111'", "'Password'", "'219099999'")


def _candidate_columns(d: I.Dialect) -> dict[str, str]:
    return {
        "event_id": "event_id",
        "type": "case when event_id % 6 = 0 then 'PII:phone_number' else 'PII:us_ssn' end",
        "field_name": d.pick(_CANDIDATE_FIELDS, "event_id % 5"),
        "whole_value": d.pick(_CANDIDATE_VALUES, "event_id % 4"),
    }


_FIELD_HIT = " OR ".join(f"contains(lower(field_name), '{w}')" for w in P.PASSWORD_FIELD_WORDS)


@query(
    "drop_false_positives",
    "SELECT * FROM (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _candidate_columns(I.DUCK).items())
    + f" FROM events) WHERE NOT (type = 'PII:us_ssn' AND ({_FIELD_HIT} "
    "OR lower(whole_value) IN ('password', 'pwd', 'pass') "
    "OR (length(whole_value) = 9 AND whole_value = repeat(whole_value[1], 9) "
    "AND regexp_matches(whole_value, '^[0-9]{9}$'))))",
)
def drop_false_positives(spark, sf):
    columns = [F.expr(e).alias(n) for n, e in _candidate_columns(I.SPARK).items()]
    candidates = I.table(spark, sf, "events").select(*columns)
    return detect.drop_false_positives(candidates, "field_name", "whole_value")


def _real_candidates_sql() -> str:
    """SSN and other findings of the requests, each with the tool it was sent to as its field."""
    steps = K.ssn(_found(I.REQUESTS_SQL, "raw_text", (P.EMAIL_SPEC,)), "raw_text", "findings")
    steps.raw("SELECT request_id, tool, raw_text, unnest(findings) AS f FROM {prev}")
    steps.raw(
        "SELECT request_id, f.\"type\" AS type, f.\"start\" AS span_start, f.text AS span_text, "
        "CASE WHEN length(raw_text) % 3 = 0 THEN 'password_' || tool ELSE tool END AS field_name, "
        "replace(f.text, '-', '') AS whole_value FROM {prev}"
    )
    return steps.select(
        "request_id, type, span_start, span_text",
        f"WHERE NOT (type = 'PII:us_ssn' AND (coalesce({_FIELD_HIT}, false) OR lower(whole_value) IN ('password', 'pwd', 'pass') "
        "OR (length(whole_value) = 9 AND whole_value = repeat(whole_value[1], 9) AND regexp_matches(whole_value, '^[0-9]{9}$'))))",
    )


@query("drop_false_positives_findings", _real_candidates_sql())
def drop_false_positives_findings(spark, sf):
    found = detect.scan_findings(_requests(spark, sf), "raw_text", profile=(P.EMAIL_SPEC,))
    rows = detect.findings_long(detect.scan_ssn_context(found, "raw_text"), ["request_id", "tool", "raw_text"])
    field = F.when(F.length("raw_text") % 3 == 0, F.concat(F.lit("password_"), "tool")).otherwise(F.col("tool"))
    candidates = rows.select("request_id", "type", F.col("start").alias("span_start"), F.col("text").alias("span_text"), field.alias("field_name"), F.replace("text", F.lit("-"), F.lit("")).alias("whole_value"))
    return detect.drop_false_positives(candidates, "field_name", "whole_value").select("request_id", "type", "span_start", "span_text")


def _profile_sql() -> str:
    steps = _found("SELECT * FROM documents", "text")
    steps.raw("SELECT doc_id, lang, source, unnest(findings) AS f FROM {prev}")
    return steps.select(
        'lang, source, f."type" AS "type", count(*) AS n_findings, count(DISTINCT doc_id) AS n_rows',
        "GROUP BY ALL",
    )


@query("corpus_pii_profile", _profile_sql())
def corpus_pii_profile(spark, sf):
    found = detect.scan_findings(_documents(spark, sf), "text")
    return detect.corpus_pii_profile(found, ["lang", "source"])


# ---------------------------------------------------------------------------------- redaction
@query(
    "mask_text",
    K.mask(K.Steps(I.REQUESTS_SQL), "raw_text", "m").select(
        f"request_id, m AS masked, {K.joined('m_r')} AS reasons"
    ),
)
def mask_text(spark, sf):
    masked = redact.mask_text(_requests(spark, sf), "raw_text")
    return masked.select("request_id", "masked", F.array_join("reasons", "|").alias("reasons"))


@query(
    "mask_text_documents",
    K.mask(K.Steps("SELECT * FROM documents"), "text", "m").select(
        f"doc_id, m AS masked, {K.joined('m_r')} AS reasons"
    ),
)
def mask_text_documents(spark, sf):
    masked = redact.mask_text(_documents(spark, sf), "text")
    return masked.select("doc_id", "masked", F.array_join("reasons", "|").alias("reasons"))


def _placeholder_sql(source: str, text: str, key: str) -> str:
    steps = _found(source, text)
    steps.add(
        first=f"findings || {K.beside(text, 'findings', P.PASSWORD_SPEC)}",
        pay=K.beside(text, "findings", P.PAYMENT_SPEC),
    )
    steps.add(every=K.first_listed("first", "pay"))
    redacted = K.splice(text, "every", K.placeholder("f.type"))
    return steps.select(f"{key}, {redacted} AS redacted, {K.joined(K.redaction_reasons('every'))} AS reasons")


@query("redact_placeholders", _placeholder_sql(I.REQUESTS_SQL, "raw_text", "request_id"))
def redact_placeholders(spark, sf):
    found = detect.scan_findings(_requests(spark, sf), "raw_text")
    found = detect.scan_password_payment(found, "raw_text")
    out = redact.redact_placeholders(
        found, "raw_text", ["findings", "password_findings", "payment_findings"]
    )
    return out.select("request_id", "redacted", F.array_join("reasons", "|").alias("reasons"))


@query("redact_placeholders_documents", _placeholder_sql("SELECT * FROM documents", "text", "doc_id"))
def redact_placeholders_documents(spark, sf):
    found = detect.scan_findings(_documents(spark, sf), "text")
    found = detect.scan_password_payment(found, "text")
    out = redact.redact_placeholders(found, "text", ["findings", "password_findings", "payment_findings"])
    return out.select("doc_id", "redacted", F.array_join("reasons", "|").alias("reasons"))


# Types of one's own, as a table of settings; the first takes digits before the second sees them.
_OWN_TYPES = (
    ("long_number", r"\d{6,}", 0.6, 1, None, "<NUMBER>"),
    ("address_v4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.8, 2, "ipv4", None),
)


def _own_types_sql() -> str:
    specs = [P.PatternSpec(t, p, score, "", check) for t, p, score, _, check, _ in _OWN_TYPES]
    steps = _found("SELECT * FROM documents", "text", specs)
    label = "CASE f.type WHEN 'PII:long_number' THEN '<NUMBER>' ELSE '<USER_ADDRESS_V4>' END"
    return steps.select(
        f"doc_id, {K.splice('text', 'findings', label)} AS redacted, {K.joined(K.redaction_reasons('findings'))} AS reasons"
    )


@query("redact_own_types", _own_types_sql())
def redact_own_types(spark, sf):
    settings = "type string, pattern string, score double, priority int, validator string, placeholder string"
    specs = detect.pattern_specs(spark.createDataFrame(_OWN_TYPES, settings))
    found = detect.scan_findings(_documents(spark, sf), "text", specs)
    out = redact.redact_placeholders(found, "text", specs=specs)
    return out.select("doc_id", "redacted", F.array_join("reasons", "|").alias("reasons"))


# Types of one's own with words that raise their score, of the languages of the texts.
_CONTEXT_TYPES = (
    ("digits", r"\d{4,}", 0.3, 1, None, None, ["the", "und", "de la", "que"]),
    ("mail_name", r"[a-z0-9.]+@", 0.7, 2, None, None, ["of", "der", "et", "el", "that"]),
    ("address_v4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.8, 3, "ipv4", None, None),
)


def _context_sql() -> str:
    specs = [P.PatternSpec(t, p, score, "", check) for t, p, score, _, check, _, _ in _CONTEXT_TYPES]
    steps = _found("SELECT * FROM documents", "text", specs)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    left = f"regexp_extract_all(lower(substring(text, greatest(1, f.\"start\" - 199), least(f.\"start\", 200))), '{word}')"
    right = f"regexp_extract_all(lower(substring(text, f.\"end\" + 1, 200)), '{word}')"
    found = steps.select("doc_id, text, unnest(findings) AS f")
    near = f"SELECT doc_id, f, ' ' || array_to_string({left}[-5:] || {right}[1:2], ' ') || ' ' AS near FROM ({found})"
    hits = " OR ".join(
        f"f.type = 'PII:{t}' AND ({' OR '.join(f'contains(near, {chr(39)} {w} {chr(39)})' for w in words)})" for t, _, _, _, _, _, words in _CONTEXT_TYPES if words
    )
    return (
        f"SELECT doc_id, f.type AS pii_type, f.\"start\" AS \"start\", f.text AS found, "
        f"CASE WHEN {hits} THEN least(1.0, greatest(0.4, f.score + 0.35::DOUBLE)) ELSE f.score END::DOUBLE AS score FROM ({near})"
    )


@query("scan_context_words", _context_sql())
def scan_context_words(spark, sf):
    settings = "type string, pattern string, score double, priority int, validator string, placeholder string, context array<string>"
    specs = detect.pattern_specs(spark.createDataFrame(_CONTEXT_TYPES, settings))
    found = detect.scan_findings(_documents(spark, sf), "text", specs, context_after=2)
    rows = found.select("doc_id", F.explode("findings").alias("f"))
    return rows.select("doc_id", F.col("f.type").alias("pii_type"), F.col("f.start").alias("start"), F.col("f.text").alias("found"), F.col("f.score").alias("score"))


# Actions by tool: some kept, some tokenised, some unknown, the rest redacted.
_ALLOW = (
    {"PII:email_address": "pass_through", "PII:us_dea": "tokenize"},
    {"PII:phone_number": "tokenize", "PII:pci_cvv": "mystery"},
    {},
)


def _action_sql(label: str) -> str:
    maps = ", ".join(I.DUCK.map(m) for m in _ALLOW)
    return f"coalesce(([{maps}])[allow_id + 1][{label}], 'redact')"


def _with_allow(df: DataFrame) -> DataFrame:
    maps = F.array(*[F.expr(I.SPARK.map(m)) for m in _ALLOW])
    return df.withColumn("allow_id", F.length("tool") % 3).withColumn("allow", F.get(maps, F.col("allow_id")))


def _transform_sql(mode: str) -> str:
    steps = _found(I.REQUESTS_SQL, "raw_text").add(allow_id="length(tool) % 3")
    action = _action_sql("f.type")
    if mode == "payload":
        new = (
            f"CASE WHEN {action} = 'tokenize' THEN {K.token('f.text')} "
            f"WHEN {action} IN ('redact', 'deny') THEN '[' || upper(f.type) || ']' END"
        )
        reason = (
            f"CASE WHEN {action} = 'tokenize' THEN 'tokenized:' || f.type "
            f"WHEN {action} IN ('redact', 'deny') THEN 'redacted:' || f.type END"
        )
    else:
        # The span's own text masked alone: with these inputs one of three mask steps applies.
        new = (
            f"CASE WHEN {action} = 'pass_through' THEN NULL WHEN {action} = 'tokenize' THEN {K.token('f.text')} "
            f"WHEN f.type = 'PII:email_address' THEN regexp_replace(f.text, {K.regex(P.EMAIL)}, '\\1***\\2') "
            f"WHEN f.type = 'PII:phone_number' THEN {K.quote(P.MASKED_PHONE)} "
            f"WHEN regexp_matches(f.text, {K.regex(P.PHONE)}) THEN "
            f"regexp_replace(f.text, {K.regex(P.PHONE)}, {K.quote(P.MASKED_PHONE)}, 'g') "
            f"ELSE {K.placeholder('f.type')} END"
        )
        reason = (
            f"'pii.' || CASE {action} WHEN 'pass_through' THEN 'allowed' WHEN 'tokenize' THEN 'tokenized' "
            "ELSE 'redacted' END || ':' || f.type"
        )
    reasons = (
        f"list_filter(list_transform({K.right_to_left('findings')}, lambda g: list_transform([g.f], "
        f"lambda f: {reason})[1]), lambda r: r IS NOT NULL)"
    )
    return steps.select(
        f"request_id, {K.splice('raw_text', 'findings', new)} AS text_out, {K.joined(reasons)} AS reasons"
    )


def _transform(spark, sf, mode: str) -> DataFrame:
    found = detect.scan_findings(_with_allow(_requests(spark, sf)), "raw_text")
    out = redact.transform_by_tool(found, "raw_text", "allow", mode=mode)
    return out.select("request_id", "text_out", F.array_join("reasons", "|").alias("reasons"))


@query("transform_by_tool_static", _transform_sql("static"))
def transform_by_tool_static(spark, sf):
    return _transform(spark, sf, "static")


@query("transform_by_tool_payload", _transform_sql("payload"))
def transform_by_tool_payload(spark, sf):
    return _transform(spark, sf, "payload")


@query(
    "tokenize_column",
    f"SELECT c_custkey, {K.token('c_name')} AS c_name_token, {K.token('c_custkey::VARCHAR')} AS c_custkey_token "
    "FROM customer",
)
def tokenize_column(spark, sf):
    out = redact.tokenize_column(I.table(spark, sf, "customer"), ["c_name", "c_custkey"])
    return out.select("c_custkey", "c_name_token", "c_custkey_token")


# Tokens of 32 bits collide among a few hundred thousand values: one for each cell of lineitem.
_CELLS = ("quantity", "extendedprice", "discount", "tax", "shipdate", "receiptdate")


@query(
    "token_collisions",
    f"SELECT {K.token('v')} AS token, count(DISTINCT v) AS n_values FROM (SELECT concat_ws('|', l_orderkey, "
    f"l_linenumber, unnest({list(_CELLS)})) AS v FROM lineitem) GROUP BY 1 HAVING count(DISTINCT v) > 1",
)
def token_collisions(spark, sf):
    cell = F.explode(F.array(*[F.lit(c) for c in _CELLS]))
    rows = I.table(spark, sf, "lineitem")
    keys = rows.select("l_orderkey", "l_linenumber").repartition(pieces(rows))  # of each row, six cells
    cells = keys.select("*", cell.alias("cell"))
    values = cells.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "cell").alias("value"))
    return redact.token_collisions(redact.tokenize_column(values, ["value"]), "value", "value_token", pieces(rows, task_bytes=TASK_BYTES // 2))


_LITERAL = r'"(?:[^"\\]|\\.)*"'
_IS_DOCUMENT = r"(json_valid(payload) AND regexp_matches(payload, '^\s*[{\[\"]'))"


def _nested_sql() -> str:
    """Documents as rows of their pieces: strings that are values are masked or hidden by the key
    before them. A text that is no document is one piece."""
    pieces = K.quote(rf'{_LITERAL}(?:\s*:\s*)?|[^"]+')
    steps = K.Steps(
        f"SELECT event_id, ok, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT event_id, {_IS_DOCUMENT} "
        f"AS ok, CASE WHEN {_IS_DOCUMENT} THEN regexp_extract_all(payload, {pieces}) ELSE [payload] END AS p FROM ({I.PAYLOADS_SQL}))"
    )
    steps.add(before="lag(piece) OVER (PARTITION BY event_id ORDER BY i)")
    steps.add(
        leaf="ok AND starts_with(piece, '\"') AND ends_with(piece, '\"')",
        field=f"CASE WHEN starts_with(before, '\"') AND NOT ends_with(before, '\"') "
        f"THEN lower(json_extract_string(regexp_extract(before, {K.quote(_LITERAL)}), '$')) END",
    )
    steps.add(value="CASE WHEN leaf THEN json_extract_string(piece, '$') WHEN NOT ok THEN piece END")
    K.mask(steps, "value", "m")
    words = " OR ".join(f"contains(field, {K.quote(w)})" for w in P.PASSWORD_FIELD_WORDS)
    steps.add(hidden=f"leaf AND coalesce({words}, false)")
    steps.add(
        new="CASE WHEN hidden THEN '\"<PASSWORD>\"' WHEN NOT ok THEN m WHEN leaf AND m <> value THEN to_json(m)::VARCHAR ELSE piece END",
        why=f"CASE WHEN hidden THEN [{K.quote(redact.FIELD_REASON)}] WHEN m <> value THEN m_r ELSE [] END",
    )
    body = (
        "event_id, string_agg(new, '' ORDER BY i) AS payload_out, "
        f"{K.joined('list_sort(list_distinct(flatten(list(why))))')} AS reasons"
    )
    return steps.select(body, "GROUP BY event_id")


@query("redact_nested", _nested_sql())
def redact_nested(spark, sf):
    out = redact.redact_nested(I.payloads(spark, sf), "payload")
    return out.select("event_id", "payload_out", F.array_join("reasons", "|").alias("reasons"))


# Findings by path: an email to keep, mask or tokenise by event type, a number, a missing path.
_PATH_ALLOW = {
    "click": {"PII:email_address": "tokenize", "PII:user_id": "tokenize"},
    "view": {"PII:email_address": "pass_through", "PII:gone": "pass_through"},
}


def _path_columns(spark, sf) -> tuple[DataFrame, DataFrame]:
    payloads = I.payloads(spark, sf)
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.lit(p).alias("path"))
            for i, (t, p) in enumerate(
                [
                    ("PII:email_address", "$.user.email"),
                    ("PII:user_id", "$.user.id"),
                    ("PII:gone", "$.user.phone"),
                    ("PII:note", "$.note"),
                ]
            )
        ]
    )
    findings = (
        payloads.select("event_id", "event_type", F.explode(listed).alias("f"))
        .select("event_id", "event_type", "f.*")
        .filter(
            "NOT (event_type = 'error' AND ord = 0) AND NOT (event_type = 'signup' AND ord = 1) "
            "AND NOT (event_type = 'purchase' AND ord >= 2)"
        )
        .drop("event_type")
    )
    cases = F.create_map(
        *[
            x
            for k, m in _PATH_ALLOW.items()
            for x in (F.lit(k), F.create_map(*[F.lit(y) for kv in m.items() for y in kv]))
        ]
    )
    allow = F.coalesce(
        F.try_element_at(cases, F.col("event_type")), F.create_map().cast("map<string,string>")
    )
    return payloads.withColumn("allow", allow), findings


def _paths_sql() -> str:
    """The four paths read from the document as it came; a number and a string differ by their type."""
    steps = K.Steps(
        f"SELECT *, CASE WHEN {_IS_DOCUMENT} THEN payload::JSON END AS doc, event_type <> 'error' AS h0, "
        f"event_type <> 'signup' AS h1, event_type <> 'purchase' AS h2, event_type <> 'purchase' AS h3 FROM ({I.PAYLOADS_SQL})"
    )
    fields = {"email": "$.user.email", "ident": "$.user.id", "note": "$.note"}
    for c, path in fields.items():
        steps.add(**{c: f"json_extract_string(doc, {K.quote(path)})", f"{c}_text": f"json_type(doc, {K.quote(path)}) = 'VARCHAR'"})
        K.mask(steps, c, f"{c}_m")
        steps.replace(**{f"{c}_m": f"CASE WHEN {c} IS NULL THEN NULL WHEN {c}_text THEN {c}_m ELSE '<REDACTED>' END"})

    def out(c: str, touched: str, kept: str, tokenised: str) -> str:
        return f"CASE WHEN NOT {touched} OR {kept} THEN {c} WHEN {tokenised} THEN {K.token(c)} ELSE {c}_m END"

    def why(label: str, c: str, touched: str, kept: str, tokenised: str) -> str:
        return (
            f"CASE WHEN NOT {touched} THEN NULL WHEN {kept} THEN 'pii.allowed:{label}' WHEN {c} IS NULL THEN NULL "
            f"WHEN {tokenised} THEN 'pii.tokenized:{label}' ELSE 'pii.redacted:{label}' END"
        )

    click, view = "event_type = 'click'", "event_type = 'view'"
    reasons = ", ".join(
        [
            why("PII:email_address", "email", "h0", view, click),
            why("PII:user_id", "ident", "h1", "false", click),
            f"CASE WHEN h2 AND {view} THEN 'pii.allowed:PII:gone' END",
            why("PII:note", "note", "h3", "false", "false"),
        ]
    )
    return steps.select(
        f"event_id, {out('email', 'h0', view, click)} AS email_out, {out('ident', 'h1', 'false', click)} AS id_out, "
        f"{out('note', 'h3', 'false', 'false')} AS note_out, "
        f"{K.joined(f'list_filter([{reasons}], lambda r: r IS NOT NULL)')} AS reasons"
    )


@query("redact_paths", _paths_sql())
def redact_paths(spark, sf):
    payloads, findings = _path_columns(spark, sf)
    out = redact.redact_paths(payloads, findings, "event_id", "payload", "allow")
    doc = F.expr("try_parse_json(payload_out)")
    return out.select(
        "event_id",
        F.try_variant_get(doc, "$.user.email", "string").alias("email_out"),
        F.try_variant_get(doc, "$.user.id", "string").alias("id_out"),
        F.get_json_object("payload_out", "$.note").alias("note_out"),
        F.array_join("reasons", "|").alias("reasons"),
    )
