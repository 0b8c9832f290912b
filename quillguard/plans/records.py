"""Queries over intake, events, deliveries, audit records and outcome counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.functions.lineage import shared_dir
from quillguard.operators import analytics, events
from quillguard.plans import inputs as I
from quillguard.plans import sqlkit as K
from quillguard.plans.catalog import ORACLES, query
from quillguard.plans.decisions import pass_steps, passes
from quillguard.sources import intake, sinks

# ----------------------------------------------------------------------------------------- intake
_BUCKET = "(conv_id + turn) % 10"


@query(
    "request_intake_accepted",
    f"SELECT conv_id, turn, concat('t', conv_id % 9) AS tool, concat('turn ', turn, ' ', coalesce(text, '')) AS raw_text, "
    f"CASE WHEN {_BUCKET} >= 7 THEN concat('u', conv_id % 50) END AS user_id, "
    f"CASE WHEN {_BUCKET} = 4 THEN 12.5::DOUBLE END AS monthly_limit FROM conversations "
    f"WHERE {_BUCKET} IN (4, 7, 8, 9)",
)
def request_intake_accepted(spark, sf):
    accepted, _ = intake.request_intake(I.raw_records(spark, sf))
    return accepted.select(
        "conv_id", "turn", "tool", "raw_text", "user_id", F.col("budget_context.monthly_limit").alias("monthly_limit")
    )


@query(
    "request_intake_rejected",
    f"SELECT conv_id, turn, CASE {_BUCKET} WHEN 0 THEN 'body.tool:missing' WHEN 1 THEN 'body.tool:string_type' "
    "WHEN 2 THEN 'body:json_invalid' WHEN 3 THEN 'body.budget_context.monthly_limit:float_parsing' "
    "WHEN 5 THEN 'body.tags:list_type|body.user_id:string_type' ELSE 'body:model_attributes_type' END AS errors "
    f"FROM conversations WHERE {_BUCKET} IN (0, 1, 2, 3, 5, 6)",
)
def request_intake_rejected(spark, sf):
    _, rejected = intake.request_intake(I.raw_records(spark, sf))
    listed = F.transform("errors", lambda e: F.concat_ws(":", e["loc"], e["kind"]))
    return rejected.select("conv_id", "turn", F.array_join(listed, "|").alias("errors"))


@query(
    "request_error_counts",
    f"SELECT e.loc AS loc, e.kind AS kind, count(*) AS n FROM (SELECT unnest(CASE {_BUCKET} "
    "WHEN 0 THEN [{'loc': 'body.tool', 'kind': 'missing'}] WHEN 1 THEN [{'loc': 'body.tool', 'kind': 'string_type'}] "
    "WHEN 2 THEN [{'loc': 'body', 'kind': 'json_invalid'}] "
    "WHEN 3 THEN [{'loc': 'body.budget_context.monthly_limit', 'kind': 'float_parsing'}] "
    "WHEN 5 THEN [{'loc': 'body.tags', 'kind': 'list_type'}, {'loc': 'body.user_id', 'kind': 'string_type'}] "
    "WHEN 6 THEN [{'loc': 'body', 'kind': 'model_attributes_type'}] END) AS e "
    "FROM conversations) GROUP BY ALL",
)
def request_error_counts(spark, sf):
    _, rejected = intake.request_intake(I.raw_records(spark, sf))
    errors = rejected.select(F.explode_outer("errors").alias("e")).select("e.loc", "e.kind")
    return analytics.outcome_counts(errors, ["loc", "kind"])


# ----------------------------------------------------------------------------------------- events
ORG, CHANNEL = "org7", "org7:decisions"
_CORR = "coalesce(corr_id, 'corr-' || sha256(request_id)[1:24])"
_REASONS = "CASE WHEN reasons IS NULL AND rule_id <> 'net-redact-regex' THEN []::VARCHAR[] ELSE reasons END"
_PARTS = "list_filter(coalesce(reasons, []), lambda r: starts_with(r, 'pii.') AND len(string_split(r, ':')) >= 3)"
_ISO = "strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def decision_events_df(spark: SparkSession, sf: str) -> DataFrame:
    decided = passes(spark, sf).withColumn("api_key", F.expr("case when ts % 3 <> 0 then concat('key-', user_id) end"))
    return events.decision_events(decided, ORG, CHANNEL, "api_key")


@query(
    "decision_events",
    pass_steps().select(
        f"request_id, make_timestamp(ts * 1000000)::DATE AS event_date, 'INGEST' AS type, '{CHANNEL}' AS channel, "
        f"'decision.v1' AS schema, concat(pass, '-', ts, '-', {_CORR}) AS idempotency_key, '{ORG}' AS org_id, "
        "pass AS direction, decision, tool, scope, raw_text, coalesce(raw_text_out, '') AS raw_text_out, "
        f"{K.joined(f'({_REASONS})')} AS reasons, 'sha256:' || sha256(raw_text) AS payload_hash, "
        f"{_CORR} AS correlation_id, {_ISO} AS ts, user_id, CASE WHEN ts % 3 <> 0 THEN "
        f"sha256(concat('key-', user_id))[1:16] END AS api_key_id, "
        f"CASE WHEN len({_PARTS}) = 0 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence, "
        f"array_to_string(list_transform({_PARTS}, lambda r: string_split(r, ':')[3]), '|') AS pii_types"
    ),
)
def decision_events(spark, sf):
    e = decision_events_df(spark, sf)
    data = "event.data."
    return e.select(
        "request_id",
        "event_date",
        "event.type",
        "event.channel",
        "event.schema",
        F.col("event.idempotencyKey").alias("idempotency_key"),
        F.col(f"{data}orgId").alias("org_id"),
        f"{data}direction",
        f"{data}decision",
        f"{data}tool",
        f"{data}scope",
        F.col(f"{data}rawText").alias("raw_text"),
        F.col(f"{data}rawTextOut").alias("raw_text_out"),
        F.array_join(f"{data}reasons", "|").alias("reasons"),
        F.col(f"{data}payloadHash").alias("payload_hash"),
        F.col(f"{data}correlationId").alias("correlation_id"),
        f"{data}ts",
        F.col(f"{data}authentication.userId").alias("user_id"),
        F.col(f"{data}authentication.apiKeyId").alias("api_key_id"),
        F.col(f"{data}detectorSummary.confidence").alias("confidence"),
        F.array_join(f"{data}detectorSummary.piiDetected", "|").alias("pii_types"),
    )


@query(
    "event_json_fields",
    pass_steps().select(
        f"concat(pass, '-', ts, '-', {_CORR}) AS idempotency_key, '{CHANNEL}' AS channel, '0' AS latency_ms, "
        f"'[]' AS tags, decision, 'sha256:' || sha256(raw_text) AS payload_hash"
    ),
)
def event_json_fields(spark, sf):
    """Fields read back from the serialised events, as a sink would write them."""
    return _event_fields(
        decision_events_df(spark, sf).select(F.to_json("event", {"ignoreNullFields": "false"}).alias("value"))
    )


def _event_fields(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.get_json_object("value", "$.idempotencyKey").alias("idempotency_key"),
        F.get_json_object("value", "$.channel").alias("channel"),
        F.get_json_object("value", "$.data.latencyMs").alias("latency_ms"),
        F.get_json_object("value", "$.data.tags").alias("tags"),
        F.get_json_object("value", "$.data.decision").alias("decision"),
        F.get_json_object("value", "$.data.payloadHash").alias("payload_hash"),
    )


_REASON_SETS = (
    ("pii.redacted:email", "net"),
    ("pii.allowed:PII:email_address", "pii.tokenized:PII:us_ssn"),
    ("pii.tokenized:allowed:x", "pii.redacted:tokenized:y:z", "pii.x:other:w"),
    (),
)


def _reason_expr(d: I.Dialect) -> str:
    if d.name == "spark":
        sets = [
            "array(" + ", ".join(f"'{r}'" for r in s) + ")" if s else "cast(array() as array<string>)"
            for s in _REASON_SETS
        ]
    else:
        sets = ["[" + ", ".join(f"'{r}'" for r in s) + "]::VARCHAR[]" for s in _REASON_SETS]
    return d.pick(sets, f"event_id % {len(_REASON_SETS)}")


def _summary_sql(source: str, key: str) -> str:
    steps = K.Steps(source)
    steps.add(parts=f"list_transform({_PARTS}, lambda r: string_split(r, ':'))")
    score = "CASE p[2] WHEN 'allowed' THEN 0.9::DOUBLE WHEN 'tokenized' THEN 0.8::DOUBLE WHEN 'redacted' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END"
    fold = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(parts, lambda p: {score})), lambda a, x: a + x)"
    return steps.select(
        f"{key}, array_to_string(list_transform(parts, lambda p: p[3]), '|') AS pii_types, "
        f"CASE WHEN len(parts) = 0 THEN 0.95::DOUBLE ELSE {fold} / len(parts) END AS confidence"
    )


@query("detector_summary", _summary_sql(f"SELECT event_id, {_reason_expr(I.DUCK)} AS reasons FROM events", "event_id"))
def detector_summary(spark, sf):
    coded = I.table(spark, sf, "events").select("event_id", F.expr(_reason_expr(I.SPARK)).alias("reasons"))
    out = events.detector_summary(coded)
    return out.select("event_id", F.array_join("pii_types", "|").alias("pii_types"), "confidence")


@query("detector_summary_passes", _summary_sql(pass_steps().select("request_id, pass, reasons"), "request_id, pass"))
def detector_summary_passes(spark, sf):
    """Of the reasons that both passes give for every request."""
    out = events.detector_summary(passes(spark, sf))
    return out.select("request_id", "pass", F.array_join("pii_types", "|").alias("pii_types"), "confidence")


@query(
    "dedupe_events",
    "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, "
    "arg_min(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type",
)
def dedupe_events(spark, sf):
    log = I.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return events.dedupe_events(log, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "dedupe_by_payload",
    "SELECT payload_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM "
    "(SELECT sha256(text) AS payload_hash, doc_id, source FROM documents) GROUP BY 1",
)
def dedupe_by_payload(spark, sf):
    hashed = I.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("payload_hash"), "doc_id", "source"
    )
    return events.dedupe_events(hashed, ["payload_hash"], ["doc_id"])


_CHANNELS = "string_split(replace(regexp_extract(q, '(?:^|&)channels=([^&]+)', 1), '%20', ' '), ',')"


@query(
    "endpoint_config",
    f"WITH u AS ({I.ENDPOINTS_SQL}), p AS (SELECT *, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM u) "
    "SELECT page_id, nullif(regexp_extract(q, '(?:^|&)org=([^&]+)', 1), '') AS org_id, "
    "nullif(replace(regexp_extract(q, '(?:^|&)key=([^&]+)', 1), '%2B', '+'), '') AS api_key, "
    f"list_filter(list_transform({_CHANNELS}, lambda c: trim(c)), lambda c: ends_with(c, ':decisions'))[1] AS channel "
    "FROM p",
)
def endpoint_config(spark, sf):
    return events.endpoint_config(I.endpoints(spark, sf)).select("page_id", "org_id", "api_key", "channel")


_OUTCOMES_SQL = f"""WITH a AS ({I.ATTEMPTS_SQL}), t AS (SELECT event_id, min(attempt) FILTER (error IS NULL) AS won,
  max(attempt) AS last, arg_max(coalesce(error, '?'), attempt) AS err FROM a WHERE attempt <= 3 GROUP BY event_id),
o AS (SELECT e.event_id, e.ts, e.event_type, CASE WHEN won IS NULL THEN 'failed' ELSE 'success' END AS status,
  coalesce(won, last, 0) AS attempts_used, CASE WHEN won IS NULL THEN CASE WHEN last IS NULL
  THEN 'webhook_url_not_configured' ELSE t.err END END AS err FROM events e LEFT JOIN t USING (event_id)),
outcomes AS (SELECT *, CASE WHEN attempts_used > 1 THEN (2 ** (attempts_used - 1) - 1) * 150 ELSE 0 END::BIGINT
  AS backoff_ms, CASE WHEN status = 'failed' THEN CASE WHEN err = '' THEN 'unknown' ELSE split_part(err, ':', 1) END
  END AS error_type FROM o)"""


def _outcomes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sent = I.table(spark, sf, "events").select("event_id", "ts", "event_type", "user_id")
    return events.delivery_outcomes(sent, I.attempts(spark, sf))


@query(
    "delivery_outcomes",
    f"{_OUTCOMES_SQL} SELECT event_id, status, attempts_used::BIGINT AS attempts_used, backoff_ms, err, error_type "
    "FROM outcomes",
)
def delivery_outcomes(spark, sf):
    outcomes, _ = _outcomes(spark, sf)
    return outcomes.select("event_id", "status", "attempts_used", "backoff_ms", "err", "error_type")


@query(
    "dead_letters",
    f"{_OUTCOMES_SQL} SELECT o.event_id, o.err, '{{\"err\":\"' || o.err || '\",\"event\":{{\"event_id\":' || o.event_id "
    "|| ',\"type\":\"' || o.event_type || '\"}}' AS value FROM outcomes o WHERE status = 'failed'",
)
def dead_letters(spark, sf):
    _, failed = _outcomes(spark, sf)
    with_event = failed.withColumn("event", F.struct("event_id", F.col("event_type").alias("type")))
    lines = sinks.dead_letter_lines(with_event)
    return lines.select(
        F.get_json_object("value", "$.event.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("value", "$.err").alias("err"),
        "value",
    )


_AUTH_SQL = f"""WITH l AS ({I.KEYED_LOG_SQL}), k AS ({I.API_KEYS_SQL})
SELECT l.id, CASE WHEN coalesce(l.api_key, '') = '' THEN 'missing_api_key' WHEN k.raw_key IS NULL OR NOT k.is_active
  THEN 'invalid_api_key' WHEN k.expires_at < l.ts THEN 'expired_api_key' ELSE 'ok' END AS auth_result
FROM l LEFT JOIN k ON l.api_key = k.raw_key"""


@query("auth_outcomes", _AUTH_SQL)
def auth_outcomes(spark, sf):
    out = events.auth_outcomes(I.keyed_log(spark, sf), I.api_keys(spark, sf), I.KEY_SECRET)
    return out.select("id", "auth_result")


def _hmac_sql(message: str) -> str:
    raw = I.KEY_SECRET.encode().ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in raw).hex()
    outer = bytes(b ^ 0x5C for b in raw).hex()
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


@query(
    "api_key_registry",
    f"SELECT {_hmac_sql('raw_key')} AS key_hash, raw_key[1:8] AS key_prefix, is_active, expires_at "
    f"FROM ({I.API_KEYS_SQL})",
)
def api_key_registry(spark, sf):
    return I.api_keys(spark, sf)


# ---------------------------------------------------------------------------------- audit, usage
@query(
    "audit_records",
    pass_steps().select(
        "ts::BIGINT AS t, pass AS event, user_id, tool, decision, corr_id, rule_id AS policy_id, "
        f"{K.joined(f'({_REASONS})')} AS reasons"
    ),
)
def audit_records(spark, sf):
    out = sinks.audit_records(passes(spark, sf))
    return out.withColumn("reasons", F.array_join("reasons", "|"))


@query(
    "audit_lines",
    pass_steps().select(
        "'{\"t\":' || ts || ',\"event\":\"' || pass || '\",\"user_id\":\"' || user_id || '\",\"tool\":\"' || tool || "
        "'\",\"decision\":\"' || decision || '\",\"corr_id\":' || coalesce('\"' || corr_id || '\"', 'null') || "
        f"',\"policy_id\":\"' || rule_id || '\",\"reasons\":' || CASE WHEN ({_REASONS}) IS NULL THEN 'null' "
        f"WHEN len({_REASONS}) = 0 THEN '[]' ELSE '[\"' || array_to_string(({_REASONS}), '\",\"') || '\"]' END || '}}' "
        "AS value"
    ),
)
def audit_lines(spark, sf):
    return sinks.audit_lines(passes(spark, sf))


@query(
    "usage_events",
    pass_steps().select(
        "user_id, tool, scope, decision, rule_id AS policy_id, make_timestamp(ts * 1000000) AS created_at, "
        "sha256(raw_text) AS payload_hash"
    ),
)
def usage_events(spark, sf):
    return sinks.usage_events(passes(spark, sf))


# ------------------------------------------------------------------------ written and read back
def _written_twice(spark: SparkSession, write: Callable[[str, str], None]) -> str:
    """Folder that ``write(folder, run)`` filled; its run was written again, as after a failure."""
    folder = f"{shared_dir(spark)}/sinks/{uuid.uuid4().hex}"
    for _ in range(2):
        write(folder, "1")
    return folder


@query("write_decision_events", ORACLES["event_json_fields"])
def write_decision_events(spark, sf):
    made = decision_events_df(spark, sf)
    folder = _written_twice(spark, lambda path, run: sinks.write_decision_events(made, path, run=run))
    return _event_fields(spark.read.text(folder).select("value"))


@query("write_dead_letters", ORACLES["dead_letters"])
def write_dead_letters(spark, sf):
    failed = _outcomes(spark, sf)[1].withColumn("event", F.struct("event_id", F.col("event_type").alias("type")))
    folder = _written_twice(spark, lambda path, run: sinks.write_dead_letters(failed, path, run=run))
    lines = spark.read.text(folder)
    return lines.select(
        F.get_json_object("value", "$.event.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("value", "$.err").alias("err"),
        "value",
    )


@query("write_audit_trail", ORACLES["audit_lines"])
def write_audit_trail(spark, sf):
    made = passes(spark, sf)
    folder = _written_twice(spark, lambda path, run: sinks.write_audit_trail(made, path, run=run))
    return spark.read.text(folder).select("value")


@query("write_usage", ORACLES["usage_events"])
def write_usage(spark, sf):
    made = passes(spark, sf)
    folder = _written_twice(spark, lambda path, run: sinks.write_usage(made, path, run=run))
    schema = sinks.usage_events(made).schema
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


# -------------------------------------------------------------------------------------- histograms
_BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def _histogram_sql(bounds: tuple[float, ...], value: str, label: str, source: str) -> str:
    cases = ", ".join(f"{b!r}::DOUBLE" for b in bounds)
    return (
        f"WITH s AS (SELECT {label}, {value} AS v FROM {source}), g AS (SELECT {label}, "
        f"sum(v::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS total, count(v) AS n FROM s GROUP BY 1), "
        f"b AS (SELECT unnest([{cases}, NULL]) AS le), "
        f"c AS (SELECT {label}, le, count(*) FILTER (v <= le) AS k FROM s, b WHERE le IS NOT NULL GROUP BY ALL) "
        f"SELECT g.{label}, b.le, CASE WHEN b.le IS NULL THEN n ELSE coalesce(k, 0) END AS cum_count, total, n "
        f"FROM g CROSS JOIN b LEFT JOIN c ON c.{label} = g.{label} AND c.le = b.le"
    )


@query("latency_histogram", _histogram_sql(_BOUNDS, "value", "event_type", "events"))
def latency_histogram(spark, sf):
    return analytics.latency_histogram(I.table(spark, sf, "events"), "value", ["event_type"], _BOUNDS)


@query(
    "latency_histogram_seconds",
    _histogram_sql(
        analytics.DURATION_BOUNDS, "value / 10.0::DOUBLE", "user_id", "events"
    ),
)
def latency_histogram_seconds(spark, sf):
    timed = I.table(spark, sf, "events").withColumn("seconds", F.col("value") / F.lit(10.0))
    return analytics.latency_histogram(timed, "seconds", ["user_id"])


@query(
    "delivery_counts",
    f"{_OUTCOMES_SQL} SELECT event_type, status, count(*) AS n FROM outcomes GROUP BY ALL",
)
def delivery_counts(spark, sf):
    return analytics.outcome_counts(_outcomes(spark, sf)[0], ["event_type", "status"])


@query(
    "dead_letter_counts",
    f"{_OUTCOMES_SQL} SELECT error_type, count(*) AS n FROM outcomes WHERE status = 'failed' GROUP BY ALL",
)
def dead_letter_counts(spark, sf):
    return analytics.outcome_counts(_outcomes(spark, sf)[1], ["error_type"])


@query(
    "auth_failure_counts",
    f"SELECT auth_result, count(*) AS n FROM ({_AUTH_SQL}) WHERE auth_result <> 'ok' GROUP BY ALL",
)
def auth_failure_counts(spark, sf):
    out = events.auth_outcomes(I.keyed_log(spark, sf), I.api_keys(spark, sf), I.KEY_SECRET)
    return analytics.outcome_counts(out.filter("auth_result <> 'ok'"), ["auth_result"])


@query(
    "dead_letter_backlog",
    f"{_OUTCOMES_SQL} SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS backlog FROM (SELECT ts::DATE AS day, "
    "count(*) AS n FROM outcomes WHERE status = 'failed' GROUP BY ALL)",
)
def dead_letter_backlog(spark, sf):
    return analytics.dead_letter_backlog(_outcomes(spark, sf)[1])
