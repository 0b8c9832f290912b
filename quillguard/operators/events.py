"""Decision events, detector summaries, delivery outcomes and authentication outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.sizing import broadcast_if_small
from quillguard.functions.spans import Sql, each, keep, let, lit, name
from quillguard.functions.text import NO_REASONS, hmac_sha256
from quillguard.functions.times import utc_date, utc_iso

# How an event names itself, what confidence a reason carries, delivery settings.
EVENT_TYPE = "INGEST"
EVENT_SCHEMA = "decision.v1"
CONFIDENCE = {"allowed": 0.9, "tokenized": 0.8, "redacted": 0.7}
OTHER_CONFIDENCE = 0.5
NO_FINDING_CONFIDENCE = 0.95
MAX_ATTEMPTS = 3
BACKOFF_MS = 150
NO_ENDPOINT_ERROR = "webhook_url_not_configured"
CHANNEL_SUFFIX = ":decisions"


def summarize_reasons(reasons: Sql, intended: bool = False) -> Column:
    """``struct(pii_types, confidence)`` from reason codes of three or more ``:`` parts.

    The confidence table is looked up by the second part, which for these codes is always ``PII``;
    ``intended`` looks it up by the verb in the first part instead.
    """
    parts = keep(
        each(keep(f"coalesce({reasons}, {NO_REASONS})", lambda r: f"startswith({r}, 'pii.')"), lambda r: f"split({r}, ':')"),
        lambda p: f"size({p}) >= 3",
    )
    cases = " ".join(f"WHEN {lit(verb)} THEN {score}D" for verb, score in CONFIDENCE.items())

    def score(p: Sql) -> Sql:
        verb = f"substring({p}[0], 5)" if intended else f"{p}[1]"
        return f"CASE {verb} {cases} ELSE {OTHER_CONFIDENCE}D END"

    def summary(ps: Sql) -> Sql:
        total = f"aggregate({each(ps, score)}, 0.0D, (a, x) -> a + x)"
        return (
            f"named_struct('pii_types', {each(ps, lambda p: f'{p}[2]')}, 'confidence', "
            f"CASE WHEN size({ps}) = 0 THEN {NO_FINDING_CONFIDENCE}D ELSE {total} / size({ps}) END)"
        )

    return F.expr(let(parts, summary))


def detector_summary(decisions: DataFrame, reasons_col: str = "reasons", intended: bool = False) -> DataFrame:
    return (
        decisions.withColumn("_s", summarize_reasons(name(reasons_col), intended))
        .withColumns({"pii_types": F.col("_s.pii_types"), "confidence": F.col("_s.confidence")})
        .drop("_s")
    )


def correlation_id(corr: Column, row_key: Column) -> Column:
    """The given id, else one derived from the row key, so that a rerun names the row alike."""
    made = F.concat(F.lit("corr-"), F.substring(F.sha2(row_key, 256), 1, 24))
    return F.when(F.coalesce(corr, F.lit("")) != "", corr).otherwise(made)


def decision_events(
    decisions: DataFrame,
    org_id: str | None = None,
    channel: str | None = None,
    api_key_col: str | None = None,
    row_key: str = "request_id",
) -> DataFrame:
    """One event struct per decision in column ``event``, beside its ``event_date`` and key."""
    cols = decisions.columns
    corr = correlation_id(
        F.col("corr_id") if "corr_id" in cols else F.lit(None).cast("string"), F.col(row_key)
    )
    no_list = F.array().cast("array<string>")
    explicit_none = F.startswith(F.col("rule_id"), F.lit("net-redact"))
    reasons = F.when(F.col("reasons").isNull() & ~explicit_none, no_list).otherwise(F.col("reasons"))
    api_key = F.col(api_key_col) if api_key_col else F.lit(None).cast("string")
    summary = summarize_reasons("reasons")
    df = decisions.withColumns({"_corr": corr, "_reasons": reasons, "_s": summary})
    event = F.struct(
        F.lit(EVENT_TYPE).alias("type"),
        F.lit(channel).cast("string").alias("channel"),
        F.lit(EVENT_SCHEMA).alias("schema"),
        F.concat_ws("-", F.col("pass"), F.col("ts").cast("string"), F.col("_corr")).alias("idempotencyKey"),
        F.struct(
            F.lit(org_id).cast("string").alias("orgId"),
            F.col("pass").alias("direction"),
            F.col("decision"),
            F.col("tool"),
            F.col("scope"),
            F.col("raw_text").alias("rawText"),
            F.coalesce(F.col("raw_text_out"), F.lit("")).alias("rawTextOut"),
            F.col("_reasons").alias("reasons"),
            F.struct(
                F.col("_reasons").alias("reasons"),
                F.col("_s.confidence").alias("confidence"),
                F.col("_s.pii_types").alias("piiDetected"),
            ).alias("detectorSummary"),
            F.concat(F.lit("sha256:"), F.sha2(F.col("raw_text"), 256)).alias("payloadHash"),
            (F.col("latency_ms") if "latency_ms" in cols else F.lit(0)).cast("bigint").alias("latencyMs"),
            F.col("_corr").alias("correlationId"),
            no_list.alias("tags"),
            utc_iso(F.col("ts")).alias("ts"),
            F.struct(
                F.col("user_id").alias("userId"),
                F.when(F.coalesce(api_key, F.lit("")) != "", F.substring(F.sha2(api_key, 256), 1, 16)).alias(
                    "apiKeyId"
                ),
            ).alias("authentication"),
        ).alias("data"),
    )
    return df.select(
        F.col(row_key),
        utc_date(F.col("ts")).alias("event_date"),
        event.alias("event"),
    )


def dedupe_events(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``. The minimum is taken map-side first, so a key with
    very many copies ships one row per task."""
    rest = [c for c in events.columns if c not in (*keys, *order)]
    first = events.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*keys, "_f.*").select(*events.columns)


def endpoint_config(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Organisation, first ``:decisions`` channel and key named in an endpoint URL's query."""
    query = F.regexp_extract(F.col(url_col), r"^[^?#]*\?([^#]*)", 1)

    def parameter(name: str) -> Column:
        raw = F.regexp_extract(query, f"(?:^|&){name}=([^&]+)", 1)
        return F.when(raw != "", F.try_url_decode(raw))

    channels = F.transform(F.split(parameter("channels"), ","), lambda c: F.trim(c))
    return urls.withColumns(
        {
            "org_id": parameter("org"),
            "channel": F.get(F.filter(channels, lambda c: c.endswith(CHANNEL_SUFFIX)), F.lit(0)),
            "api_key": parameter("key"),
        }
    )


def error_class(error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) == "", "unknown").otherwise(
        F.substring_index(error, ":", 1)
    )


def delivery_outcomes(
    events: DataFrame, attempts: DataFrame, key: str = "event_id", max_attempts: int = MAX_ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """Outcome per event, and the failed events as dead letters.

    ``attempts`` has ``(key, attempt, error)``, a null error meaning success. Attempts after the
    retry limit or after a success do not count. ``backoff_ms`` is the waiting time between the
    attempts used; it doubles each time. An event never tried had no endpoint.
    """
    tried = attempts.filter(F.col("attempt") <= max_attempts).groupBy(key).agg(
        F.min(F.when(F.col("error").isNull(), F.col("attempt"))).alias("_won"),
        F.max("attempt").alias("_last"),
        F.max_by("error", "attempt").alias("_error"),
    )
    used = F.coalesce(F.col("_won"), F.col("_last"), F.lit(0))
    failed = F.col("_won").isNull()
    error = F.when(failed, F.when(F.col("_last").isNull(), NO_ENDPOINT_ERROR).otherwise(F.col("_error")))
    outcomes = (
        events.join(tried, key, "left")
        .withColumns(
            {
                "status": F.when(failed, "failed").otherwise("success"),
                "attempts_used": used,
                "backoff_ms": F.when(used > 1, (F.pow(F.lit(2.0), used - 1) - 1) * BACKOFF_MS)
                .otherwise(F.lit(0))
                .cast("bigint"),
                "err": error,
            }
        )
        .withColumn("error_type", F.when(F.col("status") == "failed", error_class(F.col("err"))))
        .drop("_won", "_last", "_error")
    )
    return outcomes, outcomes.filter(F.col("status") == "failed")


def auth_outcomes(
    log: DataFrame,
    api_keys: DataFrame,
    secret: str,
    key_col: str = "api_key",
    ts_col: str = "ts",
) -> DataFrame:
    """Add ``auth_result``: missing_api_key, invalid_api_key, expired_api_key or ok. The registry
    holds HMACs of the keys, never the keys."""
    registry = broadcast_if_small(
        api_keys.select(F.col("key_hash").alias("_hash"), "is_active", "expires_at")
    )
    given = F.coalesce(F.col(key_col), F.lit("")) != ""
    hashed = log.withColumn("key_hash", F.when(given, hmac_sha256(secret, F.col(key_col))))
    result = (
        F.when(~given, "missing_api_key")
        .when(F.col("_hash").isNull() | ~F.coalesce(F.col("is_active"), F.lit(False)), "invalid_api_key")
        .when(F.col("expires_at") < F.col(ts_col), "expired_api_key")
        .otherwise("ok")
    )
    # rows without a key find nothing; they are spread by their time, not sent to one task
    on = F.coalesce("key_hash", F.concat(F.lit("none:"), F.xxhash64(ts_col).cast("string")))
    return (
        hashed.join(registry, on == F.col("_hash"), "left")
        .withColumn("auth_result", result)
        .drop("_hash", "is_active", "expires_at")
    )
