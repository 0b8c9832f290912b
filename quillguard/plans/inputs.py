"""Input views over the given tables, each as a DataFrame and as the same view in SQL.

Column expressions are written once; ``Dialect`` renders the few spellings that differ.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions.sizing import pieces

TOOLS = (
    "python.exec",
    "bash.exec",
    "book_courier",
    "send_report",
    "print_label",
    "open_ticket",
    "web.fetch",
    "http.post",
    "model.chat",
    "mcp.weather.current",
    "file.read",
    "payments.charge",
)
SUFFIXES = (
    "",
    " write to nadia.orr@mill-lane.test by noon",
    " ring 415-555-0132 after six",
    " paid by 4111111111111111 at the till",
    " ward list MRN: K7654321 admitted",
    " policy ID: QT-40718-C with Member Number 9081726354",
    " referred by NPI: 1982736450",
    " signed DEA Number: BK7654321",
    " born DOB: 11/23/1975",
    " cvv: 417 exp: 08/31",
    " her ssn 321-54-9876 or 318099888",
    " password: quince77 pwd=$250",
    " sum $31.75 or 26 dollars",
    " sk_QRSTUVWXYZABCDEF5678 eyJ0eXAiOi.eyJuYW1lIn0.d3Jl",
)
# One rule for each direction and kind of action, and types that are allowed or replaced.
STATIC_POLICY = {
    "version": "v1",
    "defaults": {"ingress": {"action": "redact"}, "egress": {"action": "redact"}},
    "tool_access": {
        "book_courier": {
            "direction": "ingress",
            "allow_pii": {"PII:phone_number": "pass_through", "PII:email_address": "tokenize"},
        },
        "open_ticket": {"direction": "ingress", "allow_pii": {"PII:us_ssn": "pass_through"}},
        "print_label": {"direction": "egress", "allow_pii": {"PII:phone_number": "tokenize"}},
        "send_report": {
            "direction": "egress",
            "allow_pii": {"PII:us_ssn": "tokenize", "PII:email_address": "pass_through"},
        },
    },
}
STATIC_POLICY_JSON = json.dumps(STATIC_POLICY, separators=(",", ":"))

# One of these documents per supplier: every branch of the rule chain is met.
POLICY_DOCS = (
    {
        "version": "v2",
        "tool_access": {
            "weather.current": {
                "direction": "both",
                "action": "confirm",
                "allow_pii": {"PII:email_address": "pass_through", "PII:us_ssn": "tokenize"},
            },
            "model.chat": {
                "direction": "ingress",
                "allow_pii": {"PII:phone_number": "tokenize", "PII:email_address": "pass_through"},
            },
            "chat": {"direction": "egress", "action": "tokenize", "allow_pii": {}},
            "charge": {"direction": "both", "action": "confirm", "allow_pii": {}},
        },
        "defaults": {"ingress": {"action": "redact"}, "egress": {"action": "pass_through"}},
        "model": "gpt-4-turbo",
    },
    {
        "tool_access": {
            "file.read": {
                "direction": "both",
                "action": "deny",
                "allow_pii": {"PII:email_address": "block"},
            },
            "payments.charge": {"direction": "both", "allow_pii": {"PII:pci_cvv": "mystery"}},
        },
        "defaults": {"ingress": {"action": "deny"}, "egress": {"action": "tokenize"}},
        "on_error": "pass",
    },
    {
        "deny_tools": ["web.fetch"],
        "tool_access": {
            "print_label": {
                "direction": "egress",
                "allow_pii": {"PII:phone_number": "block", "PII:us_dea": "pass_through"},
            },
            "payments.charge": {"direction": "both", "allow_pii": {}},
            "post": {"direction": "both", "allow_pii": {"PII:us_ssn": "tokenize"}},
        },
        "tool": "web.gateway",
    },
    {"tool_access": "broken", "on_error": "best_effort"},
    {"tool_access": "broken", "on_error": "pass"},
    STATIC_POLICY,
    {},
    {
        "defaults": {"ingress": {}},
        "tool_access": {
            "read": {"direction": "both", "allow_pii": {}},
            "payments.charge": {"direction": "ingress", "action": "tokenize", "allow_pii": {}},
        },
        "model": "unknown-model",
    },
)
FILE_DOC = 5  # position of the document in file form


@dataclass(frozen=True)
class Dialect:
    name: str

    def pick(self, values: Sequence[str], index: str) -> str:
        """Element ``index`` (from 0) of a list of literal expressions."""
        joined = ", ".join(values)
        if self.name == "spark":
            return f"array({joined})[cast({index} as int)]"
        return f"([{joined}])[({index}) + 1]"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def json_string(self, value: str) -> str:
        """JSON literal of a string column."""
        return f"to_json(cast({value} as variant))" if self.name == "spark" else f"to_json({value})::VARCHAR"

    def texts(self, values: Sequence[str]) -> list[str]:
        return [self.text(v) for v in values]

    def map(self, pairs: dict[str, str]) -> str:
        if self.name == "spark":
            body = ", ".join(f"'{k}', '{v}'" for k, v in pairs.items())
            return f"map({body})" if pairs else "cast(map() as map<string,string>)"
        body = ", ".join(f"'{k}': '{v}'" for k, v in pairs.items())
        return f"MAP {{{body}}}::MAP(VARCHAR, VARCHAR)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")

_METADATA = (
    {"amount": "25"},
    {"purchase_amount": "abc", "price": "12.5"},
    {},
    {"model": "claude-3-opus", "cost": "1e1"},
    {"amount": "0.5"},
)


def request_columns(d: Dialect) -> dict[str, str]:
    return {
        "request_id": "concat('c', conv_id, '-', turn)",
        "direction": "case when role = 'assistant' then 'egress' else 'ingress' end",
        "tool": d.pick(d.texts(TOOLS), "(conv_id * 7 + turn) % 12"),
        "scope": "case conv_id % 3 when 0 then 'net.external' when 1 then 'local' end",
        "user_id": "concat('u', conv_id % 50)",
        "ts": "1704067200 + conv_id * 60 + turn",
        "raw_text": f"concat(text, {d.pick(d.texts(SUFFIXES), '(conv_id + turn) % 14')})",
        "policy_key": "case when conv_id % 4 <> 3 then concat('p', conv_id % 100) end",
        "corr_id": "case when turn % 2 = 0 then concat('k', conv_id) end",
        "metadata": d.pick([d.map(m) for m in _METADATA], "(conv_id + 3 * turn) % 5"),
        "has_tool": "(conv_id + turn) % 4 <> 1",
        "has_budget": "(conv_id + turn) % 6 <> 5",
        "monthly_limit": "cast(" + d.pick(["0", "5", "20", "30"], "(conv_id + turn) % 4") + " as double)",
        "llm_spend": "cast(conv_id % 7 as double)",
        "purchase_spend": "cast(turn % 5 as double) * cast(2.5 as double)",
    }


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


REQUESTS_SQL = _select(request_columns(DUCK), "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_frame(table(spark, sf_dir, "conversations"))


def request_frame(conversations: DataFrame) -> DataFrame:
    """Chat turns as tool requests with a policy key, tool metadata and a budget context."""
    columns = [F.expr(e).alias(n) for n, e in request_columns(SPARK).items()]
    df = conversations.select(*columns)
    current = F.col("llm_spend") + F.col("purchase_spend")
    tool_config = F.struct(
        F.col("tool").alias("tool_name"), F.col("scope"), F.col("direction"), F.col("metadata")
    ).cast(S.TOOL_CONFIG_DDL)
    context = F.struct(
        F.col("monthly_limit"),
        current.alias("current_spend"),
        F.col("llm_spend"),
        F.col("purchase_spend"),
        (F.col("monthly_limit") - current).alias("remaining_budget"),
        F.lit("user").alias("budget_type"),
    ).cast(S.BUDGET_CONTEXT_DDL)
    return df.withColumns(
        {
            "tool_config": F.when(F.col("has_tool"), tool_config),
            "budget_context": F.when(F.col("has_budget"), context),
        }
    ).drop("has_tool", "has_budget", "monthly_limit", "llm_spend", "purchase_spend", "metadata")


def document_request_columns() -> dict[str, str]:
    return {
        "request_id": "concat('d', doc_id)",
        "direction": "case when doc_id % 3 = 0 then 'egress' else 'ingress' end",
        "tool": "case when doc_id % 5 = 0 then 'web.fetch' else 'model.chat' end",
        "scope": "source",
        "user_id": "concat('u', doc_id % 50)",
        "ts": "1704067200 + doc_id",
        "raw_text": "text",
    }


DOCUMENT_REQUESTS_SQL = _select(document_request_columns(), "documents")


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.expr(e).alias(n) for n, e in document_request_columns().items()]
    return table(spark, sf_dir, "documents").select(*columns)


def policy_columns(d: Dialect) -> dict[str, str]:
    docs = [json.dumps(doc, separators=(",", ":")) for doc in POLICY_DOCS]
    return {
        "policy_key": "concat('p', s_suppkey)",
        "doc": d.pick(d.texts(docs), f"s_suppkey % {len(docs)}"),
        "form": f"case when s_suppkey % {len(docs)} = {FILE_DOC} then 'file' else 'payload' end",
    }


POLICIES_SQL = _select(policy_columns(DUCK), "supplier")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy document per supplier."""
    columns = [F.expr(e).alias(n) for n, e in policy_columns(SPARK).items()]
    return table(spark, sf_dir, "supplier").select(*columns)


def version_columns(d: Dialect) -> dict[str, str]:
    return {
        "policy_key": "concat('p', s_suppkey)",
        "version_id": "concat('p', s_suppkey, '@', k)",
        "valid_from": "1704067200 + s_suppkey * 30 + k * 600",
    }


VERSIONS_SQL = _select(version_columns(DUCK), "(SELECT s_suppkey, unnest([0, 1, 2]) AS k FROM supplier)")


def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of each supplier's policy, valid from different times."""
    base = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    )
    return base.select(*[F.expr(e).alias(n) for n, e in version_columns(SPARK).items()])


REQUEST_LOG_SQL = "SELECT event_id AS id, ts, concat('u', user_id) AS key, event_type AS endpoint FROM events"


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.concat(F.lit("u"), F.col("user_id")).alias("key"),
        F.col("event_type").alias("endpoint"),
    )


SPEND_SQL = """SELECT event_id AS id, user_id,
  CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'llm' END AS transaction_type,
  CASE WHEN event_type = 'purchase' THEN value ELSE value * 0.01::DOUBLE END AS amount, ts AS created_at
  FROM events"""


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and model charges taken from the event stream."""
    is_purchase = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(is_purchase, "purchase").otherwise("llm").alias("transaction_type"),
        F.when(is_purchase, F.col("value")).otherwise(F.col("value") * F.lit(0.01)).alias("amount"),
        F.col("ts").alias("created_at"),
    )


LEDGER_SQL = """SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'purchase' ELSE 'llm' END AS transaction_type,
  o_totalprice AS amount, o_orderdate AS created_at FROM orders"""


def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger rows over many months."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "purchase").otherwise("llm").alias("transaction_type"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("created_at"),
    )


BUDGETS_SQL = """SELECT c_custkey AS user_id, cast(200 + (c_custkey % 7) * 100 AS DOUBLE) AS monthly_limit,
  CASE WHEN c_custkey % 4 = 0 THEN 'organization' ELSE 'user' END AS budget_type
  FROM customer WHERE c_acctbal >= 0"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget rows; customers in debt have none."""
    return (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_acctbal") >= 0)
        .select(
            F.col("c_custkey").alias("user_id"),
            (200 + (F.col("c_custkey") % 7) * 100).cast("double").alias("monthly_limit"),
            F.when(F.col("c_custkey") % 4 == 0, "organization").otherwise("user").alias("budget_type"),
        )
    )


QUOTAS_SQL = """SELECT c_custkey AS user_id, 5 AS daily_limit, 60 AS monthly_limit
  FROM customer WHERE c_mktsegment = 'BUILDING'"""


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of one market segment; everybody else has the default ones."""
    return (
        table(spark, sf_dir, "customer")
        .filter("c_mktsegment = 'BUILDING'")
        .select(F.col("c_custkey").alias("user_id"), F.lit(5).alias("daily_limit"), F.lit(60).alias("monthly_limit"))
    )


def payload_expression(d: Dialect) -> str:
    """JSON text of one payload per event, in six shapes, each with the whole text of the event's
    document: two kinds of object, types that differ from row to row, a list at top level, a bare string,
    and text that breaks off."""
    email = "concat('user', user_id, '@example.com')"
    quoted = f"case when event_id % 4 = 0 then 'null' else concat('\"', {email}, '\"') end"
    said = f"coalesce({d.json_string('text')}, 'null')"
    shapes = (
        f"""concat('{{"user":{{"email":', {quoted}, ',"id":', user_id, ',"password":"pw', event_id, '"}},"note":"call 555-201-7788 ref ', event_id % 7, '","said":', {said}, ',"flag":true,"tags":["', event_type, '","m', user_id, '@mail.org"]}}')""",
        f"""concat('{{"props": ', props, ', "note": ', {said}, ', "user": {{"id": "', user_id, '"}} }}')""",
        f"""concat('{{"user":', user_id, ',"note":', {d.pick(["'7.50'", "'[]'", "'null'", f"concat('[', {quoted}, ']')"], 'event_id % 4')}, ',"said":[', {said}, '],"Auth_Code":["x","m@mill.test"]}}')""",
        f"""concat('[', {quoted}, ', {{"api_key" : "k', event_id, '", "say": "', chr(92), '"', {email}, chr(92), '" ', chr(92), 'u0041"}}, ', value, ', ', {said}, ']')""",
        f"""coalesce({d.json_string('text')}, concat('"mail ', {email}, '"'))""",
        f"""concat('{{"note":"mail ', {email}, '", "said":', {said}, ', "user":')""",
    )
    cases = " ".join(f"when {i} then {shape}" for i, shape in enumerate(shapes))
    return f"case event_id % 6 {cases} end"


PAYLOADS_SQL = (
    f"SELECT event_id, user_id, event_type, {payload_expression(DUCK)} AS payload "
    "FROM events LEFT JOIN documents ON doc_id = event_id"
)


# Of events, the bytes a task of payload work gets: a few bytes of them become a payload of hundreds.
_EVENT_BYTES = 1 << 19


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all events; those of an id that a document has carry its whole text. Both tables
    are dealt out by id in as many pieces as their sizes ask for: the text work behind runs in them."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    events = table(spark, sf_dir, "events")
    n = max(pieces(events, task_bytes=_EVENT_BYTES), pieces(texts))
    events = events.repartition(n, "event_id")
    return events.join(texts, F.col("doc_id") == F.col("event_id"), "left").select(
        "event_id", "user_id", "event_type", F.expr(payload_expression(SPARK)).alias("payload")
    )


ATTEMPTS_SQL = """SELECT event_id, k AS attempt,
  CASE WHEN event_id % 5 = 0 OR k < event_id % 5 THEN
    CASE event_id % 3 WHEN 0 THEN 'websocket_exception:TimeoutError:' || k
                      WHEN 1 THEN 'auth_timeout' ELSE '' END END AS error
  FROM (SELECT event_id, unnest(range(1, 2 + event_id % 4)) AS k FROM events WHERE event_type <> 'signup')"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts per event; sign-ups were never tried."""
    base = (
        table(spark, sf_dir, "events")
        .filter("event_type <> 'signup'")
        .select("event_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("1 + event_id % 4"))).alias("attempt"))
    )
    error = F.expr(
        "case event_id % 3 when 0 then concat('websocket_exception:TimeoutError:', attempt) "
        "when 1 then 'auth_timeout' else '' end"
    )
    return base.withColumn("error", F.when(F.expr("event_id % 5 = 0 or attempt < event_id % 5"), error))


KEY_SECRET = "registry-secret"
API_KEYS_SQL = """SELECT concat('key-', c_custkey) AS raw_key, c_custkey % 7 <> 0 AS is_active,
  CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-10' END AS expires_at FROM customer"""
KEYED_LOG_SQL = """SELECT event_id AS id, ts, CASE WHEN event_id % 13 = 0 THEN NULL
  WHEN event_id % 13 = 1 THEN '' WHEN event_id % 13 = 2 THEN concat('unknown-', user_id)
  ELSE concat('key-', user_id) END AS api_key FROM events"""


def keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.expr(
            "case when event_id % 13 = 0 then null when event_id % 13 = 1 then '' "
            "when event_id % 13 = 2 then concat('unknown-', user_id) else concat('key-', user_id) end"
        ).alias("api_key"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillguard.functions.text import hmac_sha256

    raw = F.concat(F.lit("key-"), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(
        hmac_sha256(KEY_SECRET, raw).alias("key_hash"),
        F.substring(raw, 1, 8).alias("key_prefix"),
        (F.col("c_custkey") % 7 != 0).alias("is_active"),
        F.when(F.col("c_custkey") % 5 == 0, F.to_timestamp(F.lit("2024-01-10"))).alias("expires_at"),
    )


def endpoint_expression() -> str:
    base = "split_part(url, '#', 1)"
    joint = "case when url like '%?%' then '&' else '?' end"
    return (
        f"concat({base}, {joint}, 'org=o', page_id % 7, case when page_id % 4 = 0 then '&key=' "
        f"else concat('&key=k%2B', page_id) end, '&channels=', case when page_id % 3 = 0 then 'a:usage' "
        f"else concat('a:usage,%20org', page_id % 7, ':decisions,b:decisions') end, '#frag')"
    )


ENDPOINTS_SQL = f"SELECT page_id, {endpoint_expression()} AS url FROM pages"


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(endpoint_expression()).alias("url"))


def raw_record_expression() -> str:
    """Request records as JSON text, each with the whole text of its turn; four in ten are acceptable."""
    escaped = "coalesce(text, '')"
    for code in (92, 34):
        escaped = f"replace({escaped}, chr({code}), concat(chr(92), chr({code})))"
    for code, letter in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        escaped = f"replace({escaped}, chr({code}), concat(chr(92), '{letter}'))"
    raw = f"concat('\"turn ', turn, ' ', {escaped}, '\"')"
    body = f"concat('\"tool\":\"t', conv_id % 9, '\",\"raw_text\":', {raw})"
    return (
        "case (conv_id + turn) % 10 "
        f"when 0 then concat('{{\"raw_text\":', {raw}, '}}') "
        f"when 1 then concat('{{\"tool\":', turn, ',\"raw_text\":', {raw}, ',\"scope\":null}}') "
        "when 2 then concat('{', " + body + ") "
        "when 3 then concat('{', " + body + ", ',\"budget_context\":{\"monthly_limit\":\"lots\"}}') "
        "when 4 then concat('{', " + body + ", ',\"budget_context\":{\"monthly_limit\":\"12.5\"},\"extra\":1}') "
        "when 5 then concat('{', " + body + ", ',\"tags\":\"none\",\"user_id\":7}') "
        f"when 6 then concat('[', {raw}, ']') "
        "else concat('{', " + body + ", ',\"user_id\":\"u', conv_id % 50, '\"}') end"
    )


RAW_RECORDS_SQL = f"SELECT conv_id, turn, {raw_record_expression()} AS value FROM conversations"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(raw_record_expression()).alias("value")
    )
