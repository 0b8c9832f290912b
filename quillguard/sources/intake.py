"""Reading request records and policy documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions.shipping import ship

# (field path, required, kind): what a request record must look like.
_FIELDS = (
    ("tool", True, "string"),
    ("scope", False, "string"),
    ("raw_text", True, "string"),
    ("tags", False, "list"),
    ("corr_id", False, "string"),
    ("user_id", False, "string"),
    ("policy_config", False, "model"),
    ("tool_config", False, "model"),
    ("budget_context", False, "model"),
    ("budget_context.monthly_limit", False, "number"),
    ("budget_context.current_spend", False, "number"),
    ("budget_context.llm_spend", False, "number"),
    ("budget_context.purchase_spend", False, "number"),
    ("budget_context.remaining_budget", False, "number"),
    ("budget_context.budget_type", False, "string"),
    ("tool_config.tool_name", False, "string"),
    ("tool_config.scope", False, "string"),
    ("tool_config.direction", False, "string"),
    ("tool_config.metadata", False, "object"),
    ("policy_config.version", False, "string"),
    ("policy_config.on_error", False, "string"),
    ("policy_config.model", False, "string"),
    ("policy_config.deny_tools", False, "list"),
    ("policy_config.network_scopes", False, "list"),
    ("policy_config.network_tools", False, "list"),
    ("policy_config.defaults", False, "object"),
    ("policy_config.tool_access", False, "object"),
)
# Fields that may be null, as opposed to absent.
_NULLABLE = {
    "scope",
    "tags",
    "corr_id",
    "user_id",
    "policy_config",
    "tool_config",
    "budget_context",
    "tool_config.scope",
}
_ERROR_KIND = {
    "string": "string_type",
    "list": "list_type",
    "object": "dict_type",
    "model": "model_attributes_type",
    "number": "float_type",
}
_ERRORS_DDL = "array<struct<loc:string,kind:string>>"


def _fits(value: Column, kind: str) -> Column:
    shape = F.schema_of_variant(value)
    if kind == "string":
        return shape == "STRING"
    if kind == "list":
        return shape.startswith("ARRAY")
    if kind in ("object", "model"):
        return shape.startswith("OBJECT")
    numeric_text = (shape == "STRING") & F.try_variant_get(value, "$", "string").try_cast("double").isNotNull()
    return shape.isin("BIGINT", "DOUBLE", "BOOLEAN") | shape.startswith("DECIMAL") | numeric_text


def _field_error(doc: Column, path: str, required: bool, kind: str) -> Column:
    parent, _, _ = path.rpartition(".")
    value = F.try_variant_get(doc, f"$.{path}", "variant")
    absent = value.isNull()
    void = F.coalesce(F.is_variant_null(value), F.lit(False))
    ok_null = F.lit(path in _NULLABLE)
    name = F.lit(_ERROR_KIND[kind])
    if kind == "number":  # text that is no number, as opposed to something else altogether
        name = F.when(F.schema_of_variant(value) == "STRING", "float_parsing").otherwise(name)
    wrong = F.when(absent, F.lit("missing") if required else F.lit(None).cast("string")).when(
        ~(void & ok_null) & (void | ~_fits(value, kind)), name
    )
    if parent:
        holder = F.try_variant_get(doc, f"$.{parent}", "variant")
        wrong = F.when(F.schema_of_variant(holder).startswith("OBJECT"), wrong)
    return F.when(wrong.isNotNull(), F.struct(F.lit(f"body.{path}").alias("loc"), wrong.alias("kind")))


def _element_errors(doc: Column, path: str) -> Column:
    """One error per list element that is no text."""
    elements = F.try_variant_get(doc, f"$.{path}", "array<variant>")

    def error(value: Column, i: Column) -> Column:
        loc = F.concat(F.lit(f"body.{path}."), i.cast("string"))
        return F.when(
            F.schema_of_variant(value) != "STRING", F.struct(loc.alias("loc"), F.lit("string_type").alias("kind"))
        )

    return _compacted(F.transform(elements, error))


def _rule_errors(doc: Column) -> Column:
    """One error per tool rule that is no object or whose direction is missing or no text."""
    entries = F.map_entries(F.try_variant_get(doc, "$.policy_config.tool_access", "map<string,variant>"))

    def error(e: Column) -> Column:
        loc = F.concat(F.lit("body.policy_config.tool_access."), e["key"])
        direction = F.try_variant_get(e["value"], "$.direction", "variant")
        found = F.when(~F.schema_of_variant(e["value"]).startswith("OBJECT"), F.struct(loc, F.lit(_ERROR_KIND["model"])))
        at_direction = F.concat(loc, F.lit(".direction"))
        return found.when(direction.isNull(), F.struct(at_direction, F.lit("missing"))).when(
            F.schema_of_variant(direction) != "STRING", F.struct(at_direction, F.lit("string_type"))
        )

    return _compacted(F.transform(entries, error))


def _compacted(errors: Column) -> Column:
    return F.coalesce(F.array_compact(errors.cast(_ERRORS_DDL)), F.array().cast(_ERRORS_DDL))


def _request_columns(value_col: str) -> list[Column]:
    """Typed request columns. The policy stays JSON text, whose rule order counts; numbers may be
    written as text."""

    def get(path: str, ddl: str) -> Column:
        return F.try_variant_get("_doc", f"$.{path}", ddl)

    def struct(path: str, fields: dict[str, tuple[str, object]], ddl: str) -> Column:
        present = F.schema_of_variant(get(path, "variant")).startswith("OBJECT")
        made = F.struct(
            *[F.coalesce(get(f"{path}.{f}", t), F.lit(default).cast(t)).alias(f) for f, (t, default) in fields.items()]
        )
        return F.when(present, made.cast(ddl)).alias(path)

    amounts = ("monthly_limit", "current_spend", "llm_spend", "purchase_spend", "remaining_budget")
    return [
        *[get(c, "string").alias(c) for c in ("tool", "scope", "raw_text")],
        get("tags", "array<string>").alias("tags"),
        *[get(c, "string").alias(c) for c in ("corr_id", "user_id")],
        F.get_json_object(value_col, "$.policy_config").alias("policy_config"),
        struct(
            "tool_config",
            {
                "tool_name": ("string", ""),
                "scope": ("string", None),
                "direction": ("string", "ingress"),
                "metadata": ("map<string,string>", None),
            },
            S.TOOL_CONFIG_DDL,
        ),
        struct(
            "budget_context",
            {**{a: ("double", 0.0) for a in amounts}, "budget_type": ("string", "user")},
            S.BUDGET_CONTEXT_DDL,
        ),
    ]


def request_intake(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split raw JSON records into accepted requests and rejected rows.

    Rejected rows keep their other columns and get ``errors``, the field locations and error kinds;
    the content itself is not carried on. Unknown fields are dropped from accepted rows.
    """
    doc = F.try_parse_json(F.col(value_col))
    lists = [path for path, _, kind in _FIELDS if kind == "list"]
    checks = F.concat(
        _compacted(F.array(*[_field_error(F.col("_doc"), *f) for f in _FIELDS])),
        *[_element_errors(F.col("_doc"), path) for path in lists],
        _rule_errors(F.col("_doc")),
    )
    unreadable = F.array(F.struct(F.lit("body").alias("loc"), F.lit("json_invalid").alias("kind")))
    not_object = F.array(F.struct(F.lit("body").alias("loc"), F.lit("model_attributes_type").alias("kind")))
    checked = raw.withColumn("_doc", doc).withColumn(
        "errors",
        F.when(F.col("_doc").isNull(), unreadable)
        .when(~F.schema_of_variant("_doc").startswith("OBJECT"), not_object)
        .otherwise(checks)
        .cast(_ERRORS_DDL),
    )
    keep = [c for c in raw.columns if c != value_col]
    rejected = checked.filter(F.size("errors") > 0).select(*keep, "errors")
    accepted = checked.filter(F.size("errors") == 0).select(*keep, *_request_columns(value_col)).drop("_doc")
    return accepted, rejected


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected records of a folder of JSON lines."""
    return request_intake(spark.read.text(path))


def policy_json(body: str) -> str:
    """JSON text of a policy in JSON or YAML form; empty for one that cannot be read as either."""
    try:
        return json.dumps(json.loads(body) or {})
    except ValueError:
        pass
    import yaml

    try:
        return json.dumps(yaml.safe_load(body) or {}, default=str)
    except (yaml.YAMLError, ValueError):
        return "{}"


def read_policy_file(spark: SparkSession, path: str) -> str:
    """JSON text of one policy file; the empty policy for a file that is missing or cannot be read.
    A policy file is a short document, read whole by the driver. A folder of several is refused."""
    try:
        files = spark.read.text(path, wholetext=True).limit(2).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return "{}"
    if len(files) > 1:
        raise ValueError(f"{path} holds several policy files: use read_policy_files")
    return policy_json(files[0]["value"] if files else "")


def read_policy_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, policy) of every policy file of a folder, as JSON text; an empty file has no row."""
    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            yield pd.DataFrame({"path": files["path"], "policy": files["value"].map(policy_json)})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(parse, "path string, policy string")
