"""Policy documents as tables: normalisation, version lookup and rule matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quillguard import schemas as S
from quillguard.functions.times import micros
from quillguard.functions.sizing import broadcast_if_small

# A policy is one struct column, so that a decision needs a single join.
POLICY_FIELDS = (
    "version",
    "deny_tools",
    "network_scopes",
    "network_tools",
    "defaults",
    "rules",
    "on_error",
    "model",
    "scope",
    "tool",
    "bad_rules",
    "bad_defaults",
)


def _text_list(doc: Column, name: str, default: tuple[str, ...]) -> Column:
    listed = F.from_json(F.get_json_object(doc, f"$.{name}"), "array<string>")
    return F.coalesce(listed, F.array(*[F.lit(x) for x in default]))


def policy_struct(doc: Column, file_form: Column | None = None) -> Column:
    """One policy document (JSON text) as a struct with every default filled in.

    ``rules`` keeps document order. A document in file form carries no deny, network or error
    settings of its own, and an unreadable file counts as an empty one. Null for a null or empty
    document, which counts as no policy.
    """
    is_file = F.lit(False) if file_form is None else file_form
    rules_text = F.get_json_object(doc, "$.tool_access")
    rules_map = F.from_json(rules_text, S.RULES_DDL)
    rules = F.transform(
        F.map_entries(rules_map),
        lambda e, i: F.struct(
            i.alias("rule_ord"),
            e["key"].alias("tool"),
            e["value"]["direction"].alias("direction"),
            e["value"]["action"].alias("action"),
            e["value"]["allow_pii"].alias("allow_pii"),
        ),
    )
    defaults_text = F.get_json_object(doc, "$.defaults")
    defaults = F.from_json(defaults_text, S.DEFAULTS_DDL)

    def own(name: str, default: str | None) -> Column:
        found = F.get_json_object(doc, f"$.{name}")
        return F.when(~is_file, found) if default is None else F.coalesce(F.when(~is_file, found), F.lit(default))

    def own_list(name: str, default: tuple[str, ...]) -> Column:
        fixed = F.array(*[F.lit(x) for x in default])
        return F.when(is_file, fixed).otherwise(_text_list(doc, name, default))

    unreadable = F.try_parse_json(doc).isNull()
    built = F.struct(
        F.coalesce(F.get_json_object(doc, "$.version"), F.lit(S.DEFAULT_VERSION)).alias("version"),
        own_list("deny_tools", S.DEFAULT_DENY_TOOLS).alias("deny_tools"),
        own_list("network_scopes", S.DEFAULT_NETWORK_SCOPES).alias("network_scopes"),
        own_list("network_tools", S.DEFAULT_NETWORK_TOOLS).alias("network_tools"),
        defaults.alias("defaults"),
        F.coalesce(
            rules,
            F.array().cast(
                "array<struct<rule_ord:int,tool:string,direction:string,action:string,"
                "allow_pii:map<string,string>>>"
            ),
        ).alias("rules"),
        own("on_error", S.DEFAULT_ON_ERROR).alias("on_error"),
        own("model", S.DEFAULT_MODEL).alias("model"),
        own("scope", None).alias("scope"),
        own("tool", None).alias("tool"),
        ((unreadable & ~is_file) | (rules_text.isNotNull() & rules_map.isNull())).alias("bad_rules"),
        (defaults_text.isNotNull() & defaults.isNull()).alias("bad_defaults"),
    )
    empty = doc.isNull() | F.trim(doc).isin("", "{}", "null")
    return F.when(~empty, built)


def load_policies(policies: DataFrame, doc_col: str = "doc", form_col: str = "form") -> DataFrame:
    """Add the ``policy`` struct; ``form`` is ``file`` or ``payload``."""
    return policies.withColumn("policy", policy_struct(F.col(doc_col), F.col(form_col) == "file"))


def policy_rules(policies: DataFrame, key: str = "policy_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long rule, default and list tables of all policy documents.

    Rules: one row per tool rule and finding type (null type when the rule names none). Defaults:
    one row per direction, ``redact`` where the document sets none. Lists: deny tools and network
    prefixes in order.
    """
    loaded = load_policies(policies).filter(F.col("policy").isNotNull())
    version = F.col("policy.version").alias("version")
    rules = (
        loaded.select(key, version, F.explode("policy.rules").alias("r"))
        .select(key, "version", "r.*")
        .select(
            key,
            "version",
            "rule_ord",
            "tool",
            "direction",
            "action",
            F.explode_outer("allow_pii").alias("pii_type", "pii_action"),
        )
    )
    sides = F.array(F.lit("ingress"), F.lit("egress"))
    defaults = loaded.select(key, "policy", F.explode(sides).alias("direction")).select(
        key, "direction", default_action(F.col("policy"), F.col("direction")).alias("action")
    )
    named = F.array(
        *[
            F.struct(F.lit(n).alias("list_name"), F.col(f"policy.{n}").alias("entries"))
            for n in ("deny_tools", "network_scopes", "network_tools")
        ]
    )
    lists = (
        loaded.select(key, F.explode(named).alias("l"))
        .select(key, "l.list_name", F.posexplode("l.entries").alias("ord", "entry"))
        .select(key, "list_name", "ord", "entry")
    )
    return rules, defaults, lists


def default_action(policy: Column, direction: Column) -> Column:
    per_direction = F.try_element_at(policy["defaults"], direction)
    return F.coalesce(F.try_element_at(per_direction, F.lit("action")), F.lit(S.DEFAULT_ACTION))


def policy_as_of(
    requests: DataFrame,
    versions: DataFrame,
    ts_col: str = "ts",
    from_col: str = "valid_from",
    key: str = "policy_key",
    piece_s: int = 86_400,
) -> DataFrame:
    """Attach the policy version in force when each request arrived.

    ``versions`` holds (key, version_id, valid_from, ...). Validity ends where the next version of
    the same key begins; of versions that begin together the one with the greater ``version_id``, where
    there is such a column, holds. A request before the first version, for an unknown or no key, or
    without a time gets null, which counts as the empty policy.

    Requests and versions of a key meet in pieces of time of ``piece_s`` seconds, read in order. The
    version in force as a piece begins is carried over the list of the key's pieces and enters as one
    row, so a request scans no versions, and a key with most requests or very many versions is spread
    over its pieces.
    """
    rest = [c for c in versions.columns if c != key]

    def placed(df: DataFrame, at: str, kind: int, rows: str, columns: list[str]) -> DataFrame:
        us = _moment(df, at)
        fields = [F.col(key).alias("_key"), us.alias("_us"), F.floor(us / F.lit(piece_s * 1_000_000)).alias("_piece"), F.lit(kind).alias("_kind")]
        return df.select(*fields, F.struct(*columns).alias(rows))

    own = placed(versions.filter(F.col(key).isNotNull() & F.col(from_col).isNotNull()), from_col, 1, "_version", rest)
    asked = placed(requests, ts_col, 2, "_request", requests.columns)
    tie = F.col("_version.version_id") if "version_id" in rest else F.lit(0)

    # the last version of each piece, and pieces that only requests fall into
    last = own.groupBy("_key", "_piece").agg(F.max_by("_version", F.struct("_us", tie)).alias("_version"))
    pieces = last.unionByName(asked.select("_key", "_piece").distinct(), allowMissingColumns=True)
    pieces = pieces.groupBy("_key", "_piece").agg(F.first("_version", ignorenulls=True).alias("_version"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("_key", "_piece", F.lit(0).alias("_kind"), F.last("_version", ignorenulls=True).over(before).alias("_version"))

    together = asked.unionByName(own, allowMissingColumns=True).unionByName(carried.filter("_version IS NOT NULL"), allowMissingColumns=True)
    order = [F.when(F.col("_kind") == 0, 0).otherwise(1), "_us", "_kind", tie]
    inside = Window.partitionBy("_key", "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = together.withColumn("_version", F.last("_version", ignorenulls=True).over(inside)).filter("_kind = 2")
    return met.select("_request.*", *[F.col("_version")[c].alias(c) for c in rest])


def _moment(df: DataFrame, column: str) -> Column:
    """Microseconds of a time, or of whole seconds since the epoch."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long") * 1_000_000
    return F.unix_micros(F.col(column).cast("timestamp")) if isinstance(kind, T.DateType) else micros(df, column)


def exact_rule(rules: Column, tool: Column, direction: Column, accept_both: bool) -> Column:
    def fits(r: Column) -> Column:
        side = r["direction"] == direction
        if accept_both:
            side = side | (r["direction"] == "both")
        return (r["tool"] == tool) & side

    return F.get(F.filter(rules, fits), F.lit(0))


def suffix_rule(rules: Column, tool: Column, direction: Column) -> Column:
    """First rule in document order whose tool name the requested name ends with."""
    return F.get(
        F.filter(
            rules,
            lambda r: F.endswith(tool, r["tool"]) & ((r["direction"] == direction) | (r["direction"] == "both")),
        ),
        F.lit(0),
    )


def payload_rule(rules: Column, tool: Column, direction: Column) -> Column:
    return F.coalesce(exact_rule(rules, tool, direction, True), suffix_rule(rules, tool, direction))


def deny_tools(
    requests: DataFrame, lists: DataFrame, key: str | None = "policy_key"
) -> tuple[DataFrame, DataFrame]:
    """Split requests into those whose tool is on the deny list and the rest. With ``key`` the
    list is looked up per policy."""
    denied = lists.filter(F.col("list_name") == "deny_tools").withColumnRenamed("entry", "tool")
    on = ["tool"] if key is None else [key, "tool"]
    denied = broadcast_if_small(denied.select(*on).distinct())
    hits = requests.join(denied, on, "left_semi").withColumns(
        {
            "decision": F.lit("deny"),
            "reasons": F.array(F.lit("blocked tool: code/exec")),
            "rule_id": F.lit("deny-exec"),
        }
    )
    return hits, requests.join(denied, on, "left_anti")


def match_tool_rule(
    requests: DataFrame, rules: DataFrame, mode: str = "payload", key: str = "policy_key"
) -> DataFrame:
    """Attach the matching rule's ``rule_ord``, ``rule_tool`` and ``rule_action`` (null: none).

    ``static``: exact name and exact direction, an equi join. ``payload``: exact name first, then
    the first rule in document order whose name is a suffix of the tool name; ``both`` fits either
    direction. Suffixes are matched by an equi join too: each distinct (policy, tool, direction) is
    unfolded into the suffixes of its tool name, one row per letter, instead of being compared with
    every rule.
    """
    one_per_rule = rules.select(
        key,
        F.col("rule_ord").alias("rule_ord"),
        F.col("tool").alias("rule_tool"),
        F.col("direction").alias("rule_direction"),
        F.col("action").alias("rule_action"),
    ).distinct()
    if mode == "static":
        named = one_per_rule.withColumnsRenamed({"rule_direction": "direction"}).withColumn(
            "tool", F.col("rule_tool")
        )
        return requests.join(broadcast_if_small(named), [key, "tool", "direction"], "left")
    if mode != "payload":
        raise ValueError(f"mode must be static or payload, not {mode!r}")
    # a name has a row for each length that the tool names of its policy have, not for each letter
    lengths = one_per_rule.groupBy(key).agg(F.collect_set(F.length("rule_tool")).alias("_lengths"))
    suffixes = F.expr("transform(filter(_lengths, n -> n <= length(tool)), n -> substring(tool, length(tool) - n + 1))")
    asked = (
        requests.select(key, "tool", "direction")
        .distinct()
        .join(broadcast_if_small(lengths), key)
        .select(key, "tool", "direction", F.explode(suffixes).alias("rule_tool"))
    )
    ranked = (
        asked.join(broadcast_if_small(one_per_rule), [key, "rule_tool"])
        .filter((F.col("rule_direction") == F.col("direction")) | (F.col("rule_direction") == "both"))
        .groupBy(key, "tool", "direction")
        .agg(
            F.min(
                F.struct(
                    (F.col("tool") != F.col("rule_tool")).alias("is_suffix"),
                    "rule_ord",
                    "rule_tool",
                    "rule_action",
                )
            ).alias("r")
        )
        .select(key, "tool", "direction", "r.rule_ord", "r.rule_tool", "r.rule_action")
    )
    return requests.join(ranked, [key, "tool", "direction"], "left")
