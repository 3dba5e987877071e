"""Rules over key=value files: syntax, required keys, types, custom patterns and the policy gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtrail.functions import kv
from kvtrail.operators.detection import scan

_NUMBER = r"^\s*[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*\z|^\s*(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)\s*\z"


def type_holds(value: Column, kind: Column) -> Column:
    """Whether a value has the named type; an unknown type always holds."""
    return (
        F.when(kind == "string", value != "")
        .when(kind == "number", (kv.js_trim(value) != "") & value.rlike(_NUMBER))
        .when(kind == "boolean", F.lower(value).isin("true", "false", "1", "0", "yes", "no"))
        .when(kind == "url", value.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:.+") | value.rlike(r"(?i)^https?://.+"))
        .otherwise(F.lit(True))
    )


def syntax_errors(files: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without =, without a name, or with an odd number of double quotes."""
    rows = kv.lines_of(files.select(*keys, "fileContent")).where("text != '' and not startswith(text, '#')")
    at = F.instr("text", "=")
    messages = F.array(
        F.when(at == 0, "Invalid line format"),
        F.when((at > 0) & (kv.js_trim(F.expr("left(text, instr(text, '=') - 1)")) == ""), "Missing variable name"),
        F.when((at > 0) & (F.regexp_count(F.expr("substring(text, instr(text, '=') + 1)"), F.lit('"')) % 2 == 1), "Unmatched quotes"),
    )
    bad = rows.select(*keys, "line", F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("message"))
    return bad.select(*keys, F.lit("syntax").alias("type"), F.lit(None).cast("string").alias("variable"), "message", "line")


def missing_errors(files: DataFrame, pairs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys that a file lacks: its list of keys against the few rules, an anti join without a pair of all rows."""
    wanted = rules.where("rule_type = 'required'").agg(F.collect_set("variable").alias("wanted"))
    held = pairs.groupBy(*keys).agg(F.collect_set("key").alias("held"))
    frame = files.select(*keys).join(held, keys, "left").join(F.broadcast(wanted))
    gone = frame.select(*keys, F.explode(F.array_except("wanted", F.coalesce("held", F.array().cast("array<string>")))).alias("variable"))
    return gone.select(*keys, F.lit("missing").alias("type"), "variable", F.concat(F.lit("Required variable missing: "), "variable").alias("message"), F.lit(None).cast("int").alias("line"))


def type_errors(pairs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    r = rules.where("rule_type = 'type'").select(F.col("variable").alias("key"), F.col("arg").alias("kind"))
    bad = pairs.join(r, "key").where(~type_holds(F.col("value"), F.col("kind")))
    return bad.select(*keys, F.lit("type").alias("type"), F.col("key").alias("variable"), F.concat(F.lit("Expected "), "kind").alias("message"), "line")


def custom_errors(pairs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Values that do not match the pattern of their rule; the pattern is a column."""
    r = rules.where("rule_type = 'custom'").select(F.col("variable").alias("key"), F.col("arg").alias("pattern"))
    bad = pairs.join(r, "key").where(F.expr("not (value rlike pattern)"))
    return bad.select(*keys, F.lit("custom").alias("type"), F.col("key").alias("variable"), F.lit("Custom rule failed").alias("message"), "line")


#: Rules that are sent to every task, at most.
MOST_RULES = 10_000


def validate(files: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """All errors of all files: syntax, missing, type and custom.

    Each file is parsed once and stays one row until its errors are known; the rules come along as one row of
    lists. More than MOST_RULES rules meet the files by joins instead. A null content has no lines.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        pairs = kv.validator_pairs(files, keys)
        return syntax_errors(files, keys).unionByName(missing_errors(files, pairs, rules, keys)).unionByName(type_errors(pairs, rules, keys)).unionByName(custom_errors(pairs, rules, keys))
    of = lambda kind: F.col("rule_type") == kind
    rule = F.struct(F.col("variable").alias("key"), "arg")
    lists = rules.agg(F.array_sort(F.collect_set(F.when(of("required"), F.col("variable")))).alias("_required"), *(F.collect_list(F.when(of(t), rule)).alias(f"_{t}") for t in ("type", "custom")))
    text = F.transform(F.split(F.coalesce("fileContent", F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), kv.js_trim(x).alias("text")))
    rows = files.select(*keys, F.filter(text, lambda x: (x["text"] != "") & ~x["text"].startswith("#")).alias("_lines"))
    parts = lambda x: F.struct(
        x["line"].alias("line"), F.instr(x["text"], "=").alias("at"), kv.js_trim(F.substring_index(x["text"], "=", 1)).alias("key"), F.regexp_replace(x["text"], "^[^=]*=", "").alias("rest")
    )
    rows = rows.select(*keys, F.transform("_lines", parts).alias("_lines"))
    named = F.filter("_lines", lambda x: (x["at"] > 0) & (x["key"] != ""))
    rows = rows.withColumn("_sorted", F.array_sort(F.transform(named, lambda x: F.struct(x["key"].alias("key"), x["line"].alias("line"), x["rest"].alias("value")))))
    rows = rows.withColumn("_pairs", F.filter("_sorted", lambda x, i: ~F.get("_sorted", i + 1)["key"].eqNullSafe(x["key"]))).join(F.broadcast(lists))

    error = lambda kind, variable, message, line: F.struct(F.lit(kind).alias("type"), variable.cast("string").alias("variable"), message.alias("message"), line.cast("int").alias("line"))
    null = F.lit(None)
    syntax = F.flatten(F.transform("_lines", lambda x: F.filter(F.array(
        F.when(x["at"] == 0, error("syntax", null, F.lit("Invalid line format"), x["line"])),
        F.when((x["at"] > 0) & (x["key"] == ""), error("syntax", null, F.lit("Missing variable name"), x["line"])),
        F.when((x["at"] > 0) & (F.regexp_count(x["rest"], F.lit('"')) % 2 == 1), error("syntax", null, F.lit("Unmatched quotes"), x["line"])),
    ), lambda e: e.isNotNull())))
    missing = F.transform(F.array_except("_required", F.transform("_pairs", lambda x: x["key"])), lambda v: error("missing", v, F.concat(F.lit("Required variable missing: "), v), null))

    def failed(kind, holds, message):
        hit = lambda x, r: F.when((r["key"] == x["key"]) & ~holds(x["value"], r["arg"]), error(kind, x["key"], message(r["arg"]), x["line"]))
        return F.flatten(F.transform("_pairs", lambda x: F.filter(F.transform(f"_{kind}", lambda r: hit(x, r)), lambda e: e.isNotNull())))

    types = failed("type", type_holds, lambda arg: F.concat(F.lit("Expected "), arg))
    custom = failed("custom", lambda value, pattern: F.regexp_like(value, pattern), lambda _: F.lit("Custom rule failed"))
    return rows.select(*keys, F.explode(F.concat(syntax, missing, types, custom)).alias("_e")).select(*keys, "_e.type", "_e.variable", "_e.message", "_e.line")


def summary(files: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of each type and a verdict for every file, those without errors as well."""
    counts = errors.groupBy(*keys).agg(*(F.count_if(F.col("type") == t).alias(t) for t in ("syntax", "missing", "type", "custom")), F.count(F.lit(1)).alias("errors"))
    zero = {c: 0 for c in ("syntax", "missing", "type", "custom", "errors")}
    return files.select(*keys).join(counts, keys, "left").fillna(zero).withColumn("valid", F.col("errors") == 0)


def policy_gate(files: DataFrame, rules: DataFrame, change_set: str, blocking: tuple[str, ...] = ("env_file", "secret", "validation")) -> DataFrame:
    """Per change set: issues of the three checks, and whether one that is set to block was found.

    files has the change set, id, path and fileContent. Every file is scanned for secrets, unless
    it is large or binary; files whose path begins with .env are issues themselves and have to hold to the rules.
    """
    env = files.where(F.col("path").startswith(".env"))
    docs = files.select(F.col(change_set).alias("doc_key"), F.lit(None).cast("string").alias("source"), "path", F.col("fileContent").alias("text"))
    secrets = scan(docs, any_path=True).select(F.col("doc_key").alias(change_set), F.lit("secret").alias("issue"))
    errors = validate(env, rules, [change_set]).select(change_set, F.lit("validation").alias("issue"))
    none = files.select(change_set, F.lit(None).cast("string").alias("issue"))
    found = none.unionByName(env.select(change_set, F.lit("env_file").alias("issue"))).unionByName(errors).unionByName(secrets)
    blocked = F.coalesce(F.bool_or(F.col("issue").isin(*blocking)), F.lit(False)) if blocking else F.lit(False)
    return found.groupBy(change_set).agg(*(F.count_if(F.col("issue") == i).alias(f"{i}_issues") for i in ("env_file", "secret", "validation")), blocked.alias("blocked"))


def branch_switch(branches: DataFrame, mapping: DataFrame, files: DataFrame) -> DataFrame:
    """What a branch switches to: unmapped, a mapped environment without a file, or the environment."""
    m = mapping.select("branch", F.col("environmentName").alias("environment"))
    f = files.select(F.col("environmentName").alias("environment"), F.lit(True).alias("there")).distinct()
    out = branches.join(m, "branch", "left").join(f, "environment", "left")
    return out.select("branch", "environment", F.when(F.col("environment").isNull(), "unmapped").when(F.col("there").isNull(), "missing file").otherwise("switched").alias("outcome"))


# Families of configuration names that stand for one another.
FAMILIES = [["dev", "development", "develop"], ["prod", "production", "prd"], ["staging", "stg", "stage"]]


def config_names(name: Column) -> Column:
    """The name itself and then its aliases, each once."""
    rest = F.array().cast("array<string>")
    for family in FAMILIES:
        rest = F.when(F.lower(name).isin(family), F.array_distinct(F.array_prepend(F.array(*map(F.lit, family)), F.lower(name)))).otherwise(rest)
    return F.array_distinct(F.array_prepend(rest, name))
