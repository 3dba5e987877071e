"""Parsing of key=value text, one dialect a function, and small columns over it.

All dialects split at line feeds, trim lines and skip blank and # lines; they
differ in quotes, trimming, empty keys and duplicate keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = r"[\s ﻿]"


def js_trim(c: Column) -> Column:
    """Trims all Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+\\z", "")


def _numbered(df: DataFrame, content: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != content], F.posexplode(F.split(content, "\n")).alias("_pos", "raw"))


def lines_of(df: DataFrame, content: str = "fileContent") -> DataFrame:
    """One row a line: the other columns, line (from 1), raw and trimmed text."""
    return _numbered(df, content).withColumn("line", F.col("_pos") + 1).withColumn("text", js_trim(F.col("raw"))).drop("_pos")


def assignments(df: DataFrame, content: str = "fileContent") -> DataFrame:
    """The lines that assign: line, key (trimmed text before the first =) and rest (after it)."""
    rows = lines_of(df, content).where("text != '' and not startswith(text, '#') and contains(text, '=')")
    at = F.instr("text", "=")
    return rows.withColumn("key", js_trim(F.expr("left(text, instr(text, '=') - 1)"))).withColumn("rest", F.expr("substring(text, instr(text, '=') + 1)")).withColumn("has_key", at > 1)


def last_wins(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Of several lines of one key, the values of the last."""
    return rows.groupBy(*keys, "key").agg(*(F.max_by(v, "line").alias(v) for v in values))


def history_pairs(df: DataFrame, keys: list[str], content: str = "fileContent") -> DataFrame:
    """History dialect: one outer quote gone at either end, each by itself; empty keys stay; last wins."""
    rows = assignments(df.select(*keys, content), content).withColumn("value", F.regexp_replace("rest", "^[\"']|[\"']\\z", ""))
    return last_wins(rows, keys, "value")


def diff_rows(df: DataFrame, keys: list[str], content: str = "fileContent") -> DataFrame:
    """Diff dialect: raw values, no empty key, all duplicates as rows with their line."""
    return assignments(df.select(*keys, content), content).where("key != ''").select(*keys, "key", F.col("rest").alias("value"), "line")


def validator_pairs(df: DataFrame, keys: list[str], content: str = "fileContent") -> DataFrame:
    """Validator dialect: as the diff dialect, value and line of the last duplicate."""
    return last_wins(diff_rows(df, keys, content).withColumn("at", F.col("line")), keys, "value", "at").withColumnRenamed("at", "line")


def sync_pairs(df: DataFrame, keys: list[str], content: str = "fileContent") -> DataFrame:
    """Sync dialect: raw values, last wins, no line."""
    return validator_pairs(df, keys, content).drop("line")


def export_pairs(df: DataFrame, keys: list[str], content: str = "fileContent") -> DataFrame:
    """Export dialect: trimmed value, the comment after the first # (which the value keeps), whether encrypted; last wins."""
    rows = assignments(df.select(*keys, content), content).where("has_key").withColumn("value", js_trim(F.col("rest")))
    comment = F.when(F.col("rest").contains("#"), js_trim(F.expr("substring(rest, instr(rest, '#') + 1)")))
    rows = rows.withColumn("comment", comment).withColumn("encrypted", is_encrypted(F.col("value")))
    return last_wins(rows, keys, "value", "encrypted", "comment")


def completion_pairs(df: DataFrame, keys: list[str], content: str = "fileContent") -> DataFrame:
    """Completion dialect: paired quotes gone; the last comment line since the previous pair is the description."""
    from pyspark.sql import Window

    rows = lines_of(df.select(*keys, content), content).where("text != ''")
    pair = (~F.col("text").startswith("#")) & (F.instr("text", "=") > 0)
    w = Window.partitionBy(*keys).orderBy("line")
    rows = rows.withColumn("pair", pair).withColumn("block", F.sum(F.col("pair").cast("int")).over(w) - F.col("pair").cast("int"))
    note = F.when(F.col("text").startswith("#"), js_trim(F.expr("substring(text, 2)")))
    rows = rows.withColumn("description", F.last(note, True).over(Window.partitionBy(*keys, "block").orderBy("line")))
    value = js_trim(F.expr("substring(text, instr(text, '=') + 1)"))
    rows = rows.where("pair").withColumn("key", js_trim(F.expr("left(text, instr(text, '=') - 1)"))).withColumn("value", F.regexp_replace(value, "^(?:\"(.*)\"|'(.*)')\\z", "$1$2"))
    return last_wins(rows, keys, "value", "description")


def is_encrypted(value: Column) -> Column:
    return value.startswith("ENC[") & value.endswith("]")


def variable_count(content: Column) -> Column:
    """Lines that are not blank, do not start with # as they stand, and hold an =."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: (js_trim(x) != "") & ~x.startswith("#") & x.contains("=")))


def environment_name(path: Column) -> Column:
    """.env is local, .env.X is X, all else its base name."""
    base = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return F.when(base == ".env", "local").when(base.startswith(".env."), F.regexp_replace(base, r"^\.env\.", "")).otherwise(base)


def display_file_name(file_name: Column, environment: Column) -> Column:
    return F.coalesce(F.nullif(file_name, F.lit("")), F.when(environment == "local", ".env").otherwise(F.concat(F.lit(".env."), environment)))


def variable_name(context: Column) -> Column:
    """The name that a declaration or assignment in a context gives."""
    p = r"(?:const|let|var)\s+([A-Za-z0-9_]+)|([A-Za-z0-9_]+)\s*[:=]"
    return F.coalesce(F.nullif(F.regexp_extract(context, p, 1), F.lit("")), F.nullif(F.regexp_extract(context, p, 2), F.lit("")))


def file_extension(path: Column) -> Column:
    return F.when(path.contains("."), F.concat(F.lit("."), F.substring_index(path, ".", -1))).otherwise("unknown")


def sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike("key|secret|password|token|auth")


# Names that the remote store keeps for itself.
RESERVED_KEYS = [
    "DOPPLER_CONFIG", "DOPPLER_ENVIRONMENT", "DOPPLER_PROJECT", "DOPPLER_ENVIRONMENT_ID", "DOPPLER_PROJECT_ID",
    "DOPPLER_CONFIG_ID", "DOPPLER_ENVIRONMENT_TOKEN_NAME", "DOPPLER_ENVIRONMENT_TOKEN_ID",
]


def reserved_key(key: Column) -> Column:
    """Whether a push leaves the key out; case matters."""
    return key.isin(RESERVED_KEYS)
