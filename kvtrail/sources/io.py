"""Reading and writing of snapshot logs, env files, rules, exports, feedback and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvtrail.functions.kv import export_pairs, sensitive_key
from kvtrail.functions.secrets import checksum

HISTORY = """id string, timestamp timestamp, action string, environmentName string, fileName string, previousEnvironment string, user string,
commitHash string, fileContent string, metadata struct<workspace: string, reason: string, tags: array<string>, source: string, checksum: string>"""

IMPORTED = """id: string, timestamp: string, action: string, environmentName: string, fileName: string, previousEnvironment: string, user: string,
commitHash: string, fileContent: string, metadata: struct<workspace: string, reason: string, tags: array<string>, source: string, checksum: string>"""


def read_history(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """All month files of JSON arrays, or with `lines` what export_history() wrote; unreadable entries are left out; newest first."""
    schema = HISTORY + ", _corrupt_record string"
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json" if lines else "????-??.json").json(path)
    df = df.where("_corrupt_record is null and id is not null").drop("_corrupt_record").orderBy(F.desc("timestamp"), "id")
    return df.limit(limit) if limit else df


def append_history(rows: DataFrame, path: str, at: Column, source: str = "auto") -> DataFrame:
    """Adds what an entry is given when recorded (id, checksum, source, month) and appends it to its month."""
    out = rows.withColumn("timestamp", at).withColumn("checksum", checksum(F.col("fileContent"))).withColumn("source", F.lit(source))
    out = out.withColumn("id", F.coalesce("id", F.expr("uuid()"))).withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    out.write.mode("append").partitionBy("workspace", "month").parquet(path)
    return out.sparkSession.read.parquet(path)


def export_history(h: DataFrame, path: str) -> None:
    """The log as JSON lines by workspace and month; entries are never gathered in one value."""
    h.withColumn("month", F.date_format("timestamp", "yyyy-MM")).write.mode("overwrite").partitionBy("workspace", "month").json(path)


def export_documents(h: DataFrame, path: str, at: Column, most: int = 1000) -> None:
    """Export documents {exportedAt, workspace, entries} of about `most` entries, one a line; a workspace with more has several."""
    sizes = h.groupBy("workspace").agg((1 + F.floor(F.count(F.lit(1)) / most)).alias("_parts"))
    rows = h.join(sizes, "workspace").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    entry = F.struct(*[F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp") if c == "timestamp" else F.col(c) for c in h.columns if c != "workspace"])
    docs = rows.groupBy("workspace", "_part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    docs.select(F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("exportedAt"), "workspace", "entries"))).write.mode("overwrite").text(path)


def import_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of export documents {entries: [...]} that have id, timestamp, action and content; with `lines` a document a line."""
    doc = spark.read.schema(f"exportedAt string, workspace string, entries array<struct<{IMPORTED}>>").option("multiLine", not lines).json(path)
    rows = doc.select("exportedAt", "workspace", F.explode("entries").alias("e")).select("exportedAt", "workspace", "e.*")
    complete = F.lit(True)
    for c in ("id", "timestamp", "action", "fileContent"):
        complete &= F.coalesce(F.col(c) != "", F.lit(False))
    return rows.where(complete).withColumn("timestamp", F.to_timestamp("timestamp"))


#: Names after .env. that are no environments.
NO_ENVIRONMENT = ["backup", "example", "template"]


def save_files(files: DataFrame, path: str) -> None:
    """Files of workspaces as rows: path (workspace/...) and fileContent. Spark's readers pass over names that begin with a dot, so such files are kept in a table."""
    files.select("path", "fileContent").write.mode("overwrite").parquet(path)


def env_files(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """Environments among saved files: workspace, environmentName, path, fileContent of workspace/.env.NAME.

    .env itself, copies, examples and templates are no environments, nor is anything
    in a folder below; each workspace shows its first files by name, so many.
    """
    rows = spark.read.schema("path string, fileContent string").parquet(path)
    name = lambda k: F.regexp_extract("path", r"^([^/]+)/\.env\.([^/]+)$", k)
    rows = rows.select(name(1).alias("workspace"), name(2).alias("environmentName"), "path", "fileContent").where("environmentName != ''").where(~F.lower("environmentName").isin(NO_ENVIRONMENT))
    order = Window.partitionBy("workspace").orderBy("environmentName")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


_RULES = "struct<requiredVariables: array<string>, variableTypes: map<string, string>, customValidators: map<string, string>>"
CONFIG = f"""environments map<string, string>, gitBranchMapping map<string, string>, autoSwitchOnBranchChange boolean, validation {_RULES}, validationRules {_RULES},
gitCommitHook struct<blockEnvFiles: boolean, blockSecrets: boolean, blockValidationErrors: boolean, customMessage: string>"""


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """JSON configurations, one row each; what can't be read is an empty configuration."""
    return spark.read.schema(CONFIG).option("multiLine", True).json(path)


def rules_from_config(spark: SparkSession, path: str) -> DataFrame:
    """Rules of one JSON configuration as rows rule_type, variable, arg."""
    c = read_config(spark, path).select(F.coalesce("validation", "validationRules").alias("v"))
    required = c.select(F.explode("v.requiredVariables").alias("variable")).select(F.lit("required").alias("rule_type"), "variable", F.lit(None).cast("string").alias("arg"))
    kinds = [c.select(F.explode(f"v.{m}").alias("variable", "arg")).select(F.lit(t).alias("rule_type"), "variable", "arg") for t, m in (("type", "variableTypes"), ("custom", "customValidators"))]
    return required.unionByName(kinds[0]).unionByName(kinds[1])


def branch_map(config: DataFrame) -> DataFrame:
    """branch, environmentName."""
    return config.select(F.explode("gitBranchMapping").alias("branch", "environmentName"))


def custom_environments(config: DataFrame) -> DataFrame:
    """environmentName, fileName."""
    return config.select(F.explode("environments").alias("environmentName", "fileName"))


def hook_flags(config: DataFrame) -> DataFrame:
    """flag, value: what a commit is blocked for (all, unless said otherwise), and whether branches switch environments (no, unless said)."""
    on = [F.struct(F.lit(f).alias("flag"), F.coalesce(f"gitCommitHook.{f}", F.lit(True)).alias("value")) for f in ("blockEnvFiles", "blockSecrets", "blockValidationErrors")]
    switch = F.struct(F.lit("autoSwitchOnBranchChange").alias("flag"), F.coalesce("autoSwitchOnBranchChange", F.lit(False)).alias("value"))
    return config.select(F.explode(F.array(*on, switch)).alias("x")).select("x.*")


def storage_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def export_json(h: DataFrame, keys: list[str], mask: bool = True) -> DataFrame:
    """One JSON document a snapshot: its variables with value and encryption; secrets are masked."""
    value = F.when(F.lit(mask) & sensitive_key(F.col("key")) & ~F.col("encrypted"), "*** MASKED SECRET ***").otherwise(F.col("value"))
    entry = F.struct("key", F.struct(value.alias("value"), "encrypted", "comment").alias("v"))
    return export_pairs(h, keys).groupBy(*keys).agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("variables"))).alias("document"))


def feedback_sink(rows: DataFrame, path: str, keep: int = 500) -> DataFrame:
    """Appends labelled samples; the view of the table is its newest rows by a top-n, not a rewrite."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path).orderBy(F.desc("timestamp"), F.desc("id")).limit(keep)


def backup(files: DataFrame, path: str, stamp: str) -> None:
    """A timestamped copy of all files."""
    files.withColumn("backup_ts", F.lit(stamp)).write.mode("append").partitionBy("backup_ts").parquet(path)


def list_backups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("backup_ts").cast("string")).distinct().orderBy(F.desc("backup_ts"))


def restore_backup(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("backup_ts").cast("string") == stamp).drop("backup_ts")


def latest_per_key(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
