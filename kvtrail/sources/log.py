"""The stored log: batches of entries by month, the latest snapshots, retention; and month files of JSON arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvtrail.functions.secrets import checksum
from kvtrail.operators.diff import BLAME, merged_pairs, with_pairs
from kvtrail.sources.io import HISTORY
from kvtrail.sources.scratch import delete, exists

_DIFF = "array<struct<key: string, status: string, old_value: string, new_value: string, blame_user: string, blame_timestamp: timestamp, blame_commit: string>>"
ENTRY = f"""id string, timestamp timestamp, workspace string, environmentName string, action string, user string, commitHash string, reason string,
fileContent string, checksum string, source string, diff {_DIFF}"""
_LATEST = "workspace string, environmentName string, id string, timestamp timestamp, user string, commitHash string, fileContent string"


class StoredLog:
    """A log below a path. entries/month=M/batch=B holds entries, latest/batch=B the newest entry of each workspace and environment.

    A batch counts once it has its marker below commits; until then it can be appended
    again, and overwrites what it left. Readers see committed batches only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.entries = f"{self.path}/entries"

    def _committed(self) -> list[int]:
        """Numbers of the batches that count: names of folders, as many as batches were appended."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in files.listStatus(where)) if files.exists(where) else []

    def read(self) -> DataFrame:
        """All entries, with month and batch."""
        done = self._committed()
        if not done or not exists(self.spark, self.entries):
            return self.spark.createDataFrame([], f"{ENTRY}, month string, batch int")
        rows = self.spark.read.schema(f"{ENTRY}, month string, batch int").option("basePath", self.entries).parquet(self.entries)
        return rows.where(F.col("batch").isin(done))

    def latest(self) -> DataFrame:
        """The newest entry of each workspace and environment."""
        done = self._committed()
        if not done:
            return self.spark.createDataFrame([], _LATEST)
        return self.spark.read.schema(_LATEST).parquet(f"{self.path}/latest/batch={done[-1]}")

    def append(self, batch: int, rows: DataFrame, source: str = "auto") -> bool:
        """Adds entries and what each is given when recorded: checksum, source and the diff against the workspace's entry before it.

        rows has the columns of ENTRY up to fileContent. The entry before comes from the
        batch, or from the latest snapshots, one row for each environment, not from the
        log; the workspace's first entry has no diff. Batches are numbered upwards; False, and no change,
        if the batch, or a later one, is in the log already.
        """
        done = self._committed()
        if done and batch <= done[-1]:
            return False
        latest = self.latest()
        newest = latest.groupBy("workspace").agg(F.max_by(F.struct(*[c for c in latest.columns if c != "workspace"]), F.struct("timestamp", "id")).alias("x")).select("workspace", "x.*")
        both = rows.withColumn("_new", F.lit(True)).unionByName(newest.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        w = Window.partitionBy("workspace").orderBy("_new", "timestamp", "id")
        seen = with_pairs(both, "_kv").withColumn("_before", F.lag(F.struct("_kv", *BLAME)).over(w)).where("_new").withColumn("_row", F.monotonically_increasing_id())
        pairs = seen.where("_before is not null").select("workspace", "id", "_row", F.col("_before._kv").alias("_old"), "_kv", *(F.col(f"_before.{c}").alias(f"_{c}") for c in BLAME))
        changed = F.col("status") == "changed"
        change = F.struct("key", "status", "old_value", "new_value", *(F.when(changed, F.col(f"_{c}")).alias(a) for c, a in zip(BLAME, ("blame_user", "blame_timestamp", "blame_commit"), strict=True)))
        diffs = merged_pairs(pairs, "_old", "_kv").groupBy("workspace", "id", "_row").agg(F.array_sort(F.collect_list(change)).alias("diff"))
        out = seen.join(diffs, ["workspace", "id", "_row"], "left").withColumn("diff", F.when(F.col("_before").isNotNull(), F.coalesce("diff", F.expr(f"cast(array() as {_DIFF})"))))
        out = out.withColumn("checksum", checksum(F.col("fileContent"))).withColumn("source", F.lit(source)).withColumn("month", F.date_format("timestamp", "yyyy-MM")).withColumn("batch", F.lit(batch))
        names = [f.name for f in self.spark.createDataFrame([], ENTRY).schema]
        out.select(*names, "month", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(self.entries)
        kept = latest.unionByName(rows.select(*latest.columns)).groupBy("workspace", "environmentName")
        columns = [c for c in latest.columns if c not in ("workspace", "environmentName")]
        now = kept.agg(F.max_by(F.struct(*columns), F.struct("timestamp", "id")).alias("x")).select("workspace", "environmentName", "x.*")
        now.write.mode("overwrite").parquet(f"{self.path}/latest/batch={batch}")
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        for old in done:
            delete(self.spark, f"{self.path}/latest/batch={old}")
        return True

    def keep_days(self, days: int, now: Column | None = None) -> int:
        """Drops entries older than some days before now (or the newest entry); returns how many went.

        Older months go as folders, only the month of the boundary is written anew, all others keep their files.
        """
        rows = self.read()
        newest = rows.agg(F.max("timestamp").alias("t")) if now is None else self.spark.range(1).select(now.alias("t"))
        cut = newest.select((F.col("t") - F.make_dt_interval(F.lit(days))).alias("cut"), F.date_format(F.col("t") - F.make_dt_interval(F.lit(days)), "yyyy-MM").alias("month")).first()
        if cut["cut"] is None:
            return 0
        plan = rows.where(F.col("month") < cut["month"]).groupBy("month", "batch").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("left"))
        edge = rows.where(F.col("month") == cut["month"]).groupBy("month", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("timestamp") >= cut["cut"]).alias("left"))
        return self._rewrite(plan.unionByName(edge), lambda x: x.where(F.col("timestamp") >= cut["cut"]))

    def keep_newest(self, most: int) -> int:
        """Keeps the newest entries of each workspace, so many; returns how many went.

        Counts of workspace, month and batch tell which parts go, stay, or hold a boundary; entries are ordered in the boundary's months only.
        """
        rows = self.read()
        counts = rows.groupBy("workspace", "month").agg(F.count(F.lit(1)).alias("n"))
        newer = F.sum("n").over(Window.partitionBy("workspace").orderBy(F.desc("month"))) - F.col("n")
        marks = counts.select("workspace", "month", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(most) - newer)).alias("quota"), "n").where("quota < n")
        order = Window.partitionBy("workspace", "month").orderBy(F.desc("timestamp"), F.desc("id"))
        hit = rows.join(marks.select("workspace", "month", "quota"), ["workspace", "month"], "left")
        whole = hit.where("quota is null or quota = 0").withColumn("_keep", F.col("quota").isNull())
        cut = hit.where("quota > 0").withColumn("_keep", F.row_number().over(order) <= F.col("quota"))
        marked = whole.unionByName(cut)
        months = [r["month"] for r in marks.select("month").distinct().collect()]  # months of the log, at most
        marked = marked.where(F.col("month").isin(months))
        plan = marked.groupBy("month", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if("_keep").alias("left"))
        return self._rewrite(plan, lambda _: marked.where("_keep"))

    def _rewrite(self, plan: DataFrame, keep) -> int:
        """plan: month, batch, n, left of each part that may change; keep: the rows that stay, from those of the parts that are cut."""
        parts = plan.collect()  # one row for each folder
        gone, cut = [p for p in parts if p["left"] == 0], [p for p in parts if 0 < p["left"] < p["n"]]
        if cut:
            here = F.concat_ws("/", "month", "batch").isin([f"{p['month']}/{p['batch']}" for p in cut])
            keep(self.read().where(F.col("month").isin([p["month"] for p in cut]))).where(here).select(*self.read().columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(self.entries)
        for p in gone:
            delete(self.spark, f"{self.entries}/month={p['month']}/batch={p['batch']}")
        return sum(p["n"] - p["left"] for p in parts)


@dataclass
class MonthScan:
    """rows: entries, with workspace and month. skipped: paths of files that are no array of entries. months: those read, newest first."""

    rows: DataFrame
    skipped: DataFrame
    months: list[str]


_PLACE = r"([^/]+)/(?:month=)?([0-9]{4}-[0-9]{2})(?:\.json|/[^/]+)$"


def scan_month_files(spark: SparkSession, path: str, limit: int | None = None) -> MonthScan:
    """Entries of month files, one JSON array each, named workspace/yyyy-MM.json or workspace=W/month=yyyy-MM/any.

    Files are listed without being read. With a limit, the newest months are read first,
    only for workspaces that have fewer entries so far, and rows are each
    workspace's newest entries. A file that can't be parsed is named in skipped and left out, an entry without
    an id too; a time that can't be read is null.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    place = lambda k: F.regexp_extract("path", _PLACE, k)
    files = listed.select("path", F.regexp_replace(place(1), "^workspace=", "").alias("workspace"), place(2).alias("month")).where("month != ''")
    if limit is None:
        months = [r["month"] for r in files.select("month").distinct().orderBy(F.desc("month")).collect()]
        return _read_arrays(spark, [r["path"] for r in files.select("path").collect()], months)
    rows = skipped = None
    short, months = {r["workspace"]: limit for r in files.select("workspace").distinct().collect()}, []  # as many as folders
    for month in [r["month"] for r in files.select("month").distinct().orderBy(F.desc("month")).collect()]:
        if not short:
            break
        found = [r for r in files.where(F.col("month") == month).select("path", "workspace").collect() if r["workspace"] in short]
        if not found:
            continue
        part = _read_arrays(spark, [r["path"] for r in found], [month])
        months.append(month)
        rows, skipped = (part.rows, part.skipped) if rows is None else (rows.unionByName(part.rows), skipped.unionByName(part.skipped))
        for r in part.rows.groupBy("workspace").count().collect():
            short[r["workspace"]] -= r["count"]
        short = {k: n for k, n in short.items() if n > 0}
    if rows is None:
        return _read_arrays(spark, [], [])
    newest = Window.partitionBy("workspace").orderBy(F.desc_nulls_last("timestamp"), "id")
    return MonthScan(rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n"), skipped, months)


def _read_arrays(spark: SparkSession, paths: list[str], months: list[str]) -> MonthScan:
    schema = HISTORY.replace("timestamp timestamp", "timestamp string") + ", _broken string"
    if not paths:
        none = spark.createDataFrame([], f"{HISTORY}, workspace string, month string, path string")
        return MonthScan(none.drop("path"), none.select("path"), months)
    raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(paths).withColumn("path", F.col("_metadata.file_path"))
    place = lambda k: F.regexp_extract("path", _PLACE, k)
    rows = raw.where("id is not null").withColumn("timestamp", F.expr("try_cast(timestamp as timestamp)"))
    rows = rows.withColumn("workspace", F.regexp_replace(place(1), "^workspace=", "")).withColumn("month", place(2)).drop("_broken", "path")
    return MonthScan(rows, raw.where("_broken is not null and id is null").select("path").distinct(), months)
