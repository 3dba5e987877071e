"""Queries over the stored log: batches with their diffs, latest snapshots, retention by parts, month files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.plans.catalog import query
from kvtrail.plans.kv_queries import PREVIOUS, log_with_commits
from kvtrail.plans.views import H
from kvtrail.sources.log import StoredLog, scan_month_files
from kvtrail.sources.scratch import shared_folder

#: The log's times, spread over half a year.
_SPREAD = "timestamp + to_days((id::bigint % 6 * 30)::int)"


def _spread(spark, sf_dir):
    return log_with_commits(spark, sf_dir).withColumn("timestamp", F.expr("timestamp + make_dt_interval(cast(cast(id as bigint) % 6 * 30 as int))"))


def _stored(spark, rows, batches: int = 2) -> StoredLog:
    """The rows in batches by time; each batch is appended a second time, which changes nothing."""
    log = StoredLog(spark, shared_folder(spark, "stored-log"))
    ends = rows.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    place = rows.join(F.broadcast(ends)).withColumn("_k", F.expr(f"cast(least({batches - 1}, {batches} * (unix_micros(timestamp) - unix_micros(a)) div greatest(1, unix_micros(b) - unix_micros(a))) as int)")).drop("a", "b")
    for k in range(batches):
        part = place.where(F.col("_k") == k).drop("_k")
        log.append(k, part)
        log.append(k, part)
    return log


@query("stored_log_diffs", f"with {PREVIOUS.replace('{part}', 'workspace')} select workspace, id, key, status, old_value, new_value, blame_user, blame_timestamp, blame_commit from s")
def stored_log_diffs(spark, sf_dir):
    """The diff that each entry got when it was appended, from the latest snapshots and its batch."""
    rows = _stored(spark, log_with_commits(spark, sf_dir)).read()
    return rows.select("workspace", "id", F.explode("diff").alias("d")).select("workspace", "id", "d.*")


@query("latest_snapshots", f"with {H} select workspace, environmentName, arg_max(id, timestamp) as id, max(timestamp) as timestamp, arg_max(fileContent, timestamp) as fileContent from h group by all")
def latest_snapshots(spark, sf_dir):
    return _stored(spark, log_with_commits(spark, sf_dir), 3).latest().select("workspace", "environmentName", "id", "timestamp", "fileContent")


@query("stored_retention_by_age", f"with {H}, x as (select id, {_SPREAD} as timestamp from h) select id, strftime(timestamp, '%Y-%m') as month from x where timestamp >= (select max(timestamp) from x) - interval 70 day")
def stored_retention_by_age(spark, sf_dir):
    log = _stored(spark, _spread(spark, sf_dir))
    log.keep_days(70)
    return log.read().select("id", "month")


@query("stored_retention_by_count", f"with {H}, x as (select id, workspace, {_SPREAD} as timestamp from h), r as (select *, row_number() over (partition by workspace order by timestamp desc, id desc) as n from x) select workspace, id, strftime(timestamp, '%Y-%m') as month from r where n <= 40")
def stored_retention_by_count(spark, sf_dir):
    log = _stored(spark, _spread(spark, sf_dir))
    log.keep_newest(40)
    return log.read().select("workspace", "id", "month")


#: Entries of a month file, about.
_FILE = 1000


@query("history_month_files", f"with {H}, x as (select id, workspace, {_SPREAD} as timestamp, environmentName, fileContent from h), r as (select *, row_number() over (partition by workspace order by timestamp desc, id) as n from x) select workspace, id, timestamp, environmentName, fileContent from r where n <= 25")
def history_month_files(spark, sf_dir):
    """The 25 newest entries of each workspace, from month files of arrays, of which one can't be read."""
    rows, path = _spread(spark, sf_dir), shared_folder(spark, "month-files")
    rows = rows.withColumn("month", F.date_format("timestamp", "yyyy-MM")).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    parts = 1 + rows.count() // (60 * _FILE)
    entry = F.struct("id", "timestamp", "action", "environmentName", "user", "commitHash", "fileContent")
    arrays = rows.groupBy("workspace", "month", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    arrays.drop("part").write.partitionBy("workspace", "month").text(path)
    spark.range(1).select(F.lit('[{"id": "no end').alias("value"), F.lit("ws_0").alias("workspace"), F.lit("2024-05").alias("month")).write.mode("append").partitionBy("workspace", "month").text(path)
    return scan_month_files(spark, path, 25).rows.select("workspace", "id", "timestamp", "environmentName", "fileContent")
