"""Life of single variables over the snapshot log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.functions import kv


def appearances(log: DataFrame) -> DataFrame:
    """workspace, key, value, timestamp, id and more of each snapshot that holds a key."""
    meta = ["workspace", "id", "timestamp", "environmentName", "user", "reason"]
    return kv.history_pairs(log, meta)


def change_frequency(seen: DataFrame) -> DataFrame:
    """Snapshots holding the variable but the first; first and last seen; current value; changes a day."""
    days = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / F.lit(86_400_000_000.0)
    n = F.count(F.lit(1)) - 1
    velocity = F.when((n > 0) & (days > 0), F.try_divide(n, days)).otherwise(0.0)
    current = F.nullif(F.max_by("value", F.struct("timestamp", "id")), F.lit(""))
    return seen.groupBy("workspace", "key").agg(n.alias("changes"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_changed"), current.alias("current_value"), F.round(velocity, 6).alias("velocity"))


def lifecycle(seen: DataFrame) -> DataFrame:
    """Distinct values in the order of their first use, without the last of these; values are deduplicated before they meet."""
    first = seen.groupBy("workspace", "key", "value").agg(F.min(F.struct("timestamp", "id")).alias("at"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    all_values = first.groupBy("workspace", "key").agg(values.alias("v"))
    return all_values.select("workspace", "key", F.expr("slice(v, 1, greatest(0, size(v) - 1))").alias("previous_values"))


def value_changes(seen: DataFrame) -> DataFrame:
    """How often the value really changed, in order of the snapshots of a workspace."""
    w = Window.partitionBy("workspace", "key").orderBy("timestamp", "id")
    rows = seen.withColumn("before", F.lag("value").over(w)).withColumn("turn", F.row_number().over(w))
    return rows.groupBy("workspace", "key").agg(F.count_if(F.expr("turn > 1 and not (value <=> before)")).alias("value_changes"))
