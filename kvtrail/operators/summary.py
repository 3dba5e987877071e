"""A maintained summary of the log: partial aggregates of each month, and how months are put together.

Months of one workspace follow one another in time, so partials carry what joins them:
first and last change for the gap between two months, the last switch for the
transitions that a month begins with, first and last value of a variable. A change of the
log recomputes the months that it touches; the summary reads partials, not snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvtrail.operators import history as op
from kvtrail.operators.variables import appearances

_MONTH = ["workspace", "month"]


def _dated(log: DataFrame) -> DataFrame:
    return log.withColumn("month", F.date_format("timestamp", "yyyy-MM"))


def _counted(log: DataFrame) -> DataFrame:
    """part, item, n: counts that only add up: by environment, hour, weekday, day, day and hour, action."""
    item = lambda part, value: F.struct(F.lit(part).alias("part"), value.cast("string").alias("item"))
    day, hour = F.date_format("timestamp", "yyyy-MM-dd"), F.hour("timestamp")
    items = F.array(
        item("environment", F.col("environmentName")), item("hour", hour), item("weekday", F.dayofweek("timestamp") - 1), item("day", day),
        item("day and hour", F.concat_ws(" ", day, F.lpad(hour.cast("string"), 2, "0"))), item("action", F.col("action")), item("user", F.col("user")),
    )
    return log.select(*_MONTH, F.explode(items).alias("x")).where("x.item is not null and x.item != ''").groupBy(*_MONTH, "x.part", "x.item").agg(F.count(F.lit(1)).alias("n"))


def _spans(log: DataFrame) -> DataFrame:
    """environmentName, n, first, last, and sum and sum of squares of the gaps in hours within the month."""
    w = Window.partitionBy(*_MONTH, "environmentName").orderBy(*op.ORDER)
    us = F.unix_micros("timestamp")
    rows = log.withColumn("gap", (us - F.lag(us).over(w)) / F.lit(float(op.HOUR_US)))
    square = F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0))
    return rows.groupBy(*_MONTH, "environmentName").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gaps"), square.alias("squares"))


def _moves(log: DataFrame) -> DataFrame:
    """from_env, to_env, n: entries after a switch of the month (from_env null: before its first), and the month's last switch, as rows without to_env."""
    rows = op.last_switch_environment(log.withColumn("_workspace", F.col("workspace")).withColumn("workspace", F.struct("workspace", "month")))
    rows = rows.withColumn("workspace", F.col("_workspace"))
    counts = rows.groupBy(*_MONTH, F.col("previous_env").alias("from_env"), F.col("environmentName").alias("to_env")).agg(F.count(F.lit(1)).alias("n"))
    last = log.where("action = 'switch'").groupBy(*_MONTH).agg(F.max_by("environmentName", F.struct(*op.ORDER)).alias("from_env")).select(*_MONTH, "from_env", F.lit(None).cast("string").alias("to_env"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(last)


def _variables(log: DataFrame) -> DataFrame:
    """key, n, first, last, and first and last value, and changes of the value within the month."""
    seen = _dated(appearances(log))
    w = Window.partitionBy(*_MONTH, "key").orderBy("timestamp", "id")
    rows = seen.withColumn("before", F.lag("value").over(w)).withColumn("turn", F.row_number().over(w))
    at = F.struct("timestamp", "id")
    return rows.groupBy(*_MONTH, "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"),
        F.count_if(F.expr("turn > 1 and not (value <=> before)")).alias("changes"),
    )


PARTIALS = {"counts": _counted, "spans": _spans, "moves": _moves, "variables": _variables}


class MaintainedSummary:
    """Partials below a path, one table for each kind, in partitions of a month."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def update(self, log: DataFrame, months: list[str] | None = None) -> None:
        """Recomputes the partials of some months (all, if not given) from the log; other months keep their files. Repeating it changes nothing.

        A month must come with all its entries; a month that has lost them all needs forget().
        """
        rows = _dated(log)
        if months is not None:
            rows = rows.where(F.col("month").isin(months))
        for name, partial in PARTIALS.items():
            partial(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.path}/{name}")

    def partials(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").withColumn("month", F.col("month").cast("string"))

    def summary(self) -> DataFrame:
        """workspace, part, item, value of every part, from the partials of all months."""
        return summarised({name: self.partials(name) for name in PARTIALS})


def computed(log: DataFrame) -> DataFrame:
    """The same summary without stored partials."""
    rows = _dated(log)
    return summarised({name: partial(rows) for name, partial in PARTIALS.items()})


def _part(df: DataFrame, part: str, item, value) -> DataFrame:
    return df.select("workspace", F.lit(part).alias("part"), item.cast("string").alias("item"), F.round(value.cast("double"), 6).alias("value"))


def summarised(partials: dict[str, DataFrame]) -> DataFrame:
    counts = partials["counts"].groupBy("workspace", "part", "item").agg(F.sum("n").alias("n"))
    out = [counts.select("workspace", "part", "item", F.col("n").cast("double").alias("value"))]
    months = partials["counts"].where("part = 'environment'").groupBy("workspace", "month").agg(F.sum("n").alias("n"))
    out.append(_part(months, "month", F.col("month"), F.col("n")))
    out.append(_part(months.groupBy("workspace").agg(F.sum("n").alias("n")), "total", F.lit("entries"), F.col("n")))
    distinct = counts.where("part in ('environment', 'action', 'user')").groupBy("workspace", "part").agg(F.count(F.lit(1)).alias("n"))
    out.append(_part(distinct, "distinct", F.col("part"), F.col("n")))

    w = Window.partitionBy("workspace", "environmentName").orderBy("month")
    hours = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / F.lit(float(op.HOUR_US))
    spans = partials["spans"].withColumn("link", hours(F.lag("last").over(w), F.col("first")))
    spans = spans.groupBy("workspace", "environmentName").agg(
        F.sum("n").alias("total_changes"), F.min("first").alias("first_change"), F.max("last").alias("last_change"),
        (F.sum("gaps") + F.coalesce(F.sum("link"), F.lit(0.0))).alias("gaps"), (F.sum("squares") + F.coalesce(F.sum(F.col("link") * F.col("link")), F.lit(0.0))).alias("squares"),
    )
    days = hours(F.col("first_change"), F.col("last_change")) / 24
    one, n = F.col("total_changes") == 1, F.col("total_changes") - 1
    env = F.col("environmentName")
    out.append(_part(spans, "changes a day", env, F.when(one, F.lit(0.0)).otherwise(F.try_divide("total_changes", days))))
    out.append(_part(spans, "hours between changes", env, F.when(one, F.lit(0.0)).otherwise(days * 24 / n)))
    mean = F.try_divide("gaps", n)
    variance = F.try_divide("squares", n) - mean * mean
    even = F.greatest(F.lit(0.0), 100 - F.coalesce(variance, F.lit(0.0)) / F.when(F.coalesce(mean, F.lit(0.0)) == 0, 24.0).otherwise(mean) * 50)
    rare = F.coalesce(F.greatest(F.lit(0.0), 100 - F.try_divide("total_changes", days) * 7 * 10), F.lit(0.0))
    out.append(_part(spans, "stability", env, F.when(one, F.lit(100.0)).otherwise(F.round((F.round(even, 6) + F.round(rare, 6)) / 2))))
    ends = spans.groupBy("workspace").agg(F.min("first_change").alias("first"), F.max("last_change").alias("last"))
    for c in ("first", "last"):
        out.append(_part(ends, "range", F.lit(c), F.unix_micros(c) / F.lit(1e6)))

    carried = Window.partitionBy("workspace").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    switch = partials["moves"].where("to_env is null").select("workspace", "month", F.col("from_env").alias("switch"))
    known = months.select("workspace", "month").join(switch, ["workspace", "month"], "left").withColumn("before", F.last("switch", ignorenulls=True).over(carried))
    moves = partials["moves"].where("to_env is not null").join(known.select("workspace", "month", "before"), ["workspace", "month"]).withColumn("from_env", F.coalesce("from_env", "before"))
    moves = moves.where("from_env is not null and from_env != to_env").groupBy("workspace", "from_env", "to_env").agg(F.sum("n").alias("n"))
    out.append(_part(moves, "transition", F.concat_ws(" -> ", "from_env", "to_env"), F.col("n")))

    w = Window.partitionBy("workspace", "key").orderBy("month")
    v = partials["variables"].withColumn("turn", F.row_number().over(w)).withColumn("before", F.lag("last_value").over(w))
    v = v.groupBy("workspace", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), (F.sum("changes") + F.count_if(F.expr("turn > 1 and not (first_value <=> before)"))).alias("value_changes"))
    span = (F.unix_micros("last") - F.unix_micros("first")) / F.lit(float(op.DAY_US))
    key = F.col("key")
    out.append(_part(v, "variable snapshots", key, F.col("n") - 1))
    out.append(_part(v, "variable changes", key, F.col("value_changes")))
    out.append(_part(v, "variable changes a day", key, F.when((F.col("n") > 1) & (span > 0), F.try_divide(F.col("n") - 1, span)).otherwise(0.0)))
    out.append(_part(v.groupBy("workspace").agg(F.count(F.lit(1)).alias("n")), "distinct", F.lit("variable"), F.col("n")))
    union = out[0]
    for x in out[1:]:
        union = union.unionByName(x)
    return union
