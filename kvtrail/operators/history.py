"""Aggregates and ordered operators over the snapshot log. All work per workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.functions import kv

ORDER = ["timestamp", "id"]
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def environment_frequency(h: DataFrame) -> DataFrame:
    """workspace, environmentName, changes."""
    return h.groupBy("workspace", "environmentName").agg(F.count(F.lit(1)).alias("changes"))


def peak_hours(h: DataFrame) -> DataFrame:
    """workspace, hour (0-23, session time zone), changes."""
    return h.groupBy("workspace", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("changes"))


def peak_days(h: DataFrame) -> DataFrame:
    """workspace, weekday (0 is Sunday), changes."""
    return h.groupBy("workspace", (F.dayofweek("timestamp") - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("changes"))


def last_switch_environment(h: DataFrame) -> DataFrame:
    """Adds previous_env: the environment of the latest earlier row with action 'switch'."""
    before = Window.partitionBy("workspace").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("previous_env", F.last(F.when(F.col("action") == "switch", F.col("environmentName")), ignorenulls=True).over(before))


def transition_matrix(h: DataFrame) -> DataFrame:
    """workspace, from_env, to_env, transitions."""
    moved = last_switch_environment(h).where("previous_env is not null and previous_env != environmentName")
    return moved.groupBy("workspace", F.col("previous_env").alias("from_env"), F.col("environmentName").alias("to_env")).agg(F.count(F.lit(1)).alias("transitions"))


def top_k(df: DataFrame, k: int, by: list[Column], per: str = "workspace", rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the given order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(per).orderBy(*by))).where(F.col(rank) <= k)


def common_transitions(h: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent transitions of each workspace; percentage is of all its rows."""
    totals = h.groupBy("workspace").agg(F.count(F.lit(1)).alias("total"))
    best = top_k(transition_matrix(h), k, [F.desc("transitions"), F.col("from_env"), F.col("to_env")])
    return best.join(totals, "workspace").select("workspace", "rank", "from_env", "to_env", "transitions", F.round(F.col("transitions") * 100.0 / F.col("total"), 6).alias("percentage"))


def gaps(h: DataFrame) -> DataFrame:
    """Adds gap_hours since the previous row of the same workspace and environment (null for the first)."""
    w = Window.partitionBy("workspace", "environmentName").orderBy(*ORDER)
    return h.withColumn("gap_hours", (F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(w)) / F.lit(float(HOUR_US)))


def change_span(h: DataFrame) -> DataFrame:
    """workspace, environmentName, total_changes, first_change, last_change."""
    return h.groupBy("workspace", "environmentName").agg(F.count(F.lit(1)).alias("total_changes"), F.min("timestamp").alias("first_change"), F.max("timestamp").alias("last_change"))


def _span_us() -> Column:
    return F.unix_micros("last_change") - F.unix_micros("first_change")


def churn_rate(h: DataFrame) -> DataFrame:
    """Changes a day: 0 for a single change, null where several fall on one instant."""
    rate = F.when(F.col("total_changes") == 1, F.lit(0.0)).otherwise(F.try_divide("total_changes", _span_us() / F.lit(float(DAY_US))))
    return change_span(h).select("workspace", "environmentName", F.round(rate, 6).alias("churn_rate"))


def average_gap(h: DataFrame) -> DataFrame:
    """Mean hours between changes: the span by the number of gaps; 0 for a single change."""
    mean = F.when(F.col("total_changes") == 1, F.lit(0.0)).otherwise(_span_us() / F.lit(float(HOUR_US)) / (F.col("total_changes") - 1))
    return change_span(h).select("workspace", "environmentName", F.round(mean, 6).alias("avg_gap_hours"))


def stability_score(h: DataFrame) -> DataFrame:
    """0-100 from the evenness of gaps and the weekly rate; 100 for a single change."""
    g = gaps(h).groupBy("workspace", "environmentName").agg(
        F.count(F.lit(1)).alias("total_changes"), F.avg("gap_hours").alias("mean_gap"), F.var_pop("gap_hours").alias("gap_variance"),
        F.min("timestamp").alias("first_change"), F.max("timestamp").alias("last_change"),
    )
    mean = F.when(F.coalesce(F.col("mean_gap"), F.lit(0.0)) == 0, F.lit(24.0)).otherwise(F.col("mean_gap"))
    even = F.greatest(F.lit(0.0), 100 - F.coalesce("gap_variance", F.lit(0.0)) / mean * 50)
    weekly = F.try_divide(F.col("total_changes"), _span_us() / F.lit(float(DAY_US))) * 7
    rare = F.coalesce(F.greatest(F.lit(0.0), 100 - weekly * 10), F.lit(0.0))
    score = F.when(F.col("total_changes") == 1, F.lit(100.0)).otherwise(F.round((F.round(even, 9) + F.round(rare, 9)) / 2))
    return g.select("workspace", "environmentName", score.cast("int").alias("stability"))


def heatmap(h: DataFrame) -> DataFrame:
    """Counts by month, by day and by day and hour in one pass; level names the grouping."""
    base = h.select("workspace", F.date_format("timestamp", "yyyy-MM").alias("month"), F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour"))
    out = base.groupingSets([["workspace", "month"], ["workspace", "day"], ["workspace", "day", "hour"]], "workspace", "month", "day", "hour").agg(F.count(F.lit(1)).alias("changes"))
    level = F.when(F.col("month").isNotNull(), "month").when(F.col("hour").isNotNull(), "hour").otherwise("day")
    return out.select("workspace", level.alias("level"), F.coalesce("month", F.date_format("day", "yyyy-MM-dd")).alias("period"), F.coalesce("hour", F.lit(-1)).alias("hour"), "changes")


def dense_calendar(h: DataFrame, days: int = 30) -> DataFrame:
    """Every one of the last days before the log's end, with its count, intensity and colour bucket."""
    last = h.agg(F.to_date(F.max("timestamp")).alias("last"))
    spaces = h.select("workspace").distinct()
    frame = spaces.join(F.broadcast(last)).select("workspace", F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    counts = h.groupBy("workspace", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    intensity = F.least(n / 5.0, F.lit(1.0))
    bucket = F.when(intensity == 0, 0).when(intensity < 0.25, 1).when(intensity < 0.5, 2).when(intensity < 0.75, 3).otherwise(4)
    return frame.join(counts, ["workspace", "day"], "left").select("workspace", "day", n.alias("changes"), F.round(intensity, 6).alias("intensity"), bucket.alias("bucket"))


def timeline_position(h: DataFrame) -> DataFrame:
    """Index of each row in its workspace and its place between first and last row, 0 to 1."""
    w = Window.partitionBy("workspace")
    t = F.unix_micros("timestamp")
    x = (t - F.min(t).over(w)) / F.greatest(F.lit(1000), F.max(t).over(w) - F.min(t).over(w))
    return h.select("workspace", "id", (F.row_number().over(w.orderBy(*ORDER)) - 1).alias("position"), F.round(x, 6).alias("x"))


def timeline_span(h: DataFrame) -> DataFrame:
    """Days from first to last row, rounded up."""
    return h.groupBy("workspace").agg(F.ceil((F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / float(DAY_US)).alias("span_days"))


def stats_by_action(h: DataFrame) -> DataFrame:
    """Rows, oldest and newest of each action, and of all (action 'all')."""
    out = h.rollup("workspace", "action").agg(F.count(F.lit(1)).alias("entries"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"), F.grouping("action").alias("g"), F.grouping("workspace").alias("gw"))
    return out.where("gw = 0").select("workspace", F.when(F.col("g") == 1, "all").otherwise(F.col("action")).alias("action"), "entries", "oldest", "newest")


def data_range(h: DataFrame) -> DataFrame:
    """One row of totals over the whole log; nulls and 0 if it is empty."""
    return h.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("total"), F.countDistinct("environmentName").alias("environments"))


def format_hour(hour: Column) -> Column:
    """12 AM to 11 PM."""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.when(hour < 12, " AM").otherwise(" PM"))


def retention_by_age(h: DataFrame, days: int = 180) -> DataFrame:
    """Rows not older than some days before the log's newest row."""
    newest = h.agg((F.max("timestamp") - F.make_dt_interval(F.lit(days))).alias("cut"))
    return h.join(F.broadcast(newest), h.timestamp >= F.col("cut")).drop("cut")


def retention_by_count(h: DataFrame, most: int = 1000) -> DataFrame:
    """The newest rows of each workspace."""
    return top_k(h, most, [F.desc("timestamp"), F.desc("id")]).drop("rank")


def rollback(h: DataFrame, entry_id: str, at: Column, reason: str | None = None) -> DataFrame:
    """The row that going back to an entry appends: its content under action 'rollback'."""
    old = h.where(F.col("id") == entry_id)
    text = F.lit(reason) if reason else F.concat(F.lit("Rolled back to "), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return old.select("workspace", "environmentName", F.lit("rollback").alias("action"), F.col("environmentName").alias("previousEnvironment"), text.alias("reason"), at.alias("timestamp"), "fileContent")


def content_as_of(h: DataFrame, at: Column) -> DataFrame:
    """Content of each workspace and environment at an instant."""
    return h.where(F.col("timestamp") <= at).groupBy("workspace", "environmentName").agg(F.max_by("fileContent", F.struct(*ORDER)).alias("fileContent"))


def facets(h: DataFrame) -> DataFrame:
    """Distinct non-empty values of user, environment, action and variable, one row each."""
    kinds = F.array(F.struct(F.lit("user").alias("facet"), F.col("user").alias("value")), F.struct(F.lit("environment").alias("facet"), F.col("environmentName").alias("value")), F.struct(F.lit("action").alias("facet"), F.col("action").alias("value")))
    keys = kv.assignments(h.select("fileContent")).select(F.lit("variable").alias("facet"), F.col("key").alias("value"))
    return h.select(F.explode(kinds).alias("f")).select("f.facet", "f.value").unionByName(keys).where("value is not null and value != ''").distinct()


def filter_stats(h: DataFrame) -> DataFrame:
    """One row: how many entries, users, environments, actions and variables there are, and the ends of the log."""
    ends = h.agg(F.count(F.lit(1)).alias("total"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    counts = facets(h).agg(*(F.count_if(F.col("facet") == f).alias(f"{f}s") for f in ("user", "environment", "action", "variable")))
    return counts.join(F.broadcast(ends))
