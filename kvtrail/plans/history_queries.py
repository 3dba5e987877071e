"""Queries over the snapshot log: aggregates, windows, top lists and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.operators import history as op
from kvtrail.plans.catalog import query
from kvtrail.plans.views import H, H_FINE, H_TINY, history, table, tiny_history

_SWITCH = """w as (select *, last_value(case when action = 'switch' then environmentName end ignore nulls) over (partition by workspace order by timestamp, id rows between unbounded preceding and 1 preceding) as previous_env from h)"""
_MOVES = _SWITCH + ", m as (select workspace, previous_env as from_env, environmentName as to_env, count(*) as transitions from w where previous_env is not null and previous_env <> environmentName group by all)"
_SPAN = "s as (select workspace, environmentName, count(*) as total_changes, min(timestamp) as first_change, max(timestamp) as last_change, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) as us from h group by all)"


def _simple(name, f, sql, fine=False):
    query(name, f"with {H_FINE if fine else H}{sql}")(lambda spark, sf_dir: f(history(spark, sf_dir, fine)))


_simple("environment_frequency", op.environment_frequency, " select workspace, environmentName, count(*) as changes from h group by all")
_simple("peak_hours", op.peak_hours, " select workspace, hour(timestamp)::int as hour, count(*) as changes from h group by all")
_simple("peak_days", op.peak_days, " select workspace, dayofweek(timestamp)::int as weekday, count(*) as changes from h group by all")
_simple("transition_matrix", op.transition_matrix, f", {_MOVES} select * from m")
_simple("common_transitions", op.common_transitions, f""", {_MOVES}, t as (select workspace, count(*) as total from h group by 1),
r as (select *, row_number() over (partition by workspace order by transitions desc, from_env, to_env)::int as rank from m)
select workspace, rank, from_env, to_env, transitions, round(transitions * 100.0::double / total, 6) as percentage from r join t using (workspace) where rank <= 10""")
_simple("last_switch_env", lambda h: op.last_switch_environment(h).select("id", "workspace", "previous_env"), f", {_SWITCH} select id, workspace, previous_env from w")
_simple("inter_change_gap", lambda h: op.gaps(h).select("id", F.round("gap_hours", 6).alias("gap_hours")), """ select id,
round((epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by workspace, environmentName order by timestamp, id)) / 3600000000.0::double, 6) as gap_hours from h""")
_simple("change_span", op.change_span, f", {_SPAN} select workspace, environmentName, total_changes, first_change, last_change from s")
for _name, _fine in (("", False), ("_fine", True)):
    _simple("churn_rate" + _name, op.churn_rate, f", {_SPAN} select workspace, environmentName, round(case when total_changes = 1 then 0 when us = 0 then null else total_changes / (us / 86400000000.0::double) end, 6) as churn_rate from s", _fine)
    _simple("avg_time_between_changes" + _name, op.average_gap, f", {_SPAN} select workspace, environmentName, round(case when total_changes = 1 then 0 else us / 3600000000.0::double / (total_changes - 1) end, 6) as avg_gap_hours from s", _fine)
STABILITY = """, sg as (select *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by workspace, environmentName order by timestamp, id)) / 3600000000.0::double as gap from h),
sa as (select workspace, environmentName, count(*) as n, coalesce(avg(gap), 0) as mean, coalesce(var_pop(gap), 0) as v, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0::double as days from sg group by all),
st as (select workspace, environmentName, (case when n = 1 then 100 else round((round(greatest(0, 100 - v / (case when mean = 0 then 24 else mean end) * 50), 9)
  + round(case when days = 0 then 0 else greatest(0, 100 - n / days * 7 * 10) end, 9)) / 2) end)::int as stability from sa)"""
_STABLE = STABILITY + " select * from st"
_simple("stability_score", op.stability_score, _STABLE)
_simple("stability_score_fine", op.stability_score, _STABLE, True)
query("stability_score_tiny", f"with {H_TINY}{_STABLE}")(lambda spark, sf_dir: op.stability_score(tiny_history(spark, sf_dir)))
_simple("activity_heatmap", op.heatmap, """, b as (select workspace, strftime(timestamp, '%Y-%m') as month, timestamp::date as day, hour(timestamp)::int as hour from h)
select workspace, 'month' as level, month as period, -1 as hour, count(*) as changes from b group by workspace, month
union all select workspace, 'day', strftime(day, '%Y-%m-%d'), -1, count(*) from b group by workspace, day
union all select workspace, 'hour', strftime(day, '%Y-%m-%d'), hour, count(*) from b group by workspace, day, hour""")
_simple("dense_calendar", lambda h: op.dense_calendar(h).withColumn("day", F.date_format("day", "yyyy-MM-dd")), """, l as (select max(timestamp)::date as last from h), f as (select workspace, unnest(generate_series(last - interval 29 day, last, interval 1 day))::date as day from (select distinct workspace from h), l),
c as (select workspace, timestamp::date as day, count(*) as n from h group by all),
x as (select f.workspace, f.day, coalesce(n, 0) as changes, least(coalesce(n, 0) / 5.0::double, 1.0) as i from f left join c using (workspace, day))
select workspace, strftime(day, '%Y-%m-%d') as day, changes, round(i, 6) as intensity, (case when i = 0 then 0 when i < 0.25 then 1 when i < 0.5 then 2 when i < 0.75 then 3 else 4 end)::int as bucket from x""")
_simple("timeline_position", op.timeline_position, """ select workspace, id, (row_number() over (partition by workspace order by timestamp, id) - 1)::int as position,
round((epoch_us(timestamp) - min(epoch_us(timestamp)) over (partition by workspace)) / greatest(1000, max(epoch_us(timestamp)) over (partition by workspace) - min(epoch_us(timestamp)) over (partition by workspace))::double, 6) as x from h""")
_simple("timeline_span", op.timeline_span, " select workspace, ceil((max(epoch_us(timestamp)) - min(epoch_us(timestamp))) / 86400000000.0::double)::bigint as span_days from h group by 1")
_simple("stats_by_action", op.stats_by_action, """ select workspace, case when grouping(action) = 1 then 'all' else action end as action, count(*) as entries, min(timestamp) as oldest, max(timestamp) as newest
from h group by grouping sets ((workspace, action), (workspace))""")
_simple("data_range", op.data_range, ' select min(timestamp) as start, max(timestamp) as "end", count(*) as total, count(distinct environmentName) as environments from h')
_simple("top_environments", lambda h: op.top_k(op.environment_frequency(h), 5, [F.desc("changes"), F.col("environmentName")]), """, c as (select workspace, environmentName, count(*) as changes from h group by all),
r as (select *, row_number() over (partition by workspace order by changes desc, environmentName)::int as rank from c) select * from r where rank <= 5""")
_simple("peak_hours_ranked", lambda h: op.top_k(op.peak_hours(h), 3, [F.desc("changes"), F.col("hour")]).withColumn("label", op.format_hour(F.col("hour"))), """, c as (select workspace, hour(timestamp)::int as hour, count(*) as changes from h group by all),
r as (select *, row_number() over (partition by workspace order by changes desc, hour)::int as rank from c)
select *, (case when hour % 12 = 0 then 12 else hour % 12 end) || case when hour < 12 then ' AM' else ' PM' end as label from r where rank <= 3""")
_FACETS = """, fa as (select distinct facet, value from (select 'user' as facet, "user" as value from h union all select 'environment', environmentName from h union all select 'action', action from h
union all select 'variable', trim(l[:strpos(l, '=') - 1]) from (select trim(unnest(string_split(fileContent, chr(10)))) as l from h) where l not like '#%' and strpos(l, '=') > 0) where value is not null and value <> '')"""
_simple("facets", op.facets, _FACETS + " select * from fa")
_simple("filter_stats", op.filter_stats, _FACETS + """ select (select count(*) from fa where facet = 'user') as users, (select count(*) from fa where facet = 'environment') as environments, (select count(*) from fa where facet = 'action') as actions,
(select count(*) from fa where facet = 'variable') as variables, count(*) as total, min(timestamp) as oldest, max(timestamp) as newest from h""")
_simple("retention_by_age", lambda h: op.retention_by_age(h, 10).select("id", "timestamp"), " select id, timestamp from h where timestamp >= (select max(timestamp) from h) - interval 10 day")
_simple("retention_by_count", lambda h: op.retention_by_count(h, 100).select("workspace", "id"), ", r as (select workspace, id, row_number() over (partition by workspace order by timestamp desc, id desc) as n from h) select workspace, id from r where n <= 100")
_simple("rollback_as_of", lambda h: op.rollback(h, "17", F.lit("2024-02-01 00:00:00").cast("timestamp")), """ select workspace, environmentName, 'rollback' as action, environmentName as previousEnvironment,
'Rolled back to ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as reason, timestamp '2024-02-01 00:00:00' as timestamp, fileContent from h where id = '17'""")
_simple("content_as_of", lambda h: op.content_as_of(h, F.lit("2024-01-20 00:00:00").cast("timestamp")), " select workspace, environmentName, arg_max(fileContent, timestamp) as fileContent from h where timestamp <= timestamp '2024-01-20 00:00:00' group by all")
_simple("history_point_lookup", lambda h: h.where("id = '42'"), " select * from h where id = '42'")
_simple("newest_first", lambda h: h.orderBy(F.desc("timestamp"), "id").limit(50).select("id", "timestamp"), " select id, timestamp from h order by timestamp desc, id limit 50")
_simple("previous_snapshot_any", lambda h: h.select("id", F.lag("id").over(op.Window.partitionBy("workspace").orderBy(*op.ORDER)).alias("previous_id")), " select id, lag(id) over (partition by workspace order by timestamp, id) as previous_id from h")
_simple("previous_snapshot_same_env", lambda h: h.select("id", F.lag("id").over(op.Window.partitionBy("workspace", "environmentName").orderBy(*op.ORDER)).alias("previous_id")), " select id, lag(id) over (partition by workspace, environmentName order by timestamp, id) as previous_id from h")


def _bars(spark, sf_dir):
    """Environments of each workspace with bars against the largest."""
    c = op.top_k(op.environment_frequency(history(spark, sf_dir)), 8, [F.desc("changes"), F.col("environmentName")])
    return c.withColumn("percent", F.round(F.col("changes") * 100.0 / F.max("changes").over(op.Window.partitionBy("workspace"))).cast("int"))


query("dashboard_top_environments", f"""with {H}, c as (select workspace, environmentName, count(*) as changes from h group by all),
r as (select *, row_number() over (partition by workspace order by changes desc, environmentName)::int as rank from c)
select *, round(changes * 100.0::double / max(changes) over (partition by workspace))::int as percent from r where rank <= 8""")(_bars)


def _scan_log(spark, sf_dir):
    """Events as a scan log: one scan a row, its time from the value."""
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").cast("double").alias("scan_time"))


@query("scan_metrics", """with l as (select max(ts) as r from events), s as (select ts, value::double as v, r from events, l where ts >= r - interval 24 hour)
select count(*) as total_scans, round(avg(v), 2) as avg_scan_time, round(count(*) filter (where ts >= r - interval 5 minute) / count(*)::double, 6) as hit_ratio from s""")
def scan_metrics(spark, sf_dir):
    log = _scan_log(spark, sf_dir)
    ref = log.agg(F.max("timestamp").alias("ref"))
    day = log.join(F.broadcast(ref), F.expr("timestamp >= ref - interval 24 hours"))
    return day.agg(F.count(F.lit(1)).alias("total_scans"), F.round(F.avg("scan_time"), 2).alias("avg_scan_time"), F.round(F.try_divide(F.expr("count_if(timestamp >= ref - interval 5 minutes)"), F.count(F.lit(1))), 6).alias("hit_ratio"))


@query("cache_info", "select count(*) as entries, min(ts) as oldest, max(ts) as newest, round(avg(value::double), 6) as avg_scan_time from events")
def cache_info(spark, sf_dir):
    return _scan_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("entries"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"), F.round(F.avg("scan_time"), 6).alias("avg_scan_time"))


@query("scan_log_compaction", "with r as (select event_id, row_number() over (order by ts, event_id) as n, count(*) over () as c from events) select event_id from r where c < 1000 or n > 0.2 * c")
def scan_log_compaction(spark, sf_dir):
    """Once there are 1000 scans, the oldest fifth goes.

    Scans are counted by the minute; the running sum of those counts tells the minute of
    the boundary scan, and only that minute's scans are ordered to find it.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    minutes = e.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    total = minutes.agg(F.sum("n")).first()[0] or 0
    drop = int(0.2 * total) if total >= 1000 else 0
    if not drop:
        return e.select("event_id")
    upto = minutes.withColumn("upto", F.sum("n").over(op.Window.orderBy("minute")))  # a row for each minute
    at = upto.where(F.col("upto") >= drop).orderBy("minute").select("minute", (drop - F.col("upto") + F.col("n")).alias("left")).first()
    edge = e.where(F.date_trunc("minute", "ts") == F.lit(at.minute)).orderBy("ts", "event_id").limit(at.left).agg(F.max(F.struct("ts", "event_id")).alias("edge"))
    return e.join(F.broadcast(edge), F.struct("ts", "event_id") > F.col("edge")).select("event_id")
