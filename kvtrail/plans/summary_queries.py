"""The maintained summary of the log, updated month by month, against one computation over all of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.operators.summary import MaintainedSummary, computed
from kvtrail.plans.catalog import query
from kvtrail.plans.history_queries import _MOVES
from kvtrail.plans.kv_queries import _ASSIGN, _SEEN
from kvtrail.plans.views import history
from kvtrail.sources.scratch import shared_folder

# the fine log, its times spread over half a year
_LOG = _ASSIGN.replace("ts as timestamp", "ts + to_days((event_id % 6 * 30)::int) as timestamp").replace("'ws_' || (user_id % 10)", "'user_' || user_id")
_DAYS = "((epoch_us(b) - epoch_us(a)) / 86400000000.0::double)"
_SQL = f"""with {_LOG}{_SEEN}, {_MOVES},
i as (select workspace, unnest(['environment', 'hour', 'weekday', 'day', 'day and hour', 'action', 'user']) as part,
 unnest([environmentName, hour(timestamp)::varchar, dayofweek(timestamp)::varchar, strftime(timestamp, '%Y-%m-%d'), strftime(timestamp, '%Y-%m-%d %H'), action, "user"]) as item from h),
c as (select workspace, part, item, count(*)::double as value from i where item <> '' group by all),
g as (select *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by workspace, environmentName order by timestamp, id)) / 3600000000.0::double as gap from h),
sp as (select workspace, environmentName as item, count(*) as n, min(timestamp) as a, max(timestamp) as b, coalesce(avg(gap), 0) as mean, coalesce(var_pop(gap), 0) as v from g group by all),
ch as (select *, lag(value) over (partition by workspace, key order by timestamp, id) as old, row_number() over (partition by workspace, key order by timestamp, id) as turn from x),
va as (select workspace, key as item, count(*) as n, min(timestamp) as a, max(timestamp) as b, count(*) filter (where turn > 1 and old is distinct from value) as k from ch group by all),
u as (select * from c
union all select workspace, 'month', strftime(timestamp, '%Y-%m'), count(*) from h group by all
union all select workspace, 'total', 'entries', count(*) from h group by all
union all select workspace, 'distinct', part, count(*) from c where part in ('environment', 'action', 'user') group by all
union all select workspace, 'changes a day', item, case when n = 1 then 0 when {_DAYS} = 0 then null else n / {_DAYS} end from sp
union all select workspace, 'hours between changes', item, case when n = 1 then 0 else {_DAYS} * 24 / (n - 1) end from sp
union all select workspace, 'stability', item, case when n = 1 then 100 else round((round(greatest(0, 100 - v / (case when mean = 0 then 24 else mean end) * 50), 6) + round(case when {_DAYS} = 0 then 0 else greatest(0, 100 - n / {_DAYS} * 7 * 10) end, 6)) / 2) end from sp
union all select workspace, 'range', 'first', epoch_us(min(timestamp)) / 1e6 from h group by all
union all select workspace, 'range', 'last', epoch_us(max(timestamp)) / 1e6 from h group by all
union all select workspace, 'transition', from_env || ' -> ' || to_env, transitions from m
union all select workspace, 'variable snapshots', item, n - 1 from va
union all select workspace, 'variable changes', item, k from va
union all select workspace, 'variable changes a day', item, case when n > 1 and b > a then (n - 1) / {_DAYS} else 0 end from va
union all select workspace, 'distinct', 'variable', count(*) from va group by all)
select workspace, part, item, round(value, 6) as value from u"""


def _spread(spark, sf_dir):
    return history(spark, sf_dir, fine=True).withColumn("timestamp", F.expr("timestamp + make_dt_interval(cast(cast(id as bigint) % 6 * 30 as int))"))


@query("maintained_summary", _SQL)
def maintained_summary(spark, sf_dir):
    """Partials of the months up to April, then those of the later months alone, then one month a second time."""
    log = _spread(spark, sf_dir)
    store = MaintainedSummary(spark, shared_folder(spark, "summary"))
    store.update(log, ["2024-01", "2024-02", "2024-03", "2024-04"])
    store.update(log, ["2024-05", "2024-06", "2024-07"])
    store.update(log, ["2024-03"])
    return store.summary()


query("computed_summary", _SQL)(lambda spark, sf_dir: computed(_spread(spark, sf_dir)))
