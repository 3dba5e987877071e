"""Queries of sources that are read back, and of the bundles that a dashboard or a filter bar shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.functions import kv
from kvtrail.operators import crypto, filters, variables
from kvtrail.operators import history as op
from kvtrail.plans.catalog import query
from kvtrail.plans.history_queries import _MOVES, _SPAN, STABILITY
from kvtrail.plans.kv_queries import _ASSIGN, _SEEN
from kvtrail.plans.views import ENVIRONMENTS, SNAPS, H, history, snapshots_at
from kvtrail.sources import io
from kvtrail.sources.scratch import shared_folder

# sources
_SECOND = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') as second"


def _second():
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("second")


@query("history_scan", f"with {H} select id, {_SECOND}, action, environmentName, \"user\", fileContent from h")
def history_scan(s, d):
    """The log written by months and scanned again."""
    path = shared_folder(s, "log-scan")
    io.export_history(history(s, d), path)
    return io.read_history(s, path, lines=True).select("id", _second(), "action", "environmentName", "user", "fileContent")


@query("history_import", f"with {H} select workspace, id, {_SECOND}, action from h where id::bigint % 10 <> 0 and id::bigint % 7 <> 0")
def history_import(s, d):
    """Export documents of a day each, imported; entries without content or with an empty action are left out."""
    path = shared_folder(s, "log-import")
    n = F.col("id").cast("long")
    rows = history(s, d).withColumn("fileContent", F.when(n % 10 != 0, F.col("fileContent"))).withColumn("action", F.when(n % 7 != 0, F.col("action")).otherwise(""))
    entry = F.struct("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "action", "environmentName", "fileContent")
    days = rows.groupBy("workspace", F.to_date("timestamp").alias("day")).agg(F.collect_list(entry).alias("entries"))
    days.select(F.to_json(F.struct("workspace", "entries"))).write.text(path)
    return io.import_history(s, path, lines=True).select("workspace", "id", _second(), "action")


@query("rules_source", f"with {_ASSIGN} select distinct 'required' as rule_type, key as variable, null::varchar as arg from p where key <> '' union all select distinct 'type', key, 'string' from p where key <> ''")
def rules_source(s, d):
    """A configuration that demands every key of the log, written and read as rules."""
    path = shared_folder(s, "rules")
    keys = kv.sync_pairs(history(s, d), ["id"]).select("key").distinct()
    kinds = F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", F.lit("string").alias("kind")))))
    config = keys.agg(F.struct(F.struct(F.array_sort(F.collect_set("key")).alias("requiredVariables"), kinds.alias("variableTypes")).alias("validationRules")).alias("c"))
    config.select(F.to_json("c")).coalesce(1).write.text(path)
    return io.rules_from_config(s, path)


_AT = "2024-03-01 12:00:00"


@query("history_export_documents", f"with {H} select '2024-03-01T12:00:00Z' as exportedAt, workspace, id, timestamp, action, environmentName, \"user\", fileContent from h")
def history_export_documents(s, d):
    """The log as export documents, imported again."""
    path = shared_folder(s, "export-documents")
    io.export_documents(history(s, d), path, F.lit(_AT).cast("timestamp"))
    return io.import_history(s, path, lines=True).select("exportedAt", "workspace", "id", "timestamp", "action", "environmentName", "user", "fileContent")


@query("env_file_scan", f"with {SNAPS} select workspace, environmentName, fileContent from snap_b")
def env_file_scan(s, d):
    """The environments of every workspace from its files; a plain .env, copies, examples and a file in a folder below are none."""
    path = shared_folder(s, "env-files")
    now = snapshots_at(history(s, d))
    own = now.select(F.concat("workspace", F.lit("/.env."), "environmentName").alias("path"), "fileContent")
    names = F.array(*map(F.lit, (".env", ".env.backup", ".env.Example", ".env.template", "below/.env.x", "node_modules/y/.env.z", "x.env.y")))
    others = now.select(F.explode(F.transform(names, lambda x: F.concat("workspace", F.lit("/"), x))).alias("path"), "fileContent")
    io.save_files(own.unionByName(others), path)
    return io.env_files(s, path).select("workspace", "environmentName", "fileContent")


@query("config_source", f"""with {H}, b as (select distinct 'b' || (id::bigint % 5) as branch, list_extract(['development','staging','production','local'], (id::bigint % 5 % 4 + 1)::int) as env from h)
select 'branch' as kind, branch as name, env as value from b union all select distinct 'environment', environmentName, '.env.' || environmentName from h
union all select 'flag', * from (values ('blockEnvFiles', 'true'), ('blockSecrets', 'false'), ('blockValidationErrors', 'true'), ('autoSwitchOnBranchChange', 'true'))""")
def config_source(s, d):
    """A configuration of the log's branches and environments, with one flag off and two left unsaid, written and read."""
    path, n = shared_folder(s, "config"), F.col("id").cast("long") % 5
    log = history(s, d)
    branch = log.select(F.concat(F.lit("b"), n.cast("string")).alias("b"), F.element_at(F.array(*map(F.lit, ENVIRONMENTS)), (n % 4 + 1).cast("int")).alias("e")).distinct()
    branches = branch.agg(F.map_from_entries(F.collect_list(F.struct("b", "e"))).alias("gitBranchMapping"))
    envs = log.select("environmentName").distinct().agg(F.map_from_entries(F.collect_list(F.struct("environmentName", F.concat(F.lit(".env."), "environmentName")))).alias("environments"))
    hook = F.struct(F.lit(False).alias("blockSecrets"))
    branches.join(F.broadcast(envs)).select(F.to_json(F.struct("gitBranchMapping", "environments", hook.alias("gitCommitHook"), F.lit(True).alias("autoSwitchOnBranchChange")))).coalesce(1).write.text(path)
    config = io.read_config(s, path)
    row = lambda kind, df, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"))
    return row("branch", io.branch_map(config), "branch", "environmentName").unionByName(row("environment", io.custom_environments(config), "environmentName", "fileName")).unionByName(row("flag", io.hook_flags(config), "flag", "value"))


# the dialect of sealed files
_SEALED = "key = 'API_TOKEN' and id::bigint % 2 = 0"


@query("parse_encrypted_dialect", f"""with {_ASSIGN}, e as (select id, key, arg_max(trim(rest), line) as value from p where strpos(text, '=') > 1 group by id, key)
select id, key, case when {_SEALED} and id::bigint % 5 = 0 or value like 'ENC[%]' then 'sealed' else value end as value, ({_SEALED} and id::bigint % 5 <> 0) as encrypted, ({_SEALED} or value like 'ENC[%]') as raw_is_sealed from e""")
def parse_encrypted_dialect(s, d):
    """Tokens of even entries are sealed in their files; every fifth entry is read with a wrong key. What only looks sealed stays as it is."""
    right, wrong, n = F.lit(b"0" * 32), F.lit(b"1" * 32), F.col("id").cast("long")
    token = F.regexp_extract("fileContent", '(?m)^API_TOKEN=(.*)$', 1)
    line = lambda v: F.concat(F.lit("API_TOKEN="), v)
    sealed = F.when(n % 2 == 0, F.replace("fileContent", line(token), line(crypto.encrypt_value(token, right)))).otherwise(F.col("fileContent"))
    rows = crypto.encrypted_pairs(history(s, d).withColumn("fileContent", sealed), ["id"], F.when(n % 5 == 0, wrong).otherwise(right))
    value = F.when(kv.is_encrypted(F.col("value")), "sealed").otherwise(F.col("value"))
    return rows.select("id", "key", value.alias("value"), "encrypted", kv.is_encrypted(F.col("raw")).alias("raw_is_sealed"))


_RENAMED = "case key when 'PORT' then 'DOPPLER_CONFIG' when 'URL' then 'doppler_project' when 'DEBUG' then 'DOPPLER_ENVIRONMENT_TOKEN_ID' else key end"


@query("reserved_key_filter", f"""with {_ASSIGN}, e as (select workspace, id, {_RENAMED} as key from p where key <> '' group by all)
select workspace, count(*) filter (where key in ({', '.join(f"'{k}'" for k in kv.RESERVED_KEYS)})) as dropped, count(*) filter (where key not in ({', '.join(f"'{k}'" for k in kv.RESERVED_KEYS)})) as pushed from e group by 1""")
def reserved_key_filter(s, d):
    """Keys that a push drops and keeps, after some of the log's keys have been given reserved and nearly reserved names."""
    rows = kv.sync_pairs(history(s, d), ["workspace", "id"]).withColumn("key", F.expr(_RENAMED))
    reserved = kv.reserved_key(F.col("key"))
    return rows.groupBy("workspace").agg(F.count_if(reserved).alias("dropped"), F.count_if(~reserved).alias("pushed"))


# bundles
_LISTS = """lists as (select 'environments' as list, workspace, environmentName as item, count(*)::double as value, 8 as k, -1 as way from h group by workspace, environmentName
union all select 'hours', workspace, hour(timestamp)::varchar, count(*), 8, -1 from h group by workspace, hour(timestamp)
union all select 'transitions', workspace, from_env || ' -> ' || to_env, transitions, 8, -1 from m
union all select 'stability', workspace, environmentName, stability, 8, -1 from st
union all select 'churn', workspace, environmentName, round(case when total_changes = 1 then 0 when us = 0 then null else total_changes / (us / 86400000000.0::double) end, 6), 8, -1 from s
union all select 'gaps', workspace, environmentName, round(case when total_changes = 1 then 0 else us / 3600000000.0::double / (total_changes - 1) end, 6), 8, 1 from s
union all select 'variables', workspace, key, count(*) - 1, 15, -1 from x group by workspace, key)"""


@query("dashboard_lists", f"""with {_ASSIGN}{_SEEN}, {_MOVES}, {_SPAN}{STABILITY}, {_LISTS},
r as (select *, row_number() over (partition by list, workspace order by value * way nulls last, item)::int as rank from lists)
select list, workspace, rank, item, value, round(value * 100 / nullif(max(value) over (partition by list, workspace), 0))::int as percent from r where rank <= k""")
def dashboard_lists(s, d):
    """The seven top lists of a dashboard for each workspace, with bars against the largest value shown."""
    log = history(s, d)
    moves = op.transition_matrix(log).withColumn("move", F.concat_ws(" -> ", "from_env", "to_env"))
    lists = [
        ("environments", op.environment_frequency(log), "environmentName", "changes", 8), ("hours", op.peak_hours(log), "hour", "changes", 8), ("transitions", moves, "move", "transitions", 8),
        ("stability", op.stability_score(log), "environmentName", "stability", 8), ("churn", op.churn_rate(log), "environmentName", "churn_rate", 8),
        ("gaps", op.average_gap(log), "environmentName", "avg_gap_hours", 8), ("variables", variables.change_frequency(variables.appearances(log)), "key", "changes", 15),
    ]
    out = None
    for name, rows, item, value, k in lists:
        rows = rows.select(F.lit(name).alias("list"), "workspace", F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
        top = op.top_k(rows, k, [F.asc_nulls_last("value") if name == "gaps" else F.desc_nulls_last("value"), F.col("item")])
        out = top if out is None else out.unionByName(top)
    most = F.max("value").over(op.Window.partitionBy("list", "workspace"))
    return out.select("list", "workspace", "rank", "item", "value", F.round(F.try_divide(F.col("value") * 100, most)).cast("int").alias("percent"))


@query("filter_options", f"""with {_ASSIGN}{_SEEN}, f as (select distinct facet, value from (select 'user' as facet, "user" as value from h union all select 'environment', environmentName from h union all select 'action', action from h union all select 'variable', key from x) where value <> '')
select facet, value from f union all select 'number of ' || facet || 's', count(*)::varchar from f group by facet
union all select 'preset', label || ' from ' || strftime(t - to_days(d), '%Y-%m-%d') from (select date_trunc('day', max(timestamp)) as t from h), (values ('Today', 0), ('Last 7 days', 7), ('Last 30 days', 30), ('Last 90 days', 90), ('Last 180 days', 180), ('Last year', 365)) p(label, d)
union all select 'oldest', strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') from h union all select 'newest', strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') from h""")
def filter_options(s, d):
    """What a filter bar offers: the values of four facets, how many each has, ranges of time, and the ends of the log."""
    log = history(s, d)
    facets = op.facets(log)
    ranges = filters.date_presets(log.agg(F.max("timestamp").alias("ref_ts"))).select(F.lit("preset").alias("facet"), F.concat("label", F.lit(" from "), F.date_format("start", "yyyy-MM-dd")).alias("value"))
    counts = facets.groupBy("facet").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.format_string("number of %ss", "facet").alias("facet"), "value")
    ends = log.agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    end = lambda c: F.struct(F.lit(c).alias("facet"), F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("value"))
    return facets.unionByName(counts).unionByName(ranges).unionByName(ends.select(F.explode(F.array(end("oldest"), end("newest"))).alias("e")).select("e.*"))
