"""Queries of validation, policy and the bundles of history aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.functions import kv
from kvtrail.functions import secrets as fn
from kvtrail.operators import history as hist
from kvtrail.operators import validation as op
from kvtrail.operators import variables
from kvtrail.plans.catalog import query
from kvtrail.plans.history_queries import STABILITY
from kvtrail.plans.kv_queries import _ASSIGN, _SEEN
from kvtrail.plans.views import H, RULES_SQL, history, rules

K = ["id"]
_BASE = f"with {_ASSIGN}, {RULES_SQL}, q as (select id, key, arg_max(rest, line) as value, max(line)::int as line from p where key <> '' group by id, key)"
_SYN = """syn as (select id, 'syntax' as type, null::varchar as variable, message, line::int as line from (
 select id, line, 'Invalid line format' as message from a where text <> '' and text not like '#%' and strpos(text, '=') = 0
 union all select id, line, 'Missing variable name' from p where key = ''
 union all select id, line, 'Unmatched quotes' from p where len(regexp_extract_all(rest, '"')) % 2 = 1))"""
_MIS = "mis as (select h.id, 'missing' as type, r.variable, 'Required variable missing: ' || r.variable as message, null::int as line from h, rules r where r.rule_type = 'required' and not exists (select 1 from q where q.id = h.id and q.key = r.variable))"
_HOLD = r"case kind when 'string' then value <> '' when 'number' then trim(value) <> '' and regexp_matches(value, '^\s*[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\s*$|^\s*(0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)\s*$') when 'boolean' then lower(value) in ('true','false','1','0','yes','no') when 'url' then regexp_matches(value, '^[a-zA-Z][a-zA-Z0-9+.-]*:.+') else true end"
_TYP = f"typ as (select id, 'type' as type, key as variable, 'Expected ' || kind as message, line from (select q.*, r.arg as kind from q join rules r on r.rule_type = 'type' and r.variable = q.key) where not ({_HOLD}))"
_CUS = "cus as (select q.id, 'custom' as type, q.key as variable, 'Custom rule failed' as message, q.line from q join rules r on r.rule_type = 'custom' and r.variable = q.key where not regexp_matches(q.value, r.arg))"
_ALL = f"{_BASE}, {_SYN}, {_MIS}, {_TYP}, {_CUS}, er as (select * from syn union all select * from mis union all select * from typ union all select * from cus)"


def _pairs(spark, sf_dir):
    return kv.validator_pairs(history(spark, sf_dir), K)


def _errors(spark, sf_dir, keys=K):
    return op.validate(history(spark, sf_dir), rules(spark), keys)


query("validate_syntax", f"{_BASE}, {_SYN} select * from syn")(lambda s, d: op.syntax_errors(history(s, d), K))
query("required_missing", f"{_BASE}, {_MIS} select * from mis")(lambda s, d: op.missing_errors(history(s, d), _pairs(s, d), rules(s), K))
query("type_rule_join", f"{_BASE}, {_TYP} select * from typ")(lambda s, d: op.type_errors(_pairs(s, d), rules(s), K))
query("custom_regex_rule_join", f"{_BASE}, {_CUS} select * from cus")(lambda s, d: op.custom_errors(_pairs(s, d), rules(s), K))
query("validate_files", f"{_ALL} select * from er")(_errors)
query("validate_type", f"{_BASE} select id, key, ({_HOLD.replace('kind', chr(39) + 'number' + chr(39))}) as is_number, ({_HOLD.replace('kind', chr(39) + 'boolean' + chr(39))}) as is_boolean, ({_HOLD.replace('kind', chr(39) + 'url' + chr(39))}) as is_url from q")(
    lambda s, d: _pairs(s, d).select("id", "key", *(op.type_holds(F.col("value"), F.lit(t)).alias(f"is_{t}") for t in ("number", "boolean", "url")))
)
_SUM = ", c as (select id, count(*) filter (where type = 'syntax') as syntax, count(*) filter (where type = 'missing') as missing, count(*) filter (where type = 'type') as type, count(*) filter (where type = 'custom') as custom, count(*) as errors from er group by 1), su as (select h.id, coalesce(syntax, 0) as syntax, coalesce(missing, 0) as missing, coalesce(type, 0) as type, coalesce(custom, 0) as custom, coalesce(errors, 0) as errors, coalesce(errors, 0) = 0 as valid from h left join c using (id))"
query("validation_summary", f"{_ALL}{_SUM} select * from su")(lambda s, d: op.summary(history(s, d), _errors(s, d), K))
query("validation_totals", f"{_ALL}{_SUM} select count(*) filter (where valid) as passed, count(*) filter (where not valid) as failed from su")(
    lambda s, d: op.summary(history(s, d), _errors(s, d), K).agg(F.count_if("valid").alias("passed"), F.count_if(~F.col("valid")).alias("failed"))
)
_WARN = "wa as (select id, count(*) as warnings from hl where raw not like '#%' and raw like '%=%' and regexp_matches(lower(raw[:strpos(raw, '=') - 1]), 'key|secret|password|token|auth') group by 1)"


@query("security_status", f"{_ALL}, {_WARN}, c as (select id, count(*) as errors from er group by 1) select h.id, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(errors, 0) + coalesce(warnings, 0) as issues from h left join c using (id) left join wa using (id)")
def security_status(s, d):
    log = history(s, d)
    key = kv.sensitive_key(F.substring_index("raw", "=", 1))
    warnings = kv.lines_of(log.select("id", "fileContent")).where("not startswith(raw, '#') and contains(raw, '=')").where(key).groupBy("id").agg(F.count(F.lit(1)).alias("warnings"))
    errors = _errors(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("errors"))
    out = log.select("id").join(errors, "id", "left").join(warnings, "id", "left").fillna(0)
    return out.withColumn("issues", F.col("errors") + F.col("warnings"))


#: Change sets of three neighbouring entries; every second file is no env file.
_SETS = "cs as (select id, id::bigint // 3 as change_set, id::bigint % 2 = 0 as env, regexp_matches(fileContent, '\\bghp_[a-zA-Z0-9]{20,}\\b') as secret from h)"


def _change_sets(s, d):
    path = F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit(".env."), "environmentName")).otherwise(F.concat(F.lit("config/"), "environmentName", F.lit(".txt")))
    return history(s, d).withColumn("change_set", F.expr("cast(id as bigint) div 3")).withColumn("path", path)


def _gate(name, toggles):
    env, secret, validation = (t in toggles for t in ("env_file", "secret", "validation"))
    blocked = f"(({env} and env_file_issues > 0) or ({secret} and secret_issues > 0) or ({validation} and validation_issues > 0)) as blocked"
    sql = f"{_ALL}, {_SETS}, ve as (select id, count(*) as n from er group by 1), g as (select change_set, count(*) filter (where env) as env_file_issues, count(*) filter (where secret) as secret_issues, coalesce(sum(n) filter (where env), 0)::bigint as validation_issues from cs left join ve using (id) group by 1) select *, {blocked} from g"
    query(name, sql)(lambda s, d: op.policy_gate(_change_sets(s, d), rules(s), "change_set", toggles))


_gate("policy_gate", ("secret", "validation"))
_gate("policy_gate_secrets", ("secret",))
_gate("policy_gate_all", ("env_file", "secret", "validation"))


@query("branch_environment_mapping", f"with {H}, b as (select distinct 'b' || (event_id % 5) as branch from events), m(branch, environment) as (values ('b0', 'development'), ('b1', 'staging'), ('b2', 'production'), ('b3', 'preview')), f as (select distinct environmentName as environment, true as there from h) select branch, environment, case when environment is null then 'unmapped' when there is null then 'missing file' else 'switched' end as outcome from b left join m using (branch) left join f using (environment)")
def branch_environment_mapping(s, d):
    from kvtrail.plans.views import table

    branches = table(s, d, "events").select(F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string")).alias("branch")).distinct()
    mapping = s.createDataFrame([("b0", "development"), ("b1", "staging"), ("b2", "production"), ("b3", "preview")], "branch string, environmentName string")
    return op.branch_switch(branches, mapping, history(s, d))


query("config_aliases", f"with {H} select distinct environmentName, case environmentName when 'development' then 'development,dev,develop' when 'production' then 'production,prod,prd' when 'staging' then 'staging,stg,stage' else environmentName end as names from h")(
    lambda s, d: history(s, d).select("environmentName").distinct().select("environmentName", F.array_join(op.config_names(F.col("environmentName")), ",").alias("names"))
)

# bundles
_REF = "(select max(timestamp) from h)"
query("relative_time", f"with {H}, r as (select id, floor((epoch_us({_REF}) - epoch_us(timestamp)) / 1000000)::bigint as s, timestamp from h) select id, case when s < 60 then 'Just now' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago' when s < 604800 then (s // 86400) || 'd ago' else strftime(timestamp, '%Y-%m-%d') end as \"when\" from r")(
    lambda s, d: history(s, d).join(F.broadcast(history(s, d).agg(F.max("timestamp").alias("now")))).select("id", fn.relative_time(F.col("timestamp"), F.col("now")).alias("when"))
)
query("month_key", f"with {H} select id, strftime(timestamp, '%Y-%m') as month from h")(lambda s, d: history(s, d).select("id", F.date_format("timestamp", "yyyy-MM").alias("month")))


@query("quick_insights", f"with {_ASSIGN}{_SEEN}, v as (select workspace, count(distinct key) as variables from x group by 1), e as (select workspace, environmentName, row_number() over (partition by workspace order by count(*) desc, environmentName) as r from h group by workspace, environmentName), p2 as (select workspace, hour(timestamp) as hour, row_number() over (partition by workspace order by count(*) desc, hour(timestamp)) as r from h group by workspace, hour(timestamp)), k2 as (select workspace, key, row_number() over (partition by workspace order by count(*) - 1 desc, key) as r from x group by workspace, key) select v.workspace, v.variables, (select string_agg(environmentName, ',' order by r) from e where e.workspace = v.workspace and r <= 3) as environments, (select string_agg(hour::varchar, ',' order by r) from p2 where p2.workspace = v.workspace and r <= 3) as hours, (select string_agg(key, ',' order by r) from k2 where k2.workspace = v.workspace and r <= 3) as changed from v")
def quick_insights(s, d):
    log = history(s, d)
    seen = variables.appearances(log)

    def joined(df, column, name, by):
        top = hist.top_k(df, 3, by)
        ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(column).cast("string").alias("v"))))
        return top.groupBy("workspace").agg(F.array_join(F.transform(ordered, lambda x: x["v"]), ",").alias(name))

    out = seen.groupBy("workspace").agg(F.countDistinct("key").alias("variables"))
    out = out.join(joined(hist.environment_frequency(log), "environmentName", "environments", [F.desc("changes"), F.col("environmentName")]), "workspace")
    out = out.join(joined(hist.peak_hours(log), "hour", "hours", [F.desc("changes"), F.col("hour")]), "workspace")
    return out.join(joined(variables.change_frequency(seen), "key", "changed", [F.desc("changes"), F.col("key")]), "workspace")


@query("activity_score", f"with {_ASSIGN}{_SEEN}{STABILITY}, sw as (select workspace, avg(stability) as stable from st group by 1), n as (select workspace, count(*) as n from h group by 1), c as (select workspace, sum(k) as changes from (select workspace, key, count(*) - 1 as k from x group by all) group by 1) select workspace, round(0.4 * least(n / 10.0, 100) + 0.3 * stable + 0.3 * least(changes / 5.0, 100))::int as score from n join c using (workspace) join sw using (workspace)")
def activity_score(s, d):
    log = history(s, d)
    n = log.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))
    stable = hist.stability_score(log).groupBy("workspace").agg(F.avg("stability").alias("stable"))
    changes = variables.change_frequency(variables.appearances(log)).groupBy("workspace").agg(F.sum("changes").alias("changes"))
    score = 0.4 * F.least(F.col("n") / 10, F.lit(100.0)) + 0.3 * F.coalesce("stable", F.lit(50.0)) + 0.3 * F.least(F.col("changes") / 5, F.lit(100.0))
    return n.join(stable, "workspace").join(changes, "workspace").select("workspace", F.round(score).cast("int").alias("score"))


@query("analytics_summary", f"with {_ASSIGN}{_SEEN}, v as (select workspace, count(distinct key) as variables from x group by 1), t as (select workspace, min(timestamp) as start, max(timestamp) as \"end\", count(*) as total, count(distinct environmentName) as environments from h group by 1) select * from t join v using (workspace)")
def analytics_summary(s, d):
    log = history(s, d)
    totals = log.groupBy("workspace").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("total"), F.countDistinct("environmentName").alias("environments"))
    return totals.join(variables.appearances(log).groupBy("workspace").agg(F.countDistinct("key").alias("variables")), "workspace")
