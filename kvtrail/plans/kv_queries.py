"""Queries over parsed snapshots: dialects, diffs, variables and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.functions import kv
from kvtrail.operators import diff, variables
from kvtrail.operators.history import top_k
from kvtrail.plans.catalog import query
from kvtrail.plans.views import CUT, LINES_OF_H, SNAPS, H, history, snapshots_at

_ASSIGN = LINES_OF_H + r""", a as (select id, workspace, line, trim(raw, ' ' || chr(9) || chr(13)) as text from hl),
p as (select id, workspace, line, trim(text[:strpos(text, '=') - 1]) as key, text[strpos(text, '=') + 1:] as rest, text from a where text <> '' and text not like '#%' and strpos(text, '=') > 0)"""
_KEYS = ["id"]


def _parsed(name, f, sql):
    query(name, f"with {_ASSIGN}{sql}")(lambda spark, sf_dir: f(history(spark, sf_dir)))


_parsed("parse_history_dialect", lambda h: kv.history_pairs(h, _KEYS), """ select id, key, arg_max(regexp_replace(rest, '^["'']|["'']$', '', 'g'), line) as value from p group by id, key""")
_parsed("parse_diff_dialect", lambda h: kv.diff_rows(h, _KEYS), " select id, key, rest as value, line from p where key <> ''")
_parsed("parse_validator_dialect", lambda h: kv.validator_pairs(h, _KEYS), " select id, key, arg_max(rest, line) as value, max(line) as line from p where key <> '' group by id, key")
_parsed("parse_sync_dialect", lambda h: kv.sync_pairs(h, _KEYS), " select id, key, arg_max(rest, line) as value from p where key <> '' group by id, key")
_parsed("parse_export_dialect", lambda h: kv.export_pairs(h, _KEYS), """ select id, key, arg_max(trim(rest), line) as value, arg_max(trim(rest) like 'ENC[%' and trim(rest) like '%]', line) as encrypted,
arg_max(case when rest like '%#%' then trim(rest[strpos(rest, '#') + 1:]) end, line) as comment from p where strpos(text, '=') > 1 group by id, key""")
_parsed("parse_completion_dialect", lambda h: kv.completion_pairs(h, _KEYS), """, n as (select a.id, a.line, a.text, (text not like '#%' and strpos(text, '=') > 0) as pair from a where text <> ''),
b as (select *, sum(pair::int) over (partition by id order by line) - pair::int as block from n),
c as (select *, last_value(case when text like '#%' then trim(text[2:]) end ignore nulls) over (partition by id, block order by line) as description from b)
select id, trim(text[:strpos(text, '=') - 1]) as key, arg_max(regexp_replace(trim(text[strpos(text, '=') + 1:]), '^(?:"(.*)"|''(.*)'')$', '\\1\\2'), line) as value, arg_max_null(description, line) as description
from c where pair group by id, trim(text[:strpos(text, '=') - 1])""")
_parsed("variable_count", lambda h: h.select("id", kv.variable_count(F.col("fileContent")).alias("variables"), F.octet_length("fileContent").alias("bytes")), """, c as (select id, count(*) filter (where trim(raw) <> '' and raw not like '#%' and raw like '%=%') as variables from hl group by id)
select id, variables, strlen(fileContent) as bytes from h join c using (id)""")
_parsed("file_names", lambda h: h.select("id", kv.display_file_name(F.lit(None).cast("string"), F.col("environmentName")).alias("file_name")).withColumn("environment", kv.environment_name(F.col("file_name"))).withColumn("extension", kv.file_extension(F.col("file_name"))),
        """ select id, case when environmentName = 'local' then '.env' else '.env.' || environmentName end as file_name, environmentName as environment,
case when environmentName = 'local' then '.env' else '.' || environmentName end as extension from h""")  # fmt: skip
_parsed("render_kv", lambda h: kv.validator_pairs(h, _KEYS).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "key", "value"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "\n").alias("body")).select("id", F.concat("body", F.lit("\n")).alias("body")),
        """, v as (select id, key, arg_max(rest, line) as value, max(line) as line from p where key <> '' group by id, key)
select id, string_agg(key || '=' || value, chr(10) order by line) || chr(10) as body from v group by id""")  # fmt: skip
_parsed("kv_stats", lambda h: kv.export_pairs(h, _KEYS).groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("not encrypted")).alias("plain"), F.count_if("encrypted").alias("encrypted")),
        """, e as (select id, key, arg_max(trim(rest), line) as value from p where strpos(text, '=') > 1 group by id, key)
select id, count(*) as total, count(*) filter (where not (value like 'ENC[%' and value like '%]')) as plain, count(*) filter (where value like 'ENC[%' and value like '%]') as encrypted from e group by id""")  # fmt: skip
_parsed("workspace_has_encrypted", lambda h: kv.lines_of(h.select("workspace", "fileContent")).groupBy("workspace").agg(F.bool_or(F.col("raw").contains("=") & kv.is_encrypted(F.expr("substring(raw, instr(raw, '=') + 1)"))).alias("has_encrypted")),
        " select workspace, bool_or(raw like '%=ENC[%' and raw like '%]') as has_encrypted from hl group by 1")
_parsed("export_csv", lambda h: kv.export_pairs(h, _KEYS).select("id", F.concat(F.lit('"'), F.regexp_replace("key", '"', '""'), F.lit('","'), F.regexp_replace("value", '"', '""'), F.lit('",'), F.col("encrypted").cast("string"), F.lit(","), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit('"'), F.regexp_replace("comment", '"', '""'), F.lit('"'))).otherwise("")).alias("row")),
        """, e as (select id, key, arg_max(trim(rest), line) as value, arg_max(case when rest like '%#%' then trim(rest[strpos(rest, '#') + 1:]) else '' end, line) as comment from p where strpos(text, '=') > 1 group by id, key)
select id, '"' || replace(key, '"', '""') || '","' || replace(value, '"', '""') || '",' || (value like 'ENC[%' and value like '%]')::varchar || ',' || case when comment <> '' then '"' || replace(comment, '"', '""') || '"' else '' end as row from e""")  # fmt: skip
_parsed("export_metadata", lambda h: kv.export_pairs(h, ["workspace", "id"]).groupBy("workspace").agg(F.count(F.lit(1)).alias("variables"), F.count_if("encrypted").alias("encrypted"), F.count_if(F.expr("not encrypted")).alias("plain")).select("workspace", F.lit("1.0").alias("version"), "variables", "encrypted", "plain"),
        """, e as (select workspace, id, key, arg_max(trim(rest), line) as value from p where strpos(text, '=') > 1 group by workspace, id, key)
select workspace, '1.0' as version, count(*) as variables, count(*) filter (where value like 'ENC[%' and value like '%]') as encrypted, count(*) filter (where not (value like 'ENC[%' and value like '%]')) as plain from e group by 1""")  # fmt: skip
_parsed("mask_secret_on_export", lambda h: kv.export_pairs(h, _KEYS).select("id", "key", F.when(kv.sensitive_key(F.col("key")) & ~F.col("encrypted"), "*** MASKED SECRET ***").otherwise(F.col("value")).alias("value")),
        """, e as (select id, key, arg_max(trim(rest), line) as value from p where strpos(text, '=') > 1 group by id, key)
select id, key, case when regexp_matches(lower(key), 'key|secret|password|token|auth') and not (value like 'ENC[%' and value like '%]') then '*** MASKED SECRET ***' else value end as value from e""")  # fmt: skip
_parsed("export_env", lambda h: kv.export_pairs(h, _KEYS).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.when(F.col("comment").isNotNull(), F.concat(F.lit("# "), "comment", F.lit("\n"))).otherwise(""), "key", F.lit("="), "value"))), "\n").alias("body")),
        """, e as (select id, key, arg_max(trim(rest), line) as value from p where strpos(text, '=') > 1 group by id, key)
select id, string_agg(key || '=' || value, chr(10) order by key || '=' || value) as body from e group by id""")  # fmt: skip
_parsed("change_request_rows", lambda h: kv.sync_pairs(h, _KEYS).select("id", F.col("key").alias("name"), F.col("key").alias("originalName"), "value", F.lit(False).alias("shouldPrompt")),
        """ select id, key as name, key as originalName, arg_max(rest, line) as value, false as shouldPrompt from p where key <> '' group by id, key""")  # fmt: skip
_parsed("sensitive_key_warning", lambda h: kv.lines_of(h.select("id", "fileContent")).where("not startswith(raw, '#') and contains(raw, '=')").withColumn("key", kv.js_trim(F.substring_index("raw", "=", 1))).where(kv.sensitive_key(F.col("key"))).select("id", F.format_string("%s (line %d)", "key", "line").alias("warning")),
        """ select id, trim(raw[:strpos(raw, '=') - 1]) || ' (line ' || line || ')' as warning from hl where raw not like '#%' and raw like '%=%' and regexp_matches(lower(raw[:strpos(raw, '=') - 1]), 'key|secret|password|token|auth')""")  # fmt: skip
_parsed("kv_search", lambda h: kv.sync_pairs(h, _KEYS).where(F.lower("key").contains("tok") | F.lower("value").contains("h3")),
        " select * from (select id, key, arg_max(rest, line) as value from p where key <> '' group by id, key) where lower(key) like '%tok%' or lower(value) like '%h3%'")
_parsed("completion_items", lambda h: kv.completion_pairs(h, ["workspace"]).where(F.lower("key").contains("r")).select("workspace", "key", F.when(F.col("key").startswith("R"), 0).otherwise(1).alias("order")).distinct(),
        """ select distinct workspace, key, case when starts_with(key, 'R') then 0 else 1 end as "order" from p where lower(key) like '%r%'""")  # fmt: skip

# variables over time
_SEEN = ", x as (select h.workspace, h.id, h.timestamp, h.environmentName, h.\"user\", h.reason, k.key, k.value from h join (select id, key, arg_max(regexp_replace(rest, '^[\"'']|[\"'']$', '', 'g'), line) as value from p group by id, key) k using (id))"
_parsed("variable_change_frequency", lambda h: variables.change_frequency(variables.appearances(h)), _SEEN + """ select workspace, key, count(*) - 1 as changes, min(timestamp) as first_seen, max(timestamp) as last_changed, nullif(arg_max(value, timestamp), '') as current_value,
round(case when count(*) > 1 and max(timestamp) > min(timestamp) then (count(*) - 1) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0::double) else 0 end, 6) as velocity from x group by workspace, key""")
_parsed("variable_lifecycle", lambda h: variables.lifecycle(variables.appearances(h)).select("workspace", "key", F.array_join("previous_values", ",").alias("previous_values")), _SEEN + """, f as (select workspace, key, value, min(timestamp) as t from x group by all),
l as (select workspace, key, list(value order by t) as v from f group by all) select workspace, key, coalesce(array_to_string(v[:-2], ','), '') as previous_values from l""")
_parsed("true_value_changes", lambda h: variables.value_changes(variables.appearances(h)), _SEEN + """, b as (select *, lag(value) over w as before, row_number() over w as turn from x window w as (partition by workspace, key order by timestamp, id))
select workspace, key, count(*) filter (where turn > 1 and value is distinct from before) as value_changes from b group by all""")
_parsed("variable_history", lambda h: variables.appearances(h).where("key = 'DEBUG'").select("workspace", "id", "timestamp", "value", "environmentName", "user", "reason"), _SEEN + """ select workspace, id, timestamp, value, environmentName, "user", reason from x where key = 'DEBUG'""")
_parsed("most_changed_variables", lambda h: top_k(variables.change_frequency(variables.appearances(h)).select("workspace", "key", "changes"), 5, [F.desc("changes"), F.col("key")]), _SEEN + """, c as (select workspace, key, count(*) - 1 as changes from x group by all),
r as (select *, row_number() over (partition by workspace order by changes desc, key)::int as rank from c) select * from r where rank <= 5""")

# snapshots against each other
_ROWS = SNAPS + "".join(f""", l{s} as (select workspace, environmentName, unnest(string_split(fileContent, chr(10))) as text, generate_subscripts(string_split(fileContent, chr(10)), 1) as line from snap_{s}),
r{s} as (select workspace, environmentName, text[:strpos(text, '=') - 1] as key, text[strpos(text, '=') + 1:] as value, line from l{s} where text not like '#%' and strpos(text, '=') > 1),
m{s} as (select workspace, environmentName, key, arg_max(value, line) as value from r{s} group by all)""" for s in "ab")
_DIFF = _ROWS + """, d as (select b.workspace, b.environmentName, b.key, case when a.value is null then 'added' when a.value <> b.value then 'changed' else 'unchanged' end as status, a.value as old_value, b.value as new_value
  from rb b left join ma a using (workspace, environmentName, key)
  union all select workspace, environmentName, key, 'removed', value, null from ra a where not exists (select 1 from rb b where b.workspace = a.workspace and b.environmentName = a.environmentName and b.key = a.key))"""


def _two(spark, sf_dir):
    log = history(spark, sf_dir)
    a, b = snapshots_at(log, F.lit(CUT).cast("timestamp")), snapshots_at(log)
    return kv.diff_rows(a, diff.KEYS), kv.diff_rows(b, diff.KEYS)


def _compared(name, f, sql):
    query(name, f"with {_DIFF}{sql}")(lambda spark, sf_dir: f(*_two(spark, sf_dir)))


_compared("kv_diff", diff.kv_diff, " select * from d")
_compared("diff_summary", lambda a, b: diff.diff_summary(diff.kv_diff(a, b)), " select workspace, environmentName, count(*) as total, count(*) filter (where status = 'added') as added, count(*) filter (where status = 'removed') as removed, count(*) filter (where status = 'changed') as changed from d group by all")
_SYNC = """, j as (select coalesce(a.workspace, b.workspace) as workspace, coalesce(a.environmentName, b.environmentName) as environmentName, a.value as l, b.value as r from ma a full join mb b on a.workspace = b.workspace and a.environmentName = b.environmentName and a.key = b.key),
k as (select workspace, environmentName, count(*) filter (where l is null) as new_keys, count(*) filter (where l <> r) as changed_keys, count(*) filter (where r is null) as removed_keys from j group by all)
select *, new_keys + changed_keys + removed_keys as total_changes, new_keys + changed_keys + removed_keys = 0 as in_sync from k"""
_compared("sync_preview", lambda a, b: diff.sync_preview(kv.last_wins(a, diff.KEYS, "value"), kv.last_wins(b, diff.KEYS, "value")), _SYNC)
_REPORT = """, j as (select coalesce(a.workspace, b.workspace) as workspace, coalesce(a.environmentName, b.environmentName) as environmentName, coalesce(a.key, b.key) as key, a.value as l, b.value as r from ma a full join mb b on a.workspace = b.workspace and a.environmentName = b.environmentName and a.key = b.key),
k as (select *, case when l is null then 'Added' when r is null then 'Removed' else 'Modified' end as kind from j where l is distinct from r)
select workspace, environmentName, kind || ' Variables (' || count(*) over (partition by workspace, environmentName, kind) || ')' as section, case kind when 'Added' then '+ ' || key || '=' || r when 'Removed' then '- ' || key || '=' || l else '~ ' || key || '=' || l || ' → ' || r end as line from k"""
_compared("sync_report", lambda a, b: diff.sync_report(kv.last_wins(a, diff.KEYS, "value"), kv.last_wins(b, diff.KEYS, "value")), _REPORT)
_compared("key_set_difference", lambda a, b: a.select(*diff.KEYS, "key").distinct().exceptAll(b.select(*diff.KEYS, "key").distinct()).withColumn("side", F.lit("removed")).unionByName(b.select(*diff.KEYS, "key").distinct().exceptAll(a.select(*diff.KEYS, "key").distinct()).withColumn("side", F.lit("new"))),
          " select workspace, environmentName, key, 'removed' as side from (select workspace, environmentName, key from ma except select workspace, environmentName, key from mb) union all select workspace, environmentName, key, 'new' from (select workspace, environmentName, key from mb except select workspace, environmentName, key from ma)")
_order = "case status when 'added' then 0 when 'removed' then 1 when 'changed' then 2 else 3 end"
_compared("diff_display", lambda a, b: diff.kv_diff(a, b).select("workspace", "environmentName", F.expr(_order).alias("place"), F.when(F.col("status") == "added", F.concat(F.lit("+ "), "key", F.lit("="), "new_value")).when(F.col("status") == "removed", F.concat(F.lit("- "), "key", F.lit("="), "old_value")).when(F.col("status") == "changed", F.concat(F.lit("~ "), "key", F.lit(": "), "old_value", F.lit(" -> "), "new_value")).otherwise(F.concat(F.lit("  "), "key")).alias("line")),
          f" select workspace, environmentName, ({_order})::int as place, case status when 'added' then '+ ' || key || '=' || new_value when 'removed' then '- ' || key || '=' || old_value when 'changed' then '~ ' || key || ': ' || old_value || ' -> ' || new_value else '  ' || key end as line from d")
query("granular_diff")(lambda spark, sf_dir: diff.granular_diff(diff.kv_diff(*_two(spark, sf_dir)).where("status = 'changed'")))

#: Changes against the snapshot before; {part} is the partition.
PREVIOUS = _ASSIGN + """, q as (select id, key, arg_max(rest, line) as value from p where key <> '' group by id, key),
o as (select id, workspace, environmentName, lag(id) over w as pid, lag("user") over w as puser, lag(timestamp) over w as ptime from h window w as (partition by {part} order by timestamp, id)),
u as (select o.id, o.workspace, o.environmentName, o.pid, o.puser, o.ptime, q.key from o join q on q.id = o.id or q.id = o.pid where pid is not null group by all),
d as (select u.workspace, u.environmentName, u.id, u.key, a.value as old_value, b.value as new_value, u.puser, u.ptime, case when u.puser is not null then left(md5(u.pid), 8) end as pcommit from u left join q a on a.id = u.pid and a.key = u.key left join q b on b.id = u.id and b.key = u.key),
s as (select workspace, environmentName, id, key, case when old_value is null then 'added' when new_value is null then 'removed' when old_value <> new_value then 'changed' else 'unchanged' end as status, old_value, new_value, case when old_value <> new_value then puser end as blame_user,
  case when old_value <> new_value then ptime end as blame_timestamp, case when old_value <> new_value then pcommit end as blame_commit from d)"""
#: The first entry of each environment, and the file as the last entry left it.
_FIRST = """, e as (select workspace, environmentName, arg_min(id, timestamp) as id, arg_max(id, timestamp) as cid from h group by all),
k as (select e.*, q.key from e join q on q.id = e.id or q.id = e.cid group by all),
g as (select k.workspace, k.environmentName, k.id, k.key, a.value as old_value, b.value as new_value from k left join q a on a.id = k.id and a.key = k.key left join q b on b.id = k.cid and b.key = k.key)"""


def log_with_commits(spark, sf_dir):
    """The log with a commit for every entry of a known user."""
    return history(spark, sf_dir).withColumn("commitHash", F.when(F.col("user").isNotNull(), F.left(F.md5(F.col("id").cast("binary")), F.lit(8))))


def _previous(name, same, f, sql):
    part = "workspace, environmentName" if same else "workspace"
    query(name, f"with {PREVIOUS.replace('{part}', part)}{sql}")(lambda spark, sf_dir: f(log_with_commits(spark, sf_dir)))


_previous("diff_with_blame", False, lambda h: diff.diff_against_previous(h, False), " select * from s")
_previous("diff_prev_same_env", True, lambda h: diff.changes_shown(h, snapshots_at(h)), _FIRST + """ select *, 'previous' as against from s union all
select workspace, environmentName, id, key, case when old_value is null then 'added' when new_value is null then 'removed' when old_value <> new_value then 'changed' else 'unchanged' end, old_value, new_value, null, null, null, 'current' from g""")
_TRASH = " select workspace, environmentName, id, key, old_value, new_value, case when status = 'removed' then 'deleted' else 'modified' end as type from s where status = 'removed' or (status = 'changed' and new_value <> '')"
_previous("trash_log", True, diff.trash_log, _TRASH)


@query("trash_restore", f"with {PREVIOUS.replace('{part}', 'workspace, environmentName')}, t as ({_TRASH}), b as (select workspace, environmentName, key, arg_max(old_value, id::bigint) as back from t group by all)"
       + ", z as (select workspace, environmentName, arg_max(id, timestamp) as id from h group by all), c as (select workspace, environmentName, key, value from z join q using (id))"
       + " select coalesce(c.workspace, b.workspace) as workspace, coalesce(c.environmentName, b.environmentName) as environmentName, coalesce(c.key, b.key) as key, coalesce(back, value) as value from c full join b on c.workspace = b.workspace and c.environmentName = b.environmentName and c.key = b.key")
def trash_restore(spark, sf_dir):
    log = log_with_commits(spark, sf_dir)
    return diff.restore(kv.sync_pairs(snapshots_at(log), diff.KEYS), diff.trash_log(log))


@query("diff_vs_current", f"with {_ASSIGN}, q as (select id, key, arg_max(rest, line) as value from p where key <> '' group by id, key), z as (select workspace, arg_max(id, timestamp) as cid from h group by 1),"
       + " c as (select z.workspace, q.key, q.value from z join q on q.id = z.cid), o as (select h.workspace, h.id, q.key, q.value from h join q using (id)),"
       + " j as (select o.workspace, o.id, o.value as ov, c.value as cv from o left join c using (workspace, key) union all select h.workspace, h.id, null, c.value from h join c using (workspace) where not exists (select 1 from q where q.id = h.id and q.key = c.key))"
       + " select workspace, id, count(*) filter (where ov is null) as added, count(*) filter (where cv is null) as removed, count(*) filter (where ov <> cv) as changed from j group by all")
def diff_vs_current(spark, sf_dir):
    log = history(spark, sf_dir)
    current = kv.sync_pairs(log.groupBy("workspace").agg(F.max_by("fileContent", F.struct("timestamp", "id")).alias("fileContent")), ["workspace"])
    old = kv.sync_pairs(log, ["workspace", "id"]).withColumnRenamed("value", "old")
    frame = log.select("workspace", "id").join(current, "workspace")
    both = old.join(frame, ["workspace", "id", "key"], "full_outer")
    return both.groupBy("workspace", "id").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("value").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("value")).alias("changed"))


@query("current_environment", f"with {SNAPS}, f as (select workspace, arg_max(fileContent, timestamp) as c from h group by 1), m as (select s.workspace, s.environmentName from snap_b s join f on f.workspace = s.workspace and md5(s.fileContent) = md5(f.c) and s.fileContent = f.c)"
       + " select f.workspace, coalesce(min(environmentName), 'none') as environment from f left join m using (workspace) group by 1")
def current_environment(spark, sf_dir):
    """The environment whose file has the content in use: equal digests, then equal contents; the first by name."""
    log = history(spark, sf_dir)
    files = snapshots_at(log).withColumn("digest", F.md5("fileContent"))
    used = log.groupBy("workspace").agg(F.max_by("fileContent", F.struct("timestamp", "id")).alias("used")).withColumn("digest", F.md5("used"))
    hit = used.join(files, ["workspace", "digest"], "left").withColumn("hit", F.when(F.col("used") == F.col("fileContent"), F.col("environmentName")))
    return hit.groupBy("workspace").agg(F.coalesce(F.min("hit"), F.lit("none")).alias("environment"))


@query("secret_payload_normalize", "select event_id::varchar as id, 'k' as name, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def secret_payload_normalize(spark, sf_dir):
    """A wire map of strings or {computed} objects; props gives every second value in each form."""
    from kvtrail.plans.views import table

    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    wire = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"k": {"computed": "'), k, F.lit('"}}')))
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.explode(F.from_json(wire, "map<string,string>")).alias("name", "v"))
    return rows.select("id", "name", F.coalesce(F.get_json_object("v", "$.computed"), "v").alias("value")).where("value is not null")
