"""Queries of filters, searches and path rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.operators import filters as op
from kvtrail.plans.catalog import query
from kvtrail.plans.views import DOC, H, documents, history

_P = r""", a as (select id, trim(unnest(string_split(fileContent, chr(10)))) as t from h), p as (select id, trim(t[:strpos(t, '=') - 1]) as key, regexp_replace(t[strpos(t, '=') + 1:], '^["'']|["'']$', '', 'g') as value from a where t <> '' and t not like '#%' and strpos(t, '=') > 0)"""


def _kept(name, condition, sql, pairs=False):
    query(name, f"with {H}{_P if pairs else ''} select id from h where {sql}")(lambda spark, sf_dir: history(spark, sf_dir).where(condition()).select("id"))


_kept("filter_date_range", lambda: op.HistoryFilter(start="2024-01-10 00:00:00", end="2024-01-20 12:00:00").condition(), "timestamp between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-20 12:00:00'")
_kept("search_environments", lambda: op.search("PROD", "environments"), "regexp_matches(environmentName, '(?i)prod')")
_kept("search_variables", lambda: op.search("debug", "variables"), "id in (select id from p where regexp_matches(key, '(?i)debug'))", True)
_kept("search_values", lambda: op.search("h[12]$", "values", True), "id in (select id from p where regexp_matches(value, '(?i)h[12]$'))", True)
_kept("search_all", lambda: op.search("rollback after"), """regexp_matches(environmentName || ' ' || coalesce("user", '') || ' ' || coalesce(reason, '') || ' ' || fileContent, '(?i)rollback after')""")
_kept("search_literal_fallback", lambda: op.search("\"t7", "all", True), """contains(lower(fileContent), '"t7')""")
_kept("search_regex", lambda: op.search("user_1[0-3]\\b", "all", True), """regexp_matches(environmentName || ' ' || coalesce("user", '') || ' ' || coalesce(reason, '') || ' ' || fileContent, '(?i)user_1[0-3]\\b')""")
_kept("filter_users", lambda: op.HistoryFilter(users=["user_7", "user_13"]).condition(), """"user" in ('user_7', 'user_13')""")
_kept("filter_environments", lambda: op.HistoryFilter(environments=["staging", "local"]).condition(), "environmentName in ('staging', 'local')")
_kept("filter_actions", lambda: op.HistoryFilter(actions=["rollback"]).condition(), "action = 'rollback'")
_kept("filter_variables", lambda: op.has_variables(["DEBUG", "NONE"]), "id in (select id from p where key = 'DEBUG')", True)
_kept("quick_filter", lambda: op.quick_filter("User_1", "switch"), """action = 'switch' and (environmentName like '%user_1%' or coalesce(lower("user"), '') like '%user\\_1%' escape '\\' or coalesce(lower(reason), '') like '%user\\_1%' escape '\\')""")
_kept("entry_completeness_filter", lambda: F.expr("id != '' and timestamp is not null and action != '' and fileContent != ''"), "id <> '' and timestamp is not null and action <> '' and fileContent <> ''")
_ALL = op.HistoryFilter(start="2024-01-05 00:00:00", text="port", scope="variables", users=["user_3", "user_4"], actions=["switch", "modify"])
query("apply_filters", f"""with {H} select id from h where timestamp >= timestamp '2024-01-05 00:00:00' and "user" in ('user_3', 'user_4') and action in ('switch', 'modify')""")(lambda spark, sf_dir: _ALL.apply(history(spark, sf_dir)).select("id"))
query("filter_summary", f"""with {H} select count(*) as total, count(*) filter (where timestamp >= timestamp '2024-01-05 00:00:00' and "user" in ('user_3', 'user_4') and action in ('switch', 'modify')) as filtered,
'Date range, Search (variables), Users (2), Actions (2)' as applied from h""")(lambda spark, sf_dir: _ALL.summary(history(spark, sf_dir)))
query("date_range_presets", f"""with {H}, r as (select date_trunc('day', max(timestamp))::timestamp as t from h)
select 'Today' as label, t as start, t + interval 1 day - interval 1 millisecond as "end" from r
""" + "".join(f" union all select '{n}', t - interval {d} day, null from r" for n, d in (("Last 7 days", 7), ("Last 30 days", 30), ("Last 90 days", 90), ("Last 180 days", 180), ("Last year", 365))))(
    lambda spark, sf_dir: op.date_presets(history(spark, sf_dir).agg(F.max("timestamp").alias("ref_ts")))
)

_docs = lambda spark, sf_dir: documents(spark, sf_dir)
query("ignore_glob", f"""with {DOC} select doc_key, (path like '%.test.ts' or path like '%.md' or regexp_matches(path, '(?i)^(out|dist|build|tests|test|__tests__|docs|k8s|helm)/') ) as ignored from doc""")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_key", op.ignored(F.col("path")).alias("ignored"))
)
query("ignore_negation", f"""with {DOC} select doc_key, ((path like '%.md' and path not like 'conversations/%') or path like 'src1/%') as ignored from doc""")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_key", op.ignored(F.col("path"), ["*.md", "!conversations/", "src1/"]).alias("ignored"))
)
_TYPES = ", ".join(f"'{t}'" for t in op.SCANNED_TYPES)
_DIRS = " and ".join(f"not contains(path, '{d}')" for d in op.SKIPPED_FOLDERS)
query("should_scan_file", f"with {DOC} select doc_key, ({_DIRS} and regexp_extract(lower(path), '(\\.[^.]*)$', 1) in ({_TYPES})) as scan from doc")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_key", op.should_scan(F.col("path")).alias("scan"))
)
query("size_and_binary_gate", f"with {DOC} select doc_key, (strlen(text) <= 20000 and not contains(text, chr(0))) as pass from doc")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_key", op.size_gate(F.col("text"), 20_000).alias("pass"))
)
