"""Input views over the given tables: history, key-value rows, rules, documents, lines and candidates.

Each view comes as a DataFrame and as a SQL common table expression with the same
rows, so that a query and its SQL counterpart start from one definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVIRONMENTS = ["development", "staging", "production", "local"]
ACTIONS = {"click": "switch", "view": "modify", "purchase": "manual_edit", "signup": "initial", "error": "rollback"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history_from_events(events: DataFrame, fine: bool = False) -> DataFrame:
    """The snapshot log: id, timestamp, action, environmentName, user, reason, fileContent, workspace."""
    k = F.get_json_object("props", "$.k").cast("long")
    e, u = F.col("event_id"), F.col("user_id")
    action = F.lit(None).cast("string")
    for event, name in ACTIONS.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    content = F.concat(
        F.lit("# generated\nPORT="), F.when(e % 9 == 4, "auto").otherwise((3000 + e % 7).cast("string")), F.lit('\nAPI_TOKEN="t'), k.cast("string"), F.lit('"'),
        F.when(k % 3 == 0, "\nDEBUG=true").otherwise(""), F.lit("\nURL=http://h"), (u % 5).cast("string"),
        F.when(k % 17 == 0, "\nBROKEN LINE").otherwise(""), F.when(k % 11 == 0, F.concat(F.lit("\nPORT="), k.cast("string"))).otherwise(""),
        F.when((u % 10 == 3) & (e % 5 == 0), F.concat(F.lit("\nSEALED=ENC["), e.cast("string"), F.lit("]"))).otherwise(""), F.when(e % 40 == 7, F.concat(F.lit("\nGH_TOKEN=ghp_"), F.md5(e.cast("string").cast("binary")))).otherwise(""),
    )
    return events.select(
        e.cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("user_" if fine else "ws_"), (u if fine else u % 10).cast("string")).alias("workspace"),
        F.when(u % 13 != 0, F.concat(F.lit("user_"), u.cast("string"))).alias("user"),
        F.element_at(F.array(*map(F.lit, ENVIRONMENTS)), ((e * 7 + u) % 4 + 1).cast("int")).alias("environmentName"),
        action.alias("action"),
        F.when(F.col("event_type") == "error", "rollback after error").alias("reason"),
        content.alias("fileContent"),
    )


def history(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    return history_from_events(table(spark, sf_dir, "events"), fine)


def _history_sql(workspace: str, where: str = "true") -> str:
    cases = " ".join(f"when '{e}' then '{a}'" for e, a in ACTIONS.items())
    return f"""(select event_id::varchar as id, ts as timestamp, {workspace} as workspace,
  case when user_id % 13 <> 0 then 'user_' || user_id end as "user",
  list_extract(['development','staging','production','local'], (event_id * 7 + user_id) % 4 + 1) as environmentName,
  case event_type {cases} end as action,
  case when event_type = 'error' then 'rollback after error' end as reason,
  '# generated' || chr(10) || 'PORT=' || case when event_id % 9 = 4 then 'auto' else (3000 + event_id % 7)::varchar end || chr(10) || 'API_TOKEN="t' || k || '"'
   || case when k % 3 = 0 then chr(10) || 'DEBUG=true' else '' end || chr(10) || 'URL=http://h' || (user_id % 5)
   || case when k % 17 = 0 then chr(10) || 'BROKEN LINE' else '' end
   || case when k % 11 = 0 then chr(10) || 'PORT=' || k else '' end
   || case when user_id % 10 = 3 and event_id % 5 = 0 then chr(10) || 'SEALED=ENC[' || event_id || ']' else '' end
   || case when event_id % 40 = 7 then chr(10) || 'GH_TOKEN=ghp_' || md5(event_id::varchar) else '' end as fileContent
  from (select *, json_extract_string(props, '$.k')::bigint as k from events) where {where})"""


H = "h as " + _history_sql("'ws_' || (user_id % 10)")
H_FINE = "h as " + _history_sql("'user_' || user_id")
H_TINY = "h as " + _history_sql("'user_' || user_id || '_' || (event_id // 600)")


def tiny_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log in many small workspaces, most of one or two changes: of a user and 600 neighbouring events."""
    return history(spark, sf_dir, True).withColumn("workspace", F.concat("workspace", F.lit("_"), F.expr("cast(id as bigint) div 600")))


def snapshots_at(log: DataFrame, until: Column | None = None) -> DataFrame:
    """The last snapshot of each workspace and environment, at or before a time."""
    rows = log if until is None else log.where(F.col("timestamp") <= until)
    return rows.groupBy("workspace", "environmentName").agg(F.max_by("fileContent", F.struct("timestamp", "id")).alias("fileContent"))


def _snapshot_sql(name: str, where: str) -> str:
    return f"{name} as (select workspace, environmentName, arg_max(fileContent, timestamp) as fileContent from h where {where} group by all)"


CUT = "2024-01-15 00:00:00"
SNAPS = f"{H}, {_snapshot_sql('snap_a', f'''timestamp <= timestamp '{CUT}' ''')}, {_snapshot_sql('snap_b', 'true')}"

#: Lines of every snapshot in SQL, with 1-based numbers.
LINES_OF_H = H + r""", hl as (select id, workspace, unnest(string_split(fileContent, chr(10))) as raw, generate_subscripts(string_split(fileContent, chr(10)), 1) as line from h)"""

RULES = [
    ("required", "PORT", None), ("required", "DEBUG", None), ("type", "PORT", "number"), ("type", "URL", "url"),
    ("type", "DEBUG", "boolean"), ("custom", "API_TOKEN", '^"t[0-8]?[0-9]"$'),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_type string, variable string, arg string")


RULES_SQL = "rules(rule_type, variable, arg) as (values " + ", ".join(f"('{a}', '{b}', " + ("null" if c is None else f"'{c}'") + ")" for a, b, c in RULES) + ")"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_key, source, path, text of documents, pages and conversation turns."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".md", ".test.ts", ".env"))), (F.col("doc_id") % 4 + 1).cast("int"))
    a = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_key"), "source", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), "text")
    p = table(spark, sf_dir, "pages")
    b = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_key"), F.lit("pages").alias("source"), F.col("url").alias("path"), F.col("html").alias("text"))
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    t = c.select(key.alias("doc_key"), F.lit("conversations").alias("source"), F.concat(F.lit("conversations/"), key, F.lit(".md")).alias("path"), "text")
    return a.unionByName(b).unionByName(t)


DOC = """doc as (
  select 'd' || doc_id as doc_key, source, source || '/' || lang || '/' || doc_id || list_extract(['.py','.md','.test.ts','.env'], doc_id % 4 + 1) as path, text from documents
  union all select 'p' || page_id, 'pages', url, html from pages
  union all select 'c' || conv_id || '_' || turn, 'conversations', 'conversations/c' || conv_id || '_' || turn || '.md', text from conversations)"""


def lines(docs: DataFrame) -> DataFrame:
    """doc_key, source, path, line (from 1) and content of each line."""
    return docs.select("doc_key", "source", "path", F.posexplode(F.split("text", "\n")).alias("pos", "content")).select("doc_key", "source", "path", (F.col("pos") + 1).alias("line"), "content")


LINES = DOC + ", lines as (select doc_key, source, path, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1)::int as line from doc)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, value, context, variable_name: possible secrets of every family, made from events."""
    e = F.col("event_id")
    m = F.md5(e.cast("string").cast("binary"))
    mm = F.concat(m, m)
    by = e % 12
    shapes = [
        F.concat(F.lit("ghp_"), F.substring(mm, 1, 36)), F.concat(F.lit("AKIAI"), F.upper(F.substring(m, 1, 16))), F.concat(F.lit("sk-"), F.substring(m, 1, 24)),
        F.concat(F.lit("xoxb-12-34-"), m), F.concat(F.lit("eyJ"), m), m, F.sha2(e.cast("string").cast("binary"), 256),
        F.concat(F.lit("postgres://u:"), m, F.lit("@h/db")), F.concat(F.lit("password="), F.substring(m, 1, 12)), F.concat(F.lit("vercel_"), m), F.lit("example_test"), F.lit(""),
    ]
    value = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        value = F.when(by == i, shape).otherwise(value)
    rows = table(spark, sf_dir, "events").select(e.cast("string").alias("candidate_id"), value.alias("value"), e.alias("event_id"))
    context = F.when(e % 2 == 0, F.concat(F.lit('const API_KEY = "'), "value", F.lit('"'))).otherwise(F.concat(F.lit("# note "), "value"))
    name = F.when(e % 3 == 0, "API_KEY").when(e % 3 == 1, "db_pass")
    return rows.select("candidate_id", "event_id", "value", context.alias("context"), name.alias("variable_name"))


CAND = """cand as (select *, case when event_id % 2 = 0 then 'const API_KEY = "' || value || '"' else '# note ' || value end as context,
    case event_id % 3 when 0 then 'API_KEY' when 1 then 'db_pass' end as variable_name
  from (select event_id::varchar as candidate_id, event_id, case event_id % 12
    when 0 then 'ghp_' || left(m || m, 36) when 1 then 'AKIAI' || upper(left(m, 16)) when 2 then 'sk-' || left(m, 24) when 3 then 'xoxb-12-34-' || m
    when 4 then 'eyJ' || m when 5 then m when 6 then sha256(event_id::varchar) when 7 then 'postgres://u:' || m || '@h/db' when 8 then 'password=' || left(m, 12)
    when 9 then 'vercel_' || m when 10 then 'example_test' else '' end as value from (select event_id, md5(event_id::varchar) as m from events)))"""

#: What stands around the digest of an event, so that the families without a candidate have one as well.
PATTERN_FRAMES = [
    ("pk_", ""), ("sg.", ""), ("dop_v1_", ""), ("gho_", ""), ("MailgunApiKey-", ""), ("TwilioAuthToken-", ""), ("SENTRY_DSN=", ""), ("secret=", ""), ("mongodb+srv://", ""), ("redis://", ""),
    ("projects/p/secrets/", "/versions/1"), *((f"x-----BEGIN {k}-----\n", f"\n-----END {k}-----y") for k in ("RSA PRIVATE KEY", "DSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "CERTIFICATE")), ("", ""),
]


def framed() -> Column:
    """The context of a candidate and, after a blank, its event's digest in one of the frames."""
    pick = lambda side: F.element_at(F.array(*(F.lit(f[side]) for f in PATTERN_FRAMES)), (F.col("event_id") % len(PATTERN_FRAMES) + 1).cast("int"))
    return F.concat("context", F.lit(" "), pick(0), F.md5(F.col("event_id").cast("string").cast("binary")), pick(1))


def _frame_sql(side: int) -> str:
    return "list_extract([" + ", ".join("'" + f[side].replace("\n", "' || chr(10) || '") + "'" for f in PATTERN_FRAMES) + f"], event_id % {len(PATTERN_FRAMES)} + 1)"


FRAMED = f"context || ' ' || {_frame_sql(0)} || md5(event_id::varchar) || {_frame_sql(1)}"
