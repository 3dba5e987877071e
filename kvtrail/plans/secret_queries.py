"""Queries of pattern matching, scoring and classification of possible secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.functions import kv
from kvtrail.functions import secrets as fn
from kvtrail.operators import detection as op
from kvtrail.plans.catalog import query
from kvtrail.plans.views import CAND, FRAMED, LINES, LINES_OF_H, candidates, documents, framed, history, lines, table


# columns are made when a query runs: a session may not exist when this module is imported
def V():
    return F.col("value")


def C():
    return F.col("context")


def N():
    return F.col("variable_name")


_ENT = ", ch as (select candidate_id, unnest(string_split(value, '')) as c from cand), en as (select candidate_id, sum(-n / t * log2(n / t)) as h from (select candidate_id, c, count(*)::double as n, (sum(count(*)) over (partition by candidate_id))::double as t from ch where c <> '' group by candidate_id, c) group by 1), e as (select cand.*, coalesce(h, 0) as h from cand left join en using (candidate_id))"
_VARIETY = "(regexp_matches(value, '[a-z]')::int + regexp_matches(value, '[A-Z]')::int + regexp_matches(value, '[0-9]')::int + regexp_matches(value, '[^a-zA-Z0-9\\s]')::int >= 2)"


def _scored(name, columns, sql, head=CAND):
    query(name, f"with {head} select candidate_id, {sql}")(lambda spark, sf_dir: candidates(spark, sf_dir).select("candidate_id", *columns()))




def _H():
    return fn.shannon_entropy(V())


_scored("shannon_entropy", lambda: [F.round(_H(), 6).alias("entropy")], "round(h, 6) as entropy from e", CAND + _ENT)
_CONF = "case when h >= 4.5 and length(value) >= 20 then 'high' when h >= 3.5 and length(value) >= 12 then 'medium' else 'low' end"
_scored("entropy_confidence", lambda: [fn.entropy_confidence(F.round(_H(), 9), F.length(V())).alias("confidence")], f"{_CONF} as confidence from (select * replace (round(h, 9) as h) from e)", CAND + _ENT)
_scored("has_variety", lambda: [fn.has_variety(V()).alias("variety")], f"{_VARIETY} as variety from cand")
_scored("is_likely_secret", lambda: [fn.is_likely_secret(V(), F.round(_H(), 9)).alias("likely")], f"(length(value) >= 8 and round(h, 9) >= 2.5 and {_VARIETY}) as likely from e", CAND + _ENT)
_scored("secret_quality", lambda: [c.alias(n) for c, n in zip(fn.secret_quality(V(), F.round(_H(), 9)), ("score", "assessment"), strict=True)],
        f"case {_CONF} when 'high' then 1.0::double when 'medium' then 0.7::double else 0.3::double end as score, {_CONF} || ' confidence' || case when {_VARIETY} then '' else ' (low character variety)' end || case when h < 2 then ' (low entropy)' else '' end as assessment from (select * replace (round(h, 9) as h) from e)", CAND + _ENT)
_scored("checksum", lambda: [fn.checksum(V()).alias("checksum")], "left(sha256(value), 16) as checksum from cand")
_scored("hash_entry", lambda: [fn.entry_hash(N(), V()).alias("hash")], "left(sha256(variable_name || ':' || left(value, 8)), 16) as hash from cand")
_scored("secret_normalize", lambda: [fn.normalized(F.concat(F.lit(" "), V(), F.lit("\r\n"))).alias("normal")], "trim(replace(' ' || value || chr(10), chr(10), ' ')) as normal from cand")
_scored("mask_value", lambda: [fn.mask_value(V()).alias("masked")], """case when value = '' then '(empty)' when length(value) > 12 and regexp_matches(value, '[A-Za-z0-9]{8,}') then left(value, 4) || '••••••••' when length(value) > 60 then left(value, 57) || '…' else value end as masked from cand""")
_scored("variable_name_from_context", lambda: [kv.variable_name(C()).alias("name")], """coalesce(nullif(regexp_extract(context, '(?:const|let|var)\\s+(\\w+)|(\\w+)\\s*[:=]', 1), ''), nullif(regexp_extract(context, '(?:const|let|var)\\s+(\\w+)|(\\w+)\\s*[:=]', 2), '')) as name from cand""")
_scored("format_bytes", lambda: [fn.format_bytes(F.col("event_id") * 997).alias("size")], """case when n = 0 then '0 B' else regexp_replace(printf('%.1f', round(n / pow(1024.0::double, u), 1)), '\\.0$', '') || ' ' || list_extract(['B', 'KB', 'MB', 'GB'], u + 1) end as size from (select *, event_id * 997 as n, case when event_id * 997 < 1024 then 0 when event_id * 997 < 1048576 then 1 when event_id * 997 < 1073741824 then 2 else 3 end as u from cand)""")


def _any(text, words):
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _first(text, words):
    return "coalesce(" + ", ".join(f"case when contains({text}, '{w}') then '{w}' end" for w in words) + ")"


def _count(text, words):
    return "(" + " + ".join(f"contains({text}, '{w}')::int" for w in words) + ")"


_LOW = "lower(context)"
_KEYWORD = f"case when {_any(_LOW, fn.HIGH_RISK)} then 6 when {_any(_LOW, fn.GENERAL)} then 3 else 0 end"
_ASSIGN = r"(case when contains(context, '=') or contains(context, ': ') then 2 else 0 end + case when contains(context, 'process.env.') or contains(context, 'process.env[') then 4 else 0 end + case when contains(context, '{') and contains(context, '}') then 2 else 0 end + case when regexp_matches(context, '\b(const|let|var)\s+') then 3 else 0 end)"
_VAR = r"regexp_extract(context, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*[:=]', 1)"
_NAMING = f"case when {_VAR} = '' then 0 when {_any(f'lower({_VAR})', fn.HIGH_RISK)} then 5 when {_any(f'lower({_VAR})', ['api', 'key', 'token', 'secret', 'auth', 'password'])} then 3 when {_VAR} = upper({_VAR}) then 2 else 0 end"
_STRING = f"""(case when regexp_matches(context, '["''`]') then 2 else 0 end + case when contains(context, 'export ') or contains(context, 'set ') then 3 else 0 end + case when contains(context, '"') and contains(context, ':') then 2 else 0 end
 - case when contains(context, '//') or contains(context, '#') or contains(context, '/*') then 3 else 0 end - case when {_any('value', ['test', 'example', 'sample'])} then 2 else 0 end)"""
_NEIGHBOR = f"(case when len(regexp_extract_all(context, '[:=]')) > 1 then 1 else 0 end + case when len([x for x in string_split(lower(context), chr(10)) if {_any('x', fn.HIGH_RISK)}]) > 1 then 2 else 0 end)"
_CC = f"least(1.0::double, greatest(0.0::double, ({_KEYWORD} + {_ASSIGN} + {_NAMING} + {_STRING} + {_NEIGHBOR}) / 10.0::double))"
_scored("keyword_proximity", lambda: [fn.keyword_score(C()).alias("score"), fn.nearest_keyword(C()).alias("keyword")], f"{_KEYWORD} as score, coalesce({_first(_LOW, fn.HIGH_RISK)}, {_first(_LOW, fn.GENERAL)}) as keyword from cand")
_scored("assignment_score", lambda: [fn.assignment_score(C()).alias("score")], f"{_ASSIGN} as score from cand")
_scored("naming_score", lambda: [fn.naming_score(C()).alias("score")], f"{_NAMING} as score from cand")
_scored("string_score", lambda: [fn.string_score(C(), V()).alias("score")], f"{_STRING} as score from cand")
_scored("neighbor_score", lambda: [fn.neighbor_score(C()).alias("score")], f"{_NEIGHBOR} as score from cand")
_RISK = "case when c >= 0.8 then 'high' when c >= 0.5 then 'medium' else 'low' end"
_METHOD = f"case when {_KEYWORD} > 0 then 'Keyword Proximity' when {_NAMING} > 0 then 'Variable Naming' when {_ASSIGN} > 0 then 'Assignment Pattern' else 'String Context' end"
_scored("context_confidence", lambda: [F.round(fn.context_confidence(C(), V()), 6).alias("confidence"), fn.risk_level(fn.context_confidence(C(), V())).alias("risk"), fn.detection_method(C()).alias("method")],
        f"round(c, 6) as confidence, {_RISK} as risk, method from (select candidate_id, {_CC} as c, {_METHOD} as method from cand)")
_DETAIL = rf"(2 * {_count(_LOW, fn.HIGH_RISK)} + contains(context, 'process.env.')::int + contains(context, '=')::int + contains(context, ': ')::int + regexp_matches(context, '\b(const|let|var)\s+')::int)"
_scored("detailed_context", lambda: [c.alias(n) for c, n in zip(fn.detailed_context(C()), ("score", "assessment"), strict=True)],
        f"s as score, case when s >= 5 then 'High risk: Multiple security indicators' when s >= 3 then 'Medium risk: Some security indicators' when s >= 1 then 'Low risk: Minimal security indicators' else 'Safe: No security indicators detected' end as assessment from (select candidate_id, {_DETAIL} as s from cand)")


def _LABEL():
    return F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "medium").otherwise("low")


_LABEL_SQL = "case event_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end"
_scored("enhance_confidence", lambda: [F.round(fn.enhanced_confidence(_LABEL(), fn.context_confidence(C(), V())), 6).alias("confidence_num")], f"round(greatest(case event_id % 3 when 0 then 1.0::double when 1 then 0.5::double else 0 end, {_CC}), 6) as confidence_num from cand")
_scored("analyze_secret_context", lambda: [fn.surrounding_confidence(N(), C().contains("="), C()).alias("confidence"), fn.risk_level(fn.surrounding_confidence(N(), C().contains("="), C())).alias("risk")],
        f"c as confidence, {_RISK} as risk from (select candidate_id, round(least(1.0::double, 0.5 + case when {_any('lower(coalesce(variable_name, chr(48)))', fn.HIGH_RISK)} then 0.3 else 0 end + case when contains(context, '=') then 0.2 else 0 end + case when contains({_LOW}, 'auth') or contains({_LOW}, 'login') then 0.15 else 0 end), 6) as c from cand)")
_scored("comprehensive_security", lambda: [F.round(fn.security_score(F.lit(0.5), F.lit("generic password"), C()), 6).alias("score")], "round(least(1.0::double, 0.5 + case when contains(context, 'hardcoded') or contains(context, 'const ') then 0.3 else 0 end + 0.2), 6) as score from cand")
_CERTAIN = "regexp_matches(value, '" + "|".join(fn.CERTAIN) + "')"
_scored("known_pattern_l1", lambda: [fn.known_pattern(V()).alias("hit")], f"{_CERTAIN} as hit from cand")
_scored("response_label_map", lambda: [fn.response_label(F.when(F.col("event_id") % 4 == 0, "Critical").otherwise(_LABEL()), F.col("event_id") % 2 == 0).alias("label")], f"case when event_id % 4 = 0 then 'high' else {_LABEL_SQL} end as label from cand")
_scored("confirmed_label", lambda: [fn.confirmed_label(F.when(F.col("event_id") % 2 == 0, "confirmed").otherwise("ignored"), fn.context_confidence(C(), V())).alias("label")], f"case when event_id % 2 = 1 then 'false_positive' when {_CC} >= 0.8 then 'high' when {_CC} >= 0.5 then 'medium' else 'low' end as label from cand")


@query("char_distribution", f"with {CAND}, ch as (select unnest(string_split(value, '')) as c from cand) select c, count(*) as n from ch where c <> '' group by 1")
def char_distribution(spark, sf_dir):
    return candidates(spark, sf_dir).select(F.explode(fn.characters(V())).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


# the feature vector
def _gram(n, name):
    return f""", g{n} as (select candidate_id, unnest([s[i:i + {n - 1}] for i in range(1, greatest(1, length(s) - {n - 2}))]) as g from b),
h{n} as (select candidate_id, sum(-k / t * log2(k / t)) as {name} from (select candidate_id, g, count(*)::double as k, (sum(count(*)) over (partition by candidate_id))::double as t from g{n} where length(g) = {n} group by candidate_id, g) group by 1)"""


_WIN = """, w as (select candidate_id, unnest(range(1, greatest(1, length(s) - 6))) as i, s from b where length(s) >= 8), wc as (select candidate_id, i, unnest(string_split(s[i:i + 7], '')) as c from w),
we as (select candidate_id, i, round(sum(-k / 8 * log2(k / 8)), 12) as h from (select candidate_id, i, c, count(*)::double as k from wc group by all) group by 1, 2), wf as (select candidate_id, ((1 - least(1.0, stddev_pop(h) / 2)) + least(1.0, avg(h) / 4)) / 2 as f13 from we group by 1)"""
_RUN = """, rc as (select candidate_id, unnest(string_split(s, '')) as c, generate_subscripts(string_split(s, ''), 1) as i from b), rg as (select candidate_id, c, i - row_number() over (partition by candidate_id, c order by i) as g from rc where c <> ''),
rl as (select candidate_id, max(k) as run from (select candidate_id, c, g, count(*) as k from rg group by all) group by 1), uq as (select candidate_id, count(distinct c) as u from rc where c <> '' group by 1)"""
_best = "greatest(0.0::double, " + ", ".join(f"case when regexp_matches(s, '{p.replace(chr(92) + 'z', '$')}') then {v}::double else 0 end" for p, v in fn.FORMATS) + ")"
_sw = "(len([i for i in range(1, length(s)) if regexp_matches(s[i:i + 1], '^([A-Za-z][0-9]|[0-9][A-Za-z])$')]))"
_sep = "case when not regexp_matches(s, '[^-_.]') then least(1.0, len(regexp_extract_all(s, '[-_.]')) * 0.2) " + " ".join(
    f"when contains(s, '{d}') then (select least(1.0, (1 - (max(length(x)) - min(length(x))) / max(length(x))::double) * 0.8 + 0.2) from (select unnest(string_split(s, '{d}')) as x) where x <> '')" for d in "-_."
) + " else 0 end"
_rt = lambda p: f"len(regexp_extract_all(s, '{p}')) / z"
_EXPR = [
    "least(1.0, n / 100.0::double)", "case when n >= 20 then 1.0 else n / 20.0::double end", _rt("[0-9]"), _rt("[A-Z]"), _rt("[a-z]"), _rt(r"[!#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"), "coalesce(u, 0) / z",
    "coalesce(e1, 0) / 8", "coalesce(e2, 0) / 8", "coalesce(e3, 0) / 8", "least(1.0, coalesce(u, 0) / least(z, 64))", "coalesce(run, 0) / z", "1 - coalesce(run, 0) / z", "coalesce(f13, 0)", _best,
    "(n >= 16 and n % 4 = 0 and regexp_matches(s, '^[A-Za-z0-9+/=]+$'))::int", "(n >= 32 and n % 2 = 0 and regexp_matches(s, '^[0-9a-fA-F]+$'))::int",
    "(" + " or ".join(f"starts_with(s, '{p}')" for p in fn.KNOWN_PREFIXES) + ")::int", "(right(s, 1) = '=')::int", "regexp_matches(s, '[A-Za-z0-9+/]{40,}={0,2}$')::int",
    f"least(1.0, {_count(_LOW, fn.HIGH_CONTEXT)} * 0.4)", f"least(1.0, {_count(_LOW, fn.MEDIUM_CONTEXT)} * 0.2)", f"least(1.0, {_count(_LOW, fn.LOW_CONTEXT)} * 0.1)", "regexp_matches(context, '[\"''`]')::int", "contains(context, '=')::int",
    f"least(1.0, {_count('lower(v)', fn.DANGER_NAMES)} * 0.5)", f"least(1.0, {_count('lower(v)', fn.RISK_NAMES)} * 0.3)", "(v <> '' and v = upper(v))::int", "contains(v, '_')::int", "least(1.0, length(v) / 30.0::double)",
    f"case when n < 8 then 0 else least(1.0, {_sw} / (z * 0.35)) end", _sep, "case when n between 20 and 100 then 1.0 when n > 100 then 0.3 else 0 end",
    "(regexp_matches(s, '[A-Za-z]')::int + regexp_matches(s, '[0-9]')::int + (regexp_matches(s, '[A-Z]') and regexp_matches(s, '[a-z]'))::int) / 3.0::double", "regexp_matches(s, '[A-Z]{2,}[0-9]{2,}|[0-9]{2,}[A-Z]{2,}')::int",
]
_FEAT = CAND + ", b as (select *, value as s, length(value) as n, greatest(1, length(value))::double as z, coalesce(variable_name, '') as v from cand)" + _gram(1, "e1") + _gram(2, "e2") + _gram(3, "e3") + _WIN + _RUN + ", ft as (select candidate_id, variable_name, value, " + ", ".join(f"round(({x})::double, 6) as f{k:02d}" for k, x in enumerate(_EXPR)) + " from b left join h1 using (candidate_id) left join h2 using (candidate_id) left join h3 using (candidate_id) left join wf using (candidate_id) left join rl using (candidate_id) left join uq using (candidate_id))"
_CLASS = "case when f14 >= 1 and f07 * 8 > 4.0 then 'high' when f07 * 8 > 4.5 and (f20 > 0 or f25 > 0) then 'high' when f07 * 8 > 3.5 then 'medium' else 'low' end"
_wide = [f"f{k:02d}" for k in range(35)]


@query("features_f00_f34", f"with {_FEAT} select candidate_id, {', '.join(_wide)} from ft")
def features_table(spark, sf_dir):
    rows = op.feature_table(candidates(spark, sf_dir))
    return rows.select("candidate_id", *(F.round(F.col("f")[k], 6).alias(n) for k, n in enumerate(_wide)))


@query("fallback_classify", f"with {_FEAT} select candidate_id, {_CLASS} as class from ft")
def fallback_classify(spark, sf_dir):
    return op.classified(candidates(spark, sf_dir)).select("candidate_id", "class")


_BLACK = "bl as (select distinct left(sha256(variable_name || ':' || left(value, 8)), 16) as hash from cand where event_id % 24 = 10)"


def _blacklist(c):
    return c.where("event_id % 24 = 10").select(fn.entry_hash(N(), V()).alias("hash")).where("hash is not null").distinct()


@query("classify_cascade", f"with {_FEAT}, {_BLACK} select candidate_id, case when {_CERTAIN} then 'high' when left(sha256(variable_name || ':' || left(value, 8)), 16) in (select hash from bl where hash is not null) then 'high' when f07 * 8 < 3.5 then 'low' else {_CLASS} end as label from ft")
def classify_cascade(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return op.cascade(c, _blacklist(c)).select("candidate_id", "label")


@query("blacklist_semi_join", f"with {CAND}, {_BLACK} select candidate_id from cand where left(sha256(variable_name || ':' || left(value, 8)), 16) in (select hash from bl where hash is not null)")
def blacklist_semi_join(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.withColumn("hash", fn.entry_hash(N(), V())).join(_blacklist(c), "hash", "left_semi").select("candidate_id")


_HASHES = f"with {CAND}, {_BLACK}, x as (select distinct left(sha256(variable_name || ':' || left(value, 8)), 16) as hash from cand where {_CERTAIN} and variable_name is not null) "


@query("dedupe_findings_by_hash", _HASHES + "select hash from x")
def dedupe_findings(spark, sf_dir):
    return candidates(spark, sf_dir).where(fn.known_pattern(V()) & N().isNotNull()).select(fn.entry_hash(N(), V()).alias("hash")).dropDuplicates(["hash"])


@query("false_positive_removal", _HASHES + ", fp as (select left(sha256(variable_name || ':' || left(value, 8)), 16) as hash from cand where event_id % 36 = 0) select hash from x where hash not in (select hash from fp where hash is not null)")
def false_positive_removal(spark, sf_dir):
    c = candidates(spark, sf_dir)
    wrong = c.where("event_id % 36 = 0").select(fn.entry_hash(N(), V()).alias("hash")).where("hash is not null")
    return dedupe_findings(spark, sf_dir).join(wrong, "hash", "left_anti")


# patterns
def _pattern(k, p):
    # the two engines' regex flavours agree on lines; a match is compared by its count and its text
    sql = f"with {CAND}, m as (select candidate_id, unnest(regexp_extract_all({FRAMED}, '{p.re2().replace(chr(39), chr(39) * 2)}')) as match from cand) select candidate_id, match from m where match <> ''"
    query(f"pattern_{k:02d}", sql)(lambda spark, sf_dir: candidates(spark, sf_dir).select("candidate_id", F.explode(op.matches(framed(), p)).alias("match")).where("match != ''"))


for _k, _p in enumerate(op.DEFAULT_PATTERNS, 1):
    _pattern(_k, _p)
_COUNTS = " union all ".join(f"select '{p.type}' as type, coalesce(sum(len(regexp_extract_all(content, '{p.re2().replace(chr(39), chr(39) * 2)}'))), 0)::bigint as matches from lines" for p in op.DEFAULT_PATTERNS)
query("pattern_counts", f"with {LINES.replace('lines as (', 'lines as materialized (')} {_COUNTS}")(lambda spark, sf_dir: op.pattern_counts(lines(documents(spark, sf_dir)), "content"))
_TYPES = "t(type, priority) as (values " + ", ".join(f"('{p.type}', {p.priority})" for p in op.DEFAULT_PATTERNS) + "), "


def _matched(name, patterns, sql):
    """Matches of a chosen part of the pattern set over all candidates."""
    names = ", ".join(f"'{p.type}'" for p in patterns.patterns)
    counts = " union all ".join(f"select '{p.type}' as type, coalesce(sum(len(regexp_extract_all(context, '{p.re2().replace(chr(39), chr(39) * 2)}'))), 0)::bigint as matches from cand" for p in op.DEFAULT_PATTERNS)
    query(name, f"with {_TYPES}{CAND}, c as ({counts}) select type, matches from c join t using (type) where {sql} and type in ({names})")(lambda spark, sf_dir: op.pattern_counts(candidates(spark, sf_dir), "context", patterns))


_matched("patterns_by_priority", op.PatternSet().at_least(5), "priority >= 5")
_matched("patterns_by_category", op.PatternSet().category("HASH"), "contains(lower(type), 'hash')")
_custom = op.PatternSet().remove("Base64 Encoded Data").add(op.Pattern("Note", r"\bnote\b", 9)).add(op.Pattern("Slack Address", r"xoxb-[0-9]+-[0-9]+-[a-f0-9]{8}", 6))
_SETS = {"changed": _custom, "reset": _custom.reset()}


def _counted(text, where="cand"):
    count = lambda p: f"select '{p.type}' as type, coalesce(sum(len(regexp_extract_all({text}, '{p.re2().replace(chr(39), chr(39) * 2)}'))), 0)::bigint as matches from {where}"
    return {name: " union all ".join(f"select '{name}' as stage, * from ({count(p)})" for p in patterns.patterns) for name, patterns in _SETS.items()}


@query("custom_pattern_set", f"with {CAND} " + " union all ".join(_counted("context").values()))
def custom_pattern_set(spark, sf_dir):
    """Matches of every pattern after two have been added and one removed, and after a reset."""
    stages = [op.pattern_counts(candidates(spark, sf_dir), "context", p).select(F.lit(name).alias("stage"), "type", "matches") for name, p in _SETS.items()]
    return stages[0].unionByName(stages[1])


@query("pattern_counts_texts", f"with {CAND}, t as materialized (select {FRAMED} as text from cand) " + _counted("text", "t")["reset"].replace("select 'reset' as stage, * from", "select * from"))
def pattern_counts_texts(spark, sf_dir):
    """Matches of every pattern in whole texts, so keys and certificates over several lines count."""
    return op.pattern_counts(candidates(spark, sf_dir).select(framed().alias("text")), "text")


@query("context_window", f"with {LINES} select doc_key, line, lag(content) over w as before, lead(content) over w as after from lines window w as (partition by doc_key order by line)")
def context_window(spark, sf_dir):
    return op.context_window(lines(documents(spark, sf_dir))).select("doc_key", "line", "before", "after")


_TOKENS = op.PatternSet(tuple(p for p in op.DEFAULT_PATTERNS if p.type == "GitHub Personal Access Token"))


@query("context_marks", f"""with {LINES_OF_H}, w as (select id, line, raw, lag(raw) over (partition by id order by line) as before, lead(raw) over (partition by id order by line) as after from hl),
m as (select *, regexp_extract(raw, '\\bghp_[a-zA-Z0-9]{{20,}}\\b') as value from w), c as (select *, strpos(raw, value) as pos from m where value <> '')
select id, line::int as line, pos::int as "column", value, coalesce('... ' || trim(before) || chr(10), '') || raw[:pos - 1] || '[SECRET]' || raw[pos:] || coalesce(chr(10) || trim(after) || ' ...', '') as context from c""")
def context_marks(spark, sf_dir):
    """Every token in a snapshot with the lines around it, as a finding shows them."""
    docs = history(spark, sf_dir).select(F.col("id").alias("doc_key"), F.lit(None).cast("string").alias("source"), F.lit("file").alias("path"), F.col("fileContent").alias("text"))
    return op.scan(docs, _TOKENS, any_path=True, with_context=True).select(F.col("doc_key").alias("id"), "line", "column", "value", "context")


query("secret_scan")(lambda spark, sf_dir: op.scan(documents(spark, sf_dir)))
query("findings_rollup")(lambda spark, sf_dir: op.findings_rollup(op.scan(documents(spark, sf_dir))))


_FB = "from labels"


@query("feedback_stats", f"select count(*) as total, count(*) filter (where quality = 1) as confirmed, count(*) filter (where quality = 0) as false_positives, count(*) filter (where quality is null) as pending {_FB}")
def feedback_stats(spark, sf_dir):
    q = F.col("quality")
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(q == 1).alias("confirmed"), F.count_if(q == 0).alias("false_positives"), F.count_if(q.isNull()).alias("pending"))


@query("feedback_training_set", f"with {_FEAT}, l as (select doc_id::varchar as candidate_id, min(quality) as quality from labels group by 1) select candidate_id, case when quality = 1 then {_CLASS} else 'false_positive' end as label, variable_name, f07, f14, f20 from ft join l using (candidate_id)")
def feedback_training_set(spark, sf_dir):
    """Candidates with a reviewer's verdict: label, name and features."""
    verdict = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("candidate_id")).agg(F.min("quality").alias("quality"))
    rows = op.classified(candidates(spark, sf_dir)).join(verdict, "candidate_id")
    return rows.select("candidate_id", F.when(F.col("quality") == 1, F.col("class")).otherwise("false_positive").alias("label"), "variable_name", *(F.round(f"f{k:02d}", 6).alias(f"f{k:02d}") for k in (7, 14, 20)))


