"""Columns that judge one possible secret: entropy, context, features and classes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary of ASCII words.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Words that make a context suspicious.
HIGH_RISK = "password passwd pwd token key secret private_key access_token api_key auth_token bearer_token refresh_token secret_key privatekey apikey bearer".split()
GENERAL = """const let var export process.env env config settings secrets keys tokens auth api credentials access secret private secure
database db mongo postgres mysql redis connection aws azure gcp firebase heroku vercel netlify""".split()
# Word lists, prefixes and formats of the feature vector.
HIGH_CONTEXT = "password passwd secret private_key api_key auth_token access_token client_secret credentials".split()
MEDIUM_CONTEXT = "token key auth api access bearer authorization credential config".split()
LOW_CONTEXT = "const let var export process.env os.environ getenv dotenv".split()
DANGER_NAMES = "secret key token password pwd pass".split()
RISK_NAMES = "api auth access private cred".split()
KNOWN_PREFIXES = "sk- pk_ AKIA ghp_ xox SG. AIza ya29.".split()
FORMATS = [
    (r"^sk-[a-zA-Z0-9]{20,}", 1.0), (r"^pk_live_[a-zA-Z0-9]{20,}", 1.0), (r"^AKIA[A-Z0-9]{16}", 1.0), (r"^ghp_[a-zA-Z0-9]{36}", 1.0), (r"^gho_[a-zA-Z0-9]{36}", 1.0),
    (r"^xox[baprs]-[a-zA-Z0-9-]+", 1.0), (r"^SG\.[a-zA-Z0-9\-_]{22,}", 1.0), (r"^AIza[0-9A-Za-z\-_]{35}", 1.0), (r"^ya29\.[0-9A-Za-z\-_]+", 0.9),
    (r"^eyJ[a-zA-Z0-9\-_]+\.[a-zA-Z0-9\-_]+\.[a-zA-Z0-9\-_]+\z", 1.0), (r"(?m)^-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY", 1.0),
    (r"^[0-9a-f]{32}\z", 0.6), (r"^[0-9a-f]{40}\z", 0.7), (r"^[0-9a-f]{64}\z", 0.8), (r"(mysql|postgresql|mongodb|redis|amqp)://\S+:\S+@", 1.0),
]
# Formats that settle a value at once.
CERTAIN = [r"AKIA[0-9A-Z]{16}", r"sk_live_[0-9a-zA-Z]{24,}", r"sk_test_[0-9a-zA-Z]{24,}", r"ghp_[a-zA-Z0-9]{36}", r"sk-[a-zA-Z0-9]{48}", r"AIza[0-9A-Za-z\-_]{35}"]


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def entropy_of(items: Column) -> Column:
    """Shannon entropy, in bits, of an array's items; 0 for an empty one."""
    n = F.size(items)
    share = F.transform(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)) / n)
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def shannon_entropy(s: Column) -> Column:
    return entropy_of(characters(s))


def entropy_confidence(entropy: Column, n: Column) -> Column:
    return F.when((entropy >= 4.5) & (n >= 20), "high").when((entropy >= 3.5) & (n >= 12), "medium").otherwise("low")


def has_variety(s: Column) -> Column:
    return sum((s.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^a-zA-Z0-9\s]")), F.lit(0)) >= 2


def is_likely_secret(s: Column, entropy: Column) -> Column:
    return (F.length(s) >= 8) & (entropy >= 2.5) & has_variety(s)


def secret_quality(s: Column, entropy: Column) -> tuple[Column, Column]:
    """Score and assessment."""
    c = entropy_confidence(entropy, F.length(s))
    score = F.when(c == "high", 1.0).when(c == "medium", 0.7).otherwise(0.3)
    text = F.concat(c, F.lit(" confidence"))
    return score, F.concat(text, F.when(has_variety(s), "").otherwise(" (low character variety)"), F.when(entropy < 2, " (low entropy)").otherwise(""))


def checksum(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 16)


def entry_hash(name: Column, value: Column) -> Column:
    """Hash of a name and the first eight characters of its value."""
    return checksum(F.concat(name, F.lit(":"), F.substring(value, 1, 8)))


def normalized(s: Column) -> Column:
    """NUL and carriage returns gone, line feeds to blanks, trimmed."""
    return F.trim(F.translate(F.regexp_replace(s, "[\\x00\\r]", ""), "\n", " "))


def relative_time(then: Column, now: Column) -> Column:
    s = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1_000_000)
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return F.when(m < 1, "Just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(h < 24, F.concat(h.cast("string"), F.lit("h ago"))).when(d < 7, F.concat(d.cast("string"), F.lit("d ago"))).otherwise(F.date_format(then, "yyyy-MM-dd"))


def format_bytes(n: Column) -> Column:
    """Base 1024, one decimal, none if it is 0."""
    unit = F.when(n < 1024, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), unit), 1)
    text = F.regexp_replace(F.format_string("%.1f", value), r"\.0\z", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)))


def mask_value(v: Column) -> Column:
    long = F.when(F.length(v) > 60, F.concat(F.substring(v, 1, 57), F.lit("…"))).otherwise(v)
    return F.when(F.coalesce(v, F.lit("")) == "", "(empty)").when((F.length(v) > 12) & v.rlike("[A-Za-z0-9]{8,}"), F.concat(F.substring(v, 1, 4), F.lit("•" * 8))).otherwise(long)


def _contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= text.contains(w)
    return out


def _first_of(text: Column, words: list[str]) -> Column:
    return F.coalesce(*(F.when(text.contains(w), w) for w in words))


def _count_of(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def keyword_score(context: Column) -> Column:
    low = F.lower(context)
    return F.when(_contains_any(low, HIGH_RISK), 6).when(_contains_any(low, GENERAL), 3).otherwise(0)


def nearest_keyword(context: Column) -> Column:
    low = F.lower(context)
    return F.coalesce(_first_of(low, HIGH_RISK), _first_of(low, GENERAL))


def assignment_score(context: Column) -> Column:
    return (
        F.when(context.contains("=") | context.contains(": "), 2).otherwise(0)
        + F.when(context.contains("process.env.") | context.contains("process.env["), 4).otherwise(0)
        + F.when(context.contains("{") & context.contains("}"), 2).otherwise(0)
        + F.when(context.rlike(B + r"(const|let|var)\s+"), 3).otherwise(0)
    )


def naming_score(context: Column) -> Column:
    name = F.regexp_extract(context, B + r"([a-zA-Z_][a-zA-Z0-9_]*)\s*[:=]", 1)
    low = F.lower(name)
    return F.when(name == "", 0).when(_contains_any(low, HIGH_RISK), 5).when(_contains_any(low, ["api", "key", "token", "secret", "auth", "password"]), 3).when(name == F.upper(name), 2).otherwise(0)


def string_score(context: Column, value: Column) -> Column:
    return (
        F.when(context.rlike("[\"'`]"), 2).otherwise(0) + F.when(context.contains("export ") | context.contains("set "), 3).otherwise(0)
        + F.when(context.contains('"') & context.contains(":"), 2).otherwise(0) - F.when(context.contains("//") | context.contains("#") | context.contains("/*"), 3).otherwise(0)
        - F.when(_contains_any(value, ["test", "example", "sample"]), 2).otherwise(0)
    )


def neighbor_score(context: Column) -> Column:
    lines = F.size(F.filter(F.split(context, "\n"), lambda x: _contains_any(F.lower(x), HIGH_RISK)))
    return F.when(F.regexp_count(context, F.lit("[:=]")) > 1, 1).otherwise(0) + F.when(lines > 1, 2).otherwise(0)


def context_confidence(context: Column, value: Column) -> Column:
    score = keyword_score(context) + assignment_score(context) + naming_score(context) + string_score(context, value) + neighbor_score(context)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / 10.0))


def risk_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def detection_method(context: Column) -> Column:
    return F.when(keyword_score(context) > 0, "Keyword Proximity").when(naming_score(context) > 0, "Variable Naming").when(assignment_score(context) > 0, "Assignment Pattern").otherwise("String Context")


def detailed_context(context: Column) -> tuple[Column, Column]:
    """Score and band of the keywords and assignments in a context."""
    parts = [context.contains("process.env."), context.contains("="), context.contains(": "), context.rlike(B + r"(const|let|var)\s+")]
    score = 2 * _count_of(F.lower(context), HIGH_RISK) + sum((p.cast("int") for p in parts), F.lit(0))
    band = F.when(score >= 5, "High risk: Multiple security indicators").when(score >= 3, "Medium risk: Some security indicators").when(score >= 1, "Low risk: Minimal security indicators").otherwise("Safe: No security indicators detected")
    return score, band


def enhanced_confidence(label: Column, confidence: Column) -> Column:
    """The larger of a label's number and the context's."""
    return F.greatest(F.when(label == "high", 1.0).when(label == "medium", 0.5).otherwise(0.0), confidence)


def surrounding_confidence(name: Column, assigned: Column, around: Column) -> Column:
    low = F.lower(around)
    c = 0.5 + F.when(_contains_any(F.lower(F.coalesce(name, F.lit(""))), HIGH_RISK), 0.3).otherwise(0.0) + F.when(assigned, 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), c + F.when(low.contains("auth") | low.contains("login"), 0.15).otherwise(0.0)), 6)


def security_score(risk: Column, kind: Column, context: Column) -> Column:
    return F.least(F.lit(1.0), risk + F.when(context.contains("hardcoded") | context.contains("const "), 0.3).otherwise(0.0) + F.when(kind.contains("password"), 0.2).otherwise(0.0))


def known_pattern(value: Column) -> Column:
    return F.coalesce(value.rlike("|".join(CERTAIN)), F.lit(False))


def response_label(label: Column, likely: Column) -> Column:
    low = F.lower(label)
    return F.when(likely & low.isin("high", "critical"), "high").when(low.isin("critical", "high"), "high").when(low.isin("medium", "low"), low).otherwise(label)


def confirmed_label(action: Column, confidence: Column) -> Column:
    return F.when(action != "confirmed", "false_positive").when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def _separator_score(s: Column) -> Column:
    out = F.lit(0.0)
    for sep in ("\\.", "_", "-"):
        parts = F.transform(F.filter(F.split(s, sep), lambda p: p != ""), F.length)
        most, least = F.array_max(parts), F.array_min(parts)
        score = F.least(F.lit(1.0), (1 - (most - least) / most) * 0.8 + 0.2)
        out = F.when(s.rlike(sep) & (F.size(parts) > 0), score).otherwise(out)
    only = F.regexp_count(s, F.lit("[-_.]"))
    return F.when(s.rlike("[^-_.]"), out).otherwise(F.least(F.lit(1.0), only * 0.2))


def features(s: Column, context: Column, raw_name: Column, shape: Column) -> list[Column]:
    """The 35 numbers of a candidate, in their fixed order: s is normalised, shape its measures, no input is null."""
    ctx = F.lower(context)
    vn, n = F.lower(raw_name), F.length(s)
    safe = F.greatest(F.lit(1), n)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    ratio = lambda p: F.regexp_count(s, F.lit(p)) / safe
    unique, run = shape["n_distinct"], shape["longest_run"] / safe
    switches = F.regexp_count(s, F.lit("(?=[A-Za-z][0-9]|[0-9][A-Za-z])"))
    best = F.greatest(F.lit(0.0), *(F.when(s.rlike(p), v).otherwise(0.0) for p, v in FORMATS))
    counted = lambda text, words, step: F.least(F.lit(1.0), _count_of(text, words) * F.lit(step))
    return [
        F.least(F.lit(1.0), n / 100.0), F.when(n >= 20, 1.0).otherwise(n / 20.0), ratio("[0-9]"), ratio("[A-Z]"), ratio("[a-z]"),
        ratio(r"[!#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"), unique / safe, shape["entropy1"] / 8, shape["entropy2"] / 8, shape["entropy3"] / 8,
        F.least(F.lit(1.0), unique / F.least(safe, F.lit(64))), run, 1 - run, shape["evenness"], best,
        flag((n >= 16) & (n % 4 == 0) & s.rlike(r"^[A-Za-z0-9+/=]+\z")), flag((n >= 32) & (n % 2 == 0) & s.rlike(r"^[0-9a-fA-F]+\z")),
        flag(s.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in KNOWN_PREFIXES) + ")")), flag(s.endswith("=")), flag(s.rlike(r"[A-Za-z0-9+/]{40,}={0,2}\z")),
        counted(ctx, HIGH_CONTEXT, 0.4), counted(ctx, MEDIUM_CONTEXT, 0.2), counted(ctx, LOW_CONTEXT, 0.1), flag(context.rlike("[\"'`]")), flag(context.contains("=")),
        counted(vn, DANGER_NAMES, 0.5), counted(vn, RISK_NAMES, 0.3), flag((raw_name != "") & (raw_name == F.upper(raw_name))), flag(raw_name.contains("_")), F.least(F.lit(1.0), F.length(raw_name) / 30.0),
        F.when(n < 8, 0.0).otherwise(F.least(F.lit(1.0), switches / (safe * 0.35))), _separator_score(s), F.when((n >= 20) & (n <= 100), 1.0).when(n > 100, 0.3).otherwise(0.0),
        (flag(s.rlike("[A-Za-z]")) + flag(s.rlike("[0-9]")) + flag(s.rlike("[A-Z]") & s.rlike("[a-z]"))) / 3, flag(s.rlike("[A-Z]{2,}[0-9]{2,}|[0-9]{2,}[A-Z]{2,}")),
    ]


def fallback_class(f: Column | dict[int, Column]) -> Column:
    """The class from the features 7, 14, 20 and 25: entropy, format, context and name."""
    h = f[7] * 8
    return F.when((f[14] >= 1) & (h > 4.0), "high").when((h > 4.5) & ((f[20] > 0) | (f[25] > 0)), "high").when(h > 3.5, "medium").otherwise("low")
