"""Search and filters over the snapshot log, and over paths and documents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtrail.functions import kv

SPECIAL = re.compile(r"[.*+?^${}()|\[\]\\]")


def search_pattern(text: str, regex: bool = False) -> str:
    """A case-insensitive pattern; an invalid one is taken literally."""
    if regex:
        try:
            re.compile(text)
            return "(?i)" + text
        except re.error:
            pass
    return "(?i)" + SPECIAL.sub(lambda m: "\\" + m[0], text)


def _pairs(content: Column) -> Column:
    """Keys and values of a snapshot in the history dialect, all duplicates."""
    rows = F.filter(F.transform(F.split(content, "\n"), kv.js_trim), lambda x: (x != "") & ~x.startswith("#") & x.contains("="))
    return F.transform(rows, lambda x: F.struct(kv.js_trim(F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(F.regexp_replace(x, "^[^=]*=", ""), "^[\"']|[\"']\\z", "").alias("value")))


def search(text: str, scope: str = "all", regex: bool = False) -> Column:
    """Whether a row matches in its environment, its keys, its values, or all of its words."""
    p = search_pattern(text, regex)
    if scope == "environments":
        return F.col("environmentName").rlike(p)
    if scope == "variables":
        return F.exists(_pairs(F.col("fileContent")), lambda x: x["key"].rlike(p))
    if scope == "values":
        return F.exists(_pairs(F.col("fileContent")), lambda x: x["value"].rlike(p))
    parts = [F.coalesce(c, F.lit("")) for c in ("environmentName", "user", "reason", "fileContent")]
    return F.concat_ws(" ", *parts).rlike(p)


def has_variables(names: list[str]) -> Column:
    return F.arrays_overlap(F.transform(_pairs(F.col("fileContent")), lambda x: x["key"]), F.array(*map(F.lit, names)))


@dataclass
class HistoryFilter:
    """All filters that are set must hold."""

    start: str | None = None
    end: str | None = None
    text: str = ""
    scope: str = "all"
    regex: bool = False
    users: list[str] = field(default_factory=list)
    environments: list[str] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)

    def condition(self) -> Column:
        out = F.lit(True)
        if self.start:
            out &= F.col("timestamp") >= F.lit(self.start).cast("timestamp")
        if self.end:
            out &= F.col("timestamp") <= F.lit(self.end).cast("timestamp")
        if self.text:
            out &= search(self.text, self.scope, self.regex)
        for name, wanted in (("user", self.users), ("environmentName", self.environments), ("action", self.actions)):
            if wanted:
                out &= F.col(name).isin(wanted)
        if self.variables:
            out &= has_variables(self.variables)
        return F.coalesce(out, F.lit(False))

    def labels(self) -> list[str]:
        out = ["Date range"] if self.start or self.end else []
        out += [f"Search ({self.scope})"] if self.text else []
        for name in ("users", "environments", "actions", "variables"):
            if getattr(self, name):
                out.append(f"{name.capitalize()} ({len(getattr(self, name))})")
        return out

    def apply(self, h: DataFrame) -> DataFrame:
        return h.where(self.condition())

    def summary(self, h: DataFrame) -> DataFrame:
        """Total, filtered and labels in one pass."""
        return h.agg(F.count(F.lit(1)).alias("total"), F.count_if(self.condition()).alias("filtered"), F.lit(", ".join(self.labels())).alias("applied"))


def quick_filter(text: str, action: str = "all") -> Column:
    q = text.lower()
    hit = F.lit(False)
    for c in ("environmentName", "user", "reason"):
        hit |= F.coalesce(F.lower(c).contains(q), F.lit(False))
    return hit & (F.lit(action == "all") | (F.col("action") == action))


def date_presets(ref: DataFrame) -> DataFrame:
    """Start and end of the usual ranges for one row of ref_ts; only Today has an end."""
    today = F.date_trunc("day", "ref_ts")
    rows = [F.struct(F.lit("Today").alias("label"), today.alias("start"), (today + F.expr("interval 1 day") - F.expr("interval 1 millisecond")).alias("end"))]
    for label, days in (("Last 7 days", 7), ("Last 30 days", 30), ("Last 90 days", 90), ("Last 180 days", 180), ("Last year", 365)):
        rows.append(F.struct(F.lit(label).alias("label"), (today - F.make_dt_interval(F.lit(days))).alias("start"), F.lit(None).cast("timestamp").alias("end")))
    return ref.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


# The ignore rules used when a workspace has none; the first two are our own folders.
DEFAULT_IGNORE = [
    ".kvtrail/**", ".kvtrail-backups/**", "out/**", "dist/**", "build/**", "**/*.test.ts", "**/*.test.js", "**/*.spec.ts", "**/*.spec.js",
    "tests/**", "test/**", "__tests__/**", "docs/**", "README.md", "CHANGELOG.md", "SECURITY.md", "*.md", ".github/**", "k8s/**", "helm/**",
    "docker-compose*.yml", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
]

_GLOB = re.compile(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|\[[^\]]*\]|.", re.S)


def glob_regex(glob: str) -> str:
    """A Java pattern for a whole relative path; a glob without a slash matches at any depth."""
    glob = glob + "**" if glob.endswith("/") else glob
    head, glob = ("^", glob[1:]) if glob.startswith("/") else ("^", glob) if "/" in glob else ("^(?:.*/)?", glob)

    def part(t: str) -> str:
        if t == "**/":
            return "(?:.+/)?"
        if t in ("**", "*", "?"):
            return {"**": ".*", "*": "[^/]*", "?": "[^/]"}[t]
        if len(t) > 1 and t[0] == "{":
            return "(?:" + "|".join(re.escape(x) for x in t[1:-1].split(",")) + ")"
        return t if len(t) > 1 else re.escape(t)

    return "(?is)" + head + "".join(part(m[0]) for m in _GLOB.finditer(glob)) + "\\z"


def ignored(path: Column, rules: list[str] = DEFAULT_IGNORE) -> Column:
    """Whether ordered rules leave a path out; a later rule overrides, ! takes back."""
    out = F.lit(False)
    for rule in rules:
        negate = rule.startswith("!")
        out = F.when(path.rlike(glob_regex(rule.lstrip("!") if negate else rule)), F.lit(not negate)).otherwise(out)
    return out


# Folders left out, and file types that are scanned.
SKIPPED_FOLDERS = [".git/", "node_modules/", ".vscode/", "build/", "dist/", "out/", "coverage/"]
SCANNED_TYPES = ".js .ts .jsx .tsx .py .java .cpp .c .h .hpp .cs .php .rb .go .rs .swift .kt .scala .sh .bash .zsh .fish .ps1 .bat .cmd .yaml .yml .json .xml .env .dotenv .toml .ini .cfg .conf".split()


def should_scan(path: Column) -> Column:
    skip = F.lit(False)
    for folder in SKIPPED_FOLDERS:
        skip |= path.contains(folder)
    return ~skip & F.regexp_extract(F.lower(path), r"(\.[^.]*)\z", 1).isin(SCANNED_TYPES)


def size_gate(text: Column, most: int = 1 << 20) -> Column:
    return (F.octet_length(text) <= most) & ~text.contains("\0")
