"""Scanning of documents for secrets: pattern sets, one projection over lines, findings and their roll-ups."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.functions import secrets as fn
from kvtrail.functions.shapes import shape
from kvtrail.operators.filters import ignored, should_scan, size_gate


@dataclass(frozen=True)
class Pattern:
    type: str
    regex: str
    priority: int
    entropy: bool = False
    any_case: bool = False
    #: A match holds at least one of these strings (in lower case where any case matches); none known: ().
    needs: tuple[str, ...] = ()
    #: A match holds a match of this simple pattern.
    run: str = ""

    @property
    def spans_lines(self) -> bool:
        return r"[\s\S]" in self.regex

    def java(self) -> str:
        """For Spark; \\b means a boundary of ASCII words."""
        return ("(?i)" if self.any_case else "") + self.regex.replace(r"\b", fn.B)

    def re2(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


# The patterns a scan starts with, with type, priority, entropy check and case.
DEFAULT_PATTERNS = [
    Pattern("Generic API Key", r"\b(sk|pk|api|key|token|secret)[_-]?[a-zA-Z0-9_-]{20,}\b", 1, True, True, ("sk", "pk", "api", "key", "token", "secret"), "[a-zA-Z0-9_-]{20}"),
    Pattern("Stripe Secret Key", r"\b(sk-[a-zA-Z0-9]{20,})\b", 5, needs=("sk-",)),
    Pattern("Stripe Publishable Key", r"\b(pk_[a-zA-Z0-9]{16,})\b", 5, needs=("pk_",)),
    Pattern("SendGrid API Key", r"\b(sg\.[a-zA-Z0-9_-]{16,})\b", 5, needs=("sg.",)),
    Pattern("DigitalOcean Token", r"\b(dop_v1_[a-zA-Z0-9_-]{20,})\b", 5, needs=("dop_v1_",)),
    Pattern("Vercel Token", r"\b(vercel_[a-zA-Z0-9_-]{16,})\b", 5, needs=("vercel_",)),
    Pattern("GitHub Personal Access Token", r"\b(ghp_[a-zA-Z0-9]{20,})\b", 5, needs=("ghp_",)),
    Pattern("GitHub OAuth Token", r"\b(gho_[a-zA-Z0-9]{20,})\b", 5, needs=("gho_",)),
    Pattern("Slack API Token", r"\b(xoxb|xoxp|xoxa|xoxr|xoxt)-[0-9-]+-[0-9-]+-[a-zA-Z0-9-]+\b", 5, needs=("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxt-")),
    Pattern("AWS Access Key ID", r"\b(AKIAI[0-9A-Z]{16})\b", 5, needs=("AKIAI",)),
    Pattern("OpenAI API Key", r"\b(sk-[a-zA-Z0-9]{20,})\b", 5, needs=("sk-",)),
    Pattern("Mailgun API Key", r"\b(MailgunApiKey-[a-zA-Z0-9]{20,})\b", 5, needs=("MailgunApiKey-",)),
    Pattern("Twilio Auth Token", r"\b(TwilioAuthToken-[a-zA-Z0-9]{20,})\b", 5, needs=("TwilioAuthToken-",)),
    Pattern("Sentry DSN", r"""\b(SENTRY_DSN|SENTRY_KEY|SENTRY_SECRET)[=:\s]*(["'`]?)[a-zA-Z0-9+/=\-_]{20,}["'`]?\b""", 5, False, True, ("sentry_",), "[a-zA-Z0-9+/=_-]{20}"),
    Pattern("Generic Password", r"""\b(password|passwd|pwd|pass)[\s=:/]*(["'`]?)[^\s"'`]{8,}["'`]?\b""", 2, True, True, ("passwd", "pwd", "pass")),
    Pattern("Generic Secret", r"""\b(secret|token|key|auth)[\s=:/]*(["'`]?)[^\s"'`]{12,}["'`]?\b""", 2, True, True, ("secret", "token", "key", "auth")),
    Pattern("SSH RSA Private Key", r"\b-----BEGIN\s+RSA\s+PRIVATE\s+KEY-----[\s\S]*?-----END\s+RSA\s+PRIVATE\s+KEY-----\b", 5, False, True, ("-----begin",)),
    Pattern("SSH DSA Private Key", r"\b-----BEGIN\s+DSA\s+PRIVATE\s+KEY-----[\s\S]*?-----END\s+DSA\s+PRIVATE\s+KEY-----\b", 5, False, True, ("-----begin",)),
    Pattern("SSH EC Private Key", r"\b-----BEGIN\s+EC\s+PRIVATE\s+KEY-----[\s\S]*?-----END\s+EC\s+PRIVATE\s+KEY-----\b", 5, False, True, ("-----begin",)),
    Pattern("SSH OpenSSH Private Key", r"\b-----BEGIN\s+OPENSSH\s+PRIVATE\s+KEY-----[\s\S]*?-----END\s+OPENSSH\s+PRIVATE\s+KEY-----\b", 5, False, True, ("-----begin",)),
    Pattern("SSL Certificate", r"\b(-----BEGIN\s+CERTIFICATE-----[\s\S]*?-----END\s+CERTIFICATE-----)\b", 4, False, True, ("-----begin",)),
    Pattern("JWT Token", r"\b(eyJ[A-Za-z0-9+/=]{20,})\b", 4, needs=("eyJ",)),
    Pattern("MD5 Hash", r"\b([A-Fa-f0-9]{32,})\b", 1, True, run="[A-Fa-f0-9]{32}"),
    Pattern("SHA-1 Hash", r"\b([A-Fa-f0-9]{40,})\b", 1, True, run="[A-Fa-f0-9]{40}"),
    Pattern("SHA-256 Hash", r"\b([A-Fa-f0-9]{64,})\b", 1, True, run="[A-Fa-f0-9]{64}"),
    Pattern("Database URL", r"""\b(mongodb|postgres|mysql|sqlite|redis)://[^\s"'`]{15,}\b""", 5, False, True, ("://",)),
    Pattern("MongoDB Atlas URL", r"""\b(mongodb\+srv)://[^\s"'`]{15,}\b""", 5, False, True, ("://",)),
    Pattern("Redis URL", r"""redis://[^\s"'`]{10,}""", 5, False, True, ("redis://",)),
    Pattern("Google Cloud Secret Manager", r"\bprojects/[^/]+/(?:secrets|locations/[^/]+/secrets)/[^/\s]+/versions/[^/\s]+\b", 5, needs=("projects/",)),
    Pattern("Base64 Encoded Data", r"\b([a-zA-Z0-9+/=]{20,})\b", 1, True, run="[a-zA-Z0-9+/=]{20}"),
]


def required_literals(regex: str, any_case: bool = False) -> tuple[str, ...]:
    """Strings of which every match holds one (in lower case where any case matches); () if none can be told."""
    try:
        tree = re._parser.parse(regex)
    except (re.error, OverflowError):
        return ()
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ()

    def best(options: list[tuple[str, ...]]) -> tuple[str, ...]:
        return max(options, key=lambda x: min(map(len, x)), default=())

    def walk(sequence) -> list[tuple[str, ...]]:
        found, literal = [], ""
        for code, value in [*sequence, (None, None)]:
            name = str(code)
            if name == "LITERAL":
                literal += chr(value)
                continue
            if literal:
                found.append((literal,))
                literal = ""
            if name == "SUBPATTERN":
                if not value[1]:  # no flags of its own
                    found += walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                found += walk(value[2])
            elif name == "BRANCH":
                ways = [best(walk(x)) for x in value[1]]
                if all(ways):
                    found.append(tuple(dict.fromkeys(w for way in ways for w in way)))
        return found

    words = best(walk(tree))
    if not words or min(map(len, words)) < 2 or not all(w.isascii() for w in words):
        return ()
    return tuple(w.lower() if any_case else w for w in words)


@dataclass(frozen=True)
class PatternSet:
    """An unchangeable list of patterns, highest priority first once one has been added."""

    patterns: tuple[Pattern, ...] = tuple(DEFAULT_PATTERNS)

    def add(self, p: Pattern) -> PatternSet:
        """A pattern that doesn't say what its matches need gets it from its expression."""
        p = p if p.needs or p.run else replace(p, needs=required_literals(p.regex, p.any_case))
        return replace(self, patterns=tuple(sorted((*self.patterns, p), key=lambda x: -x.priority)))

    def add_rows(self, rows: DataFrame, most: int = 1000) -> PatternSet:
        """Adds the patterns of a table type, regex, priority, requires_entropy, by type; more than `most` are an error."""
        found = rows.select("type", "regex", F.col("priority").cast("int"), F.coalesce("requires_entropy", F.lit(False))).orderBy("type", "regex").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} patterns")
        return reduce(lambda s, r: s.add(Pattern(*r)), found, self)

    def reset(self) -> PatternSet:
        return PatternSet()

    def remove(self, kind: str) -> PatternSet:
        return replace(self, patterns=tuple(p for p in self.patterns if p.type != kind))

    def at_least(self, priority: int) -> PatternSet:
        return replace(self, patterns=tuple(p for p in self.patterns if p.priority >= priority))

    def category(self, word: str) -> PatternSet:
        return replace(self, patterns=tuple(p for p in self.patterns if word.lower() in p.type.lower()))


def matches(text: Column, p: Pattern) -> Column:
    return F.regexp_extract_all(text, F.lit(p.java()), F.lit(0))


def may_match(text: Column, lower: Column, p: Pattern) -> Column:
    """A cheap test that every text with a match of p passes; lower: the text in lower case."""
    tests = [F.lit(True)]
    if p.needs:
        held = lower if p.any_case else text
        tests.append(reduce(or_, (held.contains(w) for w in p.needs)))
    if p.run:
        tests.append(text.rlike(p.run))
    return reduce(and_, tests[1:] or tests)


#: Sets of more patterns find the strings that matches need by one automaton instead of one test each.
AUTOMATON_FROM = 64


def _tested(rows: DataFrame, text: str, patterns: list[Pattern]) -> tuple[DataFrame, list[Column]]:
    """rows with what the tests need, and for each pattern a cheap test that every text with a match passes."""
    rows = rows.withColumn("lower", F.lower(text))
    if len(patterns) <= AUTOMATON_FROM:
        return rows, [may_match(F.col(text), F.col("lower"), p) for p in patterns]
    words: dict[str, list[int]] = {}
    for k, p in enumerate(patterns):
        for w in p.needs:
            words.setdefault(w.lower(), []).append(k)

    @F.pandas_udf("array<int>")
    def possible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, which in words.items():
            automaton.add_word(word, which)
        automaton.make_automaton()
        for part in parts:
            yield pd.Series([sorted({k for _, which in automaton.iter(t) for k in which}) if t and words else [] for t in part], dtype=object)

    rows = rows.withColumn("_possible", possible("lower"))
    held = lambda k, p: F.array_contains("_possible", k) if p.needs else F.lit(True)
    return rows, [held(k, p) & F.col(text).rlike(p.run) if p.run else held(k, p) for k, p in enumerate(patterns)]


def _hits(text: Column, p: Pattern) -> Column:
    """type, priority, checked, value and start (from 0) of each match; matches lie between the pieces of a split."""
    both = F.array(F.struct(matches(text, p).alias("values"), F.split(text, p.java(), -1).alias("gaps")))
    size = lambda n, x: n + F.length(x)

    def hits(m: Column) -> Column:
        def hit(value: Column, k: Column) -> Column:
            ahead = F.aggregate(F.slice(m["gaps"], F.lit(1), k + 1), F.lit(0), size) + F.aggregate(F.slice(m["values"], F.lit(1), k), F.lit(0), size)
            return F.struct(F.lit(p.type).alias("type"), F.lit(p.priority).alias("priority"), F.lit(p.entropy).alias("checked"), value.alias("value"), ahead.alias("start"))

        return F.transform(m["values"], hit)

    return F.flatten(F.transform(both, hits))


def pattern_counts(rows: DataFrame, text: str, patterns: PatternSet = PatternSet()) -> DataFrame:
    """type and number of matches of each pattern: one aggregate per pattern in a single pass, behind each one's cheap test."""
    rows, tests = _tested(rows.select(F.col(text).alias("text")), "text", list(patterns.patterns))
    found = [F.when(t, F.regexp_count("text", F.lit(p.java()))) for t, p in zip(tests, patterns.patterns, strict=True)]
    counts = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"c{k}") for k, c in enumerate(found)))
    kinds = F.array(*(F.struct(F.lit(p.type).alias("type"), F.col(f"c{k}").alias("matches")) for k, p in enumerate(patterns.patterns)))
    return counts.select(F.explode(kinds).alias("x")).select("x.type", "x.matches")


def context_window(lines: DataFrame) -> DataFrame:
    """Adds the line before and after, as the context of a hit shows them."""
    w = Window.partitionBy("doc_key").orderBy("line")
    return lines.withColumn("before", F.lag("content").over(w)).withColumn("after", F.lead("content").over(w))


def _line_hits(rows: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Hits within a line: the line with its number from 0 and its neighbours, the hit and its column."""
    beside = F.transform("all", lambda x, i: F.struct(x.alias("content"), F.get("all", i - 1).alias("before"), F.get("all", i + 1).alias("after")))
    rows = rows.select("doc_key", "source", "path", F.posexplode(beside).alias("pos", "x")).select("doc_key", "source", "path", "pos", "x.*")
    rows, tests = _tested(rows, "content", patterns)
    found = F.array(*(F.when(t, _hits(F.col("content"), p)) for t, p in zip(tests, patterns, strict=True)))
    rows = rows.where(reduce(or_, tests)).withColumn("h", F.explode(F.filter(F.flatten(F.array_compact(found)), lambda h: h["value"] != "")))
    return rows.select("doc_key", "source", "path", "pos", "content", "before", "after", "h.*").withColumn("column", F.col("start") + 1).drop("start")


def _text_hits(rows: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Hits of patterns that span lines, in whole texts: as _line_hits, with all lines of a hit as content."""
    rows, tests = _tested(rows, "text", patterns)
    found = F.array(*(F.when(t, _hits(F.col("text"), p)) for t, p in zip(tests, patterns, strict=True)))
    rows = rows.where(reduce(or_, tests)).withColumn("h", F.explode(F.flatten(F.array_compact(found))))
    rows = rows.select("doc_key", "source", "path", "all", F.expr("left(text, h.start)").alias("ahead"), "h.*").drop("start")
    rows = rows.withColumn("pos", F.size(F.split("ahead", "\n")) - 1).withColumn("last", F.col("pos") + F.size(F.split("value", "\n")) - 1)
    content = F.array_join(F.slice("all", F.col("pos") + 1, F.col("last") - F.col("pos") + 1), "\n")
    rows = rows.withColumn("content", content).withColumn("column", F.length(F.substring_index("ahead", "\n", -1)) + 1)
    return rows.withColumn("before", F.get("all", F.col("pos") - 1)).withColumn("after", F.get("all", F.col("last") + 1)).drop("ahead", "all", "last")


def scan(docs: DataFrame, patterns: PatternSet = PatternSet(), most_bytes: int = 1 << 20, any_path: bool = False, with_context: bool = False) -> DataFrame:
    """Findings of every pattern in documents that pass the path and size rules, or with any_path those of size alone.

    with_context adds the lines around a finding, the place of the secret marked.

    One projection matches the patterns of single lines, each on the lines that hold what
    its matches can't do without, another those that span lines on whole texts;
    a line comes along with its two neighbours from the document's own array of lines, so nothing is shuffled.
    """
    place = F.lit(True) if any_path else ~ignored(F.col("path")) & should_scan(F.col("path"))
    rows = docs.where(place & size_gate(F.col("text"), most_bytes)).select("doc_key", "source", "path", "text", F.split("text", "\n").alias("all"))
    wide = [p for p in patterns.patterns if p.spans_lines]
    narrow = [p for p in patterns.patterns if not p.spans_lines]
    parts = ([_line_hits(rows, narrow)] if narrow or not wide else []) + ([_text_hits(rows, wide)] if wide else [])
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    entropy = fn.shannon_entropy(F.col("value"))
    found = found.withColumn("entropy", entropy).where(~F.col("checked") | fn.is_likely_secret(F.col("value"), F.col("entropy")))
    before = F.coalesce(F.concat(F.lit("... "), F.trim("before"), F.lit("\n")), F.lit(""))
    after = F.coalesce(F.concat(F.lit("\n"), F.trim("after"), F.lit(" ...")), F.lit(""))
    marked = F.concat(F.expr("left(content, `column` - 1)"), F.lit("[SECRET]"), F.expr("substring(content, `column`)"))
    found = found.withColumn("context", F.concat(before, marked, after))
    confidence = F.round(fn.context_confidence(F.col("context"), F.col("value")), 6)
    return found.select("doc_key", "source", "path", (F.col("pos") + 1).alias("line"), "column", "type", "value", "priority", confidence.alias("confidence"), fn.risk_level(confidence).alias("risk"), *(["context"] if with_context else []))


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Findings by type, risk and source, with all subtotals."""
    out = findings.cube("type", "risk", "source").agg(F.count(F.lit(1)).alias("findings"))
    return out.select(*(F.coalesce(c, F.lit("all")).alias(c) for c in ("type", "risk", "source")), "findings")


def _measured(candidates: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The candidates with their inputs and measures in _in and _shape, and the 35 features by them."""
    inputs = F.struct(fn.normalized(F.coalesce("value", F.lit(""))).alias("s"), F.coalesce("context", F.lit("")).alias("c"), F.coalesce("variable_name", F.lit("")).alias("n"))
    # the generator keeps the optimiser from writing the inputs out at every use
    rows = candidates.select("*", F.explode(F.array(inputs)).alias("_in")).withColumn("_shape", shape(F.col("_in.s")))
    return rows, fn.features(F.col("_in.s"), F.col("_in.c"), F.col("_in.n"), F.col("_shape"))


def feature_table(candidates: DataFrame) -> DataFrame:
    """f: the 35 features of each candidate, and its class by them."""
    rows, f = _measured(candidates)
    rows = rows.select("*", F.explode(F.array(F.array(*f))).alias("f")).drop("_in", "_shape")
    return rows.withColumn("class", fn.fallback_class(F.col("f")))


def classified(candidates: DataFrame) -> DataFrame:
    """The class of each candidate and the features that it rests on: f07, f14, f20 and f25; the others are not made."""
    rows, f = _measured(candidates)
    for k in (7, 14, 20, 25):
        rows = rows.withColumn(f"f{k:02d}", f[k])
    rows = rows.drop("_in", "_shape")
    return rows.withColumn("class", fn.fallback_class({k: F.col(f"f{k:02d}") for k in (7, 14, 20, 25)}))


def cascade(candidates: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Class by certain formats, then known hashes, then entropy, then the features."""
    rows = classified(candidates).withColumn("hash", fn.entry_hash(F.col("variable_name"), F.col("value")))
    rows = rows.join(blacklist.select("hash").distinct().withColumn("listed", F.lit(True)), "hash", "left")
    label = F.when(fn.known_pattern(F.col("value")), "high").when(F.col("listed"), "high").when(F.col("f07") * 8 < 3.5, "low").otherwise(F.col("class"))
    return rows.withColumn("label", label)
