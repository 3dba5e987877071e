"""Pattern sets as data, configurations, saved files and reports."""

from __future__ import annotations

import json
import random
import re

import pytest

from kvtrail.operators import detection, diff
from kvtrail.operators.detection import Pattern, PatternSet, required_literals
from kvtrail.sources import io


@pytest.mark.parametrize(
    ("regex", "words"),
    [
        (r"\b(ghp_[a-z]{20})\b", ("ghp_",)), (r"abc+d", ("ab",)), (r"(foo|barbaz)[0-9]", ("foo", "barbaz")), (r"(foo|[a-z]+)x?", ()), (r"[0-9]{4}", ()), (r"a", ()),
        (r"(?:id|key)=[0-9]+;tail", (";tail",)), (r"(?i)Abc", ()), (r"(Ünïcode)", ()), (r"(unclosed", ()), (r"(ab)*cd", ("cd",)), (r"(?P<x>ab){2}", ("ab",)),
    ],
)
def test_required_literals(regex, words):
    assert required_literals(regex) == words


def test_matches_hold_a_required_literal():
    rng = random.Random(1)
    parts = ["ab", "cd", "(?:ab|cd)", "[xy]", "z+", "(q|ab)?", "e{2}", "(?:xy)*"]
    for _ in range(300):
        regex = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        words = required_literals(regex)
        for m in re.finditer(regex, "".join(rng.choice(["ab", "cd", "x", "y", "z", "q", "ee"]) for _ in range(60))):
            assert not words or any(w in m[0] for w in words), (regex, words, m[0])


def test_large_sets_count_as_small_ones(spark):
    rng = random.Random(2)
    texts = [None, ""] + ["".join(rng.choice(["tok7_", "TOK9_", "abc", "12345", " ", "é", "\n"]) for _ in range(30)) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    extra = spark.createDataFrame([(f"User {k:03d}", rf"tok{k}_[0-9]+", k % 7, None) for k in range(70)] + [("User run", "[0-9]{5}x?", 1, True)], "type string, regex string, priority int, requires_entropy boolean")
    patterns = PatternSet(()).add_rows(extra)
    assert len(patterns.patterns) == 71 > detection.AUTOMATON_FROM and [p.priority for p in patterns.patterns] == sorted((p.priority for p in patterns.patterns), reverse=True)
    got = {r.type: r.matches for r in detection.pattern_counts(rows, "text", patterns).collect()}
    assert got == {p.type: sum(len(re.findall(p.regex, t or "")) for t in texts) for p in patterns.patterns} and got["User 007"] > 0
    wide = patterns.add(Pattern("Any case", "tok9_", 3, any_case=True))
    assert {r.type: r.matches for r in detection.pattern_counts(rows, "text", wide).collect()}["Any case"] == sum(len(re.findall("(?i)tok9_", t or "")) for t in texts)
    assert wide.reset() == PatternSet()
    with pytest.raises(ValueError):
        PatternSet().add_rows(extra, most=70)


def test_scan_with_a_large_set_finds_the_same(spark):
    docs = spark.createDataFrame([("d", "s", "a/b.py", "x = 'ghp_" + "a1" * 15 + "'\nnote\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----z")], "doc_key string, source string, path string, text string")
    many = PatternSet()
    for k in range(60):
        many = many.add(Pattern(f"none {k}", f"absent{k}x", 1))
    found = lambda p: sorted((r.type, r.line, r.column, r.value) for r in detection.scan(docs, p, any_path=True).collect())
    assert found(many) == found(PatternSet()) and found(many)


def test_priorities_of_the_defaults():
    by_type = {p.type: p for p in PatternSet().patterns}
    assert len(by_type) == 30 and by_type["Generic API Key"].priority == 1 and by_type["Stripe Secret Key"].priority == 5 and by_type["Generic Password"].priority == 2
    assert by_type["JWT Token"].priority == 4 and by_type["SSL Certificate"].priority == 4 and {p.type for p in PatternSet().patterns if p.entropy} == {"Generic API Key", "Generic Password", "Generic Secret", "MD5 Hash", "SHA-1 Hash", "SHA-256 Hash", "Base64 Encoded Data"}


def test_config(spark, tmp_path):
    def config(**fields):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(fields, indent=1))
        return str(path)

    full = config(environments={"qa": ".env.qa"}, gitBranchMapping={"main": "production"}, gitCommitHook={"blockEnvFiles": False, "customMessage": "no"}, validation={"requiredVariables": ["A"], "variableTypes": {"P": "number"}, "customValidators": {"B": "^x$"}})
    c = io.read_config(spark, full)
    assert [tuple(r) for r in io.branch_map(c).collect()] == [("main", "production")] and [tuple(r) for r in io.custom_environments(c).collect()] == [("qa", ".env.qa")]
    assert {r.flag: r.value for r in io.hook_flags(c).collect()} == {"blockEnvFiles": False, "blockSecrets": True, "blockValidationErrors": True, "autoSwitchOnBranchChange": False}
    assert sorted(tuple(r) for r in io.rules_from_config(spark, full).collect()) == [("custom", "B", "^x$"), ("required", "A", None), ("type", "P", "number")]
    none = io.read_config(spark, config())
    assert io.branch_map(none).count() == 0 and all(r.value for r in io.hook_flags(none).where("flag like 'block%'").collect())


def test_env_files(spark, tmp_path):
    names = ["a/.env.dev", "a/.env.Backup", "a/.env.example", "a/.env", "a/sub/.env.dev", "a/.env.x.y", "b/.env.template2", "b/x.env.dev", ".env.top", "c/.env."]
    io.save_files(spark.createDataFrame([(n, f"K={n}") for n in names], "path string, fileContent string"), str(tmp_path / "files"))
    rows = sorted(tuple(r) for r in io.env_files(spark, str(tmp_path / "files")).collect())
    assert rows == [("a", "dev", "a/.env.dev", "K=a/.env.dev"), ("a", "x.y", "a/.env.x.y", "K=a/.env.x.y"), ("b", "template2", "b/.env.template2", "K=b/.env.template2")]
    assert io.env_files(spark, str(tmp_path / "files"), most=1).count() == 2


def test_sync_report(spark):
    kinds = "workspace string, environmentName string, key string, value string"
    a = spark.createDataFrame([("w", "e", "same", "1"), ("w", "e", "old", "2"), ("w", "e", "both", "3")], kinds)
    b = spark.createDataFrame([("w", "e", "same", "1"), ("w", "e", "new", ""), ("w", "e", "both", "4"), ("v", "e", "k", "x")], kinds)
    rows = sorted((r.workspace, r.section, r.line) for r in diff.sync_report(a, b).collect())
    assert rows == [("v", "Added Variables (1)", "+ k=x"), ("w", "Added Variables (1)", "+ new="), ("w", "Modified Variables (1)", "~ both=3 → 4"), ("w", "Removed Variables (1)", "- old=2")]


def test_pairs_merge_without_a_key_lost(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        side = lambda: "\n".join(f"{rng.choice('abcdef')}={rng.choice('xyz')}" for _ in range(rng.randint(0, 8)))
        rows.append((k, side(), side()))
    df = spark.createDataFrame(rows, "k int, left string, fileContent string")
    df = diff.with_pairs(df, "_new").drop("fileContent").withColumnRenamed("left", "fileContent")
    got = sorted((r.k, r.key, r.status, r.old_value, r.new_value) for r in diff.merged_pairs(diff.with_pairs(df, "_old").drop("fileContent"), "_old", "_new").collect())
    want = []
    for k, left, right in rows:
        a, b = (dict(x.split("=") for x in t.split("\n") if x) for t in (left, right))
        for key in a.keys() | b.keys():
            status = "added" if key not in a else "removed" if key not in b else "unchanged" if a[key] == b[key] else "changed"
            want.append((k, key, status, a.get(key), b.get(key)))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
