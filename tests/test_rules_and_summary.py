"""Rules in one pass and by joins, the policy gate, and summaries put together from months."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from kvtrail.operators import summary, validation

RULES = [("required", "A", None), ("required", "B", None), ("type", "A", "number"), ("type", "A", "boolean"), ("type", "U", "url"), ("custom", "C", "^x+$"), ("custom", "C", "y"), ("type", "Z", "nothing")]
FILES = [
    (1, ".env.dev", "A=1\nB=2\nC=xx\nU=http://h"), (2, ".env", ""), (3, ".env.x", "A=no\nA=yes\n# A=3\nbad line\n=empty\nB=\"q\n U = ftp:x \n"), (4, "notes.txt", "A=x\nKEY ghp_" + "a1" * 14), (5, ".env.q", None),
    (6, "big.bin", "ghp_" + "a1" * 14 + "\0"),
]


def tables(spark):
    return spark.createDataFrame(FILES, "id long, path string, fileContent string"), spark.createDataFrame(RULES, "rule_type string, variable string, arg string")


@pytest.mark.parametrize("rules", [RULES, [], RULES[:2]])
def test_one_pass_gives_what_joins_give(spark, monkeypatch, rules):
    files, _ = tables(spark)
    table = spark.createDataFrame(rules, "rule_type string, variable string, arg string")
    key = lambda r: tuple(map(str, r))
    once = sorted(map(tuple, validation.validate(files, table, ["id"]).collect()), key=key)
    monkeypatch.setattr(validation, "MOST_RULES", -1)
    assert once == sorted(map(tuple, validation.validate(files, table, ["id"]).collect()), key=key)
    if rules == RULES:
        assert {r[1:4:2] for r in once if r[0] == 1} == {("custom", "Custom rule failed")}
        assert ("syntax", "Missing variable name") in {r[1:4:2] for r in once if r[0] == 3}


@pytest.mark.parametrize(("toggles", "blocked"), [((), set()), (("secret",), {4}), (("env_file",), {1, 2, 3, 5}), (("validation",), {2, 3, 5}), (("env_file", "secret", "validation"), {1, 2, 3, 4, 5})])
def test_policy_gate(spark, toggles, blocked):
    files, rules = tables(spark)
    rules = rules.where("variable in ('A', 'B', 'U') and coalesce(arg, '') != 'boolean'")
    rows = {r.id: r for r in validation.policy_gate(files, rules, "id", toggles).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6} and {k for k, r in rows.items() if r.blocked} == blocked
    assert rows[4].secret_issues >= 1 and rows[4].env_file_issues == rows[4].validation_issues == 0 and rows[6].secret_issues == 0 and rows[2].validation_issues == 2


def log(spark, rows):
    start = datetime(2024, 1, 30)
    data = [(str(k), start + timedelta(hours=h), w, env, action, user, None, content) for k, (h, w, env, action, user, content) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, timestamp timestamp, workspace string, environmentName string, action string, user string, reason string, fileContent string")


def test_summary_of_months_equals_one_over_all(spark, tmp_path):
    rows = [(h * 37 % 2000, f"w{h % 3}", f"e{h * 7 % 4}", "switch" if h % 5 == 0 else "modify", f"u{h % 6}" if h % 4 else None, f"A={h % 3}\nB={h // 40}" if h % 9 else "") for h in range(150)] + [(1, "alone", "e", "switch", None, None)]
    entries = log(spark, rows)
    want = sorted(tuple(r) for r in summary.computed(entries).collect())
    store = summary.MaintainedSummary(spark, str(tmp_path / "s"))
    store.update(entries, ["2024-03", "2024-04"])
    store.update(entries, ["2024-01"])
    store.update(entries, ["2024-02", "2024-03"])
    assert sorted(tuple(r) for r in store.summary().collect()) == want
    # a later entry changes its month alone
    more = entries.unionByName(log(spark, [(0, "w0", "e9", "switch", "new", "C=1")]).selectExpr("'late' as id", "timestamp'2024-04-20 10:00:00' as timestamp", "workspace", "environmentName", "action", "user", "reason", "fileContent"))
    store.update(more, ["2024-04"])
    assert sorted(tuple(r) for r in store.summary().collect()) == sorted(tuple(r) for r in summary.computed(more).collect()) != want
