"""Hand-made cases of the quirks that the test tables do not show."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvtrail.functions import kv, secrets
from kvtrail.operators import crypto, detection, diff, filters, history, validation, variables
from kvtrail.streaming import streams
from tests.conftest import SMALL


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_dialects_differ_on_quotes_and_duplicates(spark):
    df = spark.createDataFrame([("1", "A=B=C\nQ='x\nQ=\"y\"\n=v\n# c\n\nN\nA = 2 \r")], "id string, fileContent string")
    pairs = {r.key: r.value for r in kv.history_pairs(df, ["id"]).collect()}
    assert pairs == {"A": " 2", "Q": "y", "": "v"}
    assert sorted((r.key, r.value, r.line) for r in kv.diff_rows(df, ["id"]).collect()) == [("A", " 2", 8), ("A", "B=C", 1), ("Q", '"y"', 3), ("Q", "'x", 2)]


def test_diff_of_a_snapshot_with_itself_has_no_changes(spark):
    rows = spark.createDataFrame([("w", "e", "A", "1", 1), ("w", "e", "B", "2", 2)], "workspace string, environmentName string, key string, value string, line int")
    assert {r.status for r in diff.kv_diff(rows, rows).collect()} == {"unchanged"}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_granular_runs_rebuild_the_new_value(old, new):
    runs = diff.granular_runs(old, new)
    kept = list(old)
    i = j = 0
    out = []
    for r in runs:
        while j < r["position"]:
            out.append(kept[i])
            i, j = i + 1, j + 1
        i += len(r["original"])
        j += len(r["modified"])
        out.append(r["modified"])
    out += kept[i:]
    assert "".join(out) == new


@pytest.mark.parametrize(("value", "kind", "holds"), [("0x10", "number", True), ("Infinity", "number", True), ("NaN", "number", False), ("1e3", "number", True), ("", "number", False), ("Yes", "boolean", True), ("2", "boolean", False), ("ftp:x", "url", True), ("x", "url", False), ("", "string", False)])
def test_types_follow_the_file_format(spark, value, kind, holds):
    assert one(spark, validation.type_holds(F.col("v"), F.col("k")), v=value, k=kind) is holds


def test_word_boundaries_are_ascii_and_pem_needs_a_word_before(spark):
    aws = next(p for p in detection.DEFAULT_PATTERNS if p.type == "AWS Access Key ID")
    assert one(spark, F.size(detection.matches(F.col("v"), aws)), v="éAKIAI" + "A" * 16) == 1
    pem = next(p for p in detection.DEFAULT_PATTERNS if p.type == "SSH RSA Private Key")
    block = "-----BEGIN RSA PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----"
    assert one(spark, F.size(detection.matches(F.col("v"), pem)), v=block) == 0
    assert one(spark, F.size(detection.matches(F.col("v"), pem)), v="x" + block + "y") == 1


def test_scan_finds_blocks_over_lines_and_short_slack_tokens(spark):
    block = "-----BEGIN RSA PRIVATE KEY-----\nab\ncd\n-----END RSA PRIVATE KEY-----"
    docs = spark.createDataFrame([("k", "s", "a/b.py", f"one\nx{block}y\n{block}\n z{block}y\nend"), ("t", "s", "a/c.py", "xoxb-1-2-a")], "doc_key string, source string, path string, text string")
    found = sorted((r.doc_key, r.line, r.column, r.type) for r in detection.scan(docs).collect() if r.type.startswith(("SSH", "Slack")))
    assert found == [("k", 2, 2, "SSH RSA Private Key"), ("k", 10, 3, "SSH RSA Private Key"), ("t", 1, 1, "Slack API Token")]


def test_every_place_of_a_repeated_value_is_found(spark):
    docs = spark.createDataFrame([("t", "s", "a/c.py", "v: xoxp-12-34-5a; and xoxp-12-34-5a;")], "doc_key string, source string, path string, text string")
    assert sorted((r.line, r.column) for r in detection.scan(docs).collect() if r.type.startswith("Slack")) == [(1, 4), (1, 23)]


def test_no_cheap_test_rejects_a_match(spark):
    from kvtrail.plans.views import candidates, framed

    texts = candidates(spark, SMALL).select(framed().alias("t"))
    short = ["xoxb-1-2-a", "pwd=12345678", "PASSWD: abcdefgh", "key\tabcdefghijkl", "AUTH abcdefghijkl", "redis://0123456789", "SQLITE://" + "a" * 15, "eyJ" + "a" * 20, "f" * 32, "a/" * 10, "Sentry_Key " + "b" * 20]
    texts = texts.unionByName(spark.createDataFrame([(x,) for x in short], "t string")).withColumn("low", F.lower("t"))
    lost = [F.count_if(F.regexp_like("t", F.lit(p.java())) & ~detection.may_match(F.col("t"), F.col("low"), p)).alias(f"lost{k}") for k, p in enumerate(detection.DEFAULT_PATTERNS)]
    found = [F.count_if(F.regexp_like("t", F.lit(p.java()))).alias(f"found{k}") for k, p in enumerate(detection.DEFAULT_PATTERNS)]
    row = texts.agg(*lost, *found).first().asDict()
    assert all(row[f"lost{k}"] == 0 < row[f"found{k}"] for k in range(30))


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4, 5), (5, 2, 0, 3, 1, 4)])
def test_rescan_does_not_depend_on_the_order_of_files(spark, tmp_path, order):
    saves = [("09 00:00", "a"), ("01 00:00", "b"), ("05 00:00", "a"), ("02 00:00", "c"), ("05 00:04", "a"), ("05 00:09", "a")]
    for at in order:
        row = spark.createDataFrame([(str(at), f"2024-01-{saves[at][0]}:00", saves[at][1])], "id string, timestamp string, fileContent string")
        row.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, timestamp timestamp, fileContent string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streams.fresh_content(stream, f"{tmp_path}/out").select("content_hash", "slot").collect()
    batch = spark.read.parquet(f"{tmp_path}/in").select(secrets.checksum(F.col("fileContent")).alias("h"), F.expr("unix_micros(timestamp) div 300000000").alias("s")).distinct().collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch)) and len(found) == 5


def test_entropy(spark):
    assert abs(one(spark, secrets.shannon_entropy(F.col("v")), v="abcdABCD1234") - 3.58496) < 1e-4
    assert one(spark, secrets.shannon_entropy(F.col("v")), v="") == 0


def test_globs(spark):
    rules = ["*.md", "docs/", "!docs/keep.md", "a{b,c}?.txt", "/root.txt"]
    for path, hit in (("x/y.md", True), ("docs/a/b.py", True), ("docs/keep.md", False), ("z/ab1.txt", True), ("ad1.txt", False), ("root.txt", True), ("x/root.txt", False)):
        assert one(spark, filters.ignored(F.col("v"), rules), v=path) is hit, path


def test_lifecycle_after_a_revert(spark):
    rows = [("w", str(i), f"2024-01-0{i} 00:00:00", "e", None, None, f"K={v}") for i, v in enumerate("ABA", 1)]
    df = spark.createDataFrame(rows, "workspace string, id string, timestamp string, environmentName string, user string, reason string, fileContent string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    seen = variables.appearances(df)
    assert variables.lifecycle(seen).first().previous_values == ["A"]
    assert variables.value_changes(seen).first().value_changes == 2


def test_stability_of_single_and_simultaneous_changes(spark):
    rows = [("w", "one", "1", "2024-01-01 00:00:00"), ("w", "two", "2", "2024-01-01 00:00:00"), ("w", "two", "3", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "workspace string, environmentName string, id string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert {r.environmentName: r.stability for r in history.stability_score(df).collect()} == {"one": 100, "two": 50}
    assert {r.environmentName: r.churn_rate for r in history.churn_rate(df).collect()} == {"one": 0.0, "two": None}


def test_encryption_opens_only_with_its_key(spark):
    key, other = F.lit("k" * 32).cast("binary"), F.lit("o" * 32).cast("binary")
    sealed = crypto.encrypt_value(F.col("v"), key)
    assert one(spark, crypto.decrypt_value(sealed, key), v="väl=1") == "väl=1"
    assert one(spark, crypto.decrypt_value(sealed, other), v="x") is None
    assert one(spark, crypto.decrypt_value(F.col("v"), key), v="ENC[broken]") is None


def test_invalid_search_pattern_is_taken_literally(spark):
    df = spark.createDataFrame([("a(b", None, None, "X=1")], "environmentName string, user string, reason string, fileContent string")
    assert df.where(filters.search("a(", "environments", True)).count() == 1
    assert df.where(filters.search("A(B", "environments")).count() == 1
