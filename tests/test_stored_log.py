"""The stored log's files, and month files of JSON arrays."""

from __future__ import annotations

import json
import os
from datetime import datetime

from kvtrail.sources.log import StoredLog, scan_month_files

SCHEMA = "id string, timestamp timestamp, workspace string, environmentName string, action string, user string, commitHash string, reason string, fileContent string"


def entry(k, month, day, workspace="a", content="X=1", user="u"):
    return (str(k), datetime(2024, month, day), workspace, "local", "modify", user, f"c{k}", None, content)


def files(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def stored(spark, path):
    log = StoredLog(spark, f"{path}/log")
    log.append(0, spark.createDataFrame([entry(1, 1, 5), entry(2, 1, 20, content="X=2\nY=3"), entry(3, 2, 10, content="Y=3", user=None), entry(9, 2, 11, "b")], SCHEMA).coalesce(1))
    log.append(1, spark.createDataFrame([entry(4, 2, 20, content=""), entry(5, 3, 1, content="Z=1"), entry(6, 3, 9, content="Z=1")], SCHEMA).coalesce(1))
    return log


def test_appending_again_changes_nothing(spark, tmp_path):
    log = stored(spark, tmp_path)
    before, rows = files(tmp_path), sorted(map(str, log.read().collect()))
    assert not log.append(1, spark.createDataFrame([entry(7, 3, 10)], SCHEMA)) and not log.append(0, spark.createDataFrame([entry(8, 3, 10)], SCHEMA))
    assert files(tmp_path) == before and sorted(map(str, log.read().collect())) == rows
    latest = {(r.workspace, r.environmentName): r.id for r in log.latest().collect()}
    assert latest == {("a", "local"): "6", ("b", "local"): "9"}


def test_a_batch_without_its_marker_is_not_read(spark, tmp_path):
    log = stored(spark, tmp_path)
    os.rename(tmp_path / "log/commits/1", tmp_path / "away")
    os.rename(tmp_path / "log/latest/batch=1", tmp_path / "gone")
    assert {r.id for r in log.read().collect()} == {"1", "2", "3", "9"}


def test_diffs_come_from_the_latest_snapshots(spark, tmp_path):
    rows = {r.id: r for r in stored(spark, tmp_path).read().collect()}
    seen = {k: r.diff and [(d.key, d.status, d.old_value, d.new_value, d.blame_user, d.blame_commit) for d in r.diff] for k, r in rows.items()}
    assert seen["1"] is None and seen["9"] is None
    assert seen["2"] == [("X", "changed", "1", "2", "u", "c1"), ("Y", "added", None, "3", None, None)]
    assert seen["3"] == [("X", "removed", "2", None, None, None), ("Y", "unchanged", "3", "3", None, None)]
    assert seen["4"] == [("Y", "removed", "3", None, None, None)] and seen["5"] == [("Z", "added", None, "1", None, None)]
    assert all(r.checksum and r.source == "auto" and r.month == r.timestamp.strftime("%Y-%m") for r in rows.values())


def test_retention_rewrites_the_boundary_month_only(spark, tmp_path):
    log = stored(spark, tmp_path)
    before = files(tmp_path / "log/entries")
    assert log.keep_days(28) == 2  # from 10 February on: the entry of that day stays
    after = files(tmp_path / "log/entries")
    kept = {r.id for r in log.read().collect()}
    assert kept == {"3", "9", "4", "5", "6"} and not any("2024-01" in f for f in after)
    assert {f for f in before if "2024-01" not in f} == after  # nothing in the boundary month was older
    assert log.keep_days(18) == 2 and {r.id for r in log.read().collect()} == {"4", "5", "6"}
    assert {f for f in after if "2024-03" in f} <= files(tmp_path / "log/entries")


def test_retention_by_count_keeps_untouched_parts(spark, tmp_path):
    log = stored(spark, tmp_path)
    before = files(tmp_path / "log/entries")
    assert log.keep_newest(3) == 3
    after = files(tmp_path / "log/entries")
    assert {r.id for r in log.read().collect()} == {"9", "4", "5", "6"}
    assert {f for f in before if "2024-03" in f} == {f for f in after if "2024-03" in f} and not any("2024-01" in f for f in after)
    assert log.keep_newest(3) == 0 and files(tmp_path / "log/entries") == after


def test_month_files(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8")

    def rows(*ids):
        return json.dumps([{"id": i, "timestamp": f"2024-0{i[0]}-0{i[1]}T10:00:00.000Z", "action": "modify", "environmentName": "local", "fileContent": "A=1\nB=é", "metadata": {"tags": ["x"]}} for i in ids], indent=2)

    put("a/2024-03.json", rows("31", "32"))
    put("a/2024-02.json", rows("21"))
    put("a/2024-01.json", rows("11", "12"))
    put("b/2024-03.json", '[{"id": "38", "timestamp"')
    put("b/2024-02.json", rows("28", "29", "27"))
    put("b/2024-01.json", rows("18"))
    put("b/analytics-cache.json", "{}")
    every = scan_month_files(spark, str(tmp_path))
    assert sorted(r.id for r in every.rows.collect()) == ["11", "12", "18", "21", "27", "28", "29", "31", "32"]
    assert [os.path.basename(os.path.dirname(r.path)) + "/" + os.path.basename(r.path) for r in every.skipped.collect()] == ["b/2024-03.json"]
    some = scan_month_files(spark, str(tmp_path), 2)
    got = {}
    for r in some.rows.collect():
        got.setdefault(r.workspace, set()).add(r.id)
    assert got == {"a": {"31", "32"}, "b": {"28", "29"}} and some.months == ["2024-03", "2024-02"]
    read = {os.path.basename(f) for f in some.rows.inputFiles()}
    assert "2024-01.json" not in read and not any(f.endswith("a/2024-02.json") for f in some.rows.inputFiles())
    assert scan_month_files(spark, str(tmp_path), 1).skipped.count() == 1
