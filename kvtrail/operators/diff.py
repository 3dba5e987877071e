"""Comparison of key=value snapshots: keyed full outer joins, blame and change data."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.functions import kv

KEYS = ["workspace", "environmentName"]


def kv_diff(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of the diff dialect compared by key: status, old_value, new_value.

    Each row of b meets the last row of its key in a; rows of a whose key b lacks are
    removed rows, one each.
    """
    last = kv.last_wins(a, keys, "value").withColumnRenamed("value", "old_value")
    on = [*keys, "key"]
    new = b.withColumnRenamed("value", "new_value").join(last, on, "left")
    status = F.when(F.col("old_value").isNull(), "added").when(F.col("old_value") != F.col("new_value"), "changed").otherwise("unchanged")
    gone = a.join(b.select(*on).distinct(), on, "left_anti").select(*on, F.lit("removed").alias("status"), F.col("value").alias("old_value"), F.lit(None).cast("string").alias("new_value"))
    return new.select(*on, status.alias("status"), "old_value", "new_value").unionByName(gone)


def diff_summary(diff: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed")]
    return diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)


def sync_preview(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """New, changed and removed keys of pairs (last wins), and whether both sides agree."""
    left, right = a.withColumnRenamed("value", "local"), b.withColumnRenamed("value", "remote")
    both = left.join(right, [*keys, "key"], "full_outer")
    new, gone = F.count_if(F.col("local").isNull()), F.count_if(F.col("remote").isNull())
    changed = F.count_if(F.col("local") != F.col("remote"))
    return both.groupBy(*keys).agg(new.alias("new_keys"), changed.alias("changed_keys"), gone.alias("removed_keys"), (new + changed + gone).alias("total_changes"), ((new + changed + gone) == 0).alias("in_sync"))


def sync_report(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The lines of a report on pulling b over a: section with its number of keys, and one line a key; equal pairs are not shown."""
    both = a.withColumnRenamed("value", "_old").join(b.withColumnRenamed("value", "_new"), [*keys, "key"], "full_outer").where("not (_old <=> _new)")
    old, new = F.col("_old"), F.col("_new")
    kind = F.when(old.isNull(), "Added").when(new.isNull(), "Removed").otherwise("Modified")
    line = F.when(old.isNull(), F.concat(F.lit("+ "), "key", F.lit("="), new)).when(new.isNull(), F.concat(F.lit("- "), "key", F.lit("="), old)).otherwise(F.concat(F.lit("~ "), "key", F.lit("="), old, F.lit(" → "), new))
    rows = both.select(*keys, kind.alias("_kind"), line.alias("line"))
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_kind"))
    return rows.select(*keys, F.concat("_kind", F.lit(" Variables ("), count.cast("string"), F.lit(")")).alias("section"), "line")


def with_pairs(df: DataFrame, name: str = "kv") -> DataFrame:
    """Adds the snapshot's pairs (diff dialect, last wins) as an array of key and value, in the order of keys; narrow, no shuffle."""
    text = F.transform(F.split("fileContent", "\n"), kv.js_trim)
    rows = F.filter(text, lambda x: (x != "") & ~x.startswith("#") & (F.instr(x, "=") > 1))
    entry = F.transform(rows, lambda x, i: F.struct(kv.js_trim(F.substring_index(x, "=", 1)).alias("key"), i.alias("at"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    df = df.withColumn("_sorted", F.array_sort(F.filter(entry, lambda x: x["key"] != "")))
    last = F.filter("_sorted", lambda x, i: ~F.get("_sorted", i + 1)["key"].eqNullSafe(x["key"]))
    return df.withColumn(name, F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))).drop("_sorted")


def merged_pairs(df: DataFrame, old: str, new: str) -> DataFrame:
    """One row for each key of two sorted arrays of pairs, beside the other columns: key, status, old_value, new_value.

    Both arrays are laid together and sorted once; the two values of a key are then neighbours. A null array has no pairs.
    """
    none = F.expr("cast(array() as array<struct<key: string, value: string>>)")
    side = lambda c, k: F.transform(F.coalesce(F.col(c), none), lambda x: F.struct(x["key"].alias("key"), F.lit(k).alias("side"), x["value"].alias("value")))
    rest = [c for c in df.columns if c not in (old, new)]
    df = df.select(*rest, F.array_sort(F.concat(side(old, 0), side(new, 1))).alias("_both"))
    same = lambda x, i: F.get("_both", i)["key"].eqNullSafe(x["key"])
    row = lambda x, a, b: F.struct(x["key"].alias("key"), a.alias("old_value"), b.alias("new_value"))
    null = F.lit(None).cast("string")
    one = F.transform("_both", lambda x, i: F.when(x["side"] == 0, row(x, x["value"], F.when(same(x, i + 1), F.get("_both", i + 1)["value"]))).when(~same(x, i - 1), row(x, null, x["value"])))
    df = df.withColumn("_rows", one).select(*rest, F.explode(F.filter("_rows", lambda x: x.isNotNull())).alias("_r")).select(*rest, "_r.*")
    status = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed").otherwise("unchanged")
    return df.select(*rest, "key", status.alias("status"), "old_value", "new_value")


BLAME = ["user", "timestamp", "commitHash"]


def diff_against_previous(log: DataFrame, same_environment: bool) -> DataFrame:
    """Changes of each snapshot against the one before it, in the workspace or in its environment.

    Changed keys blame the snapshot before: its user, time and commit. The first snapshot has nothing to be compared with.
    """
    part = KEYS if same_environment else ["workspace"]
    w = Window.partitionBy(*part).orderBy("timestamp", "id")
    rows = with_pairs(log).withColumn("_before", F.lag(F.struct("kv", *BLAME)).over(w)).where("_before is not null")
    rows = rows.select("workspace", "environmentName", "id", F.col("_before.kv").alias("_old"), "kv", *(F.col(f"_before.{c}").alias(f"_{c}") for c in BLAME))
    blame = lambda c, name: F.when(F.col("status") == "changed", F.col(f"_{c}")).alias(name)
    out = merged_pairs(rows, "_old", "kv")
    return out.select("workspace", "environmentName", "id", "key", "status", "old_value", "new_value", blame("user", "blame_user"), blame("timestamp", "blame_timestamp"), blame("commitHash", "blame_commit"))


def first_against_current(log: DataFrame, current: DataFrame) -> DataFrame:
    """The first snapshot of each environment against the environment's file as it is: old values are the snapshot's.

    current has workspace, environmentName, fileContent; an environment without a file has lost all its keys.
    """
    first = log.groupBy(*KEYS).agg(F.min_by(F.struct("id", "fileContent"), F.struct("timestamp", "id")).alias("x")).select(*KEYS, "x.id", "x.fileContent")
    now = with_pairs(current.select(*KEYS, "fileContent"), "_now").drop("fileContent")
    return merged_pairs(with_pairs(first).drop("fileContent").join(now, KEYS, "left"), "kv", "_now")


def changes_shown(log: DataFrame, current: DataFrame) -> DataFrame:
    """What a viewer of each entry sees: its changes against the entry before it in the environment, or, for the first one, the file as it is now. against tells which."""
    before = diff_against_previous(log, True).withColumn("against", F.lit("previous"))
    return before.unionByName(first_against_current(log, current).withColumn("against", F.lit("current")), allowMissingColumns=True)


def trash_log(log: DataFrame) -> DataFrame:
    """Deleted and modified keys against the previous snapshot of the environment; a modification to '' is none."""
    changes = diff_against_previous(log, True).where("status = 'removed' or (status = 'changed' and new_value != '')")
    return changes.select("workspace", "environmentName", "id", "key", "old_value", "new_value", F.when(F.col("status") == "removed", "deleted").otherwise("modified").alias("type"))


def restore(current: DataFrame, trashed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pairs after taking trashed values back: modified ones replaced, deleted ones appended."""
    back = trashed.groupBy(*keys, "key").agg(F.max_by("old_value", F.col("id").cast("long")).alias("back"))
    return current.join(back, [*keys, "key"], "full_outer").select(*keys, "key", F.coalesce("back", "value").alias("value"))


def granular_runs(old: str, new: str) -> list[dict]:
    """Character runs that turn old into new, found from left to right; positions are in new.

    Equal heads are skipped. Where the texts part, the old one loses what stands before
    the next place of the new character that follows, and then the new one gains what
    stands before the next place of the old character that follows; without such a
    place, all that is left goes or comes.
    """
    out, at = [], 0
    while old or new:
        head = len(os.path.commonprefix([old, new]))
        old, new, at = old[head:], new[head:], at + head
        if not old and not new:
            break
        lost = old[: found] if new and (found := old.find(new[0])) >= 0 else old
        old = old[len(lost) :]
        gained = new[: found] if old and (found := new.find(old[0])) >= 0 else new
        new = new[len(gained) :]
        kind = "insert" if not lost else "replace" if gained else "delete"
        out.append({"type": kind, "original": lost, "modified": gained, "position": at})
        at += len(gained)
    return out


def granular_diff(changed: DataFrame) -> DataFrame:
    """Adds value_changes, the character runs of old_value to new_value; only changed rows should come here."""

    @F.pandas_udf("array<struct<type: string, original: string, modified: string, position: int>>")
    def runs(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in parts:
            yield pd.Series([granular_runs(a or "", b or "") for a, b in zip(old, new, strict=True)])

    return changed.withColumn("value_changes", runs("old_value", "new_value"))
