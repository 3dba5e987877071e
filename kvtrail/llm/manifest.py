"""Merkle manifest of a table: digests of rows, trees of digests, and proofs.

Every row is a leaf. The leaves of one tree (a language) are numbered in the order of
their doc_ids; runs of FANOUT nodes become one node, until one remains, the tree's
subroot. The subroots, in the order of their trees, are the leaves of one more tree,
whose root names the whole table.

A tree is cut into aligned subtrees of HEIGHT levels, the blocks: one task builds a
block from at most FANOUT ** HEIGHT digests, and the roots of the blocks are the
leaves of the next level of blocks. A block holds its nodes in van Emde Boas order:
its upper half of levels first, then each subtree of the lower half, every one of them
laid out in the same way. Places of nodes come from address() alone, both when a
block is built and when the siblings of a node are fetched; no pointers are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.llm.storage import discard, written

#: Nodes of a run; levels of a block, which then has at most FANOUT ** HEIGHT leaves.
FANOUT, HEIGHT = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK_SCHEMA = "tree string, block long, size long, height int, leaves int, nodes binary, root string"
_PATH = "array<struct<before: string, after: string>>"


def node_count(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes numbered `index` at `depth` (0: the root) in the van Emde Boas order of a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    below = FANOUT ** (depth - upper)
    return node_count(upper) + index // below * node_count(levels - upper) + address(levels - upper, depth - upper, index % below)


@lru_cache(maxsize=64)
def _places(height: int, depth: int, count: int) -> list[int]:
    return address(height + 1, depth, np.arange(count, dtype=np.int64)).tolist()


def _counts(leaves: int, height: int) -> list[int]:
    """Nodes that exist at each depth; the leaves are the last."""
    return [-(-leaves // FANOUT ** (height - depth)) for depth in range(height + 1)]


def least_height(leaves: int) -> int:
    height = 0
    while FANOUT**height < leaves:
        height += 1
    return height


def build_block(digests: list[str], height: int) -> bytes:
    """The nodes of a block over these leaves; places of nodes that do not exist are zero."""
    nodes = bytearray(32 * node_count(height + 1))
    row = digests
    for depth in range(height, -1, -1):
        if depth < height:
            row = [hashlib.sha256("".join(row[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(row), FANOUT)]
        for place, digest in zip(_places(height, depth, len(row)), row, strict=True):
            nodes[32 * place : 32 * place + 32] = bytes.fromhex(digest)
    return bytes(nodes)


def block_root(nodes: bytes) -> str:
    return nodes[:32].hex()


def siblings(nodes: bytes, height: int, leaves: int, position: int) -> list[tuple[str, str]]:
    """For each level from a leaf up: the digests of its run before and after the node, end to end."""
    out, counts = [], _counts(leaves, height)
    for depth in range(height, 0, -1):
        first = position // FANOUT * FANOUT
        run = address(height + 1, depth, np.arange(first, min(first + FANOUT, counts[depth]), dtype=np.int64)).tolist()
        hexes = [nodes[32 * p : 32 * p + 32].hex() for p in run]
        out.append(("".join(hexes[: position - first]), "".join(hexes[position - first + 1 :])))
        position //= FANOUT
    return out


def all_siblings(nodes: bytes, height: int, leaves: int) -> list[list[tuple[str, str]]]:
    """siblings() of every leaf of a block; each run is fetched once."""
    paths: list[list[tuple[str, str]]] = [[] for _ in range(leaves)]
    for depth, count in zip(range(height, 0, -1), _counts(leaves, height)[:0:-1], strict=True):
        hexes = [nodes[32 * p : 32 * p + 32].hex() for p in _places(height, depth, count)]
        cut = [("".join(hexes[k - k % FANOUT : k]), "".join(hexes[k + 1 : k - k % FANOUT + FANOUT])) for k in range(count)]
        under = FANOUT ** (height - depth)
        for k, path in enumerate(paths):
            path.append(cut[k // under])
    return paths


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        digest = hashlib.sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row: each value as its count of UTF-8 bytes, a colon and itself, or `-` for null."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, doc_id, leaf, claimed of every row: its digest, and the one that its tampered form would have.

    tampered: which rows are handed on with the letters A to Z of their text in lower case;
    a null counts as no. The texts are hashed where they are read and do not travel.
    """
    now = {c: F.col(c) for c in COLUMNS}
    changed = now | {"text": F.translate(F.col("text").cast("string"), _UPPER, _LOWER)}
    leaf = leaf_digest(now)
    claimed = leaf if tampered is None else F.when(tampered, leaf_digest(changed)).otherwise(leaf)
    tree = F.when(F.col("lang").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("lang").cast("string")))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), claimed.alias("claimed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows, with `position` in the order of their tree, and `size`, the rows of the tree.

    Rows are dealt by ranges of the order, equal ones by a number of their own, so no
    tree and no repeated row meets in one task. Positions come from counts of the ranges.
    """
    keys = ["tree", *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "manifest-order")
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")
    parts = parts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    return placed.join(parts, ["tree", "_part"]).withColumn("position", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _blocks(digests: DataFrame, levels: int) -> DataFrame:
    """The blocks over tree, position, size, digest; a block is a group of FANOUT ** levels rows at most."""
    most = FANOUT**levels

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        size, n = group["size"][0].as_py(), group.num_rows
        height = min(least_height(size), levels)
        nodes = build_block(group["digest"].to_pylist(), height)
        row = {"tree": group["tree"][0].as_py(), "block": group["position"][0].as_py() // most, "size": size, "height": height, "leaves": n, "nodes": nodes, "root": block_root(nodes)}
        return pa.Table.from_pylist([row], _ARROW_BLOCK)

    rows = digests.select("tree", "position", "size", "digest")
    return written(rows.groupBy("tree", F.expr(f"position div {most}")).applyInArrow(run, _BLOCK_SCHEMA), "manifest-blocks")


_ARROW_BLOCK = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("height", pa.int32()), ("leaves", pa.int32()), ("nodes", pa.binary()), ("root", pa.string())])


def _tower(digests: DataFrame, height: int) -> list[DataFrame]:
    """Blocks over the leaves, blocks over their roots, and so on, until every tree has one."""
    levels, block = [_blocks(digests, height)], FANOUT**height
    most = levels[0].agg(F.max("size")).first()[0] or 0
    while most > block:
        most = -(-most // block)
        wide = levels[-1].where(F.col("size") > block)
        roots = wide.select("tree", F.col("block").alias("position"), F.expr(f"(size + {block - 1}) div {block}").alias("size"), F.col("root").alias("digest"))
        levels.append(_blocks(roots, height))
    return levels


@dataclass
class Manifest:
    """leaves: tree, doc_id, leaf, claimed, position, size. forest and crown: levels of blocks, over the leaves and over the subroots. height: levels of a block."""

    leaves: DataFrame
    forest: list[DataFrame]
    crown: list[DataFrame]
    crown_leaves: DataFrame
    height: int

    def root(self) -> str | None:
        """The root of the whole table; None for an empty one."""
        row = _subroots(self.crown, self.height).first()
        return row and row["root"]

    def subroots(self) -> DataFrame:
        """tree, root of each tree."""
        return _subroots(self.forest, self.height)


def _subroots(levels: list[DataFrame], height: int) -> DataFrame:
    out = None
    for level in levels:
        done = level.where(F.col("size") <= FANOUT**height).select("tree", "root")
        out = done if out is None else out.union(done)
    return out


def build(rows: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest over leaves(), in blocks of so many levels.

    Rows of one doc_id follow one another by their digests, a null doc_id comes first, rows
    that are equal stay separate leaves; a null language is a tree of its own. An empty
    table has no trees and no root.
    """
    first = written(rows, "manifest-leaves")
    placed = numbered(first, "doc_id", "leaf")
    placed = written(placed, "manifest-numbered")
    discard(first)
    forest = _tower(placed.withColumnRenamed("leaf", "digest"), height)
    crown_leaves = written(numbered(_subroots(forest, height).select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), "of"), "manifest-subroots")
    return Manifest(placed, forest, _tower(crown_leaves, height), crown_leaves, height)


def _descended(levels: list[DataFrame], ends: DataFrame, block: int) -> DataFrame:
    """The lowest blocks, each with the path from its root up; ends: tree, path, subroot, root of the whole trees."""
    above = None
    for level in reversed(levels):
        placed = level.withColumnRenamed("root", "own").where(F.col("size") <= block).join(ends, "tree").withColumn("subroot", F.coalesce("subroot", "own"))
        if above is not None:
            placed = placed.unionByName(level.withColumnRenamed("root", "own").where(F.col("size") > block).join(above, ["tree", "block"]))
        placed = written(placed, "manifest-paths")
        above = _entries(placed, block)
    return placed


def _entries(placed: DataFrame, block: int) -> DataFrame:
    """tree, block, path, subroot, root: for every leaf of the blocks, numbered as a block of the level below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                up = row["path"]
                paths = [[{"before": b, "after": a} for b, a in p] + up for p in all_siblings(row["nodes"], row["height"], row["leaves"])]
                n = len(paths)
                kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                arrays = [pa.array([row["tree"]] * n, pa.string()), pa.array(np.arange(n) + row["block"] * block), pa.array(paths, kind)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string())], ["tree", "block", "path", "subroot", "root"])

    return placed.select("tree", "block", "height", "leaves", "nodes", "path", "subroot", "root").mapInArrow(run, f"tree string, block long, path {_PATH}, subroot string, root string")


def verify(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of the manifest.

    Claims meet their block, by number; proofs of rows are made there and do not travel.
    proof_sha256 is the digest of the row's siblings, level by level, left to right.
    """
    size = FANOUT**manifest.height
    whole = _subroots(manifest.crown, manifest.height).select("tree", F.expr(f"cast(array() as {_PATH})").alias("path"), F.lit("").alias("subroot"), "root")
    tops = _entries(_descended(manifest.crown, whole, size), size).withColumnRenamed("block", "position").drop("tree", "subroot")
    ends = manifest.crown_leaves.select(F.col("of").alias("tree"), "position").join(tops, "position").select("tree", "path", F.lit(None).cast("string").alias("subroot"), "root")
    blocks = _descended(manifest.forest, ends, size).select("tree", "block", "height", "leaves", "nodes", "path", "subroot", "root")

    def run(claims: pa.Table, block: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        up = [(x["before"], x["after"]) for x in row["path"]]
        paths = all_siblings(row["nodes"], row["height"], row["leaves"])
        at = (claims["position"].to_numpy() % size).tolist()
        proofs, folded = [], []
        for place, claimed in zip(at, claims["claimed"].to_pylist(), strict=True):
            path = paths[place] + up
            proofs.append(hashlib.sha256("".join([x for pair in path for x in pair]).encode()).hexdigest())
            folded.append(fold(claimed, path))
        n = claims.num_rows
        out = [claims["doc_id"], claims["leaf"], pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([x == row["root"] for x in folded], pa.bool_())]
        return pa.table(out, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    claims = manifest.leaves.select("tree", "doc_id", "leaf", "claimed", "position", F.expr(f"position div {size}").alias("block"))
    met = claims.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    return met.applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def every_third(doc_id: str = "doc_id") -> Column:
    """Rows whose doc_id, in decimal, has a CRC-32 that 3 divides."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0


#: Levels of a tree that the SQL can go up: 8 ** 9 rows.
_SQL_LEVELS = 9


def _sql_tree(name: str, leaves: str, key: str) -> str:
    """Tables {name}0, {name}1, ...: rows (key, i, h, count, before, after), one level each; {name}top: key, h."""
    group = f"partition by {key}, i // {FANOUT} order by i rows between"
    shape = (
        f"select {key}, i, h, count(*) over (partition by {key}) as n, coalesce(string_agg(h, '') over ({group} unbounded preceding and 1 preceding), '') as b, "
        f"coalesce(string_agg(h, '') over ({group} 1 following and unbounded following), '') as a from"
    )
    out = [f"{name}0 as ({shape} ({leaves}))"]
    for k in range(1, _SQL_LEVELS + 1):
        out.append(f"{name}{k} as ({shape} (select {key}, i // {FANOUT} as i, sha256(string_agg(h, '' order by i)) as h from {name}{k - 1} where n > 1 group by 1, 2))")
    out.append(f"{name}top as (" + " union all ".join(f"select {key}, h from {name}{k} where n = 1" for k in range(_SQL_LEVELS + 1)) + ")")
    return ",\n".join(out)


def _sql_paths(name: str, key: str, source: str, carry: str) -> str:
    """Tables {name}p0, ...: source's rows (key, i, carry, f, p), f folded and p lengthened level by level."""
    out, now = [], source
    for k in range(_SQL_LEVELS):
        up = f"s.n > 1 and s.{key} is not distinct from t.{key} and s.i = t.i"
        out.append(f"{name}p{k} as (select {', '.join('t.' + c for c in carry.split(', '))}, t.{key}, t.i // {FANOUT} as i, case when s.h is null then t.f else sha256(s.b || t.f || s.a) end as f, t.p || coalesce(s.b || s.a, '') as p from {now} t left join {name}{k} s on {up})")
        now = f"{name}p{k}"
    return ",\n".join(out)


_SQL_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, [ord(c)::bigint for c in string_split(doc_id::varchar, '')]), lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295)"
_SQL_LEAF = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in COLUMNS)
_SQL_CHANGED = _SQL_LEAF.replace("text::varchar", f"translate(text, '{_UPPER}', '{_LOWER}')")
ORACLE_SQL = f"""
with d as (select lang, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, doc_id, leaf,
                  case when {_SQL_CRC} % 3 = 0 then changed else leaf end as claimed
           from (select doc_id, lang, sha256({_SQL_LEAF}) as leaf, sha256({_SQL_CHANGED}) as changed from documents)),
{_sql_tree("s", "select lang, i, leaf as h from d", "lang")},
{_sql_tree("r", "select 0 as z, row_number() over (order by lang nulls first) - 1 as i, h from stop", "z")},
c as (select doc_id, leaf, lang, i, claimed as f, '' as p from d),
{_sql_paths("s", "lang", "c", "doc_id, leaf")},
l as (select lang, row_number() over (order by lang nulls first) - 1 as i, h as subroot from stop),
e as (select doc_id, leaf, subroot, 0 as z, l.i, f, p from sp{_SQL_LEVELS - 1} x join l on x.lang is not distinct from l.lang),
{_sql_paths("r", "z", "e", "doc_id, leaf, subroot")}
select doc_id, leaf, subroot, rtop.h as root, sha256(p) as proof_sha256, f as folded_root, f = rtop.h as verified
from rp{_SQL_LEVELS - 1}, rtop
"""
