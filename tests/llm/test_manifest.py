"""The Merkle manifest against a plain tree in memory."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from kvtrail.llm import manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    out = []
    for c in manifest.COLUMNS:
        v = row[c]
        if c == "text" and lower and v is not None:
            v = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in v)
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha("".join(out))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def path(tower, at):
    out = []
    for row in tower[:-1]:
        first = at // 8 * 8
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + 8])))
        at //= 8
    return out


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    towers = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        towers[name] = levels([leaf(r) for r in trees[name]])
    crown = levels([towers[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, row in enumerate(trees[name]):
            whole = path(towers[name], at) + path(crown, k)
            changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            folded = manifest.fold(leaf(row, changed), whole)
            root = crown[-1][0]
            out.append((row["doc_id"], leaf(row), towers[name][-1][0], root, sha("".join(b + a for b, a in whole)), folded, folded == root))
    return sorted(out, key=str)


def verified(docs, height=manifest.HEIGHT):
    rows = manifest.verify(manifest.build(manifest.leaves(docs, manifest.every_third()), height))
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=str)


@pytest.mark.parametrize("levels_", range(1, 7))
def test_layout(levels_):
    depth_of = {}
    for depth in range(levels_):
        places = manifest.address(levels_, depth, np.arange(8**depth))
        for k, place in enumerate(places.tolist()):
            assert place not in depth_of
            depth_of[place] = (depth, k)
    assert sorted(depth_of) == list(range(manifest.node_count(levels_)))
    upper = levels_ // 2  # the first places are the upper half; each lower subtree lies in one piece
    assert all(depth_of[p][0] < upper for p in range(manifest.node_count(upper))) or levels_ == 1
    if upper:
        size = manifest.node_count(levels_ - upper)
        for k in range(8**upper):
            first = manifest.node_count(upper) + k * size
            assert depth_of[first] == (upper, k)
            assert {i // 8 ** (d - upper) for d, i in (depth_of[p] for p in range(first, first + size))} == {k}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 500])
def test_block(n):
    digests = [sha(str(k)) for k in range(n)]
    height = manifest.least_height(n)
    tower, nodes = levels(digests), manifest.build_block(digests, height)
    assert manifest.block_root(nodes) == tower[-1][0] and len(tower) == height + 1
    paths = manifest.all_siblings(nodes, height, n)
    for k in {0, n // 2, n - 1}:
        assert paths[k] == path(tower, k) == manifest.siblings(nodes, height, n, k)
        assert manifest.fold(digests[k], paths[k]) == tower[-1][0]


@pytest.mark.parametrize("height", [1, 2, manifest.HEIGHT])
def test_odd_rows(odd, height):
    assert verified(odd, height) == plain([r.asDict() for r in odd.collect()])


@pytest.mark.parametrize("height", [1, 4])
def test_several_levels_and_many_trees(spark, height):
    rows = [(k * 7 % 1000, None if k % 50 == 0 else f"T{k} Text", "en" if k < 700 else None if k < 709 else f"l{k}é", "s", k) for k in range(1000)] + [(5, "same", "en", "s", 1)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = verified(docs, height)
    assert got == plain([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_empty_and_one(spark, empty):
    built = manifest.build(manifest.leaves(empty))
    assert built.root() is None and built.subroots().count() == 0 and manifest.verify(built).count() == 0
    one = empty.sparkSession.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    row = leaf({"doc_id": 1, "text": None, "lang": None, "source": None, "n_chars": None})
    assert verified(one) == [(1, row, row, row, sha(""), row, True)]
