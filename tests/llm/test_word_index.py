"""Phrase search by a positional index against plain scans of the word lists."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from kvtrail.llm import word_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows(text, width):
    w = words(text)
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def plain(docs, items, width):
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for item, body in items:
            for window in windows(body, width) if item is not None else ():
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        met.add(str(item))
        ids = sorted(met)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark, odd):
    rng = random.Random(3)
    long = odd.where("doc_id = 12").first().text
    w = words(long)
    items = [(k, " ".join(w[s : s + rng.randint(9, 40)])) for k, s in enumerate(rng.sample(range(len(w) - 50), 30))]
    items += [(100, "ONE two-three"), (101, "one"), (102, ""), (103, None), (None, "one two"), (104, " ".join(w[:12]).upper()), (104, "word"), (105, "é" * 300), (106, " ".join(w[5:25])), (107, " ".join(w[100:110] + w[90:100]))]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("width", "block"), [(10, word_index.BLOCK_WORDS), (3, 100)])
def test_contamination(spark, odd, monkeypatch, width, block):
    monkeypatch.setattr(word_index, "BLOCK_WORDS", block)
    items, table = tables(spark, odd)
    docs = odd.unionByName(spark.createDataFrame([(None, "One, two three!"), (70, "one two, THREE one two three")], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r)[:6] for r in word_index.contamination(word_index.build_index(docs), table, width).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], items, width)
    assert any(r[2] > 20 for r in got) and any(r[2] == 0 < r[1] for r in got)


def test_long_items_are_cut_without_loss(spark, odd, monkeypatch):
    monkeypatch.setattr(word_index, "PART_WORDS", 25)
    table = odd.where("doc_id = 12").selectExpr("doc_id as item_id", "text")
    parts = word_index.item_words(table, 10).toArrow()
    w = word_index.terms_of([table.first().text])[0].tolist()
    seen = {tuple(p[i : i + 10]) for p in (np.frombuffer(x, "<u8").tolist() for x in parts["words"].to_pylist()) for i in range(len(p) - 9)}
    assert seen == {tuple(w[i : i + 10]) for i in range(len(w) - 9)} and len(parts) > 100


def test_search_gives_every_place(spark, odd):
    items, table = tables(spark, odd)
    index = word_index.build_index(odd.where("doc_id is not null"))
    got = sorted(tuple(r) for r in word_index.search(index, table).collect())
    want = set()
    for r in odd.collect():
        w = words(r.text)
        for item, body in items:
            for window in windows(body, 10) if item is not None else ():
                want |= {(r.doc_id, str(item), i, len(window)) for i in range(len(w) - len(window) + 1) if tuple(w[i : i + len(window)]) == window}
    assert got == sorted(want) and got


def shortest(w, need, most):
    """Runs with all of `need` that hold no other such run."""
    out = []
    for i in range(len(w)):
        for j in range(i, min(len(w), i + most)):
            if need <= set(w[i : j + 1]):
                if w[i] in need and not need <= set(w[i + 1 : j + 1]):
                    out.append((i, j - i + 1))
                break
    return {(i, n) for i, n in out if not any(i <= a and a + b <= i + n and (a, b) != (i, n) for a, b in out)}


def test_near_matches(spark):
    rng = random.Random(8)
    letters = "a b c d e f g".split()
    docs = [(k, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    items = [(1, "a b c"), (2, "d d e"), (3, "g"), (4, "a b c d e f"), (5, "none a")]
    index = word_index.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2))
    for slop in (0, 1, 4):
        got = sorted(tuple(r) for r in word_index.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, slop).collect())
        want = {(d, str(item), i, n) for d, text in docs for item, body in items for i, n in shortest(text.split(), set(body.split()), len(body.split()) + slop)}
        assert got == sorted(want)


def test_empty_tables(spark, empty, odd):
    items = spark.createDataFrame([], "item_id long, text string")
    assert word_index.contamination(word_index.build_index(empty), items).count() == 0
    rows = word_index.contamination(word_index.build_index(odd), items).collect()
    assert len(rows) == odd.count() and not any(r.contaminated for r in rows)
