"""Mined phrases against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from kvtrail.llm import collocations
from tests.llm.conftest import prose

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, min_count, top=2000, percent=100):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    found = [p for p, a in f.items() if len(p) > 2 and a >= min_count]
    inside = Counter()  # the largest count of a longer phrase around each
    for q in found:
        for m in range(2, len(q) - 1):
            for i in range(1, len(q) - m + 1):
                inside[q[0], *q[i : i + m]] = max(inside[q[0], *q[i : i + m]], f[q])
    rows = {}
    for p in found:
        lang, words, a = p[0], p[1:], f[p]
        cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if 100 * inside[p] < percent * a:
            rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def test_odd_rows(odd, empty):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.mine(odd, min_count=3).collect())
    assert got == plain([(r.text, r.lang) for r in odd.collect()], 3) and len(got) > 100
    assert collocations.mine(empty).count() == 0 and collocations.mine(odd, min_count=10**6).count() == 0


@pytest.mark.parametrize(("held", "share", "top", "percent", "block"), [(1 << 20, 1000, 2000, 100, 4 << 20), (500, 40, 7, 60, 50)])
def test_copies_ties_and_small_tasks(spark, monkeypatch, held, share, top, percent, block):
    for name, value in (("_HELD", held), ("_BLOCK_BYTES", block), ("HEAVY_SHARE", share), ("LANGUAGE_PARTS", 5), ("_ROW", 16)):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(40)]
    docs = [(rng.choice(texts) if rng.random() < 0.6 else prose(rng, 60), rng.choice(["en", "en", None, "und", "é"])) for _ in range(200)]
    docs += [("A b, a B! a b a b\ta  b a b;x\x0by\rz " * 4, "en"), (None, None), ("", "xx"), ("...", "yy"), ("two words two words", "de")] * 3
    table = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.mine(table, 4, top, percent).collect())
    assert got == plain(docs, 4, top, percent) and {r[0] for r in got} >= {"en", "und", "de"}


def test_scores_beyond_64_bits(spark):
    counts = [(5_000_000_011, 7_000_000_019, 6_000_000_007, 9_000_000_000_037)]
    rows = spark.createDataFrame(counts, "a long, l long, r long, n long")
    got = rows.selectExpr(f"{collocations.SCORE} as score").first().score
    a, left, right, n = counts[0]
    assert got == 1000 * a * n // (left * right)
