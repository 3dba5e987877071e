"""Searches, classifiers, rules, joins and deduplication against brute force on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from kvtrail.llm import jaccard, line_rules, quality_net, queries, suffix_dedup, topk, toxicity
from tests.conftest import SMALL, normal

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SWAP = str.maketrans("ab", "ba")


def regular_word(length):
    """A word whose polynomial hashes modulo a power of two are those of its complement."""
    word = "a"
    while len(word) < length:
        word += word.translate(SWAP)
    return word


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    want = [dict(zip([c[0] for c in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    assert normal([r.asDict() for r in df.collect()], columns) == normal(want, columns)


def test_topk_with_ties_nulls_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 6), 2)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(15)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [0.5])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(topk.build_index(vectors, 3), vectors.where("vec_id % 20 = 0"), 3).collect())
    plain = {r.vec_id: r.v for r in vectors.collect()}
    want = []
    for q, v in plain.items():
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in plain.items() if i != q and len(w) == len(v)))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and 300 not in plain and 305 in plain
    none = vectors.where("false")
    assert topk.search(topk.build_index(none, 1), none, 1).count() == 0


def test_topk_with_repeated_ids_extra_columns_and_large_components(spark):
    big = 2.0**20
    rows = [(1, [big, 1.0], 0, 5), (1, [big, 2.0], 0, 5), (2, [big, 3.0], 0, 5), (3, [-big, 1.0], 0, 5), (20, [big, 1.0], 0, 5)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long, block long"))
    found = topk.search(topk.build_index(vectors, 1), vectors.where("vec_id = 20"), 1, 3).collect()
    score = lambda y: (2**20 * 1024) ** 2 + 1024 * 1024 * y
    assert score(3) >= 1 << 53
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 2, score(3)), (2, 1, score(2)), (3, 1, score(1))]


def test_topk_of_repeated_queries_and_scores_beyond_64_bits(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = topk.search(topk.build_index(vectors, 2), vectors.where("vec_id = 0"), 2, 1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 1, 2 << 20), (0, 1, 2, 3 << 20)]
    huge = [(0, [2.0**30, 2.0**30]), (1, [2.0**30, 2.0**30]), (2, [2.0**30, 2.0**29]), (3, [-(2.0**30), -(2.0**30)]), (4, [2.0**20, 0.0])]
    vectors = topk.integer_vectors(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    found = topk.search(topk.build_index(vectors, 1), vectors.where("vec_id = 0"), 1, 5).collect()
    top = 2**63 - 1
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 1, top), (2, 2, top), (3, 4, top), (4, 3, -(2**63))]


def test_topk_sends_no_queries_through_the_driver(spark):
    """The groups of queries, one copy for each part of the index, were broadcast when the queries themselves were small."""
    plan = queries.QUERIES["op4_exact_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def best_by_force(vectors, queried, k):
    """Sorted (query_id, rank, vec_id, score) for rows of (vec_id, vector)."""
    out = []
    for q, v in queried:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def uneven_vectors(rng):
    """Near and exact copies, repeated ids, steep and flat vectors, two lengths."""
    base = np.floor(rng.normal(0, 130, (400, 12)) * np.where(rng.random((400, 1)) < 0.2, 40, 1))
    base[200:300] = base[:1] + rng.integers(-2, 3, (100, 12))
    base[300:360] = base[7]
    base[360:380, 3:] = 0
    rows = [(k, [int(x) for x in v]) for k, v in enumerate(base)] + [(20, [int(x) for x in v]) for v in base[30:42]] + [(1000 + k, [1] * 12) for k in range(40)]
    return rows + [(2000 + k, [k, -k, 3]) for k in range(15)]


def test_topk_of_several_cells_and_groups(spark, monkeypatch):
    rows = uneven_vectors(np.random.default_rng(4))
    monkeypatch.setattr(topk, "GROUP_QUERIES", 7)
    monkeypatch.setattr(topk, "LEAST_CELLS", 3)
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    found = topk.search(topk.build_index(vectors, 10), vectors.where("vec_id % 10 = 0"), 10, 4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == best_by_force(rows, [r for r in rows if r[0] % 10 == 0], 4)


@pytest.mark.parametrize("rest", [0.0, 1 / 512, 0.3, 0.9])
def test_topk_bounds_rule_out_no_row(spark, monkeypatch, rest):
    """One cell of three blocks, with first tiers that leave nothing, little and most; queries one at a time and all at once."""
    rows = [r for r in uneven_vectors(np.random.default_rng(6)) if len(r[1]) == 12]
    monkeypatch.setattr(topk, "REST", rest)
    blocks = [topk._opened(r.asDict()) for r in topk.build_index(spark.createDataFrame(rows, "vec_id long, v array<long>"), 3).collect()]
    queried = [r for r in rows if r[0] % 4 == 0]
    want = best_by_force(rows, queried, 2)
    for step in (1, len(queried)):
        got = []
        for at in range(0, len(queried), step):
            part = queried[at : at + step]
            who, ids, score = topk._search_cell(np.array([v for _, v in part]), np.array([q for q, _ in part]), blocks, 2)
            rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
            got += [(part[w][0], *x) for w, *x in zip(who.tolist(), rank.tolist(), ids.tolist(), score.tolist(), strict=True)]
        assert sorted(got) == want


def brute_stats(text):
    words = WORD.findall(text)
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_line_rules(spark, odd, empty):
    rows = line_rules.apply_rules(odd).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((r.doc_id, *brute_stats(r.text or "")) for r in odd.collect())
    assert line_rules.apply_rules(empty).count() == 0
    body = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"own{i} {body}{i}\n{' '.join(['BOILER', 'plate'] + [f'p{j}' for j in range(80)])}", "h") for i in range(6)] + [(9, f"solo {body}", None)]
    kept = {r.doc_id: (r.kept, r.words_left) for r in line_rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, source string"), max_docs=5).collect()}
    assert kept[0] == (False, 61) and kept[9] == (True, 61)


def test_clean_drops_frequent_lines_from_texts(spark, odd, empty):
    body = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"Böiler  plate\nown{i} {body}{i}\n\n foot" + ("" if i else "\nlast"), "h", i) for i in range(6)]
    docs += [(8, f"foot\n{body}", "other", 8), (9, f"own {body}\n" + "\n".join(["foot"] * 70), "h", 9), (10, None, "h", 10)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string, n long")
    cleaned = line_rules.clean(rows, max_docs=5)
    got = {r.doc_id: (r.text, r.n) for r in cleaned.collect()}
    want = {i: (f"own{i} {body}{i}\n" + ("" if i else "\nlast"), i) for i in range(6)} | {8: (f"foot\n{body}", 8)}
    assert got == want and cleaned.columns == rows.columns
    left = {r.doc_id: r.words_left for r in line_rules.apply_rules(rows, max_docs=5).where("kept").collect()}
    assert left == {d: len(WORD.findall(t)) for d, (t, _) in got.items()}
    assert line_rules.clean(odd).columns == odd.columns and line_rules.clean(empty).count() == 0


def test_clean_beside_clashing_columns(spark):
    names = ["_id", "_host", "_key", "_frequent", "_id2", "_HOST2", "_key2", "hash", "docs", "lines"]
    body = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"foot\n{body} {i}", "h", *range(len(names))) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    cleaned = line_rules.clean(docs, max_docs=5)
    assert cleaned.columns == docs.columns
    assert sorted(tuple(r) for r in cleaned.collect()) == [(i, f"{body} {i}", "h", *range(len(names))) for i in range(6)]


def test_sketch_counts_within_its_bound():
    rng = np.random.default_rng(3)
    key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    true = Counter()
    for _ in range(40):
        part = np.concatenate([rng.integers(0, 10**6, 900), np.arange(5)]).astype(np.uint64)
        true.update(part.tolist())
        key, n = jaccard.heavier(np.concatenate([key, part]), np.concatenate([n, np.ones(len(part), np.int64)]), 300)
    got = dict(zip(key.tolist(), n.tolist(), strict=True))
    assert len(got) <= 300 and all(true[k] - sum(true.values()) / 301 <= c <= true[k] for k, c in got.items())


def test_spread_out_frequent_shingles_are_seen(spark):
    common = "these five words are everywhere"
    rows = spark.range(0, 4000, 1, 8).selectExpr("id as doc_id", f"concat(concat_ws(' ', transform(sequence(1, 40), k -> concat('w', id, '_', k))), if(id % 40 = 0, ' {common}', '')) as text")
    key, n = jaccard.frequent_shingles(rows)
    assert jaccard.shingle_sets([common])[0][0] in key and 90 <= n.max() <= 100


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups: dict = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(s), min(groups[find(i)])) for i, (d, s) in enumerate(sets))


def test_near_duplicates(spark, odd, empty):
    got = sorted(tuple(r) for r in jaccard.near_duplicates(odd).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard.near_duplicates(empty).count() == 0
    assert sorted(jaccard.keep_one(odd).columns) == sorted(odd.columns)


@pytest.mark.parametrize("words", range(8))
def test_blocks_of_few_words(words):
    text = " ".join("abcdefgh"[:words])
    for texts in ([text], [text, "", text]):
        key, bounds = jaccard.shingle_sets(texts)
        assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts] and len(key) == bounds[-1]


def test_a_table_of_two_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == [(1, 1, 1, 1), (2, 0, 2, 0), (3, 1, 1, 1)]


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_regular_words_are_not_one_another(spark, length):
    word = regular_word(length)
    if length > 1024:
        assert len(set(jaccard.shingle_sets([f"{word} b c d e", f"{word.translate(SWAP)} b c d e"])[0].tolist())) == 2
        return
    rows = [(1, f"{word} b c d e"), (2, f"{word.translate(SWAP)} b c d e")]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, 0), (2, 1, 2, 0)]
    lines = spark.createDataFrame([(1, f"{word}\n{word.translate(SWAP)}\n{word}", "s")], "doc_id long, text string, source string")
    assert line_rules.apply_rules(lines).first().n_dup_lines == 1


def test_keep_one_beside_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3), (1, "a b c d e f", 1, 2, 3), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long, _text long, _root long")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 4] and jaccard.keep_one(docs).columns == docs.columns


def test_cells_count_links_as_brute_force():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(60, size=int(rng.integers(1, 50)), replace=False).astype(np.uint64)) for _ in range(40)]
    sets += [x[:-1] for x in sets if len(x) > 6]
    for side in (np.zeros(len(sets), np.int64), (np.arange(len(sets)) % 3 == 0).astype(np.int64)):
        got = jaccard.linked(sets, side)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                common = len(set(x.tolist()) & set(y.tolist()))
                alike = i != j and (side[i] != side[j] or not side.any()) and 100 * common >= 80 * (len(x) + len(y) - common)
                assert got[i, j] == alike


@pytest.mark.parametrize("cell_nodes,bucket_members", [(256, 1000), (2, 3), (1, 1)])
def test_families_with_chains_of_edits(spark, monkeypatch, cell_nodes, bucket_members):
    monkeypatch.setattr(jaccard, "CELL_NODES", cell_nodes)
    monkeypatch.setattr(jaccard, "BUCKET_MEMBERS", bucket_members)
    monkeypatch.setattr(jaccard, "FREQUENT_DOCS", 3)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(4):
        words = [vocabulary[k] for k in rng.integers(0, 400, 120)]
        for _ in range(12):
            rows.append((int(rng.integers(0, 10**6)), " ".join(words)))
            words = list(words)
            for at in rng.integers(0, 120, 2):
                words[at] = vocabulary[int(rng.integers(0, 400))]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("bucket_members", [1000, 3])
def test_all_pairs_inside_groups_are_verified(spark, monkeypatch, bucket_members):
    monkeypatch.setattr(jaccard, "BUCKET_MEMBERS", bucket_members)
    monkeypatch.setattr(jaccard, "CELL_NODES", bucket_members)
    rng = np.random.default_rng(6)
    rows = []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(120)]
        for k in range(9):
            own = list(words)  # most edits of the last word leave the prefix as it is
            own[-1 if k % 3 else int(rng.integers(0, 120))] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100 + i, rows[0][1]) for i in range(3)] + [(200, "alone in the world it is"), (201, None)]
    sets = [(d, shingles(t)) for d, t in rows]
    alike = [(a, b, x, y) for a, x in sets for b, y in sets if a < b and x and 100 * len(x & y) >= 80 * len(x | y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for d, x in sets:
        first.setdefault(frozenset(x), d)
    want = {(a, b) for a, b, x, y in alike if x != y and first[frozenset(x)] == a and first[frozenset(y)] == b}
    assert sorted(tuple(r) for r in jaccard.similar_pairs(docs).collect()) == sorted(want) and len(want) > 30
    links = Counter(d for a, b, _, _ in alike for d in (a, b))
    assert {r.doc_id: r.n_links for r in jaccard.link_counts(docs).collect()} == {d: links[d] for d, _ in rows}


def test_a_group_that_nobody_else_touches(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)]
    while len(texts) < 2:  # an edit that leaves the size and the prefix as they are
        words[-1] += "x"
        sets = [np.sort(jaccard.shingle_sets([t])[0]) for t in (texts[0], " ".join(words))]
        length = int(jaccard._prefix_lengths(np.array([len(sets[0])]))[0])
        if (sets[0][:length] == sets[1][:length]).all():
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == [(0, 116, 0, 1), (1, 116, 0, 1)]


def brute_dedup(rows):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        cut = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                cut[p : p + 200] = b"\1" * 200
        spans = sum(cut[k] and not (k and cut[k - 1]) for k in range(len(cut)))
        out.append((d, len(b), sum(cut), int(spans), hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 2])
def test_dedup_of_documents_and_of_a_bucket_of_many_contexts(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BUCKET_CONTEXTS", most)
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{k}" for k in range(90))
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) + passage + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40))) for k in range(12)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup_digest(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == brute_dedup(rows)


def test_remove_repeats_beside_clashing_columns(spark):
    text = " ".join(f"p{k}" for k in range(90))
    docs = spark.createDataFrame([(1, text, 5, "a", 7), (2, text, 6, "b", 8), (3, None, 7, None, 9)], "doc_id long, text string, th long, kept string, several long")
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(1, "", 5, "a", 7), (2, "", 6, "b", 8), (3, None, 7, None, 9)]


def test_dedup(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in suffix_dedup.dedup_digest(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_dedup(rows)
    assert suffix_dedup.dedup_digest(empty).count() == 0
    cut = suffix_dedup.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and cut.where("doc_id = 0 and text is null").count() == 1


@pytest.mark.parametrize("size", [1000, 2 << 20])
def test_dedup_of_long_texts_in_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "_BLOCK_BYTES", size)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, period = word(700), word(300)
    rows = [(1, word(2900) + passage + word(3000)), (2, word(990) + passage + word(2000) + passage[:450] + word(1500)), (3, period * 12), (4, "x" + period * 9 + word(500)), (5, "a" * 5000), (6, word(1500) + "a" * 2300 + word(10)), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffix_dedup.dedup_digest(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == brute_dedup(rows)


def test_dedup_of_one_very_long_period(spark):
    n = 30_000_000
    period = "".join(chr(97 + k % 26) + str(k) for k in range(70))[:300]
    for unit in ("a", period):
        docs = spark.createDataFrame([(1, len(unit))], "doc_id long, n long").selectExpr("doc_id", f"repeat('{unit}', {n // len(unit)}) as text")
        row = suffix_dedup.dedup_digest(docs).first()
        assert (row.n_bytes, row.n_removed, row.n_spans) == (n // len(unit) * len(unit), n // len(unit) * len(unit), 1)


def held_out(spark, scored, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return float(np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]))


def test_quality_on_held_out_rows(spark):
    assert held_out(spark, queries.op8_quality_net(spark, "/root/testdata/sf0.1").collect(), "quality") > 0.97


def test_toxicity_on_held_out_rows(spark):
    assert held_out(spark, queries.op5_toxicity(spark, "/root/testdata/sf0.1").collect(), "toxic") > 0.9


def test_disguised_insults_score_above_clean_words():
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("aeiounrtsl"), 6)) for _ in range(80)]
    texts = [" ".join(rng.choice(clean, 20)) for _ in range(120)]
    toxic = np.arange(120) < 40
    texts = [t + " grobian." if bad else t + " friend." for t, bad in zip(texts, toxic, strict=True)]
    model = toxicity.train(texts, toxic)
    low = model.scores([" ".join(clean[:20]), "", "friend"]).max()
    for word in ("grobian", "g.r.o.b.i.a.n", "g r o b i a n", "grobbian", "GROBIAN!"):
        assert model.scores([" ".join(clean[:20]) + " " + word])[0] > max(0.5, low), word


@pytest.mark.parametrize("text", ["i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i d i o t"])
def test_letters_set_apart_make_one_word(text):
    symbols, starts, ends, owner = toxicity.words([text, "a", text, ""])
    found = [(symbols[a:b].tobytes(), int(k)) for a, b, k in zip(starts, ends, owner, strict=True)]
    assert found == [(bytes([9, 4, 9, 15, 20]), 0), (bytes([1]), 1), (bytes([9, 4, 9, 15, 20]), 2)]


def naive_subsequences(word):
    out = Counter()
    for at in combinations(range(len(word)), 4):
        if at[3] - at[0] < toxicity.SPAN:
            out[tuple(word[i] for i in at)] += toxicity.DECAY ** (at[3] - at[0] + 1)
    return out


def test_subsequence_kernel_equals_brute_force():
    rng = np.random.default_rng(5)
    found = [bytes(rng.integers(1, 5, int(n)).astype(np.uint8)) for n in rng.integers(3, 12, 30)]
    naive = [naive_subsequences(bytes([toxicity._START]) + w) for w in found]
    for w, own in zip(found, naive, strict=True):
        codes, weights = toxicity.occurrences(np.frombuffer(bytes([toxicity._START]) + w, np.uint8)[None, :])
        want = sum(v * v for v in own.values()) or 1
        assert toxicity.self_kernel(codes, weights)[0] == pytest.approx(want, rel=1e-4)
    space = toxicity._Landmarks(found)
    x = space.features(found)
    norm = [sum(v * v for v in n.values()) ** 0.5 for n in naive]
    for i in range(len(found)):
        for j in range(len(found)):
            dot = sum(v * naive[j][c] for c, v in naive[i].items()) / (norm[i] * norm[j])
            assert x[i] @ x[j] == pytest.approx(dot, abs=2e-2)


def random_net(rng):
    q = quality_net
    return q.QualityNet(rng.normal(0, 0.3, (q.WIDTH, 256, q.FILTERS)).astype(np.float32), rng.normal(0, 0.1, q.FILTERS).astype(np.float32), rng.normal(0, 0.4, (q.FILTERS + 2, q.HIDDEN)), rng.normal(0, 0.4, q.HIDDEN + 1))


def test_convolution_equals_brute_force():
    rng = np.random.default_rng(2)
    net, q = random_net(rng), quality_net
    raw = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (1, 5, 200, 256, 511, 512, 700, 1300)] + [b""]
    got = net.scores(raw)
    joined = b"".join(t or b"\n" for t in raw) + bytes(q.WIDTH)
    at = 0
    for k, text in enumerate(raw):
        text = text or b"\n"
        response = np.array([[sum(net.taps[j, joined[at + p + j], f] for j in range(q.WIDTH)) + net.bias[f] for f in range(q.FILTERS)] for p in range(len(text))])
        n = max(1, len(text) // q.SEGMENT)
        edges = [i * q.SEGMENT for i in range(n)] + [len(text)]
        spans = [(edges[i], edges[i + 2]) for i in range(n - 1)] or [(0, len(text))]
        evidence = []
        for a, b in spans:
            x = np.r_[np.maximum(response[a:b].max(0), 0), np.log2(b - a + 1.0) / 8, 1]
            evidence.append(np.tanh(x @ net.hidden) @ net.out[:-1] + net.out[-1])
        assert got[k] == pytest.approx(1 / (1 + np.exp(max(evidence))), abs=1e-4)
        at += len(text)


def test_gradients_equal_differences():
    rng = np.random.default_rng(9)
    net = random_net(rng)
    raw = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (40, 300, 800)]
    good, weight = np.array([True, False, False]), np.array([1.0, 0.5, 2.0])

    def loss():
        z = -np.log(1 / net.scores(raw) - 1) * -1
        return float((weight / len(raw) * (np.logaddexp(0, z) - ~good * z)).sum() + 0.5e-4 * (net.hidden**2).sum())

    grads = quality_net._gradients(net, raw, good, weight)
    for param, grad in zip([net.hidden, net.out, net.bias], [grads[2], grads[3], grads[1]], strict=True):
        for k in rng.integers(0, param.size, 12).tolist():
            step, kept = 1e-3, param.flat[k]
            param.flat[k] = kept + step
            up = loss()
            param.flat[k] = kept - step
            down = loss()
            param.flat[k] = kept
            assert grad.flat[k] == pytest.approx((up - down) / (2 * step), abs=2e-3)


@pytest.mark.parametrize("module", [quality_net, toxicity])
def test_classifiers_take_odd_and_empty_tables(spark, odd, empty, module):
    labels = spark.createDataFrame([(6, 1, 0), (12, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(odd, labels, modulus=1, held_out=7)
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.score(empty, model).count() == 0
    bare = module.fit(empty, labels)
    assert {r.predicted for r in module.score(odd, bare).collect()} == {1 if module is quality_net else 0}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_each_stage_does_what_its_operator_does_to_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    source = docs
    for name, module, keep in (("quality classifier", quality_net, 1), ("toxicity", toxicity, 0)):
        want = {r.doc_id for r in module.score(docs, module.fit(source, labels)).collect() if r.predicted == keep}
        docs = stages[name](spark, docs, SMALL)
        assert {r.doc_id for r in docs.collect()} == want and want
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = stages["n-gram Jaccard join"](spark, docs, SMALL)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {d for d, _, root in brute_components(rows) if d == root} and kept.items() <= dict(rows).items()
    digest = {d: sha for d, _, _, _, sha in brute_dedup(sorted(kept.items()))}
    docs = stages["suffix-array dedup"](spark, docs, SMALL)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == set(kept)
    same = sum(hashlib.sha256(left[d].encode()).hexdigest() == digest[d] for d in left)
    assert same >= 0.95 * len(left)  # a character that is cut in part goes whole
    pieces = stages["packing"](spark, docs, SMALL).collect()
    tokens = {r.doc_id: 0 for r in pieces}
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in pieces) and set(tokens) == set(left)
