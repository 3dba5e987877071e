"""Tokenizing, packing, records and token counts against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kvtrail.llm import packing, pieces, queries, records, token_counts, tokenizing
from kvtrail.llm.tokenizing import byte_bpe, piece_bpe
from tests.conftest import SMALL

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_ids(text):
    return BYTES.encode(text or "", add_special_tokens=False).ids


PARTS = ["'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "a", "bc", "Ä", "é", "1", "٣", "½", "!", "_", "日本", "　", "▁", "x's", "<|endoftext|>", "\0", "\r\n", "😀", "\x85", "\x1c", "<s>", "</s>"]


def test_chunk_tables_equal_the_libraries():
    rng = random.Random(3)
    for _ in range(800):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(4)]
        for encoder, want in ((byte_bpe(), byte_ids), (piece_bpe(), PIECES.encode)):
            ids, bounds = encoder.encode(texts)
            assert [ids[a:b].tolist() for a, b in pairwise(bounds)] == [want(t) for t in texts]


def test_pieces(odd, empty):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(odd).collect())
    want = []
    for r in odd.collect():
        ids = PIECES.encode(r.text or "") + [2]
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(PIECES.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    texts = {r.doc_id: r.text for r in pieces.decode(pieces.encode(odd)).collect()}
    assert texts[4] == "word" and texts[0] == ""
    assert pieces.digests(empty).count() == 0


def check_packing(docs, rows, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for d in docs:
        ids = byte_ids(d.text) + [0]
        texts.setdefault((d.doc_id, len(ids)), []).append(ids)
    assert set(texts) == set(by_doc)
    for key, pieces_of in by_doc.items():
        ids, spread = texts[key][0], sorted((r.start, r.length, r.ids_crc32) for r in pieces_of)
        assert sum(n for _, n, _ in spread) == len(ids) * len(texts[key])
        for start, n, crc in spread:
            assert zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc
    lengths = []
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        lengths.append(at)
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths) / sum(lengths)


def test_packing(spark, odd, empty):
    check_packing(odd.collect(), packing.pack(odd).collect(), 1024)
    check_packing(odd.collect(), packing.pack(odd, 64).collect(), 64)
    assert packing.pack(empty).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert check_packing(docs.collect(), packing.pack(docs).collect(), 1024) < 0.03


def brute_cost(cuts, penalty, capacity):
    best = [0.0] + [float("inf")] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        for i in range(j):
            n = cuts[j] - cuts[i]
            if n <= capacity:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else capacity - n) + penalty[j])
    return best[-1]


def test_regular_chunks_keep_their_own_ids():
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 1024:
            texts = [word, word.translate(str.maketrans("ab", "ba"))]
            ids, bounds = tokenizing.ByteBpe().encode(texts)
            assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in (0, 1)] == [byte_ids(t) for t in texts]
            ids, bounds = tokenizing.PieceBpe().encode(texts)
            assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in (0, 1)] == [PIECES.encode(t) for t in texts]


def test_chunks_of_equal_first_hashes_are_told_apart(monkeypatch):
    real, calls = tokenizing.span_names, []

    def weak(symbols, starts, ends, count=2, salt=0):
        calls.append(salt)
        names = real(symbols, starts, ends, count, salt)
        return [names[0] if salt else names[0] & np.uint64(3), names[1]]

    monkeypatch.setattr(tokenizing, "span_names", weak)
    texts = ["many words that share a weak hash", "other words again"]
    ids, bounds = tokenizing.ByteBpe().encode(texts)
    assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in (0, 1)] == [byte_ids(t) for t in texts] and calls == [0, 1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_cost_least(seed):
    rng = np.random.default_rng(seed)
    cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 60))])
    penalty = rng.choice([0.0, 2.0, 12.0], len(cuts))
    path = packing.plan_cuts(cuts, penalty, 32)
    assert path[0] == 0 and path[-1] == len(cuts) - 1
    cost = 0.0
    for a, b in pairwise(path):
        n = cuts[b] - cuts[a]
        assert n <= 32
        cost += (0 if n & (n - 1) == 0 else 32 - n) + penalty[b]
    assert cost == pytest.approx(brute_cost(cuts.tolist(), penalty.tolist(), 32))


def test_records_round_trip(spark, odd, empty, tmp_path):
    records.write_shards(odd, f"file://{tmp_path}/a", shard_bytes=100_000)
    index = records.with_global_start(records.write_index(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/i"))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in index.collect())
    docs, before, want = sorted(odd.collect(), key=lambda r: r.doc_id), 0, []
    for r in docs:
        ids = np.array(byte_ids(r.text) + [2], "<u4")
        want.append((r.doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert got == want and index.select("shard").distinct().count() > 1
    shuffled = records.read_shuffled(spark, f"file://{tmp_path}/a", index).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in shuffled) == [(d, n) for d, _, n, _ in want]
    records.write_shards(empty, f"file://{tmp_path}/e")
    assert records.read_records(spark, f"file://{tmp_path}/e").count() == 0


def test_many_rows_of_one_doc_id_lie_in_several_shards(spark, tmp_path):
    texts = [(7, f"text number {k} of one document") for k in range(60)] + [(k, "other") for k in (1, 2, 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    records.write_shards(docs, f"file://{tmp_path}/a", shard_bytes=200)
    index = records.with_global_start(records.read_records(spark, f"file://{tmp_path}/a"))
    rows = sorted(index.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 2] + [7] * 60 + [9] and len({r.shard for r in rows if r.doc_id == 7}) > 3
    assert all(b.start == a.start + a.n_tokens for a, b in pairwise(rows))


def test_damaged_records_are_found():
    raw = records.frame(7, np.array([1, 2, 3], np.uint32), 2) + b"\n"
    assert [(d, i.tolist()) for _, _, d, i in records.frames(raw)] == [(7, [1, 2, 3])]
    for k in range(len(raw)):
        bad = bytearray(raw)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(raw[:-3]))


def test_ledger(spark, odd, empty, tmp_path):
    store = token_counts.TokenLedger(spark, f"file://{tmp_path}/l")
    assert store.totals().count() == 0
    assert store.apply(1, inserts=token_counts.count_tokens(odd))
    assert not store.apply(1, inserts=token_counts.count_tokens(odd))
    total = store.totals().groupBy("tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    texts = [r.text or "" for r in odd.collect()]
    want = {"byte_bpe_50k": (len(texts), sum(len(byte_ids(t)) for t in texts)), "piece_bpe_32k": (len(texts), sum(len(PIECES.encode(t)) for t in texts))}
    assert {r.tokenizer: (r.docs, r.tokens) for r in total.collect()} == want
    new = spark.createDataFrame([(4, "two words", "en", "s")], "doc_id long, text string, lang string, source string")
    store.apply(2, revisions=token_counts.count_tokens(new))
    store.apply(3, deletes=odd.where("doc_id != 4").select("doc_id"))
    store.apply(4, inserts=token_counts.count_tokens(empty))
    left = {(r.source, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}
    assert left == {("s", "byte_bpe_50k"): (1, len(byte_ids("two words"))), ("s", "piece_bpe_32k"): (1, len(PIECES.encode("two words")))}


def test_a_batch_that_failed_between_ledger_and_totals_counts_once(spark, odd, tmp_path):
    store = token_counts.TokenLedger(spark, f"file://{tmp_path}/l")
    store.apply(1, inserts=token_counts.count_tokens(odd))
    before = sorted(map(tuple, store.totals().collect()), key=str)
    new = token_counts.count_tokens(spark.createDataFrame([(900, "two words", "en", "s")], "doc_id long, text string, lang string, source string"))
    new.write.parquet(f"file://{tmp_path}/l/ledger/batch=000000002")  # the ledger's part was written, the totals were not
    assert sorted(map(tuple, store.totals().collect()), key=str) == before and not store.committed(2)
    assert store.apply(2, inserts=new) and not store.apply(2, inserts=new)
    assert store.totals().agg(F.sum("docs")).first()[0] == sum(r[3] for r in before) + 2


def test_token_count_query(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet").collect(), spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    low = {r.doc_id for r in labels if r.quality == 0 and r.toxic == 0}
    want: dict = {}
    for d in docs:
        if d.doc_id not in toxic:
            text = "\n".join(dict.fromkeys(d.text.split("\n"))) if d.doc_id in low else d.text
            for name, n in (("byte_bpe_50k", len(byte_ids(text))), ("piece_bpe_32k", len(PIECES.encode(text)))):
                a, b = want.get((d.source, d.lang, name), (0, 0))
                want[d.source, d.lang, name] = (a + 1, b + n)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.op1_token_counts(spark, SMALL).collect()}
    assert got == want
