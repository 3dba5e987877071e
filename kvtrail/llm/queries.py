"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtrail.llm import collocations, jaccard, line_rules, manifest, packing, pieces, quality_net, records, suffix_dedup, token_counts, topk, toxicity, word_index
from kvtrail.llm.storage import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come in; toxic ones are deleted; those of low
    quality are revised to their distinct lines; and the deletes come in a second time.

    Revised texts are counted where they are read; only their counts meet the labels.
    """
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    low = labels.where("quality = 0 and toxic = 0").select("doc_id").distinct()
    store = token_counts.TokenLedger(spark, shared_folder(spark, "token-counts"))
    store.apply(1, inserts=token_counts.count_tokens(docs))
    store.apply(2, deletes=toxic)
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    store.apply(3, revisions=token_counts.count_tokens(docs.withColumn("text", lines)).join(low, "doc_id", "left_semi"))
    store.apply(2, deletes=toxic)
    return store.totals()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), 1024)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    vectors = topk.integer_vectors(table)
    blocks = topk.block_count(vectors)
    return topk.search(topk.build_index(vectors, blocks), topk.integer_vectors(table.where("vec_id % 100 = 0")), blocks, 10)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _with_held_out(toxicity.score(docs, model), 3, 1)


def _with_held_out(scored: DataFrame, modulus: int, held_out: int) -> DataFrame:
    flag = F.coalesce(quality_net.remainder(modulus) == held_out, F.lit(False))
    return scored.select("doc_id", flag.alias("held_out"), "score", "predicted")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-records")
    records.write_shards(_table(spark, sf_dir, "documents"), f"{folder}/shards")
    index = records.write_index(spark, f"{folder}/shards", f"{folder}/index")
    return records.with_global_start(index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "byte_offset")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(_table(spark, sf_dir, "documents"))


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = quality_net.fit(docs, _table(spark, sf_dir, "labels"))
    return _with_held_out(quality_net.score(docs, net), 5, 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = word_index.build_index(_table(spark, sf_dir, "documents"))
    return word_index.contamination(index, _table(spark, sf_dir, "benchmark")).drop("items")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.leaves(_table(spark, sf_dir, "documents"), tampered=manifest.every_third())
    return manifest.verify(manifest.build(rows))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_packing": op3_packing,
    "op4_exact_topk": op4_exact_topk,
    "op5_toxicity": op5_toxicity,
    "op6_token_records": op6_token_records,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_net": op8_quality_net,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op4_exact_topk": topk.ORACLE_SQL,
    "op9_quality_rules": line_rules.ORACLE_SQL,
    "op10_jaccard_join": jaccard.ORACLE_SQL,
    "op11_decontamination": word_index.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_merkle_manifest": manifest.ORACLE_SQL,
}
