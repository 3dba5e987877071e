"""Token counts by source, language and tokenizer version, kept up by deltas.

A store has one folder a batch. `ledger/batch=<id>` holds the batch's signed
rows: an insert adds a document and its tokens, a delete takes back what the
ledger holds for that document, a revision does both. `totals/batch=<id>` holds
the signed sums of the batch per source, language and tokenizer version; totals
are sums of these, so no batch is ever recounted. Spark's commit marker of the
totals, which are written last, commits a batch: a batch that has it is not
applied again, one without it is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtrail.llm.storage import discard, exists, written
from kvtrail.llm.text import blocks, texts_of
from kvtrail.llm.tokenizing import byte_bpe, piece_bpe

TOKENIZERS = {"byte_bpe_50k": byte_bpe, "piece_bpe_32k": piece_bpe}
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
KEYS = ["source", "lang", "tokenizer"]


def count_tokens(docs: DataFrame, tokenizers: tuple[str, ...] = tuple(TOKENIZERS)) -> DataFrame:
    """doc_id, source, lang, tokenizer, docs (1) and tokens of every row and tokenizer; null texts have 0 tokens."""
    names = [x.split()[0] for x in LEDGER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [(t, TOKENIZERS[t]()) for t in tokenizers]
        for block in blocks(batches, "text"):
            texts = texts_of(block)
            ones = pa.array(np.ones(len(texts), np.int64))
            for name, encoder in encoders:
                counts = np.diff(encoder.encode(texts)[1])
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), block.column(2), pa.array([name] * len(texts), pa.string()), ones, pa.array(counts)], names)

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))]
    return docs.select(*cols).mapInArrow(run, LEDGER)


class TokenLedger:
    """A store of token counts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def committed(self, batch: int) -> bool:
        return exists(self.spark, f"{self.path}/totals/batch={batch:09d}/_SUCCESS")

    def ledger(self) -> DataFrame:
        """The signed rows of all batches (an empty table before the first)."""
        return self._read("ledger", LEDGER)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; groups that have no document left are not listed."""
        sums = self._read("totals", LEDGER.partition(", ")[2]).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 or tokens != 0")

    def apply(self, batch: int, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Commit a batch; False if it was committed before.

        inserts and revisions: rows of count_tokens(); deletes: rows with a doc_id.
        A deleted or revised document loses all that the ledger holds for it (a
        revision: for the tokenizers that it brings); one that the ledger doesn't
        know only gains. Rows given twice count twice; null doc_ids can be inserted
        but not named in a delete.
        """
        if self.committed(batch):
            return False
        if revisions is not None:
            revisions = written(revisions, "revisions")  # read twice below
        parts = [x for x in (inserts, revisions) if x is not None]
        back = []
        if deletes is not None:
            back.append(deletes.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("for_tokenizer")))
        if revisions is not None:
            back.append(revisions.select("doc_id", F.col("tokenizer").alias("for_tokenizer")))
        if back:
            gone = back[0] if len(back) == 1 else back[0].union(back[1])
            held = self.ledger().alias("l")
            match = F.expr("l.doc_id = g.doc_id and (g.for_tokenizer is null or g.for_tokenizer = l.tokenizer)")
            hit = held.join(gone.alias("g"), match, "left_semi")
            state = hit.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")
            parts.append(state.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        rows = parts[0] if parts else self.spark.createDataFrame([], LEDGER)
        for p in parts[1:]:
            rows = rows.unionByName(p)
        own = f"{self.path}/ledger/batch={batch:09d}"
        rows.write.mode("overwrite").parquet(own)
        new = self.spark.read.schema(LEDGER).parquet(own)
        new.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch:09d}")
        if revisions is not None:
            discard(revisions)
        return True

    def _read(self, part: str, schema: str) -> DataFrame:
        """Rows of the committed batches only."""
        path = f"{self.path}/{part}"
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals/batch=*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        names = sorted(s.getPath().getParent().getName() for s in found)
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{n}" for n in names)).select(*(x.split()[0] for x in schema.split(", ")))
