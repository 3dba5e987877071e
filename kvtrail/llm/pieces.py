"""SentencePiece encoding and decoding of whole texts.

No piece of the model crosses a white-space marker, so texts are cut into
marked words. Each block of a task has a table of its distinct marked words;
every one is segmented once while the task's table holds it, and ids return to
the texts by position. One table for the whole corpus would need a shuffle of
every (block, word) pair; the README gives the figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtrail.llm.text import blocks, texts_of
from kvtrail.llm.tokenizing import piece_bpe

END_ID = 2


def encode(docs: DataFrame, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, ids array<int>. A null text counts as empty; an empty text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe()
        for block in blocks(batches, "text"):
            ids, bounds = model.encode(texts_of(block))
            if end_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column(0), lists], ["doc_id", "ids"])

    return _two(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame) -> DataFrame:
    """doc_id, text: the library's decode of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe().model
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per row: how many ids, the digest of the ids and that of the text decoded from them.

    Rows with the same doc_id stay separate rows. Encoding and decoding run in one
    pass, so that ids of whole texts don't travel between Python and the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe()
        digits = [str(i) for i in range(model.model.vocab_size())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for block in blocks(batches, "text"):
            ids, bounds = model.encode(texts_of(block))
            of_ids, of_text, b = [], [], bounds.tolist()
            for k in range(block.num_rows):
                own = ids[b[k] : b[k + 1]].tolist() + [end_id]
                of_ids.append(hashlib.sha256(" ".join([digits[i] for i in own]).encode()).hexdigest())
                of_text.append(hashlib.sha256(model.model.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(bounds) + 1), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names)

    return _two(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
