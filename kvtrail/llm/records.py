"""Token ids in files of length-delimited binary records.

A record is framed as: payload length (unsigned 64-bit), masked checksum of
those eight bytes, payload, masked checksum of the payload, one line feed. All
numbers are little-endian. The payload is the document's id (signed 64-bit), the
width of an id in bytes (one byte) and the ids. The checksum is CRC-32, turned
right by 15 bits and raised by a constant, so that a checksum of data that holds
checksums stays telling. Spark's text writer lays the frames into part files,
whose commit protocol also holds when a task runs twice; file `part-<k>` is
shard k, and shards and records ascend by doc_id. An offset index in Parquet
lists every record for shuffled reads.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvtrail.llm.text import blocks, texts_of
from kvtrail.llm.tokenizing import byte_bpe

END_ID = 2
#: Bytes of text whose ids one shard gets, about; bytes of an id, as the vocabulary has less than 2^16 of them.
SHARD_BYTES, WIDTH = 6 << 20, 2
#: Bytes of text that a task encodes at once.
_BLOCK_BYTES = 1 << 20
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    """A record without its line feed, which the text writer sets."""
    payload = struct.pack("<qB", doc_id, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def frames(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(offset, bytes, doc_id, ids) of each record; raises if a checksum fails or bytes are missing."""
    at, view = 0, memoryview(content)
    while at < len(view):
        offset, doc_id, ids = at, *read_frame(view, at)
        at += _HEAD.size + _HEAD.unpack_from(view, at)[0] + 5
        yield offset, at - offset, doc_id, ids


def read_frame(view, at: int) -> tuple[int, np.ndarray]:
    """The record at a byte offset, as the offset index gives it."""
    if len(view) < at + _HEAD.size:
        raise ValueError(f"record at {at}: cut short")
    length, check = _HEAD.unpack_from(view, at)
    if masked_crc(view[at : at + 8]) != check:
        raise ValueError(f"record at {at}: length fails its checksum")
    begin = at + _HEAD.size
    payload = view[begin : begin + length]
    if len(view) < begin + length + 5 or view[begin + length + 4] != 10:
        raise ValueError(f"record at {at}: cut short")
    if masked_crc(payload) != struct.unpack_from("<I", view, begin + length)[0]:
        raise ValueError(f"record at {at}: payload fails its checksum")
    doc_id, width = struct.unpack_from("<qB", payload)
    return doc_id, np.frombuffer(payload[9:], f"<u{width}")


@dataclass
class Cuts:
    """Where shards end, in the order of doc_id and, for a doc_id of very many rows, of a hash of the text (as a share)."""

    ids: np.ndarray
    shares: np.ndarray

    def shards(self, doc_id: np.ndarray, turn: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, doc_id, "left"), np.searchsorted(self.ids, doc_id, "right")
        share = turn / 2.0**64 + 0.5
        for k in np.flatnonzero(high > low).tolist():
            low[k] += int((self.shares[low[k] : high[k]] <= share[k]).sum())
        return low


def cuts_of(quantiles: list[int]) -> Cuts:
    """A shard ends after each quantile; a doc_id that is several quantiles has shards of its own, split by the hash."""
    out = []
    for v, times in sorted(Counter(quantiles).items()):
        out += [(v, 1.0)] if times == 1 else [(v - 1, 1.0), *((v, k / times) for k in range(1, times + 1))]
    return Cuts(np.array([v for v, _ in out], np.int64), np.array([x for _, x in out]))


def plan_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Cuts:
    """Cuts at quantiles of the doc_ids, so many that a shard gets the ids of about shard_bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // shard_bytes)
    if n < 2:
        return cuts_of([])
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n)))
    return cuts_of(found.first()[0] or [])


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text and write its record; a null text counts as empty, a null doc_id is not kept.

    Texts are encoded where they are read; only ids travel. Records ascend by doc_id,
    those of one doc_id by a hash of their texts and by the ids, over all shards; so
    many rows of one doc_id may lie in several shards.
    """
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    cuts = plan_shards(two, shard_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe()
        for block in blocks(batches, "text", _BLOCK_BYTES):
            ids, bounds = encoder.encode(texts_of(block))
            ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            raw, b = ids.astype(f"<u{WIDTH}").tobytes(), (WIDTH * bounds).tolist()
            shard = cuts.shards(block.column(0).to_numpy(), block.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), block.column(0), block.column(2), pa.array([raw[x:y] for x, y in zip(b[:-1], b[1:], strict=True)], pa.binary())], ["shard", "doc_id", "turn", "ids"])

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [frame(d, np.frombuffer(ids, f"<u{WIDTH}"), WIDTH) for d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    encoded = two.withColumn("turn", F.coalesce(F.xxhash64("text"), F.lit(0))).mapInArrow(encode, "shard int, doc_id long, turn long, ids binary")
    dealt = encoded.repartitionById(len(cuts.ids) + 1, "shard").sortWithinPartitions("doc_id", "turn", "ids")
    records = dealt.select("doc_id", "ids").mapInArrow(framed, "frame binary")
    records.select(F.col("frame").cast("string").alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """shard, record, byte_offset, n_bytes, doc_id, n_tokens, start_in_shard, ids_crc32 of every record, as read back."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("shard"), "content")
    names = ["shard", "record", "byte_offset", "n_bytes", "doc_id", "n_tokens", "start_in_shard", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, before = [], 0
                for k, (offset, size, doc_id, ids) in enumerate(frames(content.as_buffer())):
                    rows.append((shard, k, offset, size, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "shard" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True) if rows else [[]] * 8, strict=True)], names)

    return files.mapInArrow(run, "shard int, record long, byte_offset long, n_bytes long, doc_id long, n_tokens long, start_in_shard long, ids_crc32 long")


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read all shards back, check every record, and write the offset index; returns the index."""
    read_records(spark, path).write.parquet(index_path)
    return spark.read.parquet(index_path)


def with_global_start(index: DataFrame) -> DataFrame:
    """Adds `start`: the ids of all records before this one, over all shards."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))  # one row a shard
    before = shards.select("shard", (F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")).alias("before"))
    return index.join(before, "shard").withColumn("start", F.col("before") + F.col("start_in_shard"))


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id and ids of all records in an order drawn by seed, each read at its offset in the index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("shard"), "content")
    wanted = index.groupBy("shard").agg(F.collect_list("byte_offset").alias("offsets"))  # bounded by the shard's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                rows = [read_frame(view, at) for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([i.astype(np.int32) for _, i in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    read = files.join(wanted, "shard").select("content", "offsets").mapInArrow(run, "doc_id long, ids array<int>")
    return read.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
