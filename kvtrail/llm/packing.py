"""Order-preserving packing of token streams into padded windows.

A dynamic programme walks over the allowed cuts of the stream (ends of
documents, ends of sentences, and, where a sentence is very long, places inside
it) and picks those with the least padding plus penalties for cutting a
document. A window costs nothing when it is full or its length is a power of
two, else the places up to the full length; the best predecessor among all cuts
within one window is the head of a monotone queue.

Documents are packed in the order of their rows, split by split, so nothing is
shuffled; the first window of a split starts with its first document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtrail.llm.text import blocks, texts_of
from kvtrail.llm.tokenizing import byte_bpe

#: Costs of a cut, in padded places.
SENTENCE_PENALTY, INNER_PENALTY = 2.0, 12.0
#: Between cuts further apart than this, inner places are allowed as well, this far apart.
INNER_STEP = 128
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_cuts(cuts: np.ndarray, penalty: np.ndarray, capacity: int) -> list[int]:
    """Of the ascending positions `cuts`, the first and last included, those that bound windows at least cost."""
    n = len(cuts)
    at, pen = cuts.tolist(), penalty.tolist()
    powers = []
    p = 1
    while p < capacity:
        found = np.minimum(np.searchsorted(cuts, cuts - p), n - 1)
        powers.append(np.where(cuts[found] == cuts - p, found, -1))
        p *= 2
    exact = [[i for i in row if i >= 0] for row in np.stack(powers, 1).tolist()] if powers else [[] for _ in at]
    best, origin = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - capacity:
            queue.popleft()
        key, i = queue[0]
        cost = key + capacity - here
        for k in exact[j]:
            if best[k] < cost:
                cost, i = best[k], k
        cost += pen[j]
        best[j], origin[j] = cost, i
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    path = [n - 1]
    while path[-1]:
        path.append(origin[path[-1]])
    return path[::-1]


class _Ends:
    """Which ids may end a sentence, and which may follow one."""

    def __init__(self) -> None:
        pieces = byte_bpe().pieces
        n = max(pieces) + 2
        self.stops, self.opens, self.feeds = np.zeros((3, n), bool)
        for i, b in pieces.items():
            self.stops[i] = b.rstrip(b"\"')")[-1:] in (b".", b"!", b"?")
            self.opens[i] = b[:1] in (b" ", b"\n")
            self.feeds[i] = b.endswith(b"\n")


def _allowed(ids: np.ndarray, doc_ends: np.ndarray, ends: _Ends, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the stream may be cut, with penalties; 0 and the end are among them."""
    n = len(ids)
    mark = np.full(n + 1, np.inf)
    clipped = np.minimum(ids, len(ends.stops) - 1)
    sentence = ends.feeds[clipped]
    sentence[:-1] |= ends.stops[clipped[:-1]] & ends.opens[clipped[1:]]
    mark[1:][sentence] = SENTENCE_PENALTY
    mark[0] = mark[n] = 0
    mark[doc_ends] = 0
    cuts = np.flatnonzero(np.isfinite(mark))
    gap = np.diff(cuts)
    wide = np.flatnonzero(gap > step)
    if len(wide):
        count = (gap[wide] - 1) // step
        more = np.repeat(cuts[wide], count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        mark[more] = INNER_PENALTY
        cuts = np.flatnonzero(np.isfinite(mark))
    return cuts, mark[cuts]


class Packer:
    """Packs a stream of documents; pieces come out as columns. One instance serves one task."""

    def __init__(self, split: int, capacity: int) -> None:
        self.capacity, self.ends = capacity, _Ends()
        self.next_sequence = split << 32
        self.ids = np.empty(0, np.uint32)
        self.docs: list[tuple[object, int, int]] = []  # (doc_id, its ids before the stream's first, ids in the stream)
        self.sizes: list[int] = []  # all ids of each of these documents

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [(d, 0, n) for d, n in zip(doc_ids, counts.tolist(), strict=True)]
        self.sizes += counts.tolist()

    def take(self, last: bool) -> dict[str, list]:
        """Pieces of the windows that are settled; unless it is the last call, the tail stays for the next one."""
        lengths = np.array([n for *_, n in self.docs], np.int64)
        doc_ends = np.cumsum(lengths)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        if not len(self.ids):
            return out
        cuts, penalty = _allowed(self.ids, doc_ends, self.ends, min(INNER_STEP, self.capacity))
        path = plan_cuts(cuts, penalty, self.capacity)
        bounds = cuts[path] if last else cuts[path][:-4]
        if len(bounds) < 2:
            return out
        edges = np.union1d(bounds, doc_ends[doc_ends < bounds[-1]])
        doc = np.searchsorted(doc_ends, edges[:-1], side="right")
        window = np.searchsorted(bounds, edges[:-1], side="right") - 1
        doc_begin = doc_ends - lengths
        raw = memoryview(np.ascontiguousarray(self.ids).view(np.uint8))
        e = edges.tolist()
        before = np.array([b for _, b, _ in self.docs], np.int64)
        out["doc_id"] = [self.docs[k][0] for k in doc.tolist()]
        out["start"] = (edges[:-1] - doc_begin[doc] + before[doc]).tolist()
        out["length"] = np.diff(edges).tolist()
        out["ids_crc32"] = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(e[:-1], e[1:], strict=True)]
        out["doc_tokens"] = [self.sizes[k] for k in doc.tolist()]
        out["sequence_id"] = (self.next_sequence + window).tolist()
        out["offset"] = (edges[:-1] - bounds[window]).tolist()
        self.next_sequence += len(bounds) - 1
        done = int(bounds[-1])
        self.ids = self.ids[done:].copy()
        first = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[first:]
        if rest:
            gone = done - int(doc_begin[first])
            rest[0] = (rest[0][0], rest[0][1] + gone, rest[0][2] - gone)
        self.docs, self.sizes = rest, self.sizes[first:]
        return out


def _with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document, with the sequence and the place it lies in.

    A null or empty text is one document of the end id alone. Documents with the
    same doc_id stay separate documents. A document longer than a sequence is cut.
    Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    names = SCHEMA.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe()
        packer = Packer(TaskContext.get().partitionId(), capacity)
        for block in blocks(batches, "text"):
            ids, bounds = encoder.encode(texts_of(block))
            packer.add(block.column(0).to_pylist(), *_with_end(ids, bounds, end_id))
            yield _batch(packer.take(False))
        yield _batch(packer.take(True))

    def _batch(columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], pa.int64()) for k in names], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
