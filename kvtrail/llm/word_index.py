"""Benchmark decontamination by a positional inverted index of the training documents.

The index is a table of segments. A segment covers the documents of one block of a
task: a sorted dictionary of its terms (64-bit names of words), and for every term the
list of its places, all places ascending. Between two documents one place is free, so
no phrase runs from one into the next. Segments are written once; searches read them
instead of the texts, and each segment is searched by itself.

A phrase starts from the list of its term that is rarest in the segment. Each place
in it, less the term's offset in the phrase, is a possible start; the starts are then
intersected with the lists of the other terms, shifted by their offsets, rarest first.
A phrase with a term that the segment lacks costs one look into the dictionary.
Near matches go the same way: places of the rarest term that have every other term
close by are gathered, and the shortest runs of words around them are kept.

Test phrases come in blocks of bounded size, and every block meets all segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtrail.llm.storage import discard, written
from kvtrail.llm.text import blocks, byte_block, csr_take, span_hashes, texts_of

#: Words of a window of an item; an item of fewer words is one window.
WIDTH = 10
#: Words of test items in a block of phrases, about (a task holds one block), and of a part of one long item.
BLOCK_WORDS, PART_WORDS = 1 << 20, 1 << 16
#: Possible starts that are intersected at once.
_STARTS = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of all texts, end to end, A to Z in lower case; and how many words each text has."""
    data, bounds = byte_block(texts)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 32
    return span_hashes(lower, starts, ends), np.diff(np.searchsorted(starts, bounds))


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, all lowest bytes first, so that columns of zeros lie together and compress."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T).tobytes()


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw or b"", np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _segment(texts: list[str]) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """Words of each text; terms, lengths of lists and places of one segment."""
    terms, n_words = terms_of(texts)
    places = np.arange(len(terms)) + np.repeat(np.arange(len(texts)), n_words)
    order = np.argsort(terms, kind="stable")
    terms, places = terms[order], places[order]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    names = np.diff(terms[first], prepend=np.uint64(0))
    return n_words, _packed(names, "<u8"), _packed(np.diff(np.r_[first, len(terms)]), "<u4"), _packed(steps, "<u4")


def build_index(docs: DataFrame) -> DataFrame:
    """The segments: segment, doc_ids, n_words, terms, lengths, places. One pass over the texts, no shuffle.

    A null text has no words, a null doc_id stays a row; rows of one doc_id are rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            n_words, terms, lengths, places = _segment(texts_of(block))
            ids = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(0))
            words = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), pa.array(n_words.astype(np.int64)))
            binary = [pa.array([x], pa.binary()) for x in (terms, lengths, places)]
            yield pa.RecordBatch.from_arrays([ids, words, *binary], ["doc_ids", "n_words", "terms", "lengths", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_ids array<long>, n_words array<long>, terms binary, lengths binary, places binary"
    return written(rows.mapInArrow(run, kinds).withColumn("segment", F.monotonically_increasing_id()), "word-index")


class Segment:
    """One row of the index, in memory."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["segment"], row["doc_ids"]
        self.n_words = np.array(row["n_words"], np.int64)
        self.terms = np.cumsum(_unpacked(row["terms"], "<u8"), dtype=np.uint64)
        self.lengths = _unpacked(row["lengths"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        steps = _unpacked(row["places"], "<u4").astype(np.int64)
        total = np.cumsum(steps)
        filled = self.lengths > 0
        base = (total - steps)[self.starts[filled]]
        self.places = total - np.repeat(base, self.lengths[filled])
        self.end = int(self.n_words.sum()) + len(self.n_words) + 1
        #: (term, place) as one ascending number
        self.keys = self.places + np.repeat(np.arange(len(self.terms)), self.lengths) * self.end
        #: place of each document's first word
        self.first = np.cumsum(self.n_words + 1) - (self.n_words + 1)

    def ranks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each term in the dictionary, and the length of its list (0: it has none)."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        if not len(self.terms):
            return at, np.zeros(len(terms), np.int64)
        return at, np.where(self.terms[at] == terms, self.lengths[at], 0)

    def holds(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the lists hold the places."""
        key = rank * self.end + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0) & (place < self.end)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


class Phrases:
    """A block of test phrases: distinct windows by their number of words, and the items of each."""

    def __init__(self, items: list[str], words: list[np.ndarray], width: int):
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.terms, code = np.unique(flat, return_inverse=True)
        self.items, own = np.unique(np.array(items, object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        by_length: dict[int, list] = {}
        at = 0
        for item, w in zip(own.tolist(), words, strict=True):
            n = min(width, len(w))
            found = np.lib.stride_tricks.sliding_window_view(code[at : at + len(w)], n)
            by_length.setdefault(n, []).append((found, np.full(len(found), item)))
            at += len(w)
        #: for each length: windows, and (sorted by window) the item of each pair and the bounds of each window's items
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, parts in sorted(by_length.items()):
            every, item = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            windows, which = np.unique(every, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), item], 1), axis=0)
            self.windows.append((windows.astype(np.int32), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))))


def _candidates(segment: Segment, windows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows all of whose terms occur, the order of their terms from the rarest, and the places of the rarest, a bounded number at once."""
    of = length[windows]
    alive = np.flatnonzero(of.min(axis=1) > 0)
    if not len(alive):
        return
    order = np.argsort(of[alive], axis=1, kind="stable")
    rarest = windows[alive, order[:, 0]]
    cut = np.cumsum(length[rarest]) // _STARTS
    for k in np.unique(cut):
        part = np.flatnonzero(cut == k)
        place, n = csr_take(segment.places, segment.starts[rank[rarest[part]]], length[rarest[part]], np.arange(len(part)))
        who = np.repeat(part, n)
        yield alive[who], order[who], place, who


def exact(segment: Segment, windows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first place) of every occurrence of every window."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for window, order, place, _ in _candidates(segment, windows, length, rank):
        start = place - order[:, 0]
        for k in range(1, windows.shape[1]):
            ok = segment.holds(rank[windows[window, order[:, k]]], start + order[:, k])
            window, order, start = window[ok], order[ok], start[ok]
        ok = start >= 0
        found.append((window[ok], start[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near(segment: Segment, windows: np.ndarray, length: np.ndarray, rank: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first place, number of words) of the shortest runs, of at most `slop` words more than the
    window, that hold all its different words in any order; no run holds another of the same window."""
    found: set[tuple[int, int, int]] = set()
    reach = windows.shape[1] + slop
    for window, order, place, _ in _candidates(segment, windows, length, rank):
        doc = segment.document(place)
        low, high = np.maximum(place - reach + 1, segment.first[doc]), np.minimum(place + reach, segment.first[doc] + segment.n_words[doc])
        for k in range(1, windows.shape[1]):
            r = rank[windows[window, order[:, k]]]
            at = np.minimum(np.searchsorted(segment.keys, r * segment.end + low), len(segment.keys) - 1)
            ok = (segment.keys[at] >= r * segment.end + low) & (segment.keys[at] < r * segment.end + high)
            window, order, low, high = window[ok], order[ok], low[ok], high[ok]
        for w, a, b in zip(window.tolist(), low.tolist(), high.tolist(), strict=True):
            found.update((w, *x) for x in _shortest(segment, np.unique(rank[windows[w]]), a, b, reach))
    rows = np.array(sorted(found), np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _shortest(segment: Segment, ranks: np.ndarray, low: int, high: int, reach: int) -> Iterator[tuple[int, int]]:
    """The shortest runs (first place, words) between two places that hold all these terms."""
    lists = [segment.keys[slice(*np.searchsorted(segment.keys, (r * segment.end + low, r * segment.end + high)))] - r * segment.end for r in ranks.tolist()]
    place = np.concatenate(lists)
    term = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[np.argsort(place)].tolist()
    place = np.sort(place).tolist()
    count, missing, left = [0] * len(lists), len(lists), 0
    for right, t in enumerate(term):
        missing -= count[t] == 0
        count[t] += 1
        if missing:
            continue
        while count[term[left]] > 1:
            count[term[left]] -= 1
            left += 1
        if place[right] - place[left] < reach:
            yield place[left], place[right] - place[left] + 1
        count[term[left]] -= 1
        missing += 1
        left += 1


def item_words(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, words, n: the terms of every item, long items in parts that overlap by a window less one word.

    Items without an id or a word take no part; rows of one id are one item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            terms, n_words = terms_of(texts_of(block))
            out, at = [], 0
            for item, n in zip(block.column(0).to_pylist(), n_words.tolist(), strict=True):
                out += [(item, terms[k : min(k + PART_WORDS, at + n)].astype("<u8").tobytes()) for k in range(at, at + max(min(n, 1), n - width + 1), PART_WORDS - width + 1)]
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["item", "words"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, words binary").withColumn("n", F.expr("octet_length(words) div 8"))


def _phrase_blocks(items: DataFrame, width: int) -> Iterator[Phrases]:
    """All test phrases, a block of bounded size at a time."""
    table = written(item_words(items, width), "test-words")
    count = max(1, -(-(table.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    for k in range(count):
        rows = table.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == k).select("item", "words").toArrow()  # about BLOCK_WORDS words
        yield Phrases(rows["item"].to_pylist(), [np.frombuffer(w, "<u8") for w in rows["words"].to_pylist()], width)
    discard(table)


def search(index: DataFrame, items: DataFrame, width: int = WIDTH, slop: int | None = None) -> DataFrame:
    """doc_id, item, start, words of every match of a window of an item: the place of its first word in the document, from 0.

    Without slop, matches are exact phrases; with it, near ones: see near(). A document
    that holds a window several times has a row for each; windows that several items
    share have a row for each item.
    """
    spark, out = index.sparkSession, None
    for phrases in _phrase_blocks(items, width):
        shared = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for segment in _segments(batches):
                rank, length = segment.ranks(phrases.terms)
                for windows, item, bounds in phrases.windows:
                    if slop is None:
                        window, start = exact(segment, windows, length, rank)
                        words = np.full(len(window), windows.shape[1])
                    else:
                        window, start, words = near(segment, windows, length, rank, slop)
                    which, n = csr_take(item, bounds[:-1], np.diff(bounds), window)
                    doc = segment.document(start)
                    arrays = [pa.array([segment.doc_ids[d] for d in np.repeat(doc, n).tolist()], pa.int64()), pa.array(phrases.items[which].tolist(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.repeat(start - segment.first[doc], n)), pa.array(np.repeat(words, n).astype(np.int64))], ["doc_id", "item", "start", "words"])

        found = written(index.mapInArrow(run, "doc_id long, item string, start long, words long").distinct(), "phrase-matches")
        out = found if out is None else out.union(found)
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Segment(batch.slice(k, 1).to_pylist()[0])


def _marks(segment: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first and end place) of hit words, and distinct (document, item) pairs."""
    rank, length = segment.ranks(phrases.terms)
    edge = np.zeros(segment.end + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for windows, item, bounds in phrases.windows:
        window, start = exact(segment, windows, length, rank)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + windows.shape[1], -1)
        met = np.unique(segment.document(start) * len(windows) + window)  # of a document and a window
        which, n = csr_take(item, bounds[:-1], np.diff(bounds), met % len(windows))
        pairs.append(np.repeat(met // len(windows), n) * len(phrases.items) + which)
    hit = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    pair = np.unique(np.concatenate(pairs))
    return np.flatnonzero(hit == 1), np.flatnonzero(hit == -1), pair // max(1, len(phrases.items)), pair % max(1, len(phrases.items))


def contamination(index: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every row of the indexed table.

    n_hit counts words inside an occurrence of a window of an item; items are the ids of
    the items that have one, sorted as strings. Rows without words, an empty table and an
    empty list of items give rows without hits, or none.
    """
    spark, parts = index.sparkSession, []
    for phrases in _phrase_blocks(items, width):
        shared, whole = spark.sparkContext.broadcast(phrases), not parts

        def run(batches: Iterator[pa.RecordBatch], shared=shared, whole=whole) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for segment in _segments(batches):
                start, end, doc, item = _marks(segment, phrases)
                of = segment.document(start)
                n = len(segment.doc_ids)
                keep = np.arange(n) if whole else np.unique(doc)  # the first block has a row for every document
                run_at, item_at = np.searchsorted(of, np.r_[keep, n]), np.searchsorted(doc, np.r_[keep, n])
                runs = pa.StructArray.from_arrays([pa.array(start - segment.first[of]), pa.array(end - segment.first[of])], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment.id] * len(keep), pa.int64()), pa.array(keep), pa.array([segment.doc_ids[k] for k in keep.tolist()], pa.int64()), pa.array(segment.n_words[keep]),
                        pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), pa.array(phrases.items[item].tolist(), pa.string())), pa.ListArray.from_arrays(pa.array(run_at, pa.int32()), runs),
                    ],
                    ["segment", "row", "doc_id", "n_words", "items", "runs"],
                )

        parts.append(index.mapInArrow(run, "segment long, row long, doc_id long, n_words long, items array<string>, runs array<struct<start: long, end: long>>"))
        if not whole:
            parts[-1] = written(parts[-1], "phrase-hits")
    found = parts[0]
    if len(parts) > 1:  # a document has a row for each block of phrases at most
        for part in parts[1:]:
            found = found.union(part)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "runs")]
        found = found.groupBy("segment", "row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), *lists)
    covered = "aggregate(array_sort(runs), struct(0L as upto, 0L as n), (s, r) -> struct(greatest(s.upto, r.end) as upto, s.n + greatest(0L, r.end - greatest(s.upto, r.start)) as n), s -> s.n)"
    rows = found.select("doc_id", "n_words", F.expr(covered).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
with d as (select row_number() over () as row, doc_id, {_SQL_WORDS} as w from documents),
t as (select item_id, {_SQL_WORDS} as w from benchmark where item_id is not null),
s as (select *, least({WIDTH}, len(w)) as m from t where len(w) > 0),
p as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as phrase from (select *, unnest(range(1, len(w) - m + 2)) as i from s)),
g as (select row, m, i, array_to_string(w[i : i + m - 1], ' ') as phrase
      from (select row, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from s) where len(w) >= m)),
h as (select row, item_id, i, m from g join p using (m, phrase)),
n as (select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + m)) as k from h) group by 1),
x as (select row, list(distinct item_id::varchar) as ids from h group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (row) left join x using (row)
"""
