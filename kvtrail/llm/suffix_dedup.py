"""Removal of every byte covered by a long string that also starts somewhere else.

A sparse suffix array is built bucket by bucket. Each start of a LENGTH-byte
string belongs to an anchor: of the GRAM-byte strings inside it, the last one of
the smallest hash. Equal strings have equal anchors at equal distances, so
suffixes that tie over LENGTH bytes always share a bucket, the anchor's string,
and buckets are sorted apart from one another. The starts of one anchor are an
interval, and with the bytes that they reach, a context.

* A bucket with one occurrence has no tie.
* Contexts that occur twice tie as a whole; only one copy of them is sorted.
* Only buckets of several different contexts are sorted. Cover positions lie
  every STEP bytes, counted from the anchor, so that two suffixes at the same
  distance always reach cover positions together; ranks of the cover positions'
  long strings are computed first, by doubling, and settle the suffixes' ties.
  One group of buckets is in memory at a time; a bucket of very many contexts is
  never sorted whole, its strings are dealt out and counted.

Copies of a whole text are one text that occurs several times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtrail.llm.storage import discard, fresh, written
from kvtrail.llm.text import blocks, mix64, span_hashes, window_hashes

LENGTH, GRAM, STEP = 200, 64, 8
#: Bytes of contexts that are sorted together, about; a larger bucket is sorted by itself.
SORT_BYTES = 2 << 20
#: Bytes of text that a task anchors at once.
_BLOCK_BYTES = 2 << 20
#: Bits of a place in a block; the others of a hash decide which anchor is the smallest.
_PLACE_BITS = 24
#: Different contexts of a bucket that are sorted in one task, at most.
BUCKET_CONTEXTS = 4096
_REACH = LENGTH - GRAM + 1


def _raw(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch end to end, and their bounds."""
    texts = [t.encode("utf-8", "replace") for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: the text, the first and last start that belong to it (in data), its place, and two hashes:
    of its bytes, and of its context with its place in it."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none
    grams = window_hashes(data, GRAM)
    bits = np.uint64(max(_PLACE_BITS, len(data).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    least = (grams >> bits << bits) | (low - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while 2 * width <= _REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _REACH:
        least = np.minimum(least[: n], least[_REACH - width : _REACH - width + n])
    sizes = np.diff(bounds)
    long = np.flatnonzero(sizes >= LENGTH)
    count = sizes[long] - LENGTH + 1
    if not len(long):
        return none
    starts = np.arange(count.sum()) + np.repeat(bounds[:-1][long] - (np.cumsum(count) - count), count)
    text = np.repeat(long, count)
    place = (low - (least[starts] & low)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(starts)] - 1
    lo, hi, at = starts[first], starts[last], place[first]
    context = mix64(span_hashes(data, lo, hi + LENGTH) ^ mix64((at - lo).astype(np.uint64)))
    return text[first], lo, hi, at, grams[at], context


def _pieces(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """anchors() of a block, and where it begins; of one very long text in pieces, each with the bytes that its last starts reach."""
    if len(bounds) > 2 or len(data) <= 2 * size:
        yield 0, anchors(data, bounds)
        return
    for begin in range(0, len(data) - LENGTH + 1, size):
        piece = data[begin : begin + size + LENGTH - 1]
        yield begin, anchors(piece, np.array([0, len(piece)]))


def _repeated_here(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of contexts that one text repeats: one of each (with all others), whether it is repeated, and merged runs (text, lo, hi) of the starts of all of them.

    A text of one period has very many starts and few contexts, and its runs are one.
    """
    order = np.lexsort((lo, context, text))
    new = np.r_[True, (context[order][1:] != context[order][:-1]) | (text[order][1:] != text[order][:-1])] if len(text) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(new), len(text)])
    many = np.sort(order[np.repeat(size > 1, size)])  # anchors are in the order of texts and places
    t, a, b = text[many], lo[many], hi[many]
    cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (a[1:] > b[:-1] + 1)]) if len(many) else many
    return order[new], size > 1, (t[cut], a[cut], np.maximum.reduceat(b, cut) if len(cut) else b)


def _occurrences(texts: DataFrame) -> DataFrame:
    """th, lo, hi, at (places in the text), bucket, context and weight of every anchor, once for each context of a text;
    and, with a null bucket, runs of starts that are repeated within their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", _BLOCK_BYTES):
            data, bounds = _raw(block)
            th, copies = block.column(0).to_numpy(), block.column(2).to_numpy()
            for ahead, (text, lo, hi, at, gram, context) in _pieces(data, bounds, _BLOCK_BYTES):
                one, again, (run_text, run_lo, run_hi) = _repeated_here(text, lo, hi, context)
                text, lo, hi, at, gram, context = (x[one] for x in (text, lo, hi, at, gram, context))
                begin, run_begin = bounds[text] - ahead, bounds[run_text] - ahead
                none = np.full(len(run_text), -1)
                joined = [np.r_[th[text], th[run_text]], np.r_[lo - begin, run_lo - run_begin], np.r_[hi - begin, run_hi - run_begin], np.r_[at - begin, none]]
                names = [pa.array(np.r_[x.view(np.int64), none], mask=np.r_[np.zeros(len(x), bool), np.ones(len(none), bool)]) for x in (gram, context)]
                weight = np.r_[np.where(again, 2, np.minimum(copies[text], 2)), none]
                yield pa.RecordBatch.from_arrays([pa.array(joined[0]), *(pa.array(x.astype(np.int32)) for x in joined[1:]), *names, pa.array(weight.astype(np.int32))], ["th", "lo", "hi", "at", "bucket", "context", "weight"])

    return texts.mapInArrow(run, "th long, lo int, hi int, at int, bucket long, context long, weight int")


def _contexts(texts: DataFrame) -> DataFrame:
    """The bytes of the contexts that have to be sorted; texts has a list `wanted` of them beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", _BLOCK_BYTES):
            out: list[tuple] = []
            for th, text, wanted in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), block.column(3).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                out += [(w["bucket"], th, w["lo"], w["at"] - w["lo"], w["alone"], w["large"], raw[w["lo"] : w["hi"] + LENGTH]) for w in wanted]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            names = ["bucket", "th", "lo", "anchor", "alone", "large", "content"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

    return texts.mapInArrow(run, "bucket long, th long, lo int, anchor int, alone boolean, large boolean, content binary")


def _rank(names: np.ndarray) -> np.ndarray:
    return np.unique(names, return_inverse=True)[1].astype(np.uint64)


def tied_suffixes(bucket: np.ndarray, content: list[bytes], anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the context, start in it) of all suffixes that tie with another of their bucket over LENGTH bytes."""
    sizes = np.array([len(c) for c in content], np.int64)
    begin = np.cumsum(sizes) - sizes
    raw = b"".join(content) + bytes(STEP)
    words = np.ndarray((len(raw) - STEP + 1,), ">u8", raw, strides=(1,)).astype(np.uint64)
    # cover positions: every STEP bytes, counted from the anchor
    offset = anchor % STEP
    count = (sizes - offset) // STEP
    grid_begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(content)), count)
    index = np.arange(count.sum()) - grid_begin[owner]
    cover = begin[owner] + offset[owner] + STEP * index
    rank, left = _rank(words[cover]), count[owner] - index
    for step in (1, 2, 4, 8):  # ranks of 16, 32, 64 and 128 bytes; a place too near the end keeps a number nobody asks for
        after = np.minimum(np.arange(len(rank)) + step, max(0, len(rank) - 1))
        rank = _rank((rank << np.uint64(32)) | np.where(left >= 2 * step, rank[after], np.uint64(0)))
    # all suffixes of LENGTH bytes or more: first bytes, two cover ranks, last bytes
    suffixes = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(content)), suffixes)
    start = np.arange(suffixes.sum()) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    near = grid_begin[of] + -(-(start - offset[of]) // STEP)
    place = begin[of] + start
    keys = [
        words[place + LENGTH - STEP],
        (rank[near] << np.uint64(32)) | rank[near + 8],
        words[place],
        mix64(bucket[of].view(np.uint64)) + (anchor[of] - start + (1 << 20)).astype(np.uint64),
    ]
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        ranked = key[order]
        same &= ranked[1:] == ranked[:-1]
    tied = np.zeros(len(order), bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    found = np.flatnonzero(tied)
    return of[found], start[found]


def _sorted_buckets(contexts: DataFrame) -> DataFrame:
    """th, lo, hi: runs of starts that tie with others, of the contexts that stand alone; a group of buckets at a time."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        bucket, th, lo, anchor, alone, content = zip(*rows, strict=True)
        of, start = tied_suffixes(np.array(bucket, np.int64), list(content), np.array(anchor, np.int64))
        keep = np.array(alone)[of]
        of, start = of[keep], start[keep]
        place = start + np.array(lo, np.int64)[of]
        cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)]) if len(of) else np.zeros(0, np.int64)
        last = np.r_[cut[1:], len(of)] - 1 if len(of) else cut
        return pa.RecordBatch.from_arrays([pa.array(np.array(th, np.int64)[of[cut]]), pa.array(place[cut].astype(np.int32)), pa.array(place[last].astype(np.int32))], ["th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(held)

    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "th long, lo int, hi int")


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """th, text, copies: every distinct text once."""
    return docs.groupBy("th").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _large_buckets(contexts: DataFrame) -> DataFrame:
    """th, lo, hi, as _sorted_buckets gives them, of buckets that are too large for one task: their starts are dealt by whole strings."""
    starts = contexts.select("bucket", "th", "lo", "anchor", "alone", "content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - LENGTH)).alias("s"))
    string = F.expr(f"substring(content, s + 1, {LENGTH})")
    starts = starts.select("bucket", "th", (F.col("lo") + F.col("s")).alias("at"), "alone", F.xxhash64(string).alias("h1"), F.xxhash64(F.lit(1), string).alias("h2"))
    tied = starts.groupBy("bucket", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "h1", "h2")
    return starts.where("alone").join(tied, ["bucket", "h1", "h2"], "left_semi").select("th", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeated_starts(texts: DataFrame) -> DataFrame:
    """th, lo, hi: runs of starts of LENGTH-byte strings that start anywhere else as well.

    Buckets and contexts are counted by sums, never gathered: a passage that very many
    texts hold is one row of a sum. A bucket of more than BUCKET_CONTEXTS different
    contexts is dealt by its strings instead of being sorted in one task.
    """
    found = written(_occurrences(texts.select("th", "text", "copies")), "anchors")
    here = written(found.where("bucket is null").select("th", "lo", "hi"), "own-runs")
    shared = found.where("bucket is not null").groupBy("bucket").agg(F.sum("weight").alias("all"), (F.min("context") != F.max("context")).alias("mixed")).where("all > 1").select("bucket", "mixed")
    shared = written(shared, "shared-buckets")  # sums are written before they are joined, so that the join can split a hot key
    found_again = written(found.join(shared, "bucket"), "shared-anchors")
    discard(found)
    same = ["bucket", "context"]
    copied = written(found_again.groupBy(*same).agg(F.sum("weight").alias("n")).where("n > 1").select(*same), "copied-contexts")
    whole = found_again.join(copied, same, "left_semi").select("th", "lo", "hi")
    mixed = found_again.where("mixed").groupBy(*same).agg(F.sum("weight").alias("n"), F.min(F.struct("th", "lo", "hi", "at")).alias("x"))
    large = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BUCKET_CONTEXTS).select("bucket", F.lit(True).alias("large"))
    wanted = mixed.join(large, "bucket", "left").select("x.th", F.struct("bucket", "x.lo", "x.hi", "x.at", (F.col("n") == 1).alias("alone"), F.coalesce("large", F.lit(False)).alias("large")).alias("w"))
    wanted = wanted.groupBy("th").agg(F.collect_list("w").alias("wanted"))  # bounded by the text
    content = written(_contexts(texts.join(wanted, "th").select("th", "text", "copies", "wanted")), "contexts")
    return here.unionByName(whole).unionByName(_sorted_buckets(content.where("not large").drop("large"))).unionByName(_large_buckets(content.where("large")))


def _spans(runs: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """For each row, the maximal spans of covered bytes; runs: structs of first and last starts."""
    lo, hi = (runs.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        order = np.argsort(lo[a:b])
        first, end = lo[a:b][order], np.maximum.accumulate(hi[a:b][order] + LENGTH) if b > a else hi[a:b]
        cut = np.flatnonzero(np.r_[True, first[1:] > end[:-1]]) if b > a else order
        yield list(zip(first[cut].tolist(), end[np.r_[cut[1:], b - a] - 1].tolist() if b > a else [], strict=True))


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name` that is the same for equal texts only.

    It is a hash of the text; the texts of a hash that stands for several (by another
    hash) get a hash of both.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, check = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    twice = docs.select(key.alias("key"), check.alias("check")).groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b")
    if twice.isEmpty():
        return docs.withColumn(name, key)
    mark = fresh(docs, "several")
    marked = docs.withColumn(name, key).join(twice.select(F.col("key").alias(name), F.lit(True).alias(mark)), name, "left")
    return marked.withColumn(name, F.when(F.col(mark), F.xxhash64(key, check)).otherwise(key)).drop(mark)


def _prepared(docs: DataFrame) -> DataFrame:
    return _keyed(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), "th")


def _with_runs(texts: DataFrame) -> DataFrame:
    runs = repeated_starts(texts).groupBy("th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return texts.join(runs, "th", "left").select("th", "text", "copies", "runs")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text counts as empty; texts shorter than LENGTH bytes stay whole. Rows with
    equal texts are copies of one another, whatever their doc_id. Ties are taken on the
    input, so all occurrences go. An empty table gives no rows.
    """
    rows = _prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    texts = _distinct_texts(rows.select("th", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for th, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _spans(batch.column(3)), strict=True):
                raw = text.encode("utf-8", "replace")
                out.append((th, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], ["th", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    digests = _with_runs(texts).mapInArrow(run, "th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.select("doc_id", "th").join(digests, "th").drop("th")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows of docs with the repeated bytes cut out of their texts; a character that is cut in part goes whole.

    Columns other than text stay as they are; a null text stays null.
    """
    rows = _prepared(docs.select("text"))
    texts = _distinct_texts(rows.select("th", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), _spans(batch.column(3)), strict=True):
                out.append(_kept(text.encode("utf-8", "replace"), spans).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["th", "kept"])

    changed = _with_runs(texts).where("runs is not null").mapInArrow(run, "th long, kept string")
    th, kept = fresh(docs, "th"), fresh(docs, "kept")
    joined = _keyed(docs, th).join(changed.select(F.col("th").alias(th), F.col("kept").alias(kept)), th, "left")
    return joined.withColumn("text", F.coalesce(kept, "text")).select(docs.columns)
