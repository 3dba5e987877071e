"""Quality rules: counts over words and lines of each text, and the frequency of lines across documents.

A line is normalised (ASCII lower case, outer white space gone, inner runs one
blank) and hashed. Lines that more than `max_docs` distinct documents of one
host hold are boilerplate: they are removed, and a document is rejected when
less than `min_share` of its words are left. Documents that fail the base rules
are rejected as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtrail.llm.storage import fresh, written
from kvtrail.llm.text import blocks, byte_block, mix64, span_hashes, texts_of, word_spans

#: A line in more documents of a host than this is boilerplate.
MAX_DOCS_PER_HOST = 20
#: Least share of a document's words that has to be left.
MIN_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _block_stats(texts: list[str]):
    """Columns of one block: statistics of each text, and hash and words of each line with a word."""
    data, bounds = byte_block(texts)
    n_docs = len(texts)
    starts, ends = word_spans(data)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points, not bytes
    word_chars = np.bincount(doc, leads[ends] - leads[starts], minlength=n_docs).astype(np.int64)
    n_symbols = np.add.reduceat(_SYMBOLS[data].astype(np.int64), bounds[:-1]) if n_docs else np.zeros(0, np.int64)

    # words in windows of three that occur twice or more in their text
    hashes = span_hashes(data, starts, ends)
    repeat = np.zeros(len(starts), bool)
    if len(hashes) >= 3:
        three = mix64(hashes[:-2] * np.uint64(3) + mix64(hashes[1:-1] * np.uint64(5) + mix64(hashes[2:])))
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        key = mix64(three[at] ^ mix64(doc[at].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        for k in range(3):
            repeat[again + k] = True
    n_repeat = np.bincount(doc[repeat], minlength=n_docs)

    # exact repeated lines, and the normalised lines' hashes
    feed = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], feed[:-1] + 1]) if len(feed) else np.zeros(0, np.int64)
    line_of_word = np.searchsorted(line_start, starts, side="right") - 1
    words_in = np.bincount(line_of_word, minlength=len(line_start))
    full = np.flatnonzero(words_in)
    line_doc = np.searchsorted(bounds, line_start[full], side="right") - 1
    exact = span_hashes(data, line_start[full], feed[full])
    _, first = np.unique(mix64(exact ^ mix64(line_doc.astype(np.uint64))), return_index=True)
    fresh = np.zeros(len(full), bool)
    fresh[first] = True
    n_dup = np.bincount(line_doc[~fresh], minlength=n_docs)
    lower = data.copy()
    upper = (data >= 65) & (data <= 90)
    lower[upper] += 32
    plain = span_hashes(lower, starts, ends)
    # a polynomial of the line's word hashes: sums over words of a line, by their place in it
    first_word = np.searchsorted(line_of_word, full)
    place = np.arange(len(starts)) - np.repeat(first_word, words_in[full])
    spread = mix64(plain + mix64(place.astype(np.uint64)))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
    normal = mix64(upto[first_word + words_in[full]] - upto[first_word])
    return (n_words, word_chars, n_symbols, n_dup, n_repeat), (line_doc, normal.view(np.int64), words_in[full], line_start[full], feed[full])


def hashed_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """_id, _host, _key (a hash of the text) and the hash of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            line_doc, line_hash, *_ = _block_stats(texts_of(block))[1]
            offsets = np.searchsorted(line_doc, np.arange(block.num_rows + 1))
            lines = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(line_hash))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), block.column(2), lines], ["_id", "_host", "_key", "lines"])

    rows = docs.select(*_row_names(host), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "_id long, _host string, _key long, lines array<long>").select("_id", "_host", "_key", F.explode("lines").alias("hash"))


def _row_names(host: str) -> list:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("_id"), F.col(host).cast("string").alias("_host"), F.xxhash64(text).alias("_key")]


def _with_frequent(docs: DataFrame, host: str, max_docs: int) -> DataFrame:
    """docs with a column _frequent: hashes of the row's lines that more than max_docs documents of its host hold, or null."""
    lines = hashed_lines(docs, host)
    frequent = lines.groupBy("_host", "hash").agg(F.countDistinct("_id").alias("docs")).where(F.col("docs") > max_docs)
    mark = lines.alias("l").join(frequent.alias("f"), F.expr("l.hash = f.hash and l._host <=> f._host"), "left_semi")
    # rows with the same doc_id, host and text are alike, so they share their marks
    own = [fresh(docs, c) for c in ("_id", "_host", "_key")]
    other, name = [c + "2" for c in own], fresh(docs, "_frequent")
    taken = {c.lower() for c in docs.columns}
    other = [next(c + "_" * k for k in range(len(taken) + 1) if (c + "_" * k).lower() not in taken) for c in other]
    marks = mark.groupBy("_id", "_host", "_key").agg(F.collect_set("hash").alias(name)).select(*(F.col(c).alias(o) for c, o in zip(("_id", "_host", "_key"), other, strict=True)), name)
    rows = docs.select("*", *(c.alias(o) for c, o in zip(_row_names(host), own, strict=True)))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, other, strict=True)]
    return rows.join(marks, same[0] & same[1] & (F.col(own[2]) == F.col(other[2])), "left").select(*docs.columns, name)


def _failed(counts) -> np.ndarray:
    """Texts that fail the base rules."""
    n_words, n_repeat = counts[0], counts[4]
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def _cleaned(texts: list[str], marks: pa.Array, min_share: float) -> tuple[np.ndarray, list[str]]:
    """Whether each text is kept, and the texts without their marked lines."""
    counts, (line_doc, line_hash, line_words, start, end) = _block_stats(texts)
    owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
    marked = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    drop = np.isin(mix64(line_hash.view(np.uint64) ^ mix64(line_doc.astype(np.uint64))), mix64(marked ^ mix64(owner.astype(np.uint64))))
    n_words = counts[0]
    left = n_words - np.bincount(line_doc[drop], line_words[drop], minlength=len(texts)).astype(np.int64)
    out = list(texts)
    data, bounds = byte_block(texts)
    edge = np.zeros(len(data) + 1, np.int64)
    edge[start[drop]] += 1
    edge[end[drop] + 1] -= 1  # with the line feed
    gone = np.cumsum(edge[:-1]) > 0
    for k in np.unique(line_doc[drop]).tolist():
        part = slice(bounds[k], bounds[k + 1])
        out[k] = data[part][~gone[part]].tobytes()[:-1].decode("utf-8")
    return ~_failed(counts) & (left >= min_share * n_words), out


def line_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the base counts, base_failed, and hash and words of each line with a word, of every row: one pass over the texts."""
    names = ["doc_id", "host", *_COUNTS, "base_failed", "hashes", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            counts, (line_doc, line_hash, line_words, *_) = _block_stats(texts_of(block))
            at = pa.array(np.searchsorted(line_doc, np.arange(block.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (line_hash, line_words.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(_failed(counts)), *lists], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(run, f"doc_id long, host string, {kinds}, base_failed boolean, hashes array<long>, words array<long>")


def apply_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of docs: the base counts, base_failed, kept, and the words left without frequent lines.

    Null texts have no words. A null host is a host of its own. Several rows of one
    doc_id are judged each by its own text, and count as one document for the
    frequency of a line; a null doc_id counts as no document. An empty table gives
    an empty result. The texts are read once: their lines' hashes are written and
    counted; clean() gives the texts of the kept rows without those lines.
    """
    stats = written(line_stats(docs, host).withColumn("row", F.monotonically_increasing_id()), "line-stats")
    lines = stats.select("row", "doc_id", "host", F.explode(F.arrays_zip("hashes", "words")).alias("line"))
    lines = lines.select("row", "doc_id", "host", F.col("line.hashes").alias("hash"), F.col("line.words").alias("words"))
    frequent = lines.groupBy("host", "hash").agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") > max_docs)
    lost = lines.alias("l").join(frequent.alias("f"), F.expr("l.hash = f.hash and l.host <=> f.host"), "left_semi").groupBy("row").agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    kept = ~F.col("base_failed") & (left >= F.lit(min_share) * F.col("n_words"))
    return stats.join(lost, "row", "left").select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), left.alias("words_left"))


def clean(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs that apply_rules keeps, their texts without frequent lines, all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            at = block.schema.get_field_index("text")
            kept, texts = _cleaned(texts_of(block), block.column(block.num_columns - 1), min_share)
            arrays = [pa.array(texts, block.schema.field(at).type) if k == at else c for k, c in enumerate(block.columns[:-1])]
            yield pa.RecordBatch.from_arrays(arrays, block.schema.names[:-1]).filter(pa.array(kept))

    return _with_frequent(docs, host, max_docs).mapInArrow(run, docs.schema)


#: The same in SQL, for the engine's own parameters.
ORACLE_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] as lines from d),
g as (select *, [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] as threes from w),
grams as (select doc_id, t, count(*) as n from (select doc_id, unnest(threes) as t from g) group by 1, 2),
places as (select doc_id, unnest(threes) as t, unnest(range(1, len(threes) + 1)) as i from g),
repeated as (select doc_id, count(distinct i + k) as n_repeat_words
             from (select p.doc_id, p.i, unnest([0, 1, 2]) as k from places p join grams using (doc_id, t) where n > 1) group by 1),
lines as (select doc_id, source, list_aggregate(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), 'string_agg', ' ') as line,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
          from (select doc_id, source, unnest(lines) as line from w)),
frequent as (select source, line from lines group by 1, 2 having count(distinct doc_id) > 20),
lost as (select doc_id, sum(n) as lost from lines semi join frequent using (source, line) group by 1)
select g.doc_id, len(words)::bigint as n_words, coalesce(list_sum([length(x) for x in words]), 0)::bigint as word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
       (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
       (len(words) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(words)) as base_failed,
       not (len(words) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(words))
         and len(words) - coalesce(lost, 0) >= 0.5 * len(words) as kept,
       (len(words) - coalesce(lost, 0))::bigint as words_left
from g left join repeated using (doc_id) left join lost using (doc_id)
"""
