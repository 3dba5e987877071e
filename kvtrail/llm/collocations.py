"""Phrases whose words go together, by stripes.

A stripe belongs to a prefix (the language, then zero to four words) and counts what
comes next: a counter for every next word, and one for all other continuations (the
end of a piece, or a word that can't be part of a frequent phrase). Tasks fill stripes
for their own texts, equal stripes are merged counter by counter. One merged stripe
gives the extensions of its prefix, the prefix's own count (the sum of its counters)
and the largest count of an extension, which decides whether a longer phrase takes
the prefix's place.

Stripes grow from short to long: of one word after a language; of two words, where
both are frequent; of three to five, where every two neighbours are. What is frequent
goes to the tasks as a filter of bounded size that may hold more than it should, never
less, so counts of frequent phrases are exact whatever the filter lets through.

A prefix that takes a thousandth of all words or more has its stripe cut by next word,
in the same way in every task, so that no task merges the whole of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.llm.storage import written
from kvtrail.llm.text import blocks, byte_block, mix64, span_hashes, texts_of

#: Words of a phrase, at most; occurrences of a phrase, at least; rows of a language; percent of a phrase's count at which a longer one takes its place.
WORDS, MIN_COUNT, TOP, SUBSUMED_PERCENT = 5, 100, 2000, 100
#: A prefix that has this share of all words (one in so many) is cut; parts of the stripe of a language.
HEAVY_SHARE, LANGUAGE_PARTS = 1000, 1024
#: 64-bit words of the filter of frequent phrases: one for every four of them, within these bounds (at most 32 MiB).
_FILTER_WORDS = (1 << 10, 1 << 22)
#: Counters that a task holds before it hands them on, and counters of one row.
_HELD, _ROW = 1 << 20, 1024
_NAMES = ["pkey", "part", "next", "n", "word"]
_OTHER, _WHOLE, _SPELLING, _LANGUAGE = np.uint64(0), -1, -2, -3
#: Bytes of text that a task has in hand at once, about.
_BLOCK_BYTES = 4 << 20
_END = re.compile(r"[.,;:!?\x0A-\x0D]")
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b".,;:!?\n\x0b\x0c\r \t")] = True
#: floor(1000 a n / (l r)) in whole numbers of up to 38 digits.
SCORE = "(cast(a as decimal(20,0)) * cast(n as decimal(18,0)) * 1000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
#: A stripe: name of its prefix, part, next words (eight bytes each) and counts (four bytes each); or a name and its spelling.
_SCHEMA = "pkey long, part int, next binary, n binary, word string"


def _fold(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of a phrase from that of its prefix and its last word."""
    with np.errstate(over="ignore"):
        return mix64(key * np.uint64(0x9E3779B97F4A7C15) + word)


def _language_id(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little") or 1


def _root(lang: str) -> int:
    """Name of the prefix of no word."""
    return int(_fold(np.zeros(1, np.uint64), np.array([_language_id(lang)], np.uint64))[0])


def _words(texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: name, language, piece, and place in the bytes of the block, which come last."""
    data, bounds = byte_block(texts)
    inside = ~_GAP[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 32
    names = span_hashes(lower, starts, ends)
    names[names == _OTHER] = 1
    piece = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
    owner = np.searchsorted(bounds, starts, side="right") - 1
    of = {x: _language_id(x) for x in set(langs)}
    language = np.array([of[x] for x in langs] or [1], np.uint64)[owner]
    return names, language, piece, starts, ends, lower


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[str], list[str]]]:
    """Texts and languages, about `limit` bytes at a time; a very long text comes in parts that end where a piece ends."""
    for block in blocks(batches, "text", limit):
        texts, langs = texts_of(block), block.column(1).to_pylist()
        if len(texts) > 1 or len(texts[0]) <= 2 * limit:
            yield texts, langs
            continue
        text, at = texts[0], 0
        while at < len(text):
            found = _END.search(text, at + limit)
            end = found.end() if found else len(text)
            yield [text[at:end]], langs
            at = end


class _Held:
    """Counters of a task, of prefixes of one length: name of the prefix, name of its first two words, next word, count."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, pkey: np.ndarray, lead: np.ndarray, following: np.ndarray, count: np.ndarray | None = None) -> None:
        key = _fold(pkey, following)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
        at = order[first]
        n = np.diff(np.r_[first, len(key)]) if count is None else np.add.reduceat(count[order], first) if len(first) else count
        self.parts.append((pkey[at], lead[at], following[at], n))
        self.size += len(at)

    def shrink(self) -> None:
        """Sum up equal counters of different blocks."""
        if len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self.add(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    def rows(self, heavy: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        """All counters as stripes; heavy: keys of the prefixes that are cut, in order, and their numbers of parts (None: all are)."""
        self.shrink()
        for pkey, lead, following, n in self.parts:
            if heavy is None:
                part = (following % np.uint64(LANGUAGE_PARTS)).astype(np.int32)
            else:
                keys, parts = heavy
                at = np.minimum(np.searchsorted(keys, lead), max(0, len(keys) - 1))
                cut = keys[at] == lead if len(keys) else np.zeros(len(pkey), bool)
                part = np.full(len(pkey), _WHOLE, np.int32)
                part[cut] = (following[cut] % parts[at[cut]].astype(np.uint64)).astype(np.int32)
            order = np.lexsort((part, pkey))
            pkey, part, following, n = pkey[order], part[order], following[order], n[order]
            new = np.r_[True, (pkey[1:] != pkey[:-1]) | (part[1:] != part[:-1])] if len(pkey) else np.zeros(0, bool)
            run = np.cumsum(new) - 1
            inside = np.arange(len(pkey)) - np.flatnonzero(new)[run]
            first = np.flatnonzero(new | (inside % _ROW == 0))
            lists = [_lists(x, np.r_[first, len(pkey)]) for x in (following.astype("<u8"), n.astype("<u4"))]
            batch = pa.RecordBatch.from_arrays([pa.array(pkey[first].view(np.int64)), pa.array(part[first]), *lists, pa.nulls(len(first), pa.string())], _NAMES)
            yield from (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096))
        self.parts, self.size = [], 0


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[k]:bounds[k + 1]] as the bytes of row k."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _numbers(column: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows end to end, and how many each row has."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.zeros(0, np.uint8)]
    for chunk in chunks:
        if len(chunk):
            bounds = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            out.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]])
    return np.concatenate(out).view(kind), size


def _spelled(spelling: dict[int, str], part: int) -> pa.RecordBatch:
    none = pa.array([b""] * len(spelling), pa.binary())
    keys = pa.array(np.array(list(spelling), np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([keys, pa.array([part] * len(spelling), pa.int32()), none, none, pa.array(list(spelling.values()), pa.string())], _NAMES)


def _in(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = key & np.uint64(64 * len(table) - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _stripes(docs: DataFrame, lengths: range, frequent: np.ndarray | None = None, heavy: tuple[np.ndarray, np.ndarray] | None = None, spell: bool = False) -> DataFrame:
    """Stripes of prefixes of so many words, of the texts of each task.

    frequent: a filter of the frequent words (lengths 1) or pairs of words (from 2 on). spell: add the words
    of frequent pairs as rows of their own. Prefixes of no word bring the names of the languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, heavy = shared.value
        held, spelling, langs = {k: _Held() for k in lengths}, {}, {}
        for texts, own in _blocks(batches, _BLOCK_BYTES):
            name, language, piece, start, end, data = _words(texts, own)
            root = _fold(np.zeros(len(name), np.uint64), language)
            if 0 in held:
                langs |= {_root(x): x for x in set(own)}
                held[0].add(root, root, name)
            elif 1 in held:
                key = _fold(root, name)
                good = _in(frequent, key)
                follows = np.zeros(len(name), bool)
                follows[:-1] = (piece[1:] == piece[:-1]) & good[1:]
                following = np.where(follows, np.r_[name[1:], _OTHER], _OTHER)[good]
                held[1].add(key[good], key[good], following)
            else:
                # linked[i]: words i and i + 1 are a frequent pair; run[i]: so many words from i on are linked
                key = _fold(_fold(root, name)[:-1], name[1:]) if len(name) else name
                linked = np.zeros(len(name) + 1, bool)
                linked[: len(key)] = (piece[1:] == piece[:-1]) & _in(frequent, key) if len(key) else False
                stop = np.flatnonzero(~linked)
                length = stop[np.searchsorted(stop, np.arange(len(name)))] - np.arange(len(name)) + 1
                padded = np.r_[name, np.zeros(WORDS, np.uint64)]
                for k in lengths:
                    at = np.flatnonzero(length >= k)
                    pkey = lead = key[at]
                    for j in range(2, k):
                        pkey = _fold(pkey, padded[at + j])
                    held[k].add(pkey, lead, np.where(length[at] > k, padded[at + k], _OTHER))
                if spell:
                    part = np.flatnonzero(linked[:-1] | np.r_[False, linked[:-2]]) if len(name) else np.zeros(0, np.int64)
                    ids, first = np.unique(name[part], return_index=True)
                    raw = data.tobytes()
                    spelling |= {i: raw[start[f] : end[f]].decode("utf-8", "replace") for i, f in zip(ids.tolist(), part[first].tolist(), strict=True) if i not in spelling}
                    if len(spelling) > _HELD:
                        yield _spelled(spelling, _SPELLING)
                        spelling = {}
            for k, h in held.items():
                if h.size > _HELD:
                    h.shrink()
                if h.size > _HELD // 2:
                    yield from h.rows(heavy if k else None)
        for k, h in held.items():
            yield from h.rows(heavy if k else None)
        if spelling:
            yield _spelled(spelling, _SPELLING)
        if langs:
            yield _spelled(langs, _LANGUAGE)

    return docs.mapInArrow(run, _SCHEMA)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of a bounded number of counters."""
    before = np.cumsum(pc.binary_length(batch["n"]).to_numpy(zero_copy_only=False).astype(np.int64) // 4) // _HELD
    first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if batch.num_rows else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _groups(rows: pa.Table) -> np.ndarray:
    """First rows of the runs of one prefix and part."""
    pkey, part = rows["pkey"].to_numpy(), rows["part"].to_numpy()
    return np.flatnonzero(np.r_[True, (pkey[1:] != pkey[:-1]) | (part[1:] != part[:-1])])


def _summed(rows: pa.Table, wide: bool) -> pa.Table:
    """One row for each run of a prefix and part, equal counters summed up; counts have eight bytes then. wide: so have those of the first row."""
    first = _groups(rows)
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, rows.num_rows]))
    following, size = _numbers(rows["next"], "<u8")
    n = _numbers(rows["n"][1:] if wide else rows["n"], "<u4")[0].astype("<u8")
    if wide:
        n = np.concatenate([_numbers(rows["n"][:1], "<u8")[0], n])
    owner = np.repeat(owner, size)
    order = np.lexsort((following, owner))
    owner, following, n = owner[order], following[order], n[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (following[1:] != following[:-1])]) if len(owner) else np.zeros(0, np.int64)
    bounds = np.searchsorted(owner[new], np.arange(len(first) + 1))
    lists = [_lists(x, bounds) for x in (following[new], np.add.reduceat(n, new) if len(new) else n)]
    at = pa.array(first)
    return pa.table([rows["pkey"].take(at), rows["part"].take(at), *lists, rows["word"].take(at)], names=_NAMES)


def _finished(rows: pa.Table, min_count: int) -> pa.RecordBatch:
    """Totals of merged stripes, and their counters that reach min_count."""
    following, size = _numbers(rows["next"], "<u8")
    n = _numbers(rows["n"], "<i8")[0]
    owner = np.repeat(np.arange(rows.num_rows), size)
    total = np.zeros(rows.num_rows, np.int64)
    np.add.at(total, owner, n)
    keep = (n >= min_count) & (following != _OTHER)
    bounds = pa.array(np.searchsorted(owner[keep], np.arange(rows.num_rows + 1)).astype(np.int32))
    keys = _fold(rows["pkey"].to_numpy().view(np.uint64)[owner[keep]], following[keep])
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (following[keep].view(np.int64), n[keep], keys.view(np.int64))]
    return pa.table([rows["pkey"], rows["part"], rows["word"], pa.array(total), *lists], names=["pkey", "part", "word", "total", "next", "n", "keys"]).combine_chunks().to_batches()[0]


def _merged(stripes: DataFrame, min_count: int) -> DataFrame:
    """Stripes of one prefix and part summed up counter by counter, as they come in sorted order.

    pkey, part, word, total, and next, n, keys (names of the longer phrases) of the
    counters that reach min_count. Only the last stripe waits for more rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            for part in _cut(batch):
                rows = _summed(pa.concat_tables([*waiting, pa.Table.from_batches([part])]), bool(waiting))
                if rows.num_rows > 1:
                    yield _finished(rows.slice(0, rows.num_rows - 1), min_count)
                waiting = [rows.slice(rows.num_rows - 1)]
        if waiting:
            yield _finished(waiting[0], min_count)

    dealt = stripes.repartition("pkey", "part").sortWithinPartitions("pkey", "part")
    kinds = "pkey long, part int, word string, total long, next array<long>, n array<long>, keys array<long>"
    return dealt.mapInArrow(run, kinds).where(f"word is not null or part >= 0 or total >= {min_count}")


def _filter(merged: DataFrame) -> np.ndarray:
    """A bounded filter that holds the names of all frequent phrases, and perhaps more."""
    keys = merged.select(F.explode("keys").alias("key"))
    low, high = _FILTER_WORDS
    size = 1 << int(np.clip(keys.count() // 4, low, high) - 1).bit_length()
    bit = keys.select(F.col("key").bitwiseAND(64 * size - 1).alias("bit"))
    rows = bit.groupBy(F.expr("bit div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def _heavy(merged: DataFrame, all_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases that take a HEAVY_SHARE-th of all words or more, so HEAVY_SHARE at most, and into how many parts their stripes are cut."""
    rows = merged.select(F.explode(F.arrays_zip("keys", "n")).alias("x")).where(F.col("x.n") * HEAVY_SHARE >= max(1, all_words)).select("x.keys", "x.n").toArrow()
    keys, n = rows["keys"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], 1 + n[order] * HEAVY_SHARE // max(1, all_words)


def stripes(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged stripes of prefixes of no, of one, and of two to four words: pkey, part, word, total, next, n, keys.

    A null text counts as empty, a null language as `und`. next and n list the counters
    that reach min_count, keys names the phrases that they count; prefixes whose total
    does not reach it are left out. Rows with a word spell a language or a word.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    one = written(_merged(_stripes(rows, range(1)), min_count), "stripes")
    every = one.agg(F.sum("total")).first()[0] or 0
    two = written(_merged(_stripes(rows, range(1, 2), _filter(one), _heavy(one, every)), min_count), "stripes")
    return one, two, written(_merged(_stripes(rows, range(2, WORDS), _filter(two), _heavy(two, every), spell=True), min_count), "stripes")


def _phrases(one: DataFrame, two: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """words, a of every frequent phrase of two words and more; words, f, longer of every frequent prefix.

    words are the names of the language and the words. A prefix's f is the sum of its
    stripe, longer its largest extension. Phrases get their words from their prefixes, length by length.
    """
    counters = [x.select("pkey", F.explode(F.arrays_zip("next", "n", "keys")).alias("x")).select("pkey", F.col("x.next").alias("next"), F.col("x.n").alias("a"), F.col("x.keys").alias("key")) for x in (one, two, more)]
    level = counters[0].select("key", F.array("pkey", "next").alias("words"), "a")
    levels = [one.where(F.col("part") >= 0).select(F.col("pkey").alias("key"), F.array("pkey").alias("words"), F.lit(0).cast("long").alias("a")).distinct(), level]
    for k in range(2, WORDS + 1):
        shorter = levels[-1].select(F.col("key").alias("pkey"), "words")
        levels.append(written(counters[min(k - 1, 2)].join(shorter, "pkey").select("key", F.concat("words", F.array("next")).alias("words"), "a"), "phrases"))
    sums = one.union(two).union(more).where(F.col("word").isNull()).groupBy("pkey").agg(F.sum("total").alias("f"), F.max(F.array_max("n")).alias("longer"))
    sums = written(sums, "prefix-sums")
    totals = [x.join(sums, x.key == sums.pkey).select("words", "f", "longer") for x in levels[:-1]]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union([x.select("words", "a") for x in levels[2:]]), written(union(totals), "prefix-totals")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, subsumed_percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two to five words of each language whose words most go together.

    a counts the phrase, l and r the two parts of the cut with the lowest score
    floor(1000 a n / (l r)) (the first of equal ones), n all words of the language.
    Phrases inside a longer frequent one with subsumed_percent of their count are left
    out. Scores are compared as whole numbers of up to 38 digits. Tables without a
    frequent phrase give no rows.
    """
    one, two, more = stripes(docs, min_count)
    phrases, totals = _phrases(one, two, more)
    languages = one.where(F.col("part") == _LANGUAGE).select(F.array("pkey").alias("language"), F.col("word").alias("lang"))
    languages = written(languages.join(totals.select(F.col("words").alias("language"), F.col("f").alias("n")), "language"), "languages")

    language = F.slice("words", 1, 1)
    cuts = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("k"))
    cuts = cuts.select("words", "a", "k", language.alias("language"), F.expr("slice(words, 1, k + 1)").alias("first"), F.concat(language, F.expr("slice(words, k + 2, size(words))")).alias("rest"))
    part = lambda name, of: totals.select(F.col("words").alias(of), F.col("f").alias(name))
    scored = cuts.join(part("l", "first"), "first").join(part("r", "rest"), "rest").join(languages, "language")
    scored = scored.withColumn("score", F.expr(SCORE))
    best = scored.groupBy("words", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    after = totals.select("words", "longer")
    tail = F.concat(language, F.expr("slice(words, 3, size(words))"))
    before = phrases.where(F.size("words") > 3).groupBy(tail.alias("words")).agg(F.max("a").alias("longer_before"))
    longer = F.greatest(F.coalesce("longer", F.lit(0)), F.coalesce("longer_before", F.lit(0)))
    kept = best.join(after, "words", "left").join(before, "words", "left").where(100 * longer < subsumed_percent * F.col("a"))
    kept = kept.select("words", "lang", "a", "n", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    letters = more.where(F.col("part") == _SPELLING).select(F.col("pkey").alias("id"), "word")
    spelled = kept.select("words", F.posexplode(F.expr("slice(words, 2, size(words))")).alias("at", "id")).join(letters, "id")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(spelled, "words").withColumn("_salt", F.pmod(F.xxhash64("words"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = named.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from p),
g as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, range(1, {WORDS + 1}) x(m) where len(w) >= m),
f as (select lang, w[i : i + m - 1] as words, m, count(*) as a from g group by 1, 2, 3),
n as (select lang, sum(a)::bigint as n from f where m = 1 group by 1),
c as (select * from f where m > 1 and a >= {MIN_COUNT}),
k as (select *, unnest(range(1, m)) as k from c),
s as (select k.lang, k.words, k.m, k.a, n.n, k.k, l.a as l, r.a as r, ((1000::hugeint * k.a * n.n) // (l.a::hugeint * r.a))::bigint as score
      from k join n using (lang) join f l on l.lang = k.lang and l.words = k.words[1 : k.k] join f r on r.lang = k.lang and r.words = k.words[k.k + 1 :]),
b as (select *, array_to_string(words, ' ') as phrase from s qualify row_number() over (partition by lang, words order by score, k) = 1),
o as (select b.* from b where not exists (select 1 from b x where x.lang = b.lang and x.m > b.m and contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') and 100 * x.a >= {SUBSUMED_PERCENT} * b.a)),
t as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o)
select * from t where rank <= {TOP}
"""
