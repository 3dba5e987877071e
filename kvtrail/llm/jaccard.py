"""Near-duplicate documents: a grouped prefix join on word shingles with an exact Jaccard test.

Documents with equal shingle sets are one node, represented by the smallest doc_id.
A set's elements have one global order: frequent ones last, else by hash. Two sets
that are similar enough share at least k elements among the first n - ceil(0.8 n) + k
of each, so only those prefixes are joined.

* Nodes of one size whose prefixes are identical form a group; postings are those of
  groups. Elements that only one group holds are dropped before anything is joined.
* Every group belongs to the family of its most common element. A group that shares
  enough elements with a family's prefixes meets that family; a pair of families
  that do not meet has no link.
* Families are dealt into blocks of bounded size. Two blocks whose families meet are
  a cell: the whole sets of the members travel there once, and every two of them are
  compared exactly. A cell gives back each member's number of links and the smallest
  node that its links reach, so pairs are verified but never become rows.

A family with very many members has many blocks, and every two of them a cell of
their own, so no task holds more than two blocks, however common an element is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.llm.components import components
from kvtrail.llm.storage import discard, fresh, written
from kvtrail.llm.text import blocks, byte_block, mix64, span_hashes, texts_of, word_spans

WORDS = 5
#: Similarity in percent.
PERCENT = 80
#: Share of a set, in percent, by which prefixes are longer than they must be.
SPARE_PERCENT = 5
#: Entries of the table of frequent shingles, at most; documents that hold a frequent shingle, at least.
FREQUENT_ENTRIES, FREQUENT_DOCS = 250_000, 50
#: Shingles that the sketch of a task holds.
SKETCH_ENTRIES = 1 << 17
#: Members of a posting list before it is split.
BUCKET_MEMBERS = 1000
#: Members of a block and shingles of all its sets, on average; a cell holds two blocks.
CELL_NODES, CELL_SHINGLES = 256, 1 << 20
#: 64-bit words of the filter of wanted nodes: one for every four nodes, within these bounds (at most 32 MiB).
_FILTER_WORDS = (1 << 12, 1 << 22)
#: Bytes of text that a task has in hand at once; numbers of a dense table in a cell.
_BLOCK_BYTES, _DENSE = 1_900_000, 1 << 22
#: Sizes of which one is at most 1.25 times the other lie in one band or in two neighbouring ones.
_BAND = math.log(100 / PERCENT) * (1 + 1e-9)


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and the bounds of each text's set."""
    data, bounds = byte_block(texts)
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    starts, ends = word_spans(data)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    hashes = span_hashes(lower, starts, ends)
    count = np.bincount(doc, minlength=len(texts))
    n = len(hashes)
    mixed = np.zeros(n, np.uint64)
    for k in range(words):  # a shorter text gets one shingle of all its words
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = hashes[k:]
        inside = np.zeros(n, bool)
        inside[: max(0, n - k)] = doc[k:] == doc[: max(0, n - k)]
        mixed += np.where(inside, mix64(part + np.uint64(k + 1)), np.uint64(0))
    whole = np.zeros(n, bool)
    whole[: max(0, n - words + 1)] = doc[words - 1 :] == doc[: max(0, n - words + 1)]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if n else np.zeros(0, np.int64)
    whole[first[count[doc[first]] < words]] = True
    at = np.flatnonzero(whole)
    key, owner = mix64(mixed[at]), doc[at]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(len(texts) + 1))


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def heavier(key: np.ndarray, n: np.ndarray, most: int = SKETCH_ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a bounded sketch: equal keys summed up, and if there are more than `most`, all less the first count that has no room.

    A key then counts for less than it should by at most the sum of all counts by `most` + 1, however the counts came in.
    """
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    key, n = key[first], np.add.reduceat(n, first) if len(first) else n
    if len(key) > most:
        n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
        key, n = key[n > 0], n[n > 0]
    return key, n


def frequent_shingles(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a large share of the documents hold, in order of their hashes, and their counts.

    Every task counts in a sketch of SKETCH_ENTRIES shingles; the tasks' counts are summed up. A
    shingle counts for less than it should by one SKETCH_ENTRIES-th of all shingles at most, and one a task,
    wherever its documents lie. The least count that is kept follows the number of all shingles, so that the table has
    FREQUENT_ENTRIES entries at most. The counts only set an order and split long lists: results don't depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for block in blocks(batches, "text", _BLOCK_BYTES):
            found = shingle_sets(texts_of(block), words)[0]
            total += len(found)
            key, n = heavier(np.concatenate([key, found]), np.concatenate([n, np.ones(len(found), np.int64)]))
        key, n = key[n > 1], n[n > 1]
        for k in range(0, len(key) + 1, 1 << 16):
            part = slice(k, k + (1 << 16))
            h = pa.array(np.concatenate([[np.uint64(0)], key[part]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([h, pa.array(np.concatenate([[0], n[part]])), pa.array([0 if k else total] + [0] * len(key[part]), pa.int64())], ["h", "n", "total"])

    counted = written(_two(docs).mapInArrow(run, "h long, n long, total long"), "shingle-counts")
    total = counted.agg(F.sum("total")).first()[0] or 0
    least = max(FREQUENT_DOCS, -(-total // FREQUENT_ENTRIES))
    rows = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # bounded by the choice of `least`
    discard(counted)
    key, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _required(n: np.ndarray) -> np.ndarray:
    """k: how many elements of the prefix a link needs."""
    return 1 + n * SPARE_PERCENT // 100


def _enough(count: str, n: str) -> str:
    """SQL: as many shared elements as any link of a set of n needs, whose partner may be smaller than it."""
    return f"{count} >= 1 + ({n} * {PERCENT * SPARE_PERCENT}) div 10000"


def _prefix_lengths(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - -(-n * PERCENT // 100) + _required(n))


def _set_keys(key: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that together name it."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix64(key), dtype=np.uint64)])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix64(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return (one[bounds[1:]] - one[bounds[:-1]]).view(np.int64), (two[bounds[1:]] - two[bounds[:-1]]).view(np.int64)


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, the set's name (k1, k2), the prefix's name (g1, g2), tokens and parts of every row.

    tokens: the prefix in order; parts: into how many each token's list is split, null if none is.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["doc_id", "n", "k1", "k2", "g1", "g2", "tokens", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, times = table.value
        for block in blocks(batches, "text", _BLOCK_BYTES):
            key, bounds = shingle_sets(texts_of(block))
            n = np.diff(bounds)
            owner = np.repeat(np.arange(block.num_rows), n)
            often = np.zeros(len(key), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                often = np.where(hot[at] == key, times[at], 0)
            order = np.lexsort((key, often, owner))
            rank = np.arange(len(key)) - np.repeat(bounds[:-1], n)
            keep = order[rank < np.repeat(_prefix_lengths(n), n)]
            offsets = np.concatenate([[0], np.cumsum(_prefix_lengths(n))])
            tokens, parts = key[keep], 1 + often[keep] // BUCKET_MEMBERS
            split = np.add.reduceat(np.append(parts > 1, False), offsets[:-1]) * (np.diff(offsets) > 0) > 0
            at = pa.array(offsets.astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(tokens.view(np.int64)))
            whole = pa.ListArray.from_arrays(at, pa.array(parts.astype(np.int32)), mask=pa.array(~split))
            columns = [*map(pa.array, _set_keys(key, bounds)), *map(pa.array, _set_keys(tokens, offsets))]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n), *columns, lists, whole], names)

    return _two(docs).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, g1 long, g2 long, tokens array<long>, parts array<int>")


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A bounded filter that holds all nodes, and perhaps more."""
    low, high = _FILTER_WORDS
    size = 1 << int(np.clip(nodes.count() // 4, low, high) - 1).bit_length()
    bits = nodes.select(F.pmod(F.xxhash64("node"), F.lit(size * 64)).alias("bit"))
    words = bits.select(F.expr("bit div 64").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.view(np.uint64)


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, k1, k2, members: whole sets (eight bytes an element) of the nodes, and perhaps of more, read from their documents."""
    wanted = _wanted(nodes)
    table = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            held = (table.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
            for block in blocks([batch.filter(pa.array(held == 1))], "text", _BLOCK_BYTES):
                key, bounds = shingle_sets(texts_of(block))
                raw, b = key.tobytes(), (8 * bounds).tolist()
                sets = [raw[x:y] for x, y in zip(b[:-1], b[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([block.column(0), *map(pa.array, _set_keys(key, bounds)), pa.array(sets, pa.binary())], ["node", "k1", "k2", "members"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(len(wanted) * 64)).alias("bit")
    found = _two(docs).where("doc_id is not null").select("doc_id", "text", bit).mapInArrow(run, "node long, k1 long, k2 long, members binary")
    return found.dropDuplicates(["node", "k1", "k2"])


def linked(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Whether each two of the sets are similar; side: 0 and 1 for the blocks, of which only members of different ones
    are compared, or all 0, where all are."""
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    held = np.diff(np.r_[start, len(flat)])
    column = np.repeat(np.where(held > 1, np.cumsum(held > 1) - 1, -1), held)
    owner, column = owner[column >= 0], column[column >= 0]
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if (side == 1).any() else one
    common = np.zeros((len(one), len(two)), np.int64)
    step = max(1, _DENSE // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        table = np.zeros((len(sets), min(step, int(column[b - 1]) - low + 1)), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        common += (table[one] @ table[two].T).astype(np.int64)
    out = np.zeros((len(sets), len(sets)), bool)
    out[np.ix_(one, two)] = 100 * common >= PERCENT * (size[one][:, None] + size[two][None, :] - common)
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _reached(node: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The smallest node that each one reaches over the links."""
    least = node.copy()
    while True:
        now = np.minimum(least, np.where(link, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (now == least).all():
            return least
        least = now


class Join:
    """Tables of one join over docs (doc_id, text): `names` of all rows, `members` (nodes that may have links), `cells`, and
    `met`, the links of each cell's members, or with `pairs` each link."""

    def __init__(self, docs: DataFrame, pairs: bool = False) -> None:
        docs = docs.where("doc_id is not null")
        rows = prefixes(docs, frequent_shingles(docs)).withColumn("row", F.monotonically_increasing_id())
        rows = written(rows, "prefixes")
        self.names = written(rows.select("row", "doc_id", "n", "k1", "k2", "g1", "g2"), "set-names")
        postings = written(self._shared(rows, self.names), "joined-postings")
        discard(rows)
        group = ["g", "n", "band", "family"]
        found = postings.select("g", "band", "family").distinct().withColumnRenamed("g", "row")
        groups = self.names.join(found, "row").select(F.col("row").alias("g"), "n", "g1", "g2", "band", "family")
        nodes = self.names.where("n > 0").groupBy("n", "k1", "k2", "g1", "g2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        self.members = written(nodes.join(groups, ["n", "g1", "g2"]).select(*group, "node", "k1", "k2", "copies"), "members")
        self.cells = written(self._cells(self._meetings(postings)), "cells")
        discard(postings)
        self.met = written(self._verified(docs, pairs), "links")

    @staticmethod
    def _shared(rows: DataFrame, names: DataFrame) -> DataFrame:
        """g, n, band, token, family: elements of the groups' prefixes that a group of fitting size holds as well, of groups that
        have enough of them; and all of a group of several sets. A group is named by one of its rows; sizes that fit lie in
        one band or in neighbouring ones."""
        alike = F.expr("min(k1) = max(k1) and min(k2) = max(k2)").alias("alike")
        groups = names.where("n > 0").groupBy("n", "g1", "g2").agg(F.min(F.struct("doc_id", "row")).alias("x"), alike, F.count(F.lit(1)).alias("size"))
        # what is not said about a row holds: it is the only one of its group
        more = written(groups.where("size > 1").select("n", "g1", "g2", F.col("x.row").alias("first"), "alike"), "groups")
        marks = names.join(more, ["n", "g1", "g2"]).select("row", (F.col("row") != F.col("first")).alias("drop"), (~F.col("alike")).alias("several"))
        marks = written(marks, "marks")  # its size is known then, so that few marks don't shuffle all prefixes
        kept = rows.where("n > 0").join(marks, "row", "left").where("coalesce(not drop, true)")
        listed = kept.select(F.col("row").alias("g"), "n", F.coalesce("several", F.lit(False)).alias("several"), F.col("parts").alias("all"), F.posexplode("tokens").alias("at", "token"))
        parts = F.coalesce(F.element_at("all", F.col("at") + 1), F.lit(1))
        listed = listed.select("g", "n", "several", "token", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("g"), "parts"))
        near = Window.partitionBy("token", "part").orderBy("band").rangeBetween(-1, 1)
        listed = listed.withColumn("band", F.floor(F.log("n") / F.lit(_BAND)).cast("int")).withColumn("held", F.count(F.lit(1)).over(near))
        # a split list is taken to be shared
        shared = listed.where("held > 1 or parts > 1 or several").select("g", "n", "band", "token", (F.col("held") * F.col("parts")).alias("heat"))
        own = Window.partitionBy("g")
        shared = shared.withColumn("c", F.count(F.lit(1)).over(own)).withColumn("family", F.max(F.struct("heat", "token")).over(own)["token"])
        return shared.where(_enough("c", "n")).select("g", "n", "band", "token", "family")

    @staticmethod
    def _meetings(postings: DataFrame) -> DataFrame:
        """g, other, other_band: the parts of families, by size, whose prefixes share enough elements with a group's; those of
        its own family are among them."""
        families = postings.select(F.col("token").alias("held"), F.col("family").alias("other"), F.col("band").alias("other_band")).distinct()
        met = postings.join(families, F.expr("token = held and family != other and abs(band - other_band) <= 1")).groupBy("g", "n", "other", "other_band").agg(F.count(F.lit(1)).alias("c"))
        own = postings.select("g", "family", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).distinct()
        return met.where(_enough("c", "n")).select("g", "other", "other_band").union(own)

    def _cells(self, near: DataFrame) -> DataFrame:
        """x, y, side, node, k1, k2, copies: which members meet in the cell of blocks x and y, side 0 being those of x."""
        sizes = self.members.groupBy("family", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        blocks_of = sizes.select("family", "band", F.greatest(F.ceil(F.col("c") / CELL_NODES), F.ceil(F.col("s") / CELL_SHINGLES)).cast("int").alias("m"))
        turn = F.pmod(F.xxhash64("node", "k1", F.lit(7)), F.col("m").cast("long"))
        own = self.members.join(blocks_of, ["family", "band"]).select("g", "node", "k1", "k2", "copies", F.xxhash64("family", "band", turn).alias("p"))
        others = blocks_of.select("family", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).alias("turn"))
        others = others.select(F.col("family").alias("other"), F.col("band").alias("other_band"), F.xxhash64("family", "band", "turn").alias("q"))
        met = own.join(near, "g").join(others, ["other", "other_band"])
        side = (F.col("p") > F.col("q")).cast("int").alias("side")
        entries = met.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), side, "node", "k1", "k2", "copies")
        cell = Window.partitionBy("x", "y")
        counted = entries.withColumn("c", F.count(F.lit(1)).over(cell)).withColumn("c1", F.sum("side").over(cell))
        return counted.where("if(x = y, c > 1, c1 > 0 and c1 < c)").drop("c", "c1")

    def _verified(self, docs: DataFrame, pairs: bool) -> DataFrame:
        """node, k1, k2, links, root: each cell's members with links, by their copies, and the smallest node that they reach.
        With pairs: a, b of each link."""
        sets = node_sets(docs, self.cells.select("node").distinct())
        rows = sets.join(self.cells, ["node", "k1", "k2"]).select("x", "y", "side", "node", "k1", "k2", "copies", "members")
        names = ["a", "b"] if pairs else ["node", "k1", "k2", "links", "root"]

        def settled(held: list[tuple]) -> list[np.ndarray]:
            side, node, k1, k2, copies = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[2:7])
            link = linked([np.frombuffer(r[7], np.uint64) for r in held], side)
            if pairs:
                a, b = (node[x] for x in np.nonzero(np.triu(link)))
                return [np.minimum(a, b), np.maximum(a, b)]
            root, some = _reached(node, link), link.any(axis=1)
            return [c[some] for c in (node, k1, k2, link @ copies, root)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and row[:2] != held[0][:2]:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, settled(held))), names)
                        held = []
                    held.append(row)
            if held:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, settled(held))), names)

        return rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(run, ", ".join(f"{x} long" for x in names))

    def classes(self) -> DataFrame:
        """n, k1, k2, component_id, n_links of every distinct set."""
        groups = components(self.met.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        links = self.met.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
        own = self.names.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        own = own.join(groups, "node", "left").join(links, ["k1", "k2"], "left")
        n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
        return own.select("n", "k1", "k2", F.coalesce("component", "node").alias("component_id"), n_links.alias("n_links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row: how many other rows are similar to it.

    A text without words (or null) has no shingles, is a component of its own and has
    no links; one of fewer words than a shingle has is one shingle. Rows with equal
    sets are linked. Rows that share a doc_id are judged each by its own text, and
    meet in one component if they stand for their sets. A null doc_id takes no part.
    Empty tables give no rows.
    """
    join = Join(docs)
    classes = written(join.classes(), "classes")  # written before they are joined, so that the join can split a set of very many rows
    with_set = join.names.where("n > 0").join(classes, ["n", "k1", "k2"])
    with_set = with_set.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    bare = join.names.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return with_set.unionByName(bare)


def similar_pairs(docs: DataFrame) -> DataFrame:
    """a, b: every two different sets that reach the similarity, each named by its smallest doc_id, a <= b.

    Pairs grow with the square of a family of near copies; near_duplicates counts the same links without listing them.
    """
    return Join(docs, pairs=True).met


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_links of every row with a doc_id: how many other rows are similar to it, rows with an equal set among them."""
    return near_duplicates(docs).select("doc_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of each component whose doc_id is the smallest, all columns as they are.

    Of repeated rows (same doc_id and text) one stays. Rows without a doc_id stay.
    """
    root, text = fresh(docs, "root"), fresh(docs, "text")
    kept = near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias(root)).distinct()
    found = docs.join(kept, F.col("doc_id").cast("long") == F.col(root), "left_semi")
    once = found.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return once.unionByName(docs.where("doc_id is null"))


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
             else [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] end) as set from w),
t as (select doc_id, len(set) as n, unnest(set) as x from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb
      from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c where 100 * common >= 80 * (na + nb - common)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from s union select e.b, r.root from r join e on r.doc_id = e.a)
select s.doc_id, len(set)::bigint as n_shingles, min(root) as component_id, (select count(*) from e where e.a = s.doc_id)::bigint as n_links
from s join r using (doc_id) group by 1, 2
"""
