"""Exact top-k by inner product over an impact-ordered index of integer vectors.

The index deals vectors into blocks. For each block, dimension and quantised
impact (the position of the highest bit of a component's magnitude) there is one
posting segment: the members whose component has that impact, with their values.
Members are distinct vectors; equal ones share their postings and list their ids.
A search takes a block's segments by descending impact in two tiers: the levels
that hold nearly all of the block's squares, scored for a group of queries by one
matrix product, and the rest. After the first tier the postings that are left can
move a score by no more than the query's magnitudes times the level's bound, and
by no more than the product of the norms of the query and of a vector's rest. Who
can't reach the k-th best score found so far is out; if too many stay, the second
tier is added. What stays is rescored exactly in whole numbers.

A cell is a bounded number of blocks. All groups of queries are dealt to each cell;
sorted in their partition, a cell's blocks come first and the groups pass by them
one after the other, so the k-th best of one block bounds the next. The best of
each cell are merged per query. Nothing is collected, broadcast or joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvtrail.llm.storage import written

#: Vectors in one block, and queries in one group.
BLOCK_VECTORS, GROUP_QUERIES = 4096, 256
#: A cell holds so many components at most (one block at least); there are so many cells, if there are as many blocks.
CELL_COMPONENTS, LEAST_CELLS = 64 * 4096 * 64, 32
#: The share of a block's squares that the first tier may leave.
REST = 1 / 512
#: Binary columns of the index, and the types of their numbers.
COLUMNS = {"ids": "<i8", "starts": "<i8", "impacts": "<i4", "dims": "<i4", "bounds": "<i8", "members": "<i4"}


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id, v: components floor(scale * x); rows with null ids or vectors, or null or non-finite components, go."""
    # nan is above infinity here, and a null leaves no true
    sound = F.coalesce(F.forall(vector_col, lambda x: F.abs(x.cast("double")) < float("inf")), F.lit(False))
    return vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _packed(rows: DataFrame, key, *names: str) -> DataFrame:
    """block, *names: the rows of each value of `key` as one row of arrays."""
    return rows.groupBy(key.alias("block")).agg(F.collect_list(F.struct(*names)).alias("m")).select("block", *(F.col(f"m.{n}").alias(n) for n in names))


def _by_width(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """(block, width, matrix, *arrays of the named columns) of the vectors of one length at a time; vectors of different lengths are never compared."""
    for k, block in enumerate(batch.column("block").to_pylist()):
        v, others = batch.column("v")[k].values, [batch.column(n)[k].values.to_numpy() for n in names]
        lengths, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
        for width in np.unique(lengths).tolist():
            pick = lengths == width
            yield block, width, flat[np.repeat(pick, lengths)].reshape(int(pick.sum()), width), *(x[pick] for x in others)


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold all of them."""
    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    return np.ascontiguousarray(matrix.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"))


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row per block and length of vectors: distinct vectors, the ids of each, and the posting segments by descending impact.

    segments: (impact, dim, local numbers of the members); the values are read from the vectors.
    """
    dealt = _packed(vectors, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, width, matrix, ids in _by_width(batch, "vec_id"):
                matrix, same = _narrow(matrix), np.zeros(len(ids), np.int64)
                if width:
                    _, first, same = np.unique(matrix.view(np.dtype((np.void, matrix.itemsize * width))).ravel(), return_index=True, return_inverse=True)
                    matrix = matrix[first]
                else:
                    matrix = matrix[:1]
                ids, starts = ids[np.lexsort((ids, same))], np.r_[0, np.cumsum(np.bincount(same))]
                impact = np.frexp(np.abs(matrix.astype(np.float64)))[1] - 1
                member, dim = np.nonzero(matrix)
                level = impact[member, dim].astype(np.int64)
                key = (63 - level) * width + dim  # a level is 0 to 63
                order = np.argsort(key.astype(np.uint16) if 64 * width <= 1 << 16 else key, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
                found = {"ids": ids, "starts": starts, "impacts": level[order][cut], "dims": dim[order][cut], "bounds": np.r_[cut, len(order)], "members": member[order]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([width], pa.int32()), pa.array([matrix.itemsize], pa.int32()), pa.array([matrix.tobytes()], pa.binary()), *(pa.array([found[n].astype(t).tobytes()], pa.binary()) for n, t in COLUMNS.items())],
                    ["block", "width", "item", "vectors", *COLUMNS],
                )

    return dealt.mapInArrow(run, "block int, width int, item int, vectors binary, " + ", ".join(f"{n} binary" for n in COLUMNS))


def _opened(row: dict) -> dict:
    """The arrays of an index row, with the first tier: its components and, in one more column, the norms of what it leaves."""
    found = {n: np.frombuffer(row[n], t) for n, t in COLUMNS.items()}
    width, bounds, members = row["width"], found["bounds"], found["members"]
    vectors = np.frombuffer(row["vectors"], f"<i{row['item']}").reshape(len(found["starts"]) - 1, width)
    dims = np.repeat(found["dims"], np.diff(bounds))
    values = vectors[members, dims].astype(np.float64)
    level = np.repeat(found["impacts"], np.diff(bounds))
    squares = np.cumsum(values**2)
    # the first tier ends with the level at which only the REST is left
    cut = int(np.searchsorted(-level, -level[np.searchsorted(squares, squares[-1] * (1 - REST))], "right")) if len(level) else 0
    high = np.zeros((len(vectors), width + 1), np.float32)
    high[members[:cut], dims[:cut]] = values[:cut]
    rest = np.sqrt(np.bincount(members[cut:], values[cut:] ** 2, len(vectors))) * (1 + 1e-6)
    high[:, width] = rest
    low = members[cut:], dims[cut:], values[cut:]
    return found | {
        "width": width, "vectors": vectors, "high": high, "low": low, "rest": float(rest.mean()), "ceiling": float(2.0 ** (level[cut] + 1)) if cut < len(level) else 0.0,
        "norm": float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max())), "largest": float(np.abs(vectors.astype(np.float64)).max(initial=0)), "most": int(np.unique(found["ids"], return_counts=True)[1].max()),
    }


def _exact(queries: np.ndarray, found: dict, who: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs in whole numbers, a bounded number of pairs at a time."""
    out, step = np.empty(len(who), np.int64), max(1, (1 << 21) // max(1, found["width"]))
    for at in range(0, len(who), step):
        out[at : at + step] = np.einsum("ij,ij->i", found["vectors"][member[at : at + step]].astype(np.int64), queries[who[at : at + step]])
    return out


def _rows(query_ids: np.ndarray, found: dict, who: np.ndarray, member: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, vec_id, score) of the first copies of each member, as many as k ranks can need, without the query's own."""
    first = found["starts"][member]
    count = np.minimum(found["starts"][member + 1] - first, k + found["most"])
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    who, ids, score = np.repeat(who, count), found["ids"][at], np.repeat(score, count)
    other = ids != query_ids[who]
    return who[other], ids[other], score[other]


def _best(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], ids[keep], score[keep]


def _kth(who: np.ndarray, score: np.ndarray, q: int, k: int) -> np.ndarray:
    """The k-th best score of each query, from what _best gives; no bound where there are fewer."""
    count, out = np.bincount(who, minlength=q), np.full(q, -np.inf)
    full = count == k
    out[full] = score[np.cumsum(count)[full] - 1]
    return out


def _at_least(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Flat places of the bounds that are not below their query's least; most are, so that eight are looked at together."""
    flat = (bound >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]).ravel()
    whole = len(flat) // 8 * 8
    at = np.r_[(np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))]
    return at[flat[at]]


def search_block(queries: np.ndarray, query_ids: np.ndarray, found: dict, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, vec_id, score) of a block's rows that can be among the best k, its own left out; least: scores that k rows of other blocks reach."""
    n, q, width = len(found["vectors"]), len(queries), found["width"]
    size = np.abs(queries.astype(np.float64))
    magnitude, norm = size.sum(1), np.sqrt((size**2).sum(1))
    if found["largest"] * magnitude.max() >= 2**53:  # no bounds in floating point: all members are scored
        hit = np.arange(n * q)
    else:
        slack = (width + 8) * 2.0**-22 * found["norm"] * norm + 1e-6  # more than all rounding of the single precision products
        by_level = found["ceiling"] * magnitude < found["rest"] * norm
        side = np.c_[queries, np.where(by_level, 0, norm)].astype(np.float32)
        bound = side @ found["high"].T
        if n > 2 * k and not np.isfinite(least).all():  # a first k-th best from the members with the highest bounds
            open_ = np.flatnonzero(~np.isfinite(least))
            seed = np.argpartition(bound[open_], n - 2 * k, axis=1)[:, n - 2 * k :].ravel()
            who = np.repeat(open_, 2 * k)
            who, _, score = _best(*_rows(query_ids, found, who, seed, _exact(queries, found, who, seed), k), k)
            least = np.maximum(least, _kth(who, score, q, k))
        hit = _at_least(bound, least - slack - np.where(by_level, found["ceiling"] * magnitude, 0))
        if found["ceiling"] and len(hit) > max(4 * k * q, n * q // 64):
            low = np.zeros_like(found["high"])
            low[found["low"][0], found["low"][1]] = found["low"][2]
            low[:, width] = -found["high"][:, width]
            hit = _at_least(bound + side @ low.T, least - slack)
    who, member = np.divmod(hit, n)
    score = _exact(queries, found, who, member)
    keep = score >= least[who]
    return _rows(query_ids, found, who[keep], member[keep], score[keep], k)


def _search_huge(queries: np.ndarray, query_ids: np.ndarray, found: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of a block in whole numbers of any size; what 64 bits can't hold counts as the largest or smallest number that they can."""
    who, ids, score = [], [], []
    vectors, starts, names = found["vectors"].tolist(), found["starts"].tolist(), found["ids"].tolist()
    for w, (query, own) in enumerate(zip(queries.tolist(), query_ids.tolist(), strict=True)):
        sums = [-sum(a * b for a, b in zip(v, query, strict=True)) for v in vectors]
        for s, i in sorted((sums[m], i) for m in range(len(vectors)) for i in names[starts[m] : starts[m + 1]] if i != own)[:k]:
            who, ids, score = [*who, w], [*ids, i], [*score, max(-(2**63), min(2**63 - 1, -s))]
    return np.array(who, np.int64), np.array(ids, np.int64), np.array(score, np.int64)


def _search_cell(queries: np.ndarray, query_ids: np.ndarray, blocks: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of a cell for each query; of blocks with scores that 64 bits can't hold, the best k of each."""
    magnitude = np.abs(queries.astype(np.float64)).sum(1).max()
    best = [np.zeros(0, np.int64)] * 3
    least = np.full(len(queries), -np.inf)
    huge = [found for found in blocks if found["largest"] * magnitude >= 2**62]
    for found in blocks:
        if found["largest"] * magnitude < 2**62:
            more = search_block(queries, query_ids, found, k, least)
            if len(more[0]):
                best = _best(*(np.concatenate(x) for x in zip(best, more, strict=True)), k)
                least = _kth(best[0], best[2], len(queries), k)
    return tuple(np.concatenate(x) for x in zip(best, *(_search_huge(queries, query_ids, found, k) for found in huge), strict=True))


def search(index: DataFrame, queries: DataFrame, blocks: int, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query; ties go to the smaller vec_id.

    A query finds fewer rows only if there are fewer vectors of its length. Repeated
    vec_ids are rows of their own, among the vectors and among the queries, each of which has its own
    ranks; all vectors with the query's vec_id are left out. Scores that 64 bits can't hold
    are as large or small as these can be. No queries or no vectors give no rows.
    """
    rows = written(queries.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    counted = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    packed = _packed(rows, F.pmod(F.xxhash64("row"), F.lit(max(1, -(-counted.n // GROUP_QUERIES)))), "vec_id", "row", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, width, matrix, ids, numbers in _by_width(batch, "vec_id", "row"):
                matrix = _narrow(matrix)
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([matrix.itemsize], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (matrix, ids, numbers))], ["width", "item", "vectors", "ids", "rows"])

    # every group meets every cell; the cells are few enough for the queries' copies, and small enough for a task
    per = max(1, min(-(-blocks // LEAST_CELLS), CELL_COMPONENTS // (BLOCK_VECTORS * max(1, counted.width or 0))))
    cells = -(-blocks // per)
    groups = packed.mapInArrow(pack, "width int, item int, vectors binary, ids binary, rows binary").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    held = index.withColumn("cell", F.floor(F.col("block") / per).cast("int"))
    # more partitions than cells, so that few of them share one; the blocks' numbers come before the groups' nulls
    met = held.unionByName(groups, allowMissingColumns=True).repartition(4 * cells, "cell").sortWithinPartitions("cell", F.asc_nulls_last("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != cell:
                    cell, held = row["cell"], []
                if row["block"] is not None:
                    held.append(_opened(row))
                    continue
                own, numbers, width = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8"), row["width"]
                vectors = np.frombuffer(row["vectors"], f"<i{row['item']}").reshape(len(own), width).astype(np.int64)
                who, ids, score = _search_cell(vectors, own, [x for x in held if x["width"] == width], k)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[who]), pa.array(own[who]), pa.array(ids), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_count(vectors: DataFrame) -> int:
    return max(1, -(-vectors.count() // BLOCK_VECTORS))


ORACLE_SQL = """
with v as (select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
           where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select *, row_number() over () as row from v where vec_id % 100 = 0),
s as (select q.row, q.vec_id as query_id, v.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.v, v.v)])::bigint as score
      from q join v on q.vec_id <> v.vec_id and len(q.v) = len(v.v)),
r as (select *, row_number() over (partition by row order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
