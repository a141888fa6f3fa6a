"""Nearest neighbours by a block matrix join: int8 products with error bounds, then exact distances.

Method: candidate rows and queries are dealt into blocks, and each pair of blocks meets in one tile. Vectors are
quantised to int8 with a scale each, so that a tile is one product of small integers; how far a quantised vector is
from the original bounds the error of every distance. A candidate survives in its tile unless its least possible
distance is above the k-th smallest greatest-possible one; survivors' distances are computed in double precision,
each tile keeps its k best by a heap, and the tiles' heaps merge into one for each query. Results are exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids or, of one call, vectors whose length differs from the query's; repeated ids are candidates each, and each row of a
query's id is a query with ranks of its own; a query never meets rows of its own id; ties go to the smaller id; an
empty table gives an empty result; columns other than vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = "query long, query_id long, vec_id long, score double, c int"
#: Blocks whose heaps merge in one group.
FAN = 64
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, each row's scale, and the distance between row and quantised row (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    off = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-300
    return q, scale, off


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sums of int8 products: float matrix products while the sums fit their mantissas."""
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def tile_neighbours(query_ids, queries, ids, vectors, k: int, step: int = 4096):
    """For each query of a tile, its k nearest candidates as (place of the query, vec_id, score)."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    q, qs, qo = quantised(queries)
    q2 = (q.astype(np.int64) ** 2).sum(axis=1) * qs**2
    for a in range(0, len(ids), step):
        part, own = vectors[a : a + step], ids[a : a + step]
        c, cs, co = quantised(part)
        c2 = (c.astype(np.int64) ** 2).sum(axis=1) * cs**2
        near = np.sqrt(np.maximum(q2[:, None] + c2 - 2 * products(q, c) * qs[:, None] * cs, 0))
        slack = qo[:, None] + co + 1e-7 * (np.sqrt(q2)[:, None] + np.sqrt(c2))
        high = near + slack
        other = own[None, :] != query_ids[:, None]
        high[~other] = np.inf
        bound = np.partition(high, k - 1, axis=1)[:, k - 1] if len(own) >= k else np.full(len(q), np.inf)
        for i in range(len(q)):
            limit = min(bound[i], -heaps[i][0][0] if len(heaps[i]) == k else np.inf)
            survivors = np.flatnonzero(other[i] & (near[i] - slack[i] <= limit))
            exact = distances(queries[i], part[survivors])
            best = np.lexsort((own[survivors], exact))[:k]  # however many are equally near, the heap needs no more
            for d, v in zip(exact[best].tolist(), own[survivors[best]].tolist(), strict=True):
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], (-d, -v))
                elif (-d, -v) > heaps[i][0]:
                    heapq.heapreplace(heaps[i], (-d, -v))
                else:
                    break
    return [(i, -v, -s) for i, h in enumerate(heaps) for s, v in sorted(h, reverse=True)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of a to rows of b, components added in order."""
    d = b - a
    return np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row of vectors (vec_id, embedding) that is_query picks.

    block: rows of a side of a tile; numbers of blocks follow the number of rows, so a tile's size does not grow.
    """
    # A number for each row, so that rows of one id are apart, and rows that are alike in all spread over the blocks.
    rows = usable(vectors).withColumn("at", F.monotonically_increasing_id())
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // block))
    dealt = lambda parts: F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int")
    candidates = rows.withColumn("c", dealt(blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.filter(is_query).withColumn("q", dealt(query_blocks)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(tile: pa.Table) -> pa.Table:
        out = []
        asks = tile.column("asks")
        sides = [_by_length(tile.filter(x)) for x in (pc.invert(asks), asks)]
        for size in sides[0].keys() & sides[1].keys():
            (ids, _, x), (query_ids, at, y) = sides[0][size], sides[1][size]
            out += [(int(at[i]), int(query_ids[i]), v, s) for i, v, s in tile_neighbours(query_ids, y, ids, x, k)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        c = tile.column("c")[0].as_py()
        return pa.table([*(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)), pa.array([c] * len(out), pa.int32())], ["query", "query_id", "vec_id", "score", "c"])

    both = candidates.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    tiles = both.groupBy("c", "q").applyInArrow(meet, TILE)

    def best(group: pa.Table) -> list[tuple[float, int]]:
        return heapq.nsmallest(k, zip(group.column("score").to_pylist(), group.column("vec_id").to_pylist(), strict=True))

    def merge_some(group: pa.Table) -> pa.Table:
        score, vec_id = zip(*best(group), strict=True)
        first = group.slice(0, len(score))
        return pa.table([first.column("query"), first.column("query_id"), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64()), first.column("c")], ["query", "query_id", "vec_id", "score", "c"])

    def merge(group: pa.Table) -> pa.Table:
        score, vec_id = zip(*best(group), strict=True)
        first = group.slice(0, len(score))
        return pa.table([first.column("query_id"), pa.array(range(1, len(score) + 1), pa.int32()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())], ["query_id", "rank", "vec_id", "score"])

    # A query meets each block once and gets k rows of it; a group merges those of FAN blocks at most.
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        tiles = tiles.withColumn("c", F.floor(F.col("c") / FAN).cast("int")).groupBy("query", "c").applyInArrow(merge_some, TILE)
    return tiles.groupBy("query").applyInArrow(merge, RESULT)


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, row numbers and vectors of each length."""
    if not table.num_rows:
        return {}
    ids, rows = table.column("vec_id").to_numpy(), table.column("at").to_numpy()
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat, at = lists.flatten().to_numpy(), np.cumsum(size) - size
    return {int(n): (ids[size == n], rows[size == n], flat[(at[size == n][:, None] + np.arange(n)).astype(np.int64)]) for n in np.unique(size)}
