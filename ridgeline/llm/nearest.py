"""Exact nearest neighbours by a block matrix join: int8 product tiles bound the products, survivors are recomputed, heaps merge."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import finite_rows, groups_for, matrix, written_rows

#: Rows of a group of queries and of one of candidates, at most, about; fewer than the least only if there are no more.
QUERY_ROWS, CANDIDATE_ROWS, LEAST_ROWS = 4096, 16_384, 512
#: Rows of a tile, and pairs that are recomputed at a time.
TILE_QUERIES, TILE_CANDIDATES, PAIRS = 512, 2048, 1 << 16


class Quantised:
    """Rows as int8 codes times a scale of their own, with the norm of what that leaves off."""

    def __init__(self, x: np.ndarray):
        self.scale = np.maximum(np.abs(x).max(axis=1, initial=0) / 127, 1e-300)
        self.code = np.rint(x / self.scale[:, None]).astype(np.int8)
        close = self.code * self.scale[:, None]
        with np.errstate(over="ignore"):
            self.size, self.rest = np.sqrt((close * close).sum(axis=1)), np.sqrt(((x - close) ** 2).sum(axis=1))


def bounds(a: Quantised, rows: slice, b: Quantised, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Below and above the inner products of a tile: the codes' product, give or take what Cauchy-Schwarz leaves for the rests.

    With x = close_x + rest_x, xy - close_x close_y = rest_x (close_y + rest_y) + close_x rest_y.  The product of codes is
    exact in float32 up to 1,040 dimensions, in float64 beyond; a billionth of the norms covers all rounding after it.
    """
    kind = np.float32 if a.code.shape[1] * 127 * 127 < 1 << 24 else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        near = (a.code[rows].astype(kind) @ b.code[columns].astype(kind).T) * a.scale[rows, None] * b.scale[columns]
        size, rest, other, other_rest = a.size[rows, None], a.rest[rows, None], b.size[columns], b.rest[columns]
        error = rest * (other + other_rest) + size * other_rest + 1e-9 * (size + rest) * (other + other_rest)
        low, high = near - error, near + error
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first position on, in double precision; one that is not a number counts as the least."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(x.shape[1]):
            total += x[:, at] * y[:, at]
    return np.where(np.isnan(total), -np.inf, total) + 0.0


class Heaps:
    """The k best candidates of each query: greatest score first, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.of = k, [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)  # what a score must reach

    def add(self, query: int, scores: list[float], ids: list[int]) -> None:
        heap = self.of[query]
        for x in zip(scores, (-i for i in ids), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, x)
            elif x > heap[0]:
                heapq.heapreplace(heap, x)
        if len(heap) == self.k:
            self.least[query] = heap[0][0]


def nearest_in(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int) -> tuple[Heaps, int]:
    """The heaps of a cell, and how many pairs were recomputed; queries and candidates are (ids, vectors)."""
    (q_ids, q), (c_ids, c) = queries, candidates
    a, b, heaps, recomputed = Quantised(q), Quantised(c), Heaps(len(q), k), 0
    for at in range(0, len(q), TILE_QUERIES):
        rows = slice(at, min(at + TILE_QUERIES, len(q)))
        for to in range(0, len(c), TILE_CANDIDATES):
            columns = slice(to, min(to + TILE_CANDIDATES, len(c)))
            low, high = bounds(a, rows, b, columns)
            own = q_ids[rows, None] == c_ids[columns]
            low[own] = -np.inf
            least = heaps.least[rows]
            if low.shape[1] >= k:
                least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
            i, j = np.nonzero((high >= least[:, None]) & ~own)
            recomputed += len(i)
            for part in range(0, len(i), PAIRS):
                x, y = i[part : part + PAIRS] + at, j[part : part + PAIRS] + to
                scores, ids = products(q[x], c[y]).tolist(), c_ids[y].tolist()
                first = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
                for start, end in zip(first, [*first[1:], len(x)], strict=True):
                    heaps.add(int(x[start]), scores[start:end], ids[start:end])
    return heaps, recomputed


def search(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by `every`, the k other rows of the largest inner product.

    Queries and candidates go into groups; each pair of groups is a cell, a task's work of bounded size, which gives
    k rows a query at most.  A window ranks them, after each task has dropped what cannot be among the first k.
    The result is exact, ties go to the smaller id.

    Null, zero or non-finite vectors and null ids take no part; shorter vectors count as filled up with zeros.  A query's own rows are
    all of its id; if an id is repeated, each of its rows is a query and a candidate of its own.  Sums that are not a
    number for overflow count as minus infinity.  With no other row, a query has no result; an empty table gives none.
    """
    valid = finite_rows(df, id_col, vector_col).where("vec_id IS NOT NULL AND exists(v, x -> x <> 0)")
    rows, count, dims = written_rows(valid, "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_queries = groups_for(asked.count(), 1, 1, QUERY_ROWS)
    of_candidates = groups_for(count, 2 * tasks, LEAST_ROWS, CANDIDATE_ROWS)
    group = lambda n: F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("n", "vec_id", "v", group(of_queries).alias("q"), all_of(of_candidates).alias("c"))
    right = rows.select("vec_id", "v", group(of_candidates).alias("c"), all_of(of_queries).alias("q"))

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({"n": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = lambda t: t.column("vec_id").to_numpy()
        heaps, _ = nearest_in((ids(queries), matrix(queries.column("v"), dims)), (ids(candidates), matrix(candidates.column("v"), dims)), k)
        of = np.repeat(np.arange(queries.num_rows), [len(h) for h in heaps.of])
        found = [x for h in heaps.of for x in h]
        return pa.table({"n": queries.column("n").to_numpy()[of], "query_id": ids(queries)[of], "vec_id": pa.array([-i for _, i in found], pa.int64()), "score": pa.array([s for s, _ in found], pa.float64())})

    right = right.toDF(*right.columns)  # both sides come from one table
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(cell, "n bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH rows AS (
  SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""
