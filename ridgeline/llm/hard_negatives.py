"""Hard negatives by a dual-tree search: ball trees over anchors and candidates, node pairs dropped by their inner-product intervals.

The upper tree is fitted to a bounded sample and every row goes down it; its nodes' radii are taken over all rows.
Pairs of nodes whose interval cannot matter are never joined, the rest are cells of bounded size.  Within a cell, finer
trees are walked together, best interval first, and pairs of leaves are scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import arrow_map, below_share, materialise, schema_of, small_side
from .vectors import finite_rows, matrix, written_rows

#: Rows of the sample that splits the upper tree, about, and levels of it at most.
SAMPLE_ROWS, LEVELS = 16_384, 10
#: Rows of a node of anchors, of a block of candidates, and of the leaves of a cell's trees, about.
ANCHOR_ROWS, BLOCK_ROWS, ANCHOR_LEAF, BLOCK_LEAF = 1024, 4096, 32, 128
#: The score of nothing.
NONE = -(2**63 - 1)
NO_ID = 2**63 - 1


def whole(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) as int64, cut off where products of rows would not fit a bigint."""
    top = int((2**62 / max(x.shape[1], 1)) ** 0.5)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * factor), -top, top).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by float64, which is faster, where it rounds nothing."""
    if max(a.shape[1], 1) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def split(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction and the place on it that cut rows in two.

    It points from the row farthest from the mean to the one farthest from that.  The cut is midway between both, which keeps groups
    together, or at the median where less than an eighth of the rows would lie on a side.
    """
    far = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    direction = x[((x - far) ** 2).sum(axis=1).argmax()] - far
    along, cut = x @ direction, float((far + direction / 2) @ direction)
    share = (along >= cut).mean()
    return direction, cut if 0.125 <= share <= 0.875 else float(np.median(along))


@dataclass
class Upper:
    """A complete binary tree, node k's children 2k + 1 and 2k + 2; centres are means of the sample's rows."""

    levels: int
    directions: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, levels: int) -> Upper:
        inner, dims = (1 << levels) - 1, x.shape[1]
        tree = cls(levels, np.zeros((inner, dims)), np.zeros(inner), np.zeros((2 * inner + 1, dims)))
        rows = {0: x}
        for node in range(2 * inner + 1):
            own = rows.pop(node)
            tree.centres[node] = own.mean(axis=0) if len(own) else tree.centres[(node - 1) // 2]
            if node < inner:
                if len(own):
                    tree.directions[node], tree.cuts[node] = split(own)
                right = own @ tree.directions[node] >= tree.cuts[node]
                rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        return tree

    def paths(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The node of each row, level by level."""
        node = np.zeros(len(x), dtype=np.int64)
        yield node
        for _ in range(self.levels):
            node = 2 * node + 1 + ((x * self.directions[node]).sum(axis=1) >= self.cuts[node])
            yield node


def interval(a: np.ndarray, a_radius: float, b: np.ndarray, b_radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of a point of one ball and a point of the other lie between these; b may be many centres."""
    middle = b @ a
    a_size, b_size = np.sqrt(a @ a), np.sqrt((b * b).sum(axis=-1))
    reach = (a_size * b_radius + b_size * a_radius + a_radius * b_radius) * (1 + 1e-9) + 1e-9 * a_size * b_size
    return middle - reach, middle + reach


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node]

    @classmethod
    def over(cls, x: np.ndarray, rows: np.ndarray, leaf: int) -> Node:
        own = x[rows]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        children = []
        if len(rows) > leaf and radius > 0:
            direction, cut = split(own)
            right = own @ direction >= cut
            if right.any() and not right.all():
                children = [cls.over(x, part, leaf) for part in (rows[~right], rows[right])]
        return cls(rows, centre, radius, children)


class Side:
    """Rows of a cell, ordered by id so that ties fall to the smaller one; a large radius-0 node stays one leaf."""

    def __init__(self, t: pa.Table, dims: int, factor: int, leaf: int):
        t = t.sort_by([("vec_id", "ascending"), ("n", "ascending")])
        self.n, self.ids, self.labels = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "vec_id", "label"))
        self.x, self.table = whole(matrix(t.column("v"), dims), factor), t
        self.root = Node.over(self.x.astype(np.float64), np.arange(len(self.n)), leaf)


def walk(a: Node, b: Node, wanted: Callable[[np.ndarray, float, float], bool], score: Callable[[np.ndarray, np.ndarray], None]) -> int:
    """Score the pairs of leaves whose interval is still wanted, highest intervals first; gives how many pairs of rows that were."""

    def pair(x: Node, y: Node) -> tuple:
        low, high = interval(x.centre, x.radius, y.centre, y.radius)
        return -float(high), id(x), id(y), float(low), x, y

    heap, scored = [pair(a, b)], 0
    while heap:
        high, _, _, low, x, y = heapq.heappop(heap)
        if not wanted(x.rows, low, -high):
            continue
        if x.children and (not y.children or x.radius >= y.radius):
            for child in x.children:
                heapq.heappush(heap, pair(child, y))
        elif y.children:
            for child in y.children:
                heapq.heappush(heap, pair(x, child))
        else:
            scored += len(x.rows) * len(y.rows)
            score(x.rows, y.rows)
    return scored


def merged(best: np.ndarray, ids: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's two lists the first entries, by falling score, then by id, as many as `best` has."""
    s, i = np.concatenate([best, new], axis=-1), np.concatenate([ids, new_ids], axis=-1)
    order = np.lexsort((i, -s), axis=-1)[..., : best.shape[-1]]
    return np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


def first_of(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to the earlier column, and their ids; NONE and NO_ID where there are fewer."""
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    got = np.take_along_axis(s, order, 1)
    return filled(got, np.where(got == NONE, NO_ID, ids[order]), k)


def filled(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    lack = ((0, 0), (0, k - s.shape[1]))
    return np.pad(s, lack, constant_values=NONE), np.pad(ids, lack, constant_values=NO_ID)


def positives_in(a: Side, b: Side, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows of each anchor's label, other ids than its own, and the pairs scored."""
    best, ids = np.full((len(a.n), k), NONE), np.full((len(a.n), k), NO_ID)

    def score(x: np.ndarray, y: np.ndarray) -> None:
        s = scores(a.x[x], b.x[y])
        s[(a.labels[x, None] != b.labels[y]) | (a.ids[x, None] == b.ids[y])] = NONE
        best[x], ids[x] = merged(best[x], ids[x], *first_of(s, b.ids[y], k))

    scored = walk(a.root, b.root, lambda rows, low, high: high >= best[rows, -1].min(), score)
    return best, ids, scored


def negatives_in(a: Side, b: Side, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each anchor and each of its bands of scores, least to most, the k best rows of other labels within it."""
    shape = (*least.shape, k)
    best, ids = np.full(shape, NONE), np.full(shape, NO_ID)

    def wanted(rows: np.ndarray, low: float, high: float) -> bool:
        return bool(((np.maximum(least[rows], best[rows, :, -1]) <= high) & (most[rows] >= low) & (least[rows] <= most[rows])).any())

    def score(x: np.ndarray, y: np.ndarray) -> None:
        s = scores(a.x[x], b.x[y])
        s[a.labels[x, None] == b.labels[y]] = NONE
        order = np.argsort(-s, axis=1, kind="stable")
        s = np.take_along_axis(s, order, 1)
        for band in range(least.shape[1]):
            start = (s > most[x, band, None]).sum(axis=1)
            at = np.minimum(start[:, None] + np.arange(k), s.shape[1] - 1)
            got = np.take_along_axis(s, at, 1)
            inside = (start[:, None] + np.arange(k) < s.shape[1]) & (got >= least[x, band, None]) & (got != NONE)
            got_ids = np.where(inside, b.ids[y][np.take_along_axis(order, at, 1)], NO_ID)
            best[x, band], ids[x, band] = merged(best[x, band], ids[x, band], np.where(inside, got, NONE), got_ids)

    return best, ids, walk(a.root, b.root, wanted, score)


class Search:
    """The rows in blocks of the upper tree's leaves, the anchors in its nodes of a higher level, and which pairs may meet."""

    def __init__(self, df: DataFrame, anchors, factor: int, id_col: str, vector_col: str, label_col: str):
        valid = finite_rows(df, id_col, vector_col, label_col).where("vec_id IS NOT NULL AND label IS NOT NULL").withColumn("label", F.col("label").cast("string"))
        rows, self.count, self.dims = written_rows(valid, "vectors")
        self.factor = factor
        asked = rows.where(anchors).count()
        depth = lambda n, per: min(LEVELS, max(0, (n // per).bit_length()))
        self.block_level = depth(self.count, BLOCK_ROWS)
        self.anchor_level = min(depth(asked, ANCHOR_ROWS), self.block_level)
        sample = below_share(rows.withColumn("h", F.xxhash64("n")), SAMPLE_ROWS / max(self.count, 1), "h").select("v").toArrow()
        self.tree = Upper.fit(self.integers(sample.column("v")).astype(np.float64), self.block_level)
        self.rows = self.placed(rows, anchors)
        self.radii = self.measured()

    def integers(self, column) -> np.ndarray:
        return whole(matrix(column, self.dims), self.factor)

    def placed(self, rows: DataFrame, anchors) -> DataFrame:
        """node (of the anchors' level), leaf, and the row's distances from their centres; salt cuts leaves into blocks and nodes into groups."""

        def place(batch: pa.RecordBatch) -> dict:
            x = self.integers(batch.column("v")).astype(np.float64)
            nodes = list(self.tree.paths(x))
            away = lambda at: np.sqrt(((x - self.tree.centres[at]) ** 2).sum(axis=1))
            node, leaf = nodes[self.anchor_level], nodes[self.block_level]
            return {c: batch.column(c) for c in ("n", "vec_id", "label", "v", "asked")} | {"node": node, "leaf": leaf, "from_node": away(node), "from_leaf": away(leaf)}

        kind = rows.select("v").dtypes[0][1]
        out = arrow_map(rows.withColumn("asked", anchors), place, f"n bigint, vec_id bigint, label string, v {kind}, asked boolean, node bigint, leaf bigint, from_node double, from_leaf double", rows=8192)
        return materialise(out, "placed")

    def measured(self) -> DataFrame:
        """Per pair of an anchor node and a leaf: the interval of their inner products, and into how many groups and blocks each is cut.

        Both are nodes of the upper tree, whose levels are bounded, so this is a bounded table.
        """
        of_leaf = self.rows.groupBy("leaf").agg(F.max("from_leaf").alias("radius"), F.count(F.lit(1)).alias("rows")).orderBy("leaf").collect()
        of_node = self.rows.where("asked").groupBy("node").agg(F.max("from_node").alias("radius"), F.count(F.lit(1)).alias("rows")).collect()
        c = self.tree.centres
        leaves, radii = c[[r.leaf for r in of_leaf]], np.array([r.radius for r in of_leaf])
        found = []
        for a in of_node:
            low, high = interval(c[a.node], a.radius, leaves, radii) if of_leaf else ([], [])
            nearest = int(np.argmax(leaves @ c[a.node]))
            found += [
                (a.node, b.leaf, float(x), float(y), -(-a.rows // ANCHOR_ROWS), -(-b.rows // BLOCK_ROWS), i == nearest) for i, (b, x, y) in enumerate(zip(of_leaf, low, high, strict=True))
            ]
        return self.rows.sparkSession.createDataFrame(found, "node bigint, leaf bigint, low double, high double, groups int, blocks int, seed boolean")

    def group(self, salts: str):
        """Which of so many parts a row falls into; rows are numbered, so that copies spread."""
        return F.pmod(F.xxhash64("n"), F.col(salts)).cast("int")

    def anchors(self) -> DataFrame:
        of_node = self.radii.select("node", "groups").distinct()
        return self.rows.where("asked").join(F.broadcast(of_node), "node").withColumn("group", self.group("groups")).select("node", "group", "n", "vec_id", "label", "v")

    def pairs(self) -> DataFrame:
        """node, group, leaf, block, low, high, seed: all that could meet; a seed is one block, of the leaf nearest to the node."""
        some = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        groups = self.radii.select("*", some("groups").alias("group"))
        out = groups.select("node", "group", "leaf", some("blocks").alias("block"), "low", "high", "seed")
        return out.withColumn("seed", F.col("seed") & (F.col("block") == 0))

    def cells(self, pairs: DataFrame, anchors: DataFrame, fn: Callable[[Side, Side], dict], ddl: str) -> DataFrame:
        """fn over the anchors of a group and the candidates of a block, for each of the pairs (node, group, leaf, block)."""
        of_leaf = self.radii.select("leaf", "blocks").distinct()
        blocks = self.rows.join(F.broadcast(of_leaf), "leaf").withColumn("block", self.group("blocks")).select("leaf", "block", "n", "vec_id", "label", "v")
        pairs = small_side(materialise(pairs.select("node", "group", "leaf", "block"), "node-pairs"))
        left, right = anchors.join(pairs, ["node", "group"]), blocks.join(pairs, ["leaf", "block"])
        schema, dims, factor = to_arrow_schema(schema_of(ddl)), self.dims, self.factor

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return schema.empty_table()
            return pa.table(fn(Side(a, dims, factor, ANCHOR_LEAF), Side(b, dims, factor, BLOCK_LEAF)), schema=schema)

        left = left.toDF(*left.columns)  # both sides come from one table
        key = ("node", "group", "leaf", "block")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, ddl)


def positives_of(search: Search, anchors: DataFrame, k: int) -> DataFrame:
    """n, vec_id, node, group, at, positive_id, positive_score: each anchor's k best rows of its own label, of other ids."""

    def best(a: Side, b: Side) -> dict:
        s, ids, _ = positives_in(a, b, k)
        return {"n": a.n, "vec_id": a.ids, "node": a.table.column("node"), "group": a.table.column("group"), "scores": s.tolist(), "ids": ids.tolist()}

    ddl = "n bigint, vec_id bigint, node bigint, group int, scores array<bigint>, ids array<bigint>"
    seeds = materialise(search.cells(search.pairs().where("seed"), anchors, best, ddl), "positives")
    bounds = materialise(seeds.groupBy("node", "group").agg(F.min(F.element_at("scores", k)).alias("bound")), "bounds")
    rest = search.pairs().where("NOT seed").join(small_side(bounds), ["node", "group"], "left").where("bound IS NULL OR high >= bound")
    both = seeds.union(search.cells(rest, anchors, best, ddl))
    each = both.select("n", "vec_id", "node", "group", F.explode(F.arrays_zip("scores", "ids")).alias("x"))
    each = each.where(F.col("x.scores") != NONE).select("n", "vec_id", "node", "group", F.col("x.ids").alias("positive_id"), F.col("x.scores").alias("positive_score"))
    at = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("positive_score"), "positive_id"))
    return materialise(each.withColumn("at", at).where(F.col("at") <= k), "positives")


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent of 100 of the scores, rounded up or down, without a product that could be too large."""
    q, r = np.divmod(score, 100)
    return percent * q + (-(-percent * r // 100) if up else percent * r // 100)


def mine(df: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; scores are inner products of floor(factor * x).  A positive is
    one of the first `positives` rows of the anchor's label; its negatives are the first `negatives` rows of other labels whose score lies between
    low and high percent of the positive's.  Higher scores come first, ties by the smaller id.  The result is exact.

    Null ids, labels and vectors, and vectors with null or non-finite components, take no part; shorter vectors count as
    filled up with zeros.  Rows of the anchor's own id are not its positives; if an id is repeated, each of its rows is
    an anchor and a candidate of its own.  Integers are cut off where a product of rows would not fit a bigint (at 2**28
    for 64 positions).  A positive without negatives gives no row, nor does an empty table.
    """
    search = Search(df, F.col("vec_id") % every == 0, factor, id_col, vector_col, label_col)
    anchors = search.anchors()
    found = positives_of(search, anchors, positives)

    score = F.col("positive_score").cast("double")
    ranges = found.where("positive_score >= 0").groupBy("node", "group").agg((F.min(score) * low / 100 - 1).alias("least"), (F.max(score) * high / 100 + 1).alias("most"))
    met = search.pairs().join(small_side(materialise(ranges, "ranges")), ["node", "group"]).where((F.col("high") >= F.col("least")) & (F.col("low") <= F.col("most")))
    bands = found.where("positive_score >= 0").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("bands"))  # `positives` at most

    def worst(a: Side, b: Side) -> dict:
        own = a.table.column("bands").to_pylist()
        count = [len(x) for x in own]
        padded = [x + [{"at": 0, "positive_id": NO_ID, "positive_score": -1}] * (positives - len(x)) for x in own]
        at, ids, of = (np.array([[y[c] for y in x] for x in padded], dtype=np.int64) for c in ("at", "positive_id", "positive_score"))
        there = np.arange(positives) < np.array(count)[:, None]
        least, most = np.where(there, share(of, low, True), 1), np.where(there, share(of, high, False), 0)
        best, best_ids, _ = negatives_in(a, b, least, most, negatives)
        i, j, m = np.nonzero(best != NONE)
        return {"n": a.n[i], "anchor_id": a.ids[i], "at": at[i, j], "positive_id": ids[i, j], "positive_score": of[i, j], "negative_id": best_ids[i, j, m], "negative_score": best[i, j, m]}

    out = search.cells(met, anchors.join(bands, "n"), worst, "n bigint, anchor_id bigint, at int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("n", "at").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """WITH rows AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.n, c.n AS other, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score FROM rows a JOIN rows c ON a.vec_id % 50 = 0
), positives AS (
  SELECT n, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM scored WHERE same AND anchor_id <> vec_id) WHERE place <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.n, p.other ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON p.n = s.n AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""
