"""Exact Jaccard join of word-shingle sets, heavy-light by size.

Two sets of sizes n and m link when 100 * overlap >= percent * union, so their overlap is at least need(n, m).

Copies first: documents with one set are one class, known by the set's hash.  Then, by a boundary that a cost estimate
over the sizes chooses:

* light sets list all subsets that a link could leave in common (all but a few elements of a small set).
  Sets under one subset link exactly if it is large enough for their sizes, and if any two of them link, each links with
  the smallest, so one row a set is compared and no pairs are made;
* heavy sets, and light ones just below the boundary, are put in inverted lists of their n - least(n) + 1
  rarest shingles (any order common to all sets is exact; frequent shingles go last).  Parity sketches bound the symmetric
  difference from below, so a pair that a sketch excludes cannot link.  First each list is dealt into blocks, in one of two
  ways by its shingle.  A block of at most SHORT sets gives all its pairs, a longer one for each set the closest before and
  after it: at most SHORT pairs a set, which join groups of near copies of any size.  After these pairs are verified on the
  whole sets, the lists of over SHORT sets are scanned again: all pairs that share one and are in different components are
  compared and verified, so no link is lost.  There the largest component of a list meets the rest of the list, and never
  itself.

Hashes have 64 bits: two different shingles or sets are taken for one with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, arrow_map, clears_tables, fresh, frugal, highest, materialise, mix, rolling, schema_of, signed, small_side, text_hash, texts_of, word_hashes
from .components import components

PERCENT, WORDS = 80, 5
#: Rows of the blocks into which lists are dealt, in the first scan and in the second.
FIRST_BLOCK, BLOCK = 128, 512
#: Rows of a list up to which the first scan gives all its pairs, so that the second one passes it over.
SHORT = 16
#: Frequent shingles that the order of shingles knows at most; further ones only make lists longer.
FREQUENT = 1 << 18
LARGEST_LIGHT = 40
SCAN_COST = 8


class Threshold:
    """Links at percent or more of the union."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, n: int) -> int:
        """What a set of n must share with any set that it links with."""
        return -(-self.percent * n // 100)

    def need(self, both):
        """Overlap that sizes with this sum must have."""
        return -(-self.percent * both // (100 + self.percent))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; fewer words make one shingle, none make none."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    return np.unique(rolling(w, min(words, len(w)))) if len(w) else np.empty(0, np.uint64)


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s, 1).sum(dtype=np.uint64) ^ np.uint64(len(s))]), 3).view(np.int64)[0])


def sketch_words(n: int, t: Threshold) -> int:
    """64-bit words of a sketch, doubled from 2 on until it parts sets that share nothing from linked ones.

    Sketches of the former differ in half of their bits, of which five standard deviations (four a root of the words) are taken
    off; linked sets differ in no more elements than the largest partner allows.
    """
    words, both = 2, n + 100 * n // t.percent
    while both - 2 * t.need(both) > 32 * words - 20 * math.sqrt(words):
        words *= 2
    return words


def sketch(s: np.ndarray, t: Threshold) -> bytes:
    """Parities of the elements by hash: the bits in which two sketches differ are at most the elements in which the sets do."""
    return parities(s, sketch_words(len(s), t) * 64)


def fine_sketch(s: np.ndarray) -> bytes:
    """Parities by 8 bits an element or more, which a pair must pass before its sets are compared."""
    return parities(s, max(512, 8 << (len(s) - 1).bit_length()))


def parities(s: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((mix(s, 2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def set_table(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """One pass over the texts: doc_id, h (hash of the text), n, fp per row (n = 0 without words), and the most frequent shingles.

    Frequent are shingles seen over 3 times in one slice and over 50 times in such slices, sorted by hash: a
    guess that only orders shingles.  Each slice adds one row, at position null, with its counts.
    """
    ddl = "pos int, doc_id bigint, h bigint, n bigint, fp bigint, tokens array<bigint>, counts array<bigint>"

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, words) for t in texts_of(batch)]
        u, c = np.unique(np.concatenate(sets), return_counts=True)
        again = (c > 3) & (u < np.uint64(2**63))
        n, none = len(sets), pa.nulls(1, pa.int64())
        at = np.zeros(n + 2, np.int32)
        at[-1] = again.sum()
        return {
            "pos": [*range(n), None], "doc_id": pa.concat_arrays([batch.column(0), none]), "h": pa.concat_arrays([batch.column(2), none]), "n": [*map(len, sets), None], "fp": [*map(set_hash, sets), None],
            "tokens": pa.ListArray.from_arrays(at, pa.array(signed(u[again]))), "counts": pa.ListArray.from_arrays(at, pa.array(c[again])),
        }

    both = materialise(arrow_map(docs.select("doc_id", "text", text_hash("h")), run, ddl), "sets")
    seen = both.where("pos IS NULL").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n"))
    seen = materialise(seen.where("n > 50"), "frequent")
    top = seen.where(highest(seen, "n", "token", FREQUENT)[0]).select("token")
    often = np.sort(np.array([r.token for r in top.collect()], np.int64).view(np.uint64))
    return both.where("pos IS NOT NULL").select("doc_id", "h", "n", "fp"), often


def boundary(sizes: dict[int, int], t: Threshold) -> int:
    """The largest light size: least total of subset rows below and of list rows, each scanned SCAN_COST times, above."""

    def light(n: int) -> int:
        return sum(math.comb(n, k) for k in range(n - t.least(n) + 1))

    def heavy(n: int) -> int:
        return (n - t.least(n) + 1) * (1 + SCAN_COST)

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (sum(c * (light(n) if n <= x else heavy(n)) for n, c in sizes.items()), x))


def light_rows(s: np.ndarray, missing: int) -> tuple[list[int], list[int]]:
    """(subset size, hash) of all subsets without at most so many elements."""
    with np.errstate(over="ignore"):
        m = mix(s, 5)
        level = {(): m.sum(dtype=np.uint64)}
        sizes, hashes = [], []
        for k in range(missing + 1):
            values = np.array(list(level.values()), np.uint64)
            hashes += signed(mix(values, 64 + len(s) - k)).tolist()
            sizes += [len(s) - k] * len(values)
            if k < missing:
                level = {(*left, i): v - m[i] for left, v in level.items() for i in range(left[-1] + 1 if left else 0, len(s))}
    return sizes, hashes


def prefix(s: np.ndarray, t: Threshold, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (frequent, hash)."""
    p = len(s) - t.least(len(s)) + 1
    if not len(often):
        return s[:p]

    def split(part: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(often, part), len(often) - 1)
        return often[at] == part

    head = s[: 2 * p + 16]
    rare = head[~split(head)]
    if len(rare) < p < len(s):
        hot = split(s)
        rare = np.concatenate([s[~hot], s[hot]])
    return rare[:p] if len(rare) >= p else s[:p]


def signatures(docs: DataFrame, t: Threshold, light: int, often: np.ndarray, words: int) -> DataFrame:
    """One row per set and slice of rows: fp, n, sketch and tokens (of sets in lists), sizes and subsets (of light sets)."""
    ddl = "fp bigint, n int, sketch binary, tokens array<bigint>, sizes array<int>, subsets array<bigint>"
    in_lists = t.least(light + 1)
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batch: pa.RecordBatch) -> dict:
        sets = {set_hash(s): s for s in (shingles(x, words) for x in texts_of(batch)) if len(s)}
        rows = list(sets.values())
        lights = [light_rows(s, len(s) - t.least(len(s))) if len(s) <= light else ([], []) for s in rows]
        tokens = [signed(prefix(s, t, shared.value)) if len(s) >= in_lists else np.empty(0, np.int64) for s in rows]
        at = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
        return {
            "fp": list(sets), "n": list(map(len, rows)), "sketch": [sketch(s, t) if len(s) >= in_lists else b"" for s in rows],
            "tokens": pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, np.int64), *tokens]))), "sizes": [x for x, _ in lights], "subsets": [x for _, x in lights],
        }

    return materialise(arrow_map(docs.select("text"), run, ddl), "signatures")


def light_links(table: DataFrame, t: Threshold) -> DataFrame:
    """Links of each light set with the smallest set under each of its subsets."""
    rows = table.where("size(subsets) > 0").select("fp", "n", F.explode(F.arrays_zip("sizes", "subsets")).alias("x")).select("fp", "n", F.col("x.sizes").alias("size"), F.col("x.subsets").alias("key"))
    hubs = rows.groupBy("key", "size").agg(F.min(F.struct("n", "fp")).alias("hub"), F.max("fp").alias("top"), F.min("fp").alias("low")).where("low <> top")
    hubs = materialise(hubs.select("key", "size", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hub_n")), "subsets")
    on = rows.join(hubs, ["key", "size"]).where(F.col("fp") != F.col("hub"))
    on = on.where(100 * F.col("size") >= t.percent * (F.col("n") + F.col("hub_n") - F.col("size")))
    return on.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def members(table: DataFrame) -> DataFrame:
    """token, length, fp of the lists that hold two sets or more, written; length counts a set once a slice.

    Near copies share most of their shingles, and so whole lists.  Of short lists with the same sets, which give the same pairs, one stays,
    known by the hash of its sets in place of a token, and as one of SHORT sets.
    """
    w = W.partitionBy("token").orderBy("fp")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # One shuffle of the narrow rows: an aggregate and a join with it would send them twice.
    rows = table.select("fp", F.explode("tokens").alias("token")).select("token", "fp", F.count("*").over(whole).alias("length"), F.min("fp").over(whole).alias("low"), F.max("fp").over(whole).alias("top"), F.lag("fp").over(w).alias("before"), *(F.sum(F.pmod(F.xxhash64("fp", F.lit(k)), F.lit(1 << 32))).over(whole).alias(f"sum{k}") for k in (0, 1)))
    short = F.col("length") <= SHORT
    rows = rows.where("low <> top AND (before IS NULL OR before <> fp)").select(F.when(short, F.xxhash64("low", "top", "sum0", "sum1")).otherwise(F.col("token")).alias("token"), F.when(short, F.lit(SHORT).cast("bigint")).otherwise(F.col("length")).alias("length"), "fp")
    return materialise(rows.distinct(), "members")


def with_sketches(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joined last, so that the rows that look up lists stay narrow."""
    return rows.join(table.where("size(tokens) > 0").select("fp", "n", "sketch").dropDuplicates(["fp"]), "fp")


def first_rows(member: DataFrame) -> DataFrame:
    """place, side, fp, label of each list, dealt once into blocks: by one of two hashes, which most lists of a group of copies share."""
    blocks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("length") / FIRST_BLOCK)))).cast("bigint")
    block = F.pmod(F.xxhash64("fp", F.pmod("token", F.lit(2))), blocks)
    return member.select(F.xxhash64("token", block).alias("place"), F.lit(0).alias("side"), "fp", F.col("fp").alias("label"))


def rest_rows(member: DataFrame, labels: DataFrame) -> DataFrame:
    """place, side, fp, label of the lists that hold two components or more and were not scanned whole at first.

    The sets of a list's largest component (by its number of sets in the list) and the others are dealt into blocks;
    each block of others meets all blocks, so a list of G and S rows makes about 2 G S / BLOCK + S S / BLOCK of them.
    """
    rows = member.where(F.col("length") > SHORT).select("token", "fp").join(small_side(labels.withColumnRenamed("node", "fp")), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    parts = rows.groupBy("token", "label").agg(F.count("*").alias("n"))
    lists = parts.groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("labels")).where("labels > 1")
    lists = materialise(lists.select("token", F.col("most.label").alias("main"), F.col("most.n").alias("main_n"), (F.col("total") - F.col("most.n")).alias("rest_n")), "lists")
    rows = rows.join(small_side(lists), "token")
    mains, rests = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("main_n", "rest_n"))
    main = F.col("label") == F.col("main")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp", "token"), F.when(main, mains).otherwise(rests)).cast("int"))
    place = lambda kind, a, b, side: F.struct(F.xxhash64("token", F.lit(kind), a, b).alias("place"), side.alias("side"))
    of_main = F.transform(F.sequence(F.lit(0), rests - 1), lambda j: place("main", F.col("block"), j, F.lit(1)))
    with_main = F.transform(F.sequence(F.lit(0), mains - 1), lambda j: place("main", j, F.col("block"), F.lit(2)))
    with_rest = F.transform(F.sequence(F.lit(0), rests - 1), lambda j: place("rest", F.least("block", j), F.greatest("block", j), F.when(j == F.col("block"), 0).when(j > F.col("block"), 1).otherwise(2)))
    rows = rows.select("fp", "label", F.explode(F.when(main, of_main).otherwise(F.concat(with_main, with_rest))).alias("x"))
    return rows.select("x.place", "x.side", "fp", "label")


def fold(matrix: np.ndarray, words: int) -> np.ndarray:
    """The same sketches in fewer words."""
    while (half := matrix.shape[1] // 2) >= words:
        matrix = matrix[:, :half] ^ matrix[:, half:]
    return matrix


class Chunk:
    """Whole places of list rows, as arrays."""

    def __init__(self, batch: pa.Table, t: Threshold):
        self.t = t
        self.place, self.fp, self.n, self.label, self.side = (batch.column(c).to_numpy() for c in ("place", "fp", "n", "label", "side"))
        self.edges = np.flatnonzero(np.concatenate([[True], self.place[1:] != self.place[:-1], [True]]))
        self.length = np.repeat(np.diff(self.edges), np.diff(self.edges))
        sketches = batch.column("sketch").to_pylist()
        self.width = np.array([len(x) // 8 for x in sketches])
        self.row, self.of_width = np.zeros(len(sketches), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.of_width[w] = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), w)

    def index_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows in one place, in slices: by distance over short places, by matrix in long ones."""
        edges = self.edges
        lengths = np.diff(edges)
        short = np.flatnonzero(self.length <= 48)
        place = self.place[short]
        for d in range(1, 48):
            i = np.flatnonzero(place[d:] == place[:-d])
            if not len(i):
                break
            yield short[i], short[i + d]
        for k in np.flatnonzero(lengths > 48):
            for x in range(edges[k], edges[k + 1] - 1, 64):
                i, j = np.meshgrid(np.arange(x, min(x + 64, edges[k + 1])), np.arange(x + 1, edges[k + 1]), indexing="ij")
                up = j > i
                yield i[up], j[up]

    def close(self, forest: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may link: all of them, or in places of over SHORT rows, for each row those before and after it with the most room for further differences."""
        found = [(np.empty(0, np.int64),) * 3]

        def best(i: np.ndarray, j: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
            keep = self.length[j] <= SHORT
            for end, other in ((j, i), (i, j)):
                order = np.lexsort((other, -room, end))
                keep[order[np.flatnonzero(np.diff(end[order], prepend=-1))]] = True
            return i[keep], j[keep], room[keep]

        for i, j in self.index_pairs():
            low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
            on = (self.label[i] != self.label[j]) & (100 * low >= self.t.percent * high) & ((self.side[i] == 0) | (self.side[i] != self.side[j]))
            i, j = i[on], j[on]
            parts = [(np.empty(0, np.int64),) * 3]
            for w in np.unique(self.width[i]).tolist():
                for v in np.unique(self.width[j]).tolist():
                    at = np.flatnonzero((self.width[i] == w) & (self.width[j] == v))
                    least = min(w, v)
                    for part in np.array_split(at, 1 + len(at) * least // (1 << 20)):
                        if len(part):
                            left, right = (fold(self.of_width[x][self.row[k[part]]], least) for x, k in ((w, i), (v, j)))
                            differ = np.bitwise_count(left ^ right).sum(1).astype(np.int64)
                            both = self.n[i[part]].astype(np.int64) + self.n[j[part]]
                            room = both - 2 * self.t.need(both) - differ
                            ok = room >= 0
                            parts.append((i[part][ok], j[part][ok], room[ok]))
            slice_ = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            found.append(best(*slice_) if forest else slice_)
        i, j, room = (np.concatenate(x) for x in zip(*found, strict=True))
        if forest:
            i, j, _ = best(i, j, room)
        return i, j

    def candidates(self, forest: bool) -> np.ndarray:
        i, j = self.close(forest)
        pairs = np.stack([np.minimum(self.fp[i], self.fp[j]), np.maximum(self.fp[i], self.fp[j])], 1)
        return np.unique(pairs, axis=0) if len(pairs) else pairs


def candidates(rows: DataFrame, table: DataFrame, t: Threshold, forest: bool) -> DataFrame:
    """Distinct pairs a, b from list rows; a place never spans two partitions, and a chunk is whole places."""
    rows = with_sketches(rows, table).repartition("place").sortWithinPartitions("place", "n", "fp")
    ddl = "a bigint, b bigint"
    target = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            pairs = Chunk(table.combine_chunks(), t).candidates(forest)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=target)

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = pa.Table.from_batches([batch.slice(at, SLICE_ROWS)])
                held = part if held is None else pa.concat_tables([held, part])
                place = held.column("place").to_numpy()
                cut = int(np.searchsorted(place, place[-1]))
                if cut:
                    yield out(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield out(held)

    return rows.mapInArrow(frugal(run), schema_of(ddl)).distinct()


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, t: Threshold, words: int) -> DataFrame:
    """The pairs that link, by the intersection of the whole sets, written."""
    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "asked")
    ids = sets.join(small_side(asked), "fp").groupBy("fp").agg(F.min("doc_id").alias("rep")).select("rep").distinct()
    ids = small_side(materialise(ids, "asked-ids"))
    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def run(batch: pa.RecordBatch) -> dict:
        s = [shingles(x, words) for x in texts_of(batch)]
        return {"fp": [set_hash(x) for x in s], "n": list(map(len, s)), "fine": list(map(fine_sketch, s)), "s": [signed(x) for x in s]}

    whole = arrow_map(chosen, run, "fp bigint, n int, fine binary, s array<bigint>").join(small_side(asked), "fp", "left_semi")
    whole = materialise(whole, "whole-sets")
    if whole.groupBy("fp").count().where("count > 1").limit(1).count():  # rows alike in id and text
        whole = materialise(whole.dropDuplicates(["fp"]), "whole-sets")

    def ends(pairs: DataFrame, whole: DataFrame, *columns: str) -> DataFrame:
        """The pairs with columns of both sets, numbered 1 and 2."""
        one, two = (whole.select(F.col("fp").alias(end), *(F.col(c).alias(f"{c}{k}") for c in columns)) for k, end in ((1, "a"), (2, "b")))
        return small_side(pairs).join(one, "a").join(two, "b")

    def near(batch: pa.RecordBatch) -> dict:
        on = []
        for k, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "fine1", "fine2")), strict=True)):
            x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            if int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * t.need(n + m):
                on.append(k)
        return {c: batch.column(c).take(pa.array(on, pa.int64())) for c in ("a", "b")}

    close = materialise(arrow_map(ends(pairs, whole, "n", "fine"), near, "a bigint, b bigint"), "close-pairs")
    left = materialise(close.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "asked")
    on = ends(close, whole.join(small_side(left), "fp", "left_semi"), "n", "s").withColumn("both", F.col("n1") + F.col("n2")).withColumn("overlap", F.size(F.array_intersect("s1", "s2")))
    return materialise(on.where(100 * F.col("overlap") >= t.percent * (F.col("both") - F.col("overlap"))).select("a", "b"), "links")


def labelled(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, h, n, fp of each row, and with the label of its component of each row with words, written."""
    t = Threshold(percent)
    docs = docs.select("doc_id", "text")
    sets, often = set_table(docs, words)
    sizes = {r.n: r["count"] for r in sets.where(f"n > 0 AND n <= {LARGEST_LIGHT}").groupBy("n").count().collect()}
    table = signatures(docs, t, boundary(sizes, t), often, words)
    member = members(table)
    first = materialise(candidates(first_rows(member), table, t, forest=True), "candidates")
    links = light_links(table, t).union(verify(first, docs, sets, t, words))
    labels = components(links)
    # Written before the join: Spark would move that below distinct(), where a pair is a row for each list it shares.
    rest = materialise(candidates(rest_rows(member, labels), table, t, forest=False), "candidates")
    rest = materialise(rest.join(first, ["a", "b"], "left_anti"), "candidates")
    if rest.limit(1).count():
        more = verify(rest, docs, sets, t, words)
        if more.limit(1).count():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    rows = sets.where("n > 0").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "h", "n", "fp", F.coalesce("label", "fp").alias("label"))
    return sets, materialise(rows, "labelled")


@clears_tables
def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the least doc_id that links reach, itself included.

    Rows without words have n_shingles 0 and are alone; repeated rows are copies of one another; a null doc_id takes
    part but gives its component no id (null where there is no other).  Further columns are dropped; no rows give none.
    """
    sets, rows = labelled(docs, percent, words)
    least = materialise(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    out = rows.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


@clears_tables
def surplus(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """i, h (an id and the hash of its text) of the rows that keep_one() drops (gone) or finds repeated (again)."""
    _, rows = labelled(docs, percent, words)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "h")
    kept = rows.groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_i"), F.col("k.h").alias("kept_h"))
    keys = rows.groupBy(F.col("doc_id").alias("i"), "h").agg(F.count("*").alias("times"))
    meant = F.col("i").eqNullSafe(F.col("kept_i")) & (F.col("h") == F.col("kept_h"))
    return keys.join(kept, meant, "left").select("i", "h", (F.col("times") > 1).alias("again"), F.col("kept_h").isNull().alias("gone")).where("gone OR again")


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs with one row of each component, that of least doc_id (a null id comes last) and then set hash; all columns stay.

    Rows without words are alone and all stay.  A row is known by its id and the hash of its text; of rows alike in both, which are
    copies, one stays.
    """
    i, h, mark = fresh(docs.columns, "i", "h", "mark")
    keys = surplus(docs, percent, words).withColumnsRenamed({"i": i, "h": h})
    marked = docs.withColumn(mark, text_hash(mark))
    on = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(mark) == F.col(h))
    out = marked.join(small_side(keys.select(i, h)), on, "left_anti")
    copies = keys.where("again AND NOT gone").select(i, h)
    if copies.limit(1).count():
        out = out.union(marked.join(small_side(copies), on, "left_semi").dropDuplicates(["doc_id", mark]))
    return out.drop(mark)
