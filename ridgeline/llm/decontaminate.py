"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded slice of a partition's documents as one sequence of word numbers.  Its suffix array gives the
Burrows-Wheeler transform, a wavelet matrix over that answers rank queries, and every window of 10 benchmark words
is searched backwards in all of them at once.  Hits are located by walking to the next sampled suffix position, and
the hit windows of a document are merged into removal spans.

Words that no benchmark item of the block has can be in no hit: they become separators, and what is left between two
separators is indexed only if it is as long as the shortest window.  That changes no result and keeps the index small.
Benchmark items are a stated query set: they go to the tasks in blocks of at most BLOCK_BYTES of text, one after the other, each
against all documents; where there is more than one block, the hits of each are written, and the spans of a document are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_size, fresh, frugal, materialise, slices_of, text_hash, texts_of, with_column
from .spans import merged

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Words in one shard's index at most (a single longer document makes a longer shard).
SHARD_WORDS = 1 << 20
SAMPLE = 16

#: Lower-cases A-Z; turns all ASCII but letters and digits into spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class FMIndex:
    """Over numbers from 0 to sigma; 0 separates and is in no pattern.  All queries are over arrays of patterns."""

    def __init__(self, symbols: np.ndarray):
        """symbols: must end in 0."""
        n = len(symbols)
        suffixes = self.suffix_array(symbols)
        self.n, self.sigma = n, int(symbols.max()) + 1
        bwt = symbols[suffixes - 1]  # of the suffix at 0 it is the last symbol
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))])
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.zeros, self.ranks = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):  # wavelet matrix: stable partition by each bit
            ones = (level >> b & 1).astype(np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(n - int(ones.sum()))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        self.sampled = (suffixes % SAMPLE == 0) | (bwt == 0)  # a walk ends before it would cross a separator
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = suffixes[self.sampled]
        self.bwt_symbol = bwt

    @staticmethod
    def suffix_array(symbols: np.ndarray) -> np.ndarray:
        """Prefix doubling; separators differ from one another by position, so a comparison ends at the first of them."""
        n = len(symbols)
        stops = symbols == 0
        rank = symbols.astype(np.int64) + int(stops.sum())
        rank[stops] = np.arange(int(stops.sum()))
        _, rank = np.unique(rank, return_inverse=True)
        width = 1
        while True:
            key = rank.astype(np.int64) * (n + 1)
            key[: n - width] += rank[width:] + 1 if width < n else 0
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1 or width >= n:
                return order
            width *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before each place."""
        start, at = np.zeros_like(at), at.copy()
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one, r, z = (symbol >> b & 1).astype(bool), self.ranks[k], self.zeros[k]
            start = np.where(one, z + r[start], start - r[start])
            at = np.where(one, z + r[at], at - r[at])
        return at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search; patterns is a matrix with one pattern a row.  Returns the ranges of suffixes."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in patterns.T[::-1]:
            known = column < self.sigma
            c = np.where(known, column, 0)
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            high = np.where(known, np.maximum(low, high), low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps backwards until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            done = self.sampled[r]
            out[open_[done]] = self.samples[self.sample_rank[r[done]]] + steps[open_[done]]
            open_, r = open_[~done], r[~done]
            c = self.bwt_symbol[r]
            rows[open_] = self.before[c] + self.rank(c, r)
            steps[open_] += 1
        return out


class Queries:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text or "")]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.by_length: list[tuple[np.ndarray, list[list]]] = []
        for n in sorted({len(w) for w in windows}):
            of_n = sorted(w for w in windows if len(w) == n)
            self.by_length.append((np.array(of_n, np.int64), [list(windows[w]) for w in of_n]))
        self.shortest = min((len(w) for w in windows), default=0)

    def hits(self, shard: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set]]:
        """For each document of a shard (word numbers, 0: other word): the merged word spans, and the items."""
        out: list[tuple[list, set]] = [([], set()) for _ in shard]
        if not self.shortest or not shard:
            return out
        flat = np.concatenate([x for ids in shard for x in (ids, [0])]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in shard])])
        known = flat != 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known, [0]])))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= self.shortest]
        if not len(runs):
            return out
        lengths = runs[:, 1] - runs[:, 0] + 1  # with the separator behind
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(runs[:, 0], lengths)
        index = FMIndex(flat[where])
        spans: list[list] = [[] for _ in shard]
        for patterns, items in self.by_length:
            low, high = index.search(patterns)
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            counts = (high - low)[found]
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[found], counts)
            at = where[index.locate(rows)]
            docs = np.searchsorted(starts, at, side="right") - 1
            for d, a, k in zip(docs.tolist(), (at - starts[docs]).tolist(), np.repeat(found, counts).tolist(), strict=True):
                spans[d].append((a, a + patterns.shape[1]))
                out[d][1].update(items[k])
        return [(merged(s), items) for s, (_, items) in zip(spans, out, strict=True)]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_BYTES; null texts drop out.  The driver holds one block at a time; there is one at least."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        n = len(r.t.encode("utf-8", "surrogatepass")) + 64
        if size + n > BLOCK_BYTES and block:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    yield block


def word_numbers(texts: list[str], numbers: dict[bytes, int]) -> list[np.ndarray]:
    get = numbers.get
    return [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in map(words_of, texts)]


def shard_hits(texts: list[str], queries: Queries) -> list[tuple[int, list[tuple[int, int]], set]]:
    """(words, merged spans, items) of each text, shard by shard."""
    out = []
    for shard in by_size(texts, 4 * SHARD_WORDS):
        numbers = word_numbers(shard, queries.numbers)
        out += [(len(n), spans, items) for n, (spans, items) in zip(numbers, queries.hits(numbers), strict=True)]
    return out


def known(items: set) -> list[int]:
    """Ids in order; an item without an id hits, but cannot be listed."""
    return sorted(items - {None})


HITS = "doc_id bigint, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<bigint>"


def hits(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """doc_id, n_words, spans, items of one block for each row."""
    queries = docs.sparkSession.sparkContext.broadcast(Queries(items))

    def run(batch: pa.RecordBatch) -> dict:
        found = shard_hits(texts_of(batch), queries.value)
        spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in found]
        return {"doc_id": batch.column(0), "n_words": [n for n, _, _ in found], "spans": spans, "items": [known(x) for _, _, x in found]}

    return arrow_map(docs.select("doc_id", "text"), run, HITS)


def all_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """hits() over all blocks; rows alike in id and text have the same."""
    rest = blocks(benchmark, "item_id", "text")
    first, second = next(rest), next(rest, None)
    if second is None:
        return hits(docs, first)
    keyed = docs.select("doc_id", "text", text_hash("fp"))
    found = by_blocks(docs, chain((first, second), rest))
    none = lambda c: F.coalesce(c, F.array())
    rows = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("fp") == F.col("k_fp")), "left").select("doc_id", "text", none("spans").alias("spans"), none("items").alias("items"))

    def run(batch: pa.RecordBatch) -> dict:
        spans = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in s])] for s in batch.column("spans").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(words_of(t)) for t in texts_of(batch)], "spans": spans, "items": batch.column("items")}

    return arrow_map(rows, run, HITS)


def by_blocks(docs: DataFrame, parts: Iterator[list[tuple[int, str]]]) -> DataFrame:
    """k_id, k_fp (hash of the text), spans and items of all blocks for the rows that any hits; each block's hits are written."""
    keyed = docs.select("doc_id", "text", text_hash("fp"))
    tables = []
    for items in parts:
        queries = docs.sparkSession.sparkContext.broadcast(Queries(items))
        tables.append(materialise(of_block(keyed, queries), "block-hits"))
        queries.destroy()  # its hits are written
    found = reduce(DataFrame.union, tables)
    return found.groupBy("k_id", "k_fp").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def of_block(keyed: DataFrame, queries: Broadcast) -> DataFrame:
    """k_id, k_fp, spans, items of the rows that a block's queries hit."""

    def run(batch: pa.RecordBatch) -> dict:
        found = shard_hits(texts_of(batch), queries.value)
        on = [i for i, x in enumerate(found) if x[1]]
        return {
            "k_id": batch.column("doc_id").take(pa.array(on, pa.int64())), "k_fp": batch.column("fp").take(pa.array(on, pa.int64())),
            "spans": [[{"start": a, "end": b} for a, b in found[i][1]] for i in on], "items": [known(found[i][2]) for i in on],
        }

    return arrow_map(keyed, run, HITS.replace("doc_id", "k_id").replace("n_words", "k_fp"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges, end exclusive) per document.

    Null and empty texts have no words and no hits; items without words hit nothing; items with one text all count;
    repeated rows are judged each.  An empty benchmark leaves every document clean.  One block of items: no shuffle.
    """
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return all_hits(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the removal spans cut out of text; a document that was nothing but hits is dropped.

    Null texts and clean documents stay as they are, and so do the other columns.  Blocks of items are judged each on the whole
    texts: those that more than one block hits are cut by the union of the spans.
    """
    rest = blocks(benchmark, "item_id", "text")
    first, second = next(rest), next(rest, None)
    if second is None:
        queries = docs.sparkSession.sparkContext.broadcast(Queries(first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices_of(batches):
                texts = batch.column("text").to_pylist()
                yield without(batch, texts, [(n, s) for n, s, _ in shard_hits([t or "" for t in texts], queries.value)])

        return docs.mapInArrow(frugal(run), docs.schema)
    names = docs.columns
    fp, k_id, k_fp, spans = fresh(names, "fp", "k_id", "k_fp", "spans")
    found = by_blocks(docs, chain((first, second), rest)).select(F.col("k_id").alias(k_id), F.col("k_fp").alias(k_fp), F.col("spans").alias(spans))
    marked = docs.withColumn(fp, text_hash(fp)).join(found, F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(fp) == F.col(k_fp)), "left").select(*names, spans)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            texts = batch.column("text").to_pylist()
            found = [merged([(x["start"], x["end"]) for x in s or []]) for s in batch.column(spans).to_pylist()]
            yield without(batch.select(names), texts, [(len(words_of(t or "")), s) for t, s in zip(texts, found, strict=True)])

    return marked.mapInArrow(frugal(cut_out), docs.schema)


def without(batch: pa.RecordBatch, texts: list, found: list[tuple[int, list]]) -> pa.RecordBatch:
    """The batch without the spans (words, spans) of its texts, and without the rows that were nothing else."""
    texts = [cut(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
    keep = [not s or sum(b - a for a, b in s) < n for n, s in found]
    return with_column(batch, "text", texts).filter(pa.array(keep, pa.bool_()))
