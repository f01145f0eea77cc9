"""Removal of repeated passages by a De Bruijn graph of words, compacted before it is built.

The edges of the graph are windows of WINDOW words, its nodes the overlaps between them.  All windows that hold the
same least ANCHOR-word hash (their anchor) form one path without branches inside its document, so a document is a chain of
paths of 1 to 16 edges, and only paths travel between tasks:

1. anchors are counted; a window can be repeated only if its anchor is;
2. paths with repeated anchors are joined with the count of their whole word sequence: a path that occurs twice
   as a whole is repeated in all its edges, whatever its number of places;
3. repeated paths are compacted: where all places of a path go on with one path, and all places of that one come from
   the first, neither end has a branch, and the two are joined; chains of any length shrink to their first path in
   rounds of Spark joins that halve them;
4. where paths with one anchor differ, the graph branches inside them: one path of each kind there is opened into its
   edges, and edges are counted;
5. what is repeated goes back to its source coordinates (document, first word, end); spans are merged and cut from the
   words.

A sequence is known by the 128-bit digest of the words themselves, read at its coordinates while their text is at hand, so
texts meet spans only once, in the last step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, clears_tables, materialise, mix, rolling, signed, small_side, texts_of, word_hashes
from .spans import merged

WINDOW = 35
ANCHOR = 20
#: Words that are hashed at once; a longer document is done alone.
SLICE_WORDS = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def digests(words: list[bytes], first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit digest of the words from each first to each end, by single spaces."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    data = memoryview(b" ".join(words))
    found = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip((ends - size)[first].tolist(), ends[end - 1].tolist(), strict=True)])
    halves = np.frombuffer(found, np.uint64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def slices(texts: list[str], window: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list[bytes]]]:
    """(numbers of texts, hashes of their words in a row, where each begins and the end, the words) for texts with a window at least."""
    at, parts, words, total = [], [], [], 0
    for i, t in enumerate(texts):
        w = words_of(t)
        if len(w) >= window:
            at.append(i)
            parts.append(word_hashes(w))
            words += w
            total += len(w)
        if total >= SLICE_WORDS or i + 1 == len(texts) and parts:
            yield at, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), words
            at, parts, words, total = [], [], [], 0


def anchored(h: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths as (anchor hash, anchor place, first window, last window), all places in h; none crosses a document."""
    k = rolling(h, anchor)
    place, width, left = np.arange(len(k)), 1, window - anchor + 1
    best = place
    total = left
    while width * 2 <= total:  # least of each power of two, leftmost first
        a, b = best[:-width], best[width:]
        best = np.where(k[b] < k[a], b, a)
        width *= 2
    if width < total:
        a, b = best[: len(best) - (total - width)], best[total - width :]
        best = np.where((k[b] < k[a]) | ((k[b] == k[a]) & (b < a)), b, a)
    inside = np.zeros(len(h) + 1, np.int64)
    inside[starts[:-1]] += 1
    inside[np.maximum(starts[:-1], starts[1:] - window + 1)] -= 1
    first = np.flatnonzero(np.cumsum(inside)[: len(best)] > 0)
    of = best[first]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (first[1:] != first[:-1] + 1)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(first)]]) - 1
    return k[of[begin]], of[begin], first[begin], first[end]


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """token of each anchor that occurs at two places or more."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [anchored(h, starts, window, anchor)[0] for _, h, starts, _ in slices(texts_of(batch), window)]
        u, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        return {"token": signed(u), "n": n}

    counted = arrow_map(docs.select("text"), run, "token bigint, n bigint", rows=4096).groupBy("token").agg(F.sum("n").alias("n"))
    return materialise(counted.where("n > 1").select("token"), "anchors")


def paths(docs: DataFrame, repeated: DataFrame, window: int, anchor: int) -> DataFrame:
    """token, c1, c2 (digest of the whole path's words, and where the anchor is), doc_id, fp, first, last (its windows) of paths with repeated anchors, written."""

    def run(batch: pa.RecordBatch) -> dict:
        doc_id, fp = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(object), batch.column("fp").to_numpy()
        out: dict[str, list] = {k: [np.empty(0, np.int64)] for k in ("token", "c1", "c2", "row", "first", "last")}
        for at, h, starts, words in slices(texts_of(batch), window):
            token, place, first, last = anchored(h, starts, window, anchor)
            doc = np.searchsorted(starts, first, side="right") - 1
            for name, whole in zip(("c1", "c2"), digests(words, first, last + window), strict=True):
                out[name].append(signed(mix(whole ^ (place - first).astype(np.uint64))))
            out["token"].append(signed(token))
            out["row"].append(np.array(at)[doc])
            out["first"].append(first - starts[doc])
            out["last"].append(last - starts[doc])
        c = {k: np.concatenate(v) for k, v in out.items()}
        row = c.pop("row").astype(np.int64)
        return {**c, "doc_id": pa.array(doc_id[row], pa.int64(), from_pandas=True), "fp": fp[row]}

    rows = arrow_map(docs, run, "token bigint, c1 bigint, c2 bigint, doc_id bigint, fp bigint, first bigint, last bigint")
    return materialise(rows.join(small_side(repeated), "token"), "paths")


def opened(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """h1, h2 (digest of the words), doc_id, fp, first of every window of the given paths (p_id, p_fp, first, last), written."""
    lists = kinds.groupBy("p_id", "p_fp").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    on = docs.join(small_side(materialise(lists, "ranges")), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("fp") == F.col("p_fp")))
    on = on.select("doc_id", "fp", "text", "ranges")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [np.empty(0, np.int64)] for k in ("h1", "h2", "row", "first")}
        for i, (text, ranges) in enumerate(zip(texts_of(batch), batch.column("ranges").to_pylist(), strict=True)):
            first = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges])
            for name, half in zip(("h1", "h2"), digests(words_of(text), first, first + window), strict=True):
                out[name].append(signed(half))
            out["row"].append(np.full(len(first), i))
            out["first"].append(first)
        c = {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}
        row = c.pop("row")
        ids = batch.column("doc_id").take(pa.array(row))
        return {**c, "doc_id": ids, "fp": batch.column("fp").to_numpy()[row]}

    return materialise(arrow_map(on, run, "h1 bigint, h2 bigint, doc_id bigint, fp bigint, first bigint"), "edges")


@clears_tables
def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """r_id, r_fp, spans array<struct<start, end>>: merged word ranges of repeated windows, of documents that have some.

    fp is the hash of the text, so rows with one id are told apart by it; rows alike in both repeat one another.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    found = paths(docs, anchors(docs, window, anchor), window, anchor)
    kinds = found.groupBy("token", "c1", "c2").agg(F.count("*").alias("places"), F.min(F.struct("doc_id", "fp", "first", "last")).alias("x"))
    kinds = materialise(kinds.select("token", "c1", "c2", "places", "x.*"), "kinds")
    twice = materialise(kinds.where("places > 1").select("token", "c1", "c2", F.xxhash64("token", "c1", "c2").alias("k")), "repeated-paths")
    places = materialise(found.join(small_side(twice), ["token", "c1", "c2"]).select("k", "doc_id", "fp", "first", "last"), "repeated-places")
    chain = compacted(places)
    whole = places.join(small_side(chain), "k").select("doc_id", "fp", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (window - 1)).alias("end"))
    # Branches: anchors with a kind of path that has one place only; the kind of least coordinates stands for all its places.
    branching = kinds.groupBy("token").agg(F.min("places").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1").select("token")
    inside = kinds.join(small_side(materialise(branching, "branching")), "token", "left_semi").withColumnsRenamed({"doc_id": "p_id", "fp": "p_fp"})
    edges = opened(docs, materialise(inside.select("p_id", "p_fp", "first", "last"), "branching-paths"), window)
    again = materialise(edges.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated-edges")
    single = edges.join(small_side(again), ["h1", "h2"]).select("doc_id", "fp", F.col("first").alias("start"), (F.col("first") + window).alias("end"))
    spans = whole.union(single).groupBy(F.col("doc_id").alias("r_id"), F.col("fp").alias("r_fp")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batch: pa.RecordBatch) -> dict:
        joined = [merged([(x["start"], x["end"]) for x in s]) for s in batch.column("spans").to_pylist()]
        return {"r_id": batch.column("r_id"), "r_fp": batch.column("r_fp"), "spans": [[{"start": a, "end": b} for a, b in s] for s in joined]}

    return arrow_map(spans, run, "r_id bigint, r_fp bigint, spans array<struct<start: bigint, end: bigint>>")


def compacted(places: DataFrame) -> DataFrame:
    """k, windows: the first path of each chain without branches among the places (k, doc_id, fp, first, last), and the windows of the chain.

    A path has one neighbour on a side if all its places have it there; as every place of a chain is then whole, the
    places of its first path are the places of the chain.  No chain is a ring: the first place in a document has no
    neighbour before it.
    """
    w = W.partitionBy("doc_id", "fp").orderBy("first", "k")
    after = F.when(F.lead("first").over(w) == F.col("last") + 1, F.lead("k").over(w))
    before = F.when(F.lag("last").over(w) == F.col("first") - 1, F.lag("k").over(w))
    sides = places.withColumn("after", after).withColumn("before", before)
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    degrees = materialise(sides.groupBy("k").agg(only("after"), only("before"), F.max(F.col("last") - F.col("first") + 1).alias("windows")), "degrees")
    back = degrees.select(F.col("k").alias("before"), F.col("after").alias("k"))
    # Each path points at the one before it in its chain, or, at the first, at nothing.
    state = degrees.join(back.where("k IS NOT NULL"), ["k", "before"], "left_semi").select("k", F.col("before").alias("to"))
    state = materialise(degrees.select("k", "windows").join(state, "k", "left").select("k", "windows", F.coalesce("to", "k").alias("to")), "chains")
    while True:
        jump = state.select(F.col("k").alias("to"), F.col("to").alias("next"))
        new = materialise(state.join(jump, "to").select("k", "windows", F.col("to").alias("old"), F.col("next").alias("to")), "chains")
        if not new.where("old <> to").limit(1).count():
            return materialise(new.groupBy(F.col("to").alias("k")).agg(F.sum("windows").alias("windows")), "compacted")
        state = new.select("k", "windows", "to")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, fp, text, spans: the documents, broadcast join if the spans are few."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    return docs.join(small_side(spans), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("fp") == F.col("r_fp")), "left").select("doc_id", "fp", "text", "spans")


def without(words: list[bytes], spans: list[dict]) -> list[bytes]:
    out, at = [], 0
    for s in spans:
        out += words[at : s["start"]]
        at = s["end"]
    return out + words[at:]


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text with the repeated words gone and the rest joined by single spaces, for each row.

    Null and empty texts have no words and give the empty text; texts shorter than a window stay; every place of a
    repeated window goes, also both of two equal rows.  Windows are judged on the input.  Further columns are dropped.
    """

    def run(batch: pa.RecordBatch) -> dict:
        spans = batch.column("spans").to_pylist()
        return {"doc_id": batch.column("doc_id"), "text": [b" ".join(without(words_of(t), s or [])).decode("utf-8", "surrogatepass") for t, s in zip(texts_of(batch), spans, strict=True)]}

    return arrow_map(with_spans(docs, repeated_spans(docs, window, anchor)), run, "doc_id bigint, text string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what dedup() keeps."""

    def run(batch: pa.RecordBatch) -> dict:
        n, removed, sha = [], [], []
        for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist(), strict=True):
            words = words_of(text)
            kept = without(words, spans or [])
            n.append(len(words))
            removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_words": n, "n_removed": removed, "kept_sha256": sha}

    return arrow_map(with_spans(docs, repeated_spans(docs)), run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
