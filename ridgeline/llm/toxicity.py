"""Toxicity from two Kneser-Ney models of spelling, one of toxic and one of ordinary documents.

A word is ^, its characters, $.  For a character x after the context h (up to 5 characters of the word):

    P_c(x | h) = (max(n_c(h x) - D, 0) + (D N_c(h .) + T) P(x | h')) / (n_c(h) + T)

n_c counts in the words of a class, N_c counts distinct characters after h, and h' is the last 3 characters of h.  The
back-off P(x | h') is itself Kneser-Ney over continuation counts that both classes share, so a rare expression is
judged by its class only as far as the class has seen it.  A word's evidence is the sum over its characters of
log P_toxic - log P_ordinary; of a document it is the mean over its words (length-normalised), the largest mean over
STRETCH words in a row, and the evidence of its strongest words, each word once: few toxic words in a long clean text
change no mean.  A logistic regression on these gives the score.

Counts cover all labelled documents of folds 0 and 2 (crc32 of the id modulo 3) and are made by Spark in partial aggregates.
The model stays whole in a table, one row a context.  Its most frequent contexts, of at most GRAMS n-grams, are broadcast, and
a Bloom filter tells which others it may hold; documents with such ones get them by a join.  The regression is fitted on about SAMPLE labelled documents
of both folds, chosen by a hash, each scored with the counts of the other fold.  Documents of fold 1 are never
learnt from.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, below_share, highest, materialise, mix, signed, small_side, texts_of

DISCOUNT, PRIOR = 0.75, 10.0
LONG, SHORT = 5, 3
#: What is broadcast of the model at most; the rest is joined.
GRAMS = 1 << 19
#: 64-bit words of the Bloom filter of contexts.
FILTER_BITS = 20
SAMPLE = 20_000
STRETCH, STRONGEST = 25, 6
FOLDS = 3
#: Lower-cases A-Z; other ASCII than letters and digits divides words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def fold_of(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, fold: int) -> DataFrame:
    """doc_id, text, toxic of one fold; rows without id, label or text are left out, a document with two labels is toxic."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold_of("doc_id") == fold)
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(small_side(known), "doc_id").select("doc_id", "text", "toxic")


class Spelling:
    """N-grams of words in a row: for each character after ^ its word, hashes of both contexts and of context and character."""

    def __init__(self, words: list[bytes]):
        text = "".join(["\x02" + w.decode("utf-8", "surrogatepass") + "\x03" for w in words])
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.flatnonzero(code == 2)
        number = np.cumsum(code == 2) - 1
        place = np.arange(len(code)) - start[number] if len(code) else np.empty(0, np.int64)
        at = np.flatnonzero(place > 0)
        self.word, self.x = number[at], code[at]
        context, hashes = np.zeros(len(at), np.uint64), []
        with np.errstate(over="ignore"):
            for back in range(1, LONG + 1):
                known = place[at] >= back
                context = context + np.where(known, mix(code[at - np.where(known, back, 0)], back), np.uint64(0))
                if back in (SHORT, LONG):
                    hashes.append(mix(context))
            self.short, self.long = hashes
            self.gram = mix(self.long + mix(self.x, 99))


def vocabulary(train: DataFrame) -> DataFrame:
    """word, ordinary, toxic counts, written."""

    def run(batch: pa.RecordBatch) -> dict:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            counts[bool(toxic)].update(words_of(text))
        words = list(counts[0].keys() | counts[1].keys())
        return {"word": words, "ordinary": [counts[0][w] for w in words], "toxic": [counts[1][w] for w in words]}

    rows = arrow_map(train, run, "word binary, ordinary bigint, toxic bigint", rows=10_000)
    return materialise(rows.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "vocabulary")


def grams(words: DataFrame) -> DataFrame:
    """gram, long, short, x, ordinary, toxic counts, written."""

    def run(batch: pa.RecordBatch) -> dict:
        s = Spelling(batch.column("word").to_pylist())
        counts = [batch.column(c).to_numpy()[s.word] for c in ("ordinary", "toxic")]
        _, first, back = np.unique(s.gram, return_index=True, return_inverse=True)
        a, b = (np.bincount(back, c, len(first)).astype(np.int64) for c in counts)
        return {"gram": signed(s.gram[first]), "long": signed(s.long[first]), "short": signed(s.short[first]), "x": signed(s.x[first]), "ordinary": a, "toxic": b}

    rows = arrow_map(words, run, "gram bigint, long bigint, short bigint, x bigint, ordinary bigint, toxic bigint", rows=10_000)
    return materialise(rows.groupBy("gram", "long", "short", "x").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "grams")


@dataclass
class Model:
    """The whole model as a table (long, n, back, kinds, grams, llrs), what is broadcast of it, and the regression's weights."""

    table: DataFrame
    local: dict[str, np.ndarray]
    weights: np.ndarray | None = None


def filter_places(long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of each context in the Bloom filter."""
    h = mix(long, 7)
    one = np.uint64(1)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63)))


def bloom(contexts: DataFrame) -> np.ndarray:
    """The Bloom filter of all contexts; its size is fixed, so more contexts only make it less selective."""

    def run(batch: pa.RecordBatch) -> dict:
        place, bits = filter_places(batch.column("long").to_numpy().view(np.uint64))
        return {"place": place, "bits": signed(bits)}

    rows = arrow_map(contexts.select("long"), run, "place bigint, bits bigint", rows=10_000).groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS, np.uint64)
    out[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def tables_of(long: np.ndarray, back: np.ndarray, grams: np.ndarray, llrs: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes and log ratios of contexts and of their n-grams."""
    c, g = np.argsort(long), np.argsort(grams)
    return {"contexts": long[c], "context_llr": back[c], "grams": grams[g], "gram_llr": llrs[g]}


def flat(column, kind) -> np.ndarray:
    """The values of an Arrow column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), kind)


def model(table: DataFrame) -> Model:
    """Log ratios of all n-grams and, for other characters, of their contexts (back-off weights)."""
    seen = lambda c: F.sum((F.col(c) > 0).cast("bigint"))
    long = table.groupBy("long").agg(F.sum("ordinary").alias("n0"), F.sum("toxic").alias("n1"), seen("ordinary").alias("d0"), seen("toxic").alias("d1"))
    back = [(DISCOUNT * F.col(f"d{k}") + PRIOR) / (F.col(f"n{k}") + PRIOR) for k in (0, 1)]
    long = materialise(long.select("long", "n0", "n1", back[0].alias("b0"), back[1].alias("b1")), "contexts")
    ends = table.groupBy("short", "x").agg(F.count("*").alias("kinds"))
    short = ends.groupBy("short").agg(F.sum("kinds").alias("after"), F.count("*").alias("types"))
    letters = ends.groupBy("x").agg(F.sum("kinds").alias("of_x"))
    total = letters.agg(F.coalesce(F.sum("of_x"), F.lit(1)).alias("n")).first().n
    ends = ends.join(small_side(short), "short").join(small_side(letters), "x")
    shared = (F.greatest(F.col("kinds") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("of_x") / total) / F.col("after")
    ends = materialise(ends.select("short", "x", shared.alias("p")), "shared-endings")
    full = table.join(long, "long").join(small_side(ends), ["short", "x"])
    p = [(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (F.col(f"n{k}") + PRIOR) + F.col(f"b{k}") * F.col("p")) for k, c in enumerate(("ordinary", "toxic"))]
    ratio = lambda a, b: F.log(a) - F.log(b)
    full = full.select("long", "gram", (F.col("n0") + F.col("n1")).alias("n"), ratio(p[1], p[0]).alias("llr"), ratio(F.col("b1"), F.col("b0")).alias("back"))
    full = full.groupBy("long", "n", "back").agg(F.collect_list(F.struct("gram", "llr")).alias("x"))
    full = materialise(full.select("long", "n", "back", F.size("x").alias("kinds"), F.col("x.gram").alias("grams"), F.col("x.llr").alias("llrs")), "model")
    frequent, every = highest(full, "n", "long", GRAMS, weight="kinds")
    chosen = full.where(frequent)
    t = chosen.select("long", "back", "grams", "llrs").toArrow()
    local = tables_of(np.asarray(t.column("long"), np.int64), np.asarray(t.column("back"), float), flat(t.column("grams"), np.int64), flat(t.column("llrs"), float))
    if not every:
        local["bloom"] = bloom(full)
    return Model(full, local)


def look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of asked keys."""
    if not len(keys):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    known = keys[at] == asked
    return np.where(known, values[at], 0.0), known


class Judge:
    """Evidence of words, remembered for up to twice so many words; NaN while a context of the word has yet to be joined."""

    words = 300_000

    def __init__(self, m: dict[str, np.ndarray]):
        self.m = m
        self.seen: dict[bytes, float] = {}
        self.before: dict[bytes, float] = {}

    def open(self, long: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether the table may hold contexts that the broadcast does not."""
        if "bloom" not in self.m:
            return np.zeros(len(long), bool)
        place, bits = filter_places(long)
        return ~known & (self.m["bloom"][place] & bits == bits)

    def of_words(self, words: list[bytes], more: dict[str, np.ndarray] | None = None) -> np.ndarray:
        s = Spelling(words)
        llr, known = look(self.m["grams"], self.m["gram_llr"], signed(s.gram))
        back, here = look(self.m["contexts"], self.m["context_llr"], signed(s.long))
        x = np.where(known, llr, back)
        if more is None:
            x[self.open(s.long, here)] = np.nan
        else:
            llr, known = look(more["grams"], more["gram_llr"], signed(s.gram))
            back, _ = look(more["contexts"], more["context_llr"], signed(s.long))
            x = np.where(here, x, np.where(known, llr, back))
        return np.bincount(s.word, x, len(words))

    def asked(self, text: str) -> list[int]:
        """Contexts of a text that have to be joined."""
        words = list(dict.fromkeys(words_of(text)))
        s = Spelling([w for w, x in zip(words, self.of_text(words), strict=True) if np.isnan(x)])
        _, here = look(self.m["contexts"], self.m["context_llr"], signed(s.long))
        return np.unique(signed(s.long)[self.open(s.long, here)]).tolist()

    def of_text(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.seen.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found, strict=True) if x is None})
            if len(self.seen) + len(new) > self.words:
                self.before, self.seen = self.seen, {}
            known = {w: x for w in new if (x := self.before.get(w)) is not None}
            ask = [w for w in new if w not in known]
            if ask:
                known.update(zip(ask, self.of_words(ask).tolist(), strict=True))
            self.seen.update(known)
            found = [known[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return np.array(found)

    def evidence(self, text: str, more: dict[str, np.ndarray] | None = None) -> list[float] | None:
        """Mean, largest stretch mean, then the STRONGEST highest of distinct words, falling; zeros without words.

        None if contexts have to be joined; more has those that were.
        """
        words = words_of(text)
        x = self.of_text(words)
        if np.isnan(x).any():
            if more is None:
                return None
            new = list({w for w, v in zip(words, x.tolist(), strict=True) if v != v})
            found = dict(zip(new, self.of_words(new, more).tolist(), strict=True))
            x = np.array([found[w] if v != v else v for w, v in zip(words, x.tolist(), strict=True)])
        if not len(x):
            return [0.0] * (2 + STRONGEST)
        k = min(len(x), STRETCH)
        total = np.concatenate([[0.0], np.cumsum(x)])
        once = np.sort(np.fromiter(dict(zip(words, x.tolist(), strict=True)).values(), float))[::-1][:STRONGEST]
        strong = np.maximum(0.0, np.concatenate([once, np.zeros(STRONGEST - len(once))]))
        return [float(x.mean()), float((total[k:] - total[:-k]).max()) / STRETCH, *strong.tolist()]


#: The judge of the model that this worker used last.
LAST: dict[int, Judge] = {}


def with_evidence(df: DataFrame, m: Model, keep: str) -> DataFrame:
    """Column keep and evidence array<double> per row."""
    shared = df.sparkSession.sparkContext.broadcast(m.local)
    kind, number = dict(df.dtypes)[keep], shared._jbroadcast.id()

    def judge() -> Judge:
        if number not in LAST:
            LAST.clear()
            LAST[number] = Judge(shared.value)
        return LAST[number]

    def run(batch: pa.RecordBatch) -> dict:
        return {keep: batch.column(keep), "evidence": list(map(judge().evidence, texts_of(batch)))}

    def begin(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        found = list(map(judge().evidence, texts))
        rest = [e is None for e in found]
        key = np.random.default_rng().integers(2**63, size=len(texts))  # only groups: rows with one key would share contexts
        return {
            keep: batch.column(keep), "evidence": found, "key": key, "text": [t if r else None for t, r in zip(texts, rest, strict=True)],
            "asked": [judge().asked(t) if r else None for t, r in zip(texts, rest, strict=True)],
        }

    def end(batch: pa.RecordBatch) -> dict:
        x = batch.column("found").flatten()
        long, back, grams, llrs = (x.field(k) for k in ("long", "back", "grams", "llrs"))
        _, once = np.unique(np.asarray(long, np.int64), return_index=True)
        long, back, grams, llrs = (c.take(pa.array(once)) for c in (long, back, grams, llrs))
        more = tables_of(np.asarray(long, np.int64), np.asarray(back, float), flat(grams, np.int64), flat(llrs, float))
        return {keep: batch.column(keep), "evidence": [judge().evidence(t, more) for t in texts_of(batch)]}

    out = f"{keep} {kind}, evidence array<double>"
    if "bloom" not in m.local:
        return arrow_map(df.select(keep, "text"), run, out)
    first = materialise(arrow_map(df.select(keep, "text"), begin, f"{out}, key bigint, text string, asked array<bigint>"), "evidence")
    rest = first.where("asked IS NOT NULL")
    found = rest.select("key", F.explode("asked").alias("long")).join(m.table.select("long", "back", "grams", "llrs"), "long")
    found = found.groupBy("key").agg(F.collect_list(F.struct("long", "back", "grams", "llrs")).alias("found"))
    rest = arrow_map(rest.select("key", keep, "text").join(found, "key", "left").select(keep, "text", "found"), end, out, rows=256)
    return first.where("asked IS NULL").select(keep, "evidence").union(rest)


def regress(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic regression by damped Newton steps; a fixed low score where there are not both classes."""
    if not len(y) or y.min() == y.max():
        return np.array([-3.0, *[0.0] * (x.shape[1] - 1)])
    scale = np.concatenate([[1.0], x[:, 1:].std(0) + 1e-9])
    x, b = x / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - penalty * b * [0, *[1] * (len(b) - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(b)), g)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b / scale


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of folds 0 and 2, and the weights of the regression, for which each fold is scored with the counts of the other."""
    rows = {fold: labelled(docs, labels, fold) for fold in (0, 2)}
    counts = {fold: grams(vocabulary(rows[fold])) for fold in rows}
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").count()
    sample = rows[0].withColumn("fold", F.lit(0)).union(rows[2].withColumn("fold", F.lit(2)))
    sample = materialise(below_share(sample.withColumn("h", F.xxhash64("doc_id", "text")), SAMPLE * FOLDS / 2 / max(1, known), "h").select("text", "fold", "toxic"), "sample")
    x, y = [], []
    for fold, other in ((0, 2), (2, 0)):
        t = with_evidence(sample.where(F.col("fold") == fold), model(counts[other]), "toxic").toArrow()
        x += [[1.0, *e] for e in t.column("evidence").to_pylist()]
        y += t.column("toxic").to_pylist()
    both = counts[0].union(counts[2]).groupBy("gram", "long", "short", "x").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    m = model(materialise(both, "grams"))
    m.weights = regress(np.array(x).reshape(len(x), 3 + STRONGEST), np.array(y, float))
    return m


def score(docs: DataFrame, m: Model, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, from its whole text alone.

    A null text is the empty text, whose score comes from the regression's constant.  held_out is null where the id is.
    """
    b = [float(v) for v in m.weights]
    rows = with_evidence(docs.select("doc_id", "text"), m, "doc_id")
    s = 1 / (1 + F.exp(-sum((b[k + 1] * F.get("evidence", F.lit(k)) for k in range(2 + STRONGEST)), F.lit(b[0]))))
    return rows.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), s.alias("score")).withColumn("predicted", (F.col("score") >= limit).cast("int"))
