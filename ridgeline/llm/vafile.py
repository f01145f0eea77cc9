"""Vector codes: product quantisation whose assignment goes through a VA-file of the codebook entries."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, small_side
from .vectors import finite_rows, floors, matrix, written_rows

#: Sums travel as signed digits of so many bits, so that sums of any size stay whole.
DIGIT = 30
LONG_MAX = 2**63 - 1


class VaFile:
    """The entries of one part's codebook, each coordinate quantised to a cell of `bits` bits.

    Cells of a position are cut at the quantiles of the entries' own coordinates.  A query's table holds, for each
    position and cell, the least and the greatest squared distance from its coordinate to any entry in the cell;
    the sums along an entry's cells bound its distance from below and above.
    """

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries = entries
        k, width = entries.shape
        cells = 1 << bits
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * cells // max(k, 1)  # of entry and position
        self.low = np.zeros((width, cells), dtype=entries.dtype)
        self.high = np.zeros((width, cells), dtype=entries.dtype)
        self.used = np.zeros((width, cells), dtype=bool)
        for j in range(width):
            for c in set(self.cell[:, j].tolist()):
                own = entries[self.cell[:, j] == c, j]
                self.low[j, c], self.high[j, c], self.used[j, c] = own.min(), own.max(), True
        self.choice = np.zeros((width * cells, k), dtype=entries.dtype if entries.dtype == object else np.float64)
        for j in range(width):
            self.choice[j * cells + self.cell[:, j], np.arange(k)] = 1

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each query to each position's cells."""
        under, over = self.low - q[:, :, None], q[:, :, None] - self.high
        nearest = np.maximum(np.maximum(under, over), 0)
        farthest = np.maximum(-under, -over)
        unused = ~self.used
        low, high = nearest * nearest, farthest * farthest
        low[:, unused] = high[:, unused] = 0
        return low.reshape(len(q), -1), high.reshape(len(q), -1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry (ties to the lower index), its squared distance, and how many pairs were refined."""
        n, k = len(q), len(self.entries)
        low, high = self.tables(q)
        if self.choice.dtype != object:
            low, high = low.astype(np.float64), high.astype(np.float64)
        lower, upper = low @ self.choice, high @ self.choice
        rows, picks = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = q[rows] - self.entries[picks]
        exact = (gap * gap).sum(axis=1)
        found = np.full((n, k), None if q.dtype == object else LONG_MAX, dtype=q.dtype)
        if q.dtype == object:  # of any size
            found[:] = exact.max(initial=0) + 1
        found[rows, picks] = exact
        index = found.argmin(axis=1)
        return index, found[np.arange(n), index], len(rows)


def common_type(q: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if every sum of squares fits a float64 without rounding, else both as Python's integers."""
    if q.dtype != object and entries.dtype != object:
        reach = int(np.abs(q).max(initial=0)) + int(np.abs(entries).max(initial=0))
        if reach * reach * max(q.shape[1], 1) < 2**53:
            return q, entries
    return q.astype(object), entries.astype(object)


def parts_of(column: pa.Array, parts: int, width: int, factor: int) -> list[np.ndarray]:
    x = floors(matrix(column, parts * width), factor)
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def digits(total: int) -> list[int]:
    """total in base 2**DIGIT, all digits with its sign."""
    sign, rest, out = (1 if total >= 0 else -1), abs(total), []
    while rest:
        out.append(sign * (rest & ((1 << DIGIT) - 1)))
        rest >>= DIGIT
    return out


def train(rows: DataFrame, dims: int, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096, bits: int = 3) -> list[np.ndarray]:
    """The codebooks, entries by width, after all rounds over all rows; what reaches the driver is their size alone.

    rows: n, vec_id, v of vectors.finite_rows, written.
    """
    width = -(-dims // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    if not first.num_rows:
        return []
    books = parts_of(first.column("v").combine_chunks(), parts, width, factor)

    for _ in range(rounds):

        def partial(batch: pa.RecordBatch, books: list[np.ndarray] = books) -> dict:
            out: dict[str, list[int]] = {"part": [], "entry": [], "at": [], "digit": [], "total": []}
            for p, (q, book) in enumerate(zip(parts_of(batch.column("v"), parts, width, factor), books, strict=True)):
                q, book = common_type(q, book)
                index = VaFile(book, bits).nearest(q)[0]
                for e in np.unique(index).tolist():
                    own = q[index == e]
                    for at, total in enumerate([len(own), *own.sum(axis=0).tolist()]):
                        for digit, value in enumerate(digits(int(total))):
                            for name, x in zip(out, (p, e, at, digit, value), strict=True):
                                out[name].append(x)
            return out

        sums: dict[tuple[int, int], list[int]] = {}
        per_digit = arrow_map(rows.select("v"), partial, "part int, entry int, at int, digit int, total bigint", rows=8192)
        for r in per_digit.groupBy("part", "entry", "at", "digit").agg(F.sum("total").alias("total")).collect():
            sums.setdefault((r.part, r.entry), [0] * (width + 1))[r.at] += r.total << (DIGIT * r.digit)
        new = [[sums.get((p, e)) for e in range(len(book))] for p, book in enumerate(books)]
        moved = [[old.tolist() if got is None else [x // got[0] for x in got[1:]] for got, old in zip(of_part, book, strict=True)] for of_part, book in zip(new, books, strict=True)]
        books = [integers(m, width) for m in moved]
    return books


def integers(rows: list[list[int]], width: int) -> np.ndarray:
    top = max((abs(x) for r in rows for x in r), default=0)
    return np.array(rows, dtype=np.int64 if top < 2**40 else object).reshape(len(rows), width)


def encode(rows: DataFrame, books: list[np.ndarray], dims: int, factor: int = 4096, bits: int = 3) -> DataFrame:
    """vec_id, label, code, error of each row; refined counts the entries whose distance was computed, over all parts."""
    parts = len(books)
    width = -(-dims // parts) if parts else 0

    def code(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        error, refined, codes = np.zeros(n, dtype=object), 0, np.zeros((n, parts), dtype=np.int64)
        for p, (q, book) in enumerate(zip(parts_of(batch.column("v"), parts, width, factor), books, strict=True)):
            codes[:, p], far, pairs = VaFile((both := common_type(q, book))[1], bits).nearest(both[0])
            error, refined = error + far.astype(object), refined + pairs
        return {
            "vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": ["".join(f"{x:02x}" for x in row) for row in codes.tolist()],
            "error": [min(int(x), LONG_MAX) for x in error], "refined": np.diff(np.arange(n + 1) * refined // max(n, 1)),
        }

    label = rows.schema["label"].dataType.simpleString()
    return arrow_map(rows.select("vec_id", "label", "v"), code, f"vec_id bigint, label {label}, code string, error bigint, refined bigint", rows=8192)


def quantise(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row with a whole, finite vector; one row for each.

    Components become floor(factor * x), factor a power of two; codebooks start as the parts of the rows of the least
    ids, and move for `rounds` rounds.  Codes have two hexadecimal digits a part, so entries is 256 at most.

    Null vectors, and those with null or non-finite components, give no row.  A null id stays and sorts last.  Of rows
    with one id the lesser vector comes first; repeated rows each count and each give a row.  Vectors of unequal length, or of
    one that parts does not divide, are filled up with zeros.  Null labels are one label.  An error beyond a bigint
    is given as the greatest bigint.  An empty table gives no row.
    """
    if factor & (factor - 1) or entries > 256:
        raise ValueError("factor is a power of two, entries 256 at most")
    rows, _, dims = written_rows(finite_rows(df, id_col, vector_col, label_col), "vectors")
    books = train(rows, dims, parts, entries, rounds, factor)
    coded = materialise(encode(rows, books, dims, factor).drop("refined"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint")
    of_label = materialise(coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(str(x) for book in books for row in book.tolist() for x in row).encode()).hexdigest()
    out = coded.join(small_side(of_label), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> str:
    """quantise() in DuckDB's SQL, for vectors of one length that parts divides and ids that differ."""
    gap = "list_sum(list_transform(range(1, CAST(w AS BIGINT) + 1), lambda i: CAST(x[i] - y[i] AS HUGEINT) * (x[i] - y[i])))"
    nearest = "SELECT vec_id, p, any_value(label) AS label, arg_min(e, d * {k} + e) AS e, min(d) AS d, any_value(x) AS x FROM (SELECT a.vec_id, a.label, a.p, b.e, a.x, {gap} AS d FROM parts a JOIN b{r} b ON a.p = b.p CROSS JOIN wide) GROUP BY vec_id, p"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(k=entries, gap=gap, r=r)})")
        steps.append(f"""m{r} AS MATERIALIZED (SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS y FROM (
  SELECT p, e, i, sum(x[i]) AS s, CAST(count(*) AS HUGEINT) AS c FROM a{r} CROSS JOIN wide CROSS JOIN LATERAL (SELECT unnest(range(1, CAST(w AS BIGINT) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e)""")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)")
    chain = ",\n".join(steps)
    return f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), wide AS (SELECT max(len(v)) // {parts} AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept CROSS JOIN wide CROSS JOIN range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS y FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts) WHERE e < {entries}),
{chain},
last AS MATERIALIZED ({nearest.format(k=entries, gap=gap, r=rounds)}),
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded CROSS JOIN book"""
