"""What the three vector operators share: rows that take part, dense matrices from Arrow lists, group counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def finite_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """n bigint, vec_id, v array<float or double> and, if asked for, label: the rows whose vector is whole and finite.

    n numbers the rows; it holds still only once the table is written.  Columns of other names are left behind.
    """
    kind = df.select(vector_col).dtypes[0][1]
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    columns = [F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), *([F.col(label_col).alias("label")] if label_col else [])]
    return df.where(v.isNotNull() & whole).select(F.monotonically_increasing_id().alias("n"), *columns)


def written_rows(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """The rows, written, how many they are, and their longest vector's length."""
    rows = materialise(df, name)
    count, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    return rows, count, dims


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of a float64 matrix; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.asarray(column.value_lengths())
    if (length == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < length[:, None]] = flat
    return out


def floors(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of a float64 matrix, factor a power of two: int64, or Python's integers where that is too short."""
    top = np.abs(x).max(initial=0)
    if top < 2.0**40 / factor:
        return np.floor(x * factor).astype(np.int64)
    exact = [math.floor(v * factor) if abs(v) < 2.0**52 else int(v) * factor for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def groups_for(count: int, tasks: int, least: int, most: int) -> int:
    """Into how many groups rows go: none of more than about `most` rows, and one for each task unless under `least` rows come of it."""
    return max(1, -(-count // most), min(tasks, count // least))
