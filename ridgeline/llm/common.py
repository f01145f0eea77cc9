"""Helpers that the text operators share: Arrow maps, word hashing, shared folders, size checks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space that bytes.split() also uses: [\x20\x09-\x0D].
SPACE = rb" \t\n\r\x0b\x0c"
#: Bytes of files up to which a written table may be broadcast; beyond it a shuffle join is used.
BROADCAST_BYTES = 24 << 20


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


#: Rows of an Arrow batch that are Python objects at one time.
SLICE_ROWS = 1024


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], ddl: str, rows: int = SLICE_ROWS, release: Callable[[], None] = lambda: None) -> DataFrame:
    """Map slices of Arrow batches, of so many rows at most, with fn, which gives a dict of columns for a slice.

    An empty table gives an empty table; memory is bounded by the slice and by Spark's own batches
    (spark.sql.execution.arrow.maxRecordsPerBatch), not by the partition.  release is called when a task ends.
    """
    schema = schema_of(ddl)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches, rows):
            out = fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(frugal(run, release), schema)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], release: Callable[[], None] = lambda: None) -> Callable:
    """run, with memory given back when the task ends: Spark keeps worker processes, and idle ones count against the executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
            HASHES.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return task


def slices_of(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    """The batch with other values in one column."""
    k = batch.schema.get_field_index(name)
    return pa.RecordBatch.from_arrays([pa.array(values, batch.schema.field(k).type) if i == k else c for i, c in enumerate(batch.columns)], schema=batch.schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def text_hash(name: str):
    """Column name: hash of text, a null one as the empty text."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias(name)


def by_size(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in slices of at most so many characters; a longer text is a slice of its own."""
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > chars:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


class WordHasher(dict):
    """word -> 63-bit hash; forgets everything at limit entries, so memory is bounded."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


HASHES = WordHasher()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply) over an array."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each k consecutive entries: a polynomial modulo 2**64, built by doubling, then mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total, at, block, power, width = None, 0, h, base & (2**64 - 1), 1
        rest = k
        while rest:
            if rest & 1:
                part = block[at : at + n]
                total = part.copy() if total is None else total * np.uint64(power) + part
                at += width
            rest >>= 1
            if rest:
                block = block[: len(block) - width] * np.uint64(power) + block[width:]
                power = power * power & (2**64 - 1)
                width *= 2
    return mix(total, k)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Folders of the tables that the innermost function under clears_tables has written; None outside of any.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    if (written := WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clears_tables(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """fn with its result written; the tables that fn itself wrote on the way go then, and if it fails."""

    @wraps(fn)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        paths: list[str] = []
        token = WRITTEN.set(paths)
        try:
            try:
                out = fn(docs, *args, **kwargs)
            finally:
                WRITTEN.reset(token)
            return materialise(out, fn.__name__.replace("_", "-"))
        finally:
            for path in paths:
                remove_folder(docs.sparkSession, path)

    return run


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of this library's own, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def below_share(df: DataFrame, share: float, hash_col: str) -> DataFrame:
    """About that share of the rows, chosen by their hash alone (a bigint column): all of them from 1 on."""
    return df if share >= 1 else df.where(F.pmod(F.col(hash_col), F.lit(1 << 52)) < int(share * (1 << 52)))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with so many underscores in front that no taken column has it."""
    low = {c.lower() for c in taken}
    longest = max((len(c) for c in taken), default=0)
    return [next(x for k in range(longest + 2) if (x := "_" * k + name).lower() not in low) for name in names]


def bytes_of(df: DataFrame) -> int:
    """Size in memory that Spark's own statistics give for a written table: of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its files are small enough, else as it is, for a shuffle join.

    Files are compressed, so the bytes of what is broadcast are some times these, but bounded by them.
    """
    return F.broadcast(df) if bytes_of(df) <= limit else df


def highest(rows: DataFrame, count: str, key: str, most: int, weight: str | None = None) -> tuple[Column, bool]:
    """A condition that rows of the highest counts meet, about `most` of them at most (or of their weight), and whether all rows do.

    Counts fall into some hundred classes, and one aggregate over those decides: the driver gets a row a class, whatever the table.
    Of the class at the edge a share of the keys is chosen by hash.  Counts are 1 or more.
    """
    n = F.col(count)
    level = F.when(n <= 64, n).otherwise(64 + F.floor(16 * F.log2(n / 64))).cast("int")
    classes = rows.groupBy(level.alias("level")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("total")).collect()
    left = most
    for x in sorted(classes, key=lambda x: -x.level):
        if x.total > left:
            share = F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(left / x.total * (1 << 40)))
            return (level > x.level) | ((level == x.level) & share), False
        left -= x.total
    return F.lit(True), True


def local_path(uri: str) -> tuple[object, str]:
    """A pyarrow file system and the path in it, for folders in any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")
