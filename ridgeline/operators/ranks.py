"""Numbers in an order over tables of any size: rows in ranges, counts or sums a range, and what stands before each range."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .durable import written

#: Bits that a row's number takes within its range, as monotonically_increasing_id() has them.
WITHIN = 33


def before_ranges(per_range: list[tuple[int, int]]) -> dict[int, int]:
    """What stands before each range, from (range, amount); a row a range, which is a task's, comes to the driver."""
    ordered = sorted(per_range)
    return dict(zip([k for k, _ in ordered], accumulate([0] + [n for _, n in ordered]), strict=False))


def shifted(spark, before: dict[int, int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(before.items()), "range bigint, before bigint"))  # a row a task


def dense_codes(values: DataFrame, column: str) -> DataFrame:
    """column, code: the distinct values that are not null, numbered from 0 in their order.

    Distinct values are dealt into ranges by a sample and sorted there; a value's number is its place in its range, and
    what the ranges before hold.  No task has more than its range, the driver a number for each.
    """
    ranged = values.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    numbered = written(ranged.select(column, F.monotonically_increasing_id().alias("id")), "codes")
    numbered = numbered.select(column, F.shiftright("id", WITHIN).alias("range"), F.col("id").bitwiseAND((1 << WITHIN) - 1).alias("at"))
    counts = numbered.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()
    before = shifted(values.sparkSession, before_ranges([(r.range, r.n) for r in counts]))
    return numbered.join(before, "range").select(column, (F.col("before") + F.col("at")).alias("code"))


def offsets(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows with start, the sum of the sizes before each in the order of the key; keys differ.

    Each range is summed as it streams by, and moved on by the sums of the ranges before it.
    """
    columns = rows.columns
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("range", F.spark_partition_id().cast("bigint"))
    schema = StructType([*ranged.schema.fields, StructField("within", LongType())])

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for b in batches:
            sums = b[size].fillna(0).astype("int64").cumsum()
            b["within"] = total + sums - b[size].fillna(0).astype("int64")
            total += int(sums.iloc[-1]) if len(b) else 0
            yield b

    summed = written(ranged.mapInPandas(running, schema), "offsets")
    sums = summed.groupBy("range").agg(F.sum(size).alias("n")).collect()
    before = shifted(rows.sparkSession, before_ranges([(r.range, r.n or 0) for r in sums]))
    return summed.join(before, "range").select(*columns, (F.col("before") + F.col("within")).alias("start"))
