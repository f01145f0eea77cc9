"""Tables made once from a source and kept: fresh if made by this version from a source of the same size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def fingerprint(source: DataFrame) -> int:
    """Bytes of the source's files, by Spark's own listing of them."""
    files = source.select("_metadata.file_path", "_metadata.file_size").distinct()
    return int(files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("n")).first().n)


def packed(spark: SparkSession, source: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], version: int = VERSION) -> DataFrame:
    """make(source), read from the table at path; the table is made anew if the version or the source's size differ.

    A table lies in a folder named after both, and its committer's _SUCCESS file tells that it is whole, so a reader never sees a half.
    """
    folder = f"{path.rstrip('/')}/v{version}-{fingerprint(source)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make(source).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
