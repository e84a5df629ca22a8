"""Tables saved in key order, read by range of the first key from the files that can hold it.

Rows are range-partitioned and sorted within files, and an index of the least and greatest first key of each file is written
into the same version, so that table and index are switched together. A reader of a range opens only
the files whose span meets it, and Parquet's own statistics skip row groups inside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelcast.sources import versions

INDEX = "_spans"


def write_ordered(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    """Save ``df`` in order of ``keys``; ``files`` is the number of files to aim at, by default one per shuffle partition."""
    spark, first = df.sparkSession, keys[0]
    spread = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)

    def index(version: str) -> None:
        rows = spark.read.schema(df.schema).parquet(version)
        spans = rows.groupBy(F.input_file_name().alias("file")).agg(
            F.min(first).alias("low"), F.max(first).alias("high"), F.count("*").alias("n"),
            F.count(F.when(F.col(first).isNull(), 1)).alias("n_null"))
        spans.coalesce(1).write.parquet(f"{version}/{INDEX}")

    versions.write(spread.sortWithinPartitions(*keys), path, "parquet", finish=index)


def spans(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``low``, ``high``, ``n`` and ``n_null`` of each file of the table."""
    _, parts = versions.latest(spark, path.rstrip("/"))
    return spark.read.parquet(f"{path.rstrip('/')}/{parts['']}/{INDEX}")


def read_range(spark: SparkSession, path: str, schema: StructType, key: str, low, high) -> DataFrame:
    """Rows whose ``key``, the first one of the order, lies in [low, high]; rows without a key are in no range."""
    meeting = spans(spark, path).filter((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low))).orderBy("low", "file")
    found = [row["file"] for row in meeting.select("file").collect()]  # a name per file that will be opened
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*found).filter(F.col(key).between(low, high))
