"""Parquet tables in buckets of a key, so that a small batch reads and rewrites only the buckets that it touches.

A table's folder has one folder for each bucket (bucket=0 to buckets - 1, by a hash of the key; bucket=-1 for rows without a
key). The number of buckets belongs to the table and is the same in all calls: choose it so that one bucket is a task's work.
Only the touched buckets are listed and read; their numbers, `buckets` + 1 at most, are all that the driver sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslink.operators.tables import insert_ignore, upsert
from newslink.sources.storage import discard, materialize


def bucket_of(keys: list[str], buckets: int) -> Column:
    """A row's bucket; -1 if a part of its key is null."""
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    return F.when(there, F.pmod(F.xxhash64(*keys), F.lit(buckets))).otherwise(-1).cast("int")


def write_keyed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A new table at path; each bucket is written by one task."""
    df.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def touched(df: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets of df's keys, in order."""
    return sorted(r.bucket for r in df.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect())


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_buckets(like: DataFrame, path: str, numbers: list[int]) -> DataFrame:
    """The rows of these buckets with the columns of `like`, and further partition columns; a bucket without rows has no folder."""
    spark: SparkSession = like.sparkSession
    there = [f"{path}/bucket={k}" for k in numbers if _exists(spark, f"{path}/bucket={k}")]
    empty = like.limit(0).withColumns({"bucket": F.lit(0), "batch": F.lit(0).cast("bigint")})
    return spark.read.schema(empty.schema).option("basePath", path).parquet(*there) if there else empty


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The whole table, with its column `batch` if schema has that; without rows where nothing was ever written."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def upsert_keyed(path: str, source: DataFrame, key: str, values: list[str], buckets: int, latest: str | None = None) -> list[int]:
    """tables.upsert into the table at path; the numbers of the buckets that were rewritten, all others stay as they are.

    The merged buckets are written beside the table first and replace the old ones in one job's commit. The same source
    again changes nothing, but for its rows without a key, which are inserted again.
    """
    source = source.select(key, *values)
    numbers = touched(source, [key], buckets)
    if numbers:
        old = read_buckets(source, path, numbers).select(key, *values)
        merged = materialize(upsert(old, source, key, values, latest), "merged", keep=True)
        out = merged.withColumn("bucket", bucket_of([key], buckets)).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        discard(merged)
    return numbers


def append_new(path: str, batch: DataFrame, number: int, keys: list[str], order: list[str], buckets: int, by: list[str] | None = None) -> list[int]:
    """insert_ignore of one numbered batch into the table at path; the numbers of the buckets that were read.

    The table lies in buckets of `by` (some of the keys; default: all). Within a bucket each batch has a folder of its own,
    which is written again if the batch is: nothing is lost or doubled.
    """
    numbers = touched(batch, by or keys, buckets)
    if numbers:
        old = read_buckets(batch, path, numbers).where(F.col("batch") != number)
        write_batch(path, insert_ignore(old, batch, keys, order), number, by or keys, buckets)
    return numbers


def write_batch(path: str, rows: DataFrame, number: int, by: list[str], buckets: int) -> None:
    """Rows of one numbered batch in the folders that are the batch's own; written again, they replace themselves."""
    placed = rows.withColumns({"bucket": bucket_of(by, buckets), "batch": F.lit(number).cast("bigint")})
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
