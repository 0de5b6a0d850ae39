"""A serving index of rows by unordered pair: folders by the first byte of a hash of the pair, rows sorted by pair within.

A lookup reads one folder of 256 and, in its files, the row groups whose pair range holds the pair.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "\x1f"


def pair_of(a: Column, b: Column) -> Column:
    """Both names in order, as one text."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws(MARK, F.least(a, b), F.greatest(a, b))


def bucket_of(pair: Column) -> Column:
    return F.conv(F.substring(F.sha2(pair, 256), 1, 2), 16, 10).cast("int")


def build_index(df: DataFrame, path: str, a: str, b: str, time: str, parts: int = 4) -> None:
    """Write ``df`` with its pair below ``path``. Rows without one of the names are left out.

    Rows are dealt by bucket and part of the pair, so a bucket is written by up to ``parts`` tasks, and a pair's rows lie together.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("pair", pair_of(F.col(a), F.col(b)))
    rows = rows.withColumns({"bucket": bucket_of(F.col("pair")), "__part": F.pmod(F.xxhash64("pair"), F.lit(parts))})
    rows.repartition("bucket", "__part").sortWithinPartitions("bucket", "pair", time).drop("__part").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, a: str, b: str) -> DataFrame:
    """The rows of one pair, from its bucket alone."""
    pair = MARK.join(sorted((str(a), str(b)), key=lambda s: s.encode()))
    bucket = hashlib.sha256(pair.encode()).digest()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("pair") == pair)).drop("bucket")


def lookup_all(spark: SparkSession, path: str, requests: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of all pairs that ``requests`` (columns a, b) names; only the buckets named are read."""
    wanted = requests.select(pair_of(F.col(a), F.col(b)).alias("pair")).where("pair IS NOT NULL").distinct().withColumn("bucket", bucket_of(F.col("pair")))
    return spark.read.parquet(path).join(wanted, ["bucket", "pair"], "left_semi").drop("bucket")
