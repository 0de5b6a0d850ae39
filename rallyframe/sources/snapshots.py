"""Yearly snapshots: partitioned Parquet with a manifest that every read is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.plans.scratch import stash

_MANIFEST = "year int, n long, first string, last string"


def write_years(df: DataFrame, path: str, time: str, empty_years: list[int] | None = None) -> None:
    """Write rows below ``path`` by UTC year, replacing only the years at hand, and the manifest beside them.

    Spark commits the years' files together and each manifest is a folder of its own number, the last one counting, so a
    reader meets the old state or the new one; after a crash between the two, writing again mends it. empty_years: years
    to remove.
    """
    spark = df.sparkSession
    rows = df.withColumn("year", F.year(time))
    rows.repartition("year", F.pmod(F.xxhash64(time), F.lit(8))).sortWithinPartitions("year", time).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{path}/data")
    written = manifest(rows, time)
    for year in empty_years or []:
        _delete(spark, f"{path}/data/year={year}")
    last = _last(spark, path)
    if last is not None:
        old = spark.read.schema(_MANIFEST).json(f"{path}/manifest/{last:08d}")
        gone = old.where(~F.col("year").isin(empty_years or [-1])).join(written.select("year"), "year", "left_anti")
        written = gone.unionByName(written)
    written.coalesce(1).write.json(f"{path}/manifest/{(last or 0) + 1:08d}")


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    system, at = _path(spark, path)
    system.delete(at, True)


def _last(spark: SparkSession, path: str) -> int | None:
    """The number of the last whole manifest."""
    system, at = _path(spark, f"{path}/manifest")
    if not system.exists(at):
        return None
    done = [int(f.getPath().getName()) for f in system.listStatus(at) if f.getPath().getName().isdigit() and system.exists(_path(spark, f"{f.getPath()}/_SUCCESS")[1])]
    return max(done, default=None)


def manifest(rows: DataFrame, time: str) -> DataFrame:
    """(year, n, first, last): one row a year."""
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.min(time).cast("string").alias("first"), F.max(time).cast("string").alias("last"))


def read_years(spark: SparkSession, path: str, time: str, years: list[int] | None = None, before: str | None = None) -> DataFrame:
    """Rows of the chosen years strictly before a cutoff; raises if those years' rows differ from the manifest. Only their partitions are read."""
    last = _last(spark, path)
    if last is None:
        raise ValueError(f"there is no manifest below {path}")
    rows = spark.read.parquet(f"{path}/data")
    known = spark.read.schema(_MANIFEST).json(f"{path}/manifest/{last:08d}")
    if years is not None:
        rows, known = rows.where(F.col("year").isin(years)), known.where(F.col("year").isin(years))
    want = {tuple(r) for r in known.collect()}  # one row a year
    if {tuple(r) for r in manifest(rows, time).withColumn("year", F.col("year").cast("int")).collect()} != want:
        raise ValueError(f"the years below {path} differ from their manifest")
    return rows if before is None else rows.where(F.col(time) < F.lit(before).cast(rows.schema[time].dataType))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header that must name the schema's columns; lines that do not parse fail."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema).fieldNames()
    found = spark.read.option("header", True).csv(path).columns
    if found != want:
        raise ValueError(f"the header is {found}, not {want}")
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, rows: int | None = None, where: str | None = None) -> DataFrame:
    """JSON lines, gzip or plain; raises if the files do not hold ``rows`` lines; then filtered."""
    if rows is not None and (n := spark.read.text(path).count()) != rows:
        raise ValueError(f"{path} holds {n} lines, not {rows}")
    found = spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    return found if where is None else found.where(where)


def append_new(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Rows whose digest of ``columns`` is not below ``path`` yet, once each, appended there; returns what was appended.

    One writer at a time: two that run together may both append a row.
    """
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    fresh = df.withColumn("digest", F.sha2(F.to_json(F.struct(*columns)), 256)).dropDuplicates(["digest"])
    try:
        fresh = fresh.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    made = stash(fresh, "fresh")  # written once, so that what is returned is what was appended
    made.write.mode("append").parquet(path)
    return made
