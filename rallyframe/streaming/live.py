"""Live scan: a stream of events joined with a table of picks, rules that fire once for each pick, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def signal_id(pick: str) -> Column:
    """The same id whenever the same rule fires for the same pick."""
    return F.sha2(F.concat_ws("|", F.col(pick).cast("string"), F.col("rule")), 256).alias("signal")


def scan(events: DataFrame, picks: DataFrame, pick: str, time: str, rules: dict[str, str]) -> DataFrame:
    """One row (pick, rule, time) for each event of a pick and each rule (a SQL condition) that it meets; for streams and batches.

    The picks are a table: a stream's micro-batches are each joined with it, so their size decides how. Events without a pick or a time are left out.
    """
    met = events.where(F.col(time).isNotNull()).join(picks, pick)
    held = F.filter(F.array(*[F.when(F.expr(condition), F.lit(name)) for name, condition in rules.items()]), F.isnotnull)
    return met.select(pick, F.col(time), F.explode(held).alias("rule"))


def fired(scanned: DataFrame, pick: str, time: str) -> DataFrame:
    """Each (pick, rule) once: signal, pick, rule, the time it first fired and how often it was met; a stream's state has one row for each. For update mode or a batch."""
    return scanned.groupBy(pick, "rule").agg(F.min(time).alias(time), F.count("*").alias("seen")).select(signal_id(pick), pick, "rule", time, "seen")


def emit_once(path: str, id_col: str = "signal") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that adds to ``path`` the rows whose id no other batch has written.

    Each batch has a folder of its own that a repeated batch replaces, so a restart after a failure neither loses nor doubles
    a signal, also with a checkpoint that starts anew: ids decide, not offsets. Only ids are read of what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates([id_col])
        there = _batches(spark, path)
        if others := [n for n in there if n != number]:
            new = new.join(spark.read.parquet(*[f"{path}/batch={n}" for n in others]).select(id_col), id_col, "left_anti")
        if number in there:
            again = spark.read.parquet(f"{path}/batch={number}").select(id_col)
            if not again.join(new, id_col, "left_anti").isEmpty():  # the number is an earlier checkpoint's: its rows stay
                new, number = new.join(again, id_col, "left_anti"), max(there) + 1
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches written so far."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return [int(n.partition("=")[2]) for n in names if n.startswith("batch=")]
