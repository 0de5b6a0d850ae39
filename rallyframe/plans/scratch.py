"""Intermediate tables in the shared folder the session names in ``spark.checkpoint.dir``.

Iterative operators write what they need more than once as Parquet there and read it back: that cuts the
lineage, survives the loss of any executor, and lets later steps read only the columns they need. Tables are deleted
as soon as nothing reads them any more (``unstash``), the last ones when the application ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``; a temporary folder on local masters where that is unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="rallyframe-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/rallyframe/{name}-{uuid.uuid4().hex}"
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame) -> None:
    """Delete the files of stashed tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rallyframe/" in path:
                system, at = _file_system(df.sparkSession, path)
                system.delete(at, True)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Join with ``small`` broadcast if its counted ``rows`` are at most ``limit``, else shuffled."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)
