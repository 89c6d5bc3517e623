"""Session helpers shared by every operator: table loading, package shipping and durable materialisation."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()
#: Where the tables of cut() lie.
_cuts: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: With it, Spark removes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, whatever their working folder; once for each context."""
    sc = spark.sparkContext
    if sc not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(), f"strandweave_{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(target)
        _shipped.add(sc)
        # Rows can be long; smaller Arrow batches bound the memory of a task on both sides of the pipe.
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (local[n], as in tests) gets a folder of its own; a cluster is refused,
    since its executors would not see a folder of the driver.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="checkpoints_")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends here and survives the loss of executors.

    Parquet is smaller than what checkpoint() writes. The shuffle files of the write go when it ends; else they would
    stay until the driver happens to collect its garbage. The table goes with free(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut_{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _cuts[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() gave and nothing reads any more; others are left alone."""
    for df in tables:
        if path := _cuts.pop(df, None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
