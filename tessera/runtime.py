"""Session-level helpers: table access, lineage cuts and shared scratch space."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Python functions travel to the executors by value: those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["tessera"])


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named parquet table, pruned to ``cols`` when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def stream(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str]:
    """(folder, name pattern) of a table's files, for a file stream: a table is one file or a folder of files, and a stream's pattern is
    compared with the names of files alone."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (f"{sf_dir}/{name}.parquet", "*.parquet") if fs.getFileStatus(there).isDirectory() else (sf_dir, f"{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where a scan has fewer splits than there are cores (a file of one row
    group is one split's work whatever its size); a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    enough = len(df.inputFiles()) >= cores or df.rdd.getNumPartitions() > 2 * cores
    return df if enough else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, from ``spark.checkpoint.dir``."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        # One process: its own disk is all the sharing there is.
        there = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(there)
        return there
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once, keep it reliably in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffle files stay on the executors' disks until what read them is collected, which may take as long as the session.
    To be called where large steps have just been written and nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder for tables that an operator writes itself."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch, where it is there."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a table was last written, and its bytes: tells whether what was derived from it still holds."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(there).getModificationTime(), fs.getContentSummary(there).getLength()
