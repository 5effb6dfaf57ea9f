"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where a step sets its own number of tasks.
ROWS = 1 << 19

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, in the session or its context.

    Where none is set and the master is local, as in tests, a temporary folder that goes with the process; a cluster without
    the setting is an error, as its executors would write where no one else reads.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sparkloom-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def _own(spark: SparkSession) -> str:
    return f"{folder(spark)}/tables/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: lineage ends here and lost executors lose nothing."""
    path = f"{_own(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """How many tasks hold `each` (ROWS) of so many rows, so that a task's memory doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // (each or ROWS)))


def numbered(df: DataFrame, *order) -> DataFrame:
    """The rows with number, from 0 in the given order: ranges are sorted and counted apart, so no task holds all. Rows that order leaves equal come in any order."""
    held = written(df)
    spread = held.repartitionByRange(parts(df.sparkSession, held.count()), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    spread = written(spread.select("*", F.spark_partition_id().alias("nb_part"), place.alias("nb_place")))
    # a row a range
    sizes = sorted(spread.groupBy("nb_part").agg((F.max("nb_place") + 1).alias("n")).collect())
    before, first = 0, []
    for part, n in sizes:
        first.append((part, before))
        before += n
    known = df.sparkSession.createDataFrame(first, "nb_part int, nb_first bigint")
    return spread.join(F.broadcast(known), "nb_part").select(*df.columns, (F.col("nb_first") + F.col("nb_place")).alias("number"))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote; no result that reads them may be in use."""
    files, at = _files(spark, _own(spark))
    files.delete(at, True)


def stamp(spark: SparkSession, path: str) -> str:
    """What changes when a file or folder does: its size, number of files and time of change."""
    files, at = _files(spark, path)
    held = files.getContentSummary(at)
    return f"{path}:{held.getLength()}:{held.getFileCount()}:{files.getFileStatus(at).getModificationTime()}"
