"""Session helpers shared by all queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Settings that results or memory depend on: UTC times, and Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


#: Tables of long texts, whose rows are much work.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def placed(rows: DataFrame) -> DataFrame:
    """Rows of a table of files with their ``place`` in it, by file and row: the same however the table is cut or dealt out."""
    return rows.withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows that lie in fewer splits than there are cores, as in one file of one row group, dealt out over all of them.

    What has a split for each core, and so everything large, stays where it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes, each of which is much work, such as keys that pictures are made of, dealt out over all cores, in four
    parts for each.  Files of them are small, so that one task would have many of them or all, however many splits there are."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def by_key(rows: DataFrame, key: str, n_rows: int, most: int = 100_000) -> DataFrame:
    """Rows dealt out by key for all the windows, groups and joins by key that follow, ``most`` rows of ``n_rows`` to a task, so
    that a task's memory stays what it is as tables grow: the session's number of partitions is one for all sizes."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // most))
    return rows.repartition(parts, key)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset, one of our own on a single machine, as in tests; a cluster
    has to name one, as its executors do not see each other's disks."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="maskwork-")
        at = _own[app]
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: computed once, and there if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/maskwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` has made and no later result reads."""
    files = table.inputFiles()
    if files:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/maskwork/" in folder.toString():
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
