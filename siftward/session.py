"""Session settings for the jobs, and the places they share."""

import warnings
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # All calendar arithmetic is in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What a finished query has shuffled is read no more, and would stay on disk until the driver collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # A task reads as much of a large file, or one row group if that is larger.
    "spark.sql.files.maxPartitionBytes": str(32 << 20),
}


_cleared: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options the jobs rely on; cluster sizing stays untouched."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; where none is set, one in its warehouse.

    Both are storage that all machines of a cluster share, never a machine's own disk. A session has a
    folder of its own in it.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                warnings.warn("spark.checkpoint.dir is not set; tables are stored in the warehouse, which all machines must share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/siftward_stored"
        context.setCheckpointDir(folder)
    folder = context.getCheckpointDir()
    _clear_at_end(spark, f"{folder}/siftward")
    return folder


def _clear_at_end(spark: SparkSession, folder: str) -> None:
    """Have the session's stored tables deleted when the application ends."""
    if folder not in _cleared:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _cleared.add(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store as a table in the shared folder and go on from there.

    Lost executors then cost no recomputation, and readers of the table get
    column pruning and a known size.
    """
    path = f"{shared_folder(df.sparkSession)}/siftward/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """Arrow's file system of a URI, and the path within it.

    Covers local and mounted paths and the stores Arrow can open (HDFS needs its
    client library on the machine).
    """
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
