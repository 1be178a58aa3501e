"""Sessions and the folder that all executors share."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, app: str = "plumbline", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where a session names none, as in tests, a temporary one is set."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="plumbline-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that several stages read. clear_scratch removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._plumbline_scratch = [*getattr(sc, "_plumbline_scratch", []), path]
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._plumbline_path = path
    return written


def settled(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """df (or columns of it) written, unless it comes straight from materialize; for what is read several times."""
    if getattr(df, "_plumbline_path", None):
        return df
    return materialize(df.select(*columns) if columns else df, name)


def release(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing will read again, such as those of a loop's earlier rounds."""
    for df in frames:
        path = getattr(df, "_plumbline_path", None)
        if path:
            delete_path(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan needs any more, such as those before a materialized table.

    Else they stay on the executors' disks until the driver happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session's queries wrote to the shared folder. Their results must have been written or read."""
    sc = spark.sparkContext
    for path in getattr(sc, "_plumbline_scratch", []):
        if "/package-" not in path:
            delete_path(spark, path)
    sc._plumbline_scratch = []


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores where its files give fewer tasks than there are cores, for stages that compute much per row.

    Large inputs have more tasks than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < cores else df


def parts_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """The number of tasks for so many rows: one for every rows_per_task, but one for every core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per session, wherever the driver was started from.

    The zipped sources go to the shared folder and from there, by Spark's own file service, to the Python workers.
    """
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    target = f"{scratch_path(spark, 'package')}/plumbline.zip"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(target)
    sc._plumbline_shipped = True
