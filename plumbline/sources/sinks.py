
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.joins import upsert
from plumbline.session import delete_path


# K01
def write_document(spark: SparkSession, path: str, text: str) -> None:
    """One small document, replaced as a whole: written beside its place, then renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"cannot replace {path}")


# K02
def write_all(frames: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Several results side by side under a folder."""
    for name, df in frames.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")


# K03, K04
def write_partitioned(df: DataFrame, path: str, by: Sequence[str], files_per_value: int = 1) -> None:
    """A folder per value; a hot value is spread over files_per_value files by a salt."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df.withColumn("__salt", salt).repartition(tasks, *by, "__salt").drop("__salt").write.mode("overwrite").partitionBy(*by).parquet(path)


# K05
def write_label_csv(df: DataFrame, path: str, columns: Sequence[str], order: str = "image") -> None:
    """One CSV file in a fixed order of columns and rows, lists joined by ' | '. A hand-edited file, small by its nature."""
    flat = [F.array_join(c, " | ").alias(c) if df.schema[c].dataType.simpleString().startswith("array") else F.col(c) for c in columns]
    df.select(*flat).orderBy(order).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


# K06
def label_template(items: DataFrame, version: str, role: str = "template") -> DataFrame:
    """One row, text: a label bundle of the items (image, status) to be filled in by hand."""
    nodes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("image", F.struct(F.col("status").alias("expected_status"), F.lit(1.0).alias("weight"), F.lit("").alias("notes"))))))
    return items.agg(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(role).alias("dataset_role"), nodes.alias("items"))).alias("text"))


def part_of(key: str, rows: int, size: int) -> Column:
    """The number of the part that a row belongs to, by a hash of the key: parts of about size rows."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows // size)))).alias("part")


# K06
def write_label_bundles(items: DataFrame, path: str, version: str, size: int = 1000) -> None:
    """Label bundles of about size items (image, status) each, a document per file, written by the tasks."""
    node = F.struct("image", F.struct(F.col("status").alias("expected_status"), F.lit(1.0).alias("weight"), F.lit("").alias("notes")))
    nodes = items.groupBy(part_of("image", items.count(), size)).agg(F.map_from_entries(F.array_sort(F.collect_list(node))).alias("items"))
    text = F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit("template").alias("dataset_role"), "items"))
    nodes.select(text).write.option("maxRecordsPerFile", 1).text(path)


# K08, K09, K10
def upsert_table(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], version: str) -> str:
    """The path of a new version of a keyed table: under path/v=<n>, so that readers of the old one are not disturbed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []
    rows = upsert(spark.read.parquet(f"{path}/v={versions[-1]}"), changes, keys, version) if versions else upsert(changes.limit(0), changes, keys, version)
    target = f"{path}/v={(versions[-1] if versions else 0) + 1}"
    rows.write.mode("overwrite").parquet(target)
    for old in versions[:-1]:
        delete_path(spark, f"{path}/v={old}")
    return target


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v="))
    return spark.read.parquet(f"{path}/v={last}")


# K11
def refreshed_manifest(scanned: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """An entry for every scanned file: the existing one where there is one."""
    return scanned.select(key).distinct().join(existing, key, "left")


# K12
def append_cache(df: DataFrame, path: str, version: Column | str) -> None:
    """Rows added under their version, a folder each: one for all, or a column. One scan and one write."""
    df.withColumn("version", F.lit(version) if isinstance(version, str) else version).write.mode("append").partitionBy("version").parquet(path)
