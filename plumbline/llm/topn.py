"""The N highest-scoring items of every group, by statistics-guided skipping.

The rows are written once, clustered by group and downward score: a range partitioning on (group, score, tie) cuts a
group of millions of items into several files, each with its own range of scores, and Parquet footers keep the group and
score range of every row group. From these footers alone follows a floor for a group's N-th score: a row group of that
group only, with at least N rows, cannot lie above it. Row groups strictly below the floor of the one group they hold
are never read. What is left is read file by file in descending maximum score, each row group is skipped once every
group that it can contain has N better items, and a last ranking over the few survivors joins the files.

Order: score downward, then tie column upward by code points, then id upward; null ties come last. Rows with a null
score belong to no ranking. Null group keys form groups of their own. Repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import materialize, parts_for, scratch_path

#: Rows of a clustered file.
FILE_ROWS = 500_000
#: Names of file systems, in Hadoop and in Arrow (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3"}
CLUSTERED = "grp string, score double, tie string, id bigint"


def cluster_by_group(rows: DataFrame, keys: list[str], score: str, tie: str, row_id: str, files: int | None = None, row_group_bytes: int = 1 << 20) -> str:
    """Write (group, score, tie, id) clustered; the path. Group keys become one string with nulls kept apart."""
    spark = rows.sparkSession
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("\x00"), F.lit("\x00\x00"))), F.lit("-"))
    slim = rows.select(F.concat_ws("\x00\x01", *[part(k) for k in keys]).alias("grp"), F.col(score).cast("double").alias("score"), F.col(tie).cast("string").alias("tie"), F.col(row_id).cast("bigint").alias("id"))
    # a range partitioning reads its input twice
    slim = materialize(slim.filter(F.col("score").isNotNull() & ~F.isnan("score")), "scored")
    order = [F.col("grp"), F.col("score").desc(), F.col("tie").asc_nulls_last(), F.col("id")]
    count = files or parts_for(spark, slim.count(), FILE_ROWS)
    path = scratch_path(spark, "clustered")
    writer = slim.repartitionByRange(count, *order).sortWithinPartitions(*order).write
    writer.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", 2000).option("parquet.block.size.row.check.min", 1).parquet(path)
    return path


def _open(uri: str) -> pq.ParquetFile:
    scheme, there, rest = uri.partition("://")
    fs, path = pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + there + rest) if there else (pafs.LocalFileSystem(), uri.removeprefix("file:"))
    return pq.ParquetFile(fs.open_input_file(path))


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def _files(spark: SparkSession, path: str) -> list[str]:
    """A table's files: one for every FILE_ROWS rows."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jvm_path)
    return [s.getPath().toString() for s in listed if s.getPath().getName().endswith(".parquet") and s.getLen() > 0]


def row_group_statistics(spark: SparkSession, path: str) -> DataFrame:
    """file, row_group, rows, first and last group, lowest and highest score: from the footers, read in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                with _open(_uri(uri)) as f:
                    for i in range(f.metadata.num_row_groups):
                        group = f.metadata.row_group(i)
                        g, s = group.column(0).statistics, group.column(1).statistics
                        out.append((uri, i, group.num_rows, g.min, g.max, float(s.min), float(s.max)))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["file", "row_group", "rows", "first_group", "last_group", "low", "high"])

    files = _files(spark, path)
    if not files:
        return spark.createDataFrame([], "file string, row_group int, rows bigint, first_group string, last_group string, low double, high double")
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(parts_for(spark, len(files), 50))
    return names.mapInArrow(run, "file string, row_group int, rows bigint, first_group string, last_group string, low double, high double")


def top_n(spark: SparkSession, path: str, n: int) -> DataFrame:
    """grp, score, tie, id and rank (1 to n) from a clustered table."""
    statistics = row_group_statistics(spark, path)
    single = F.col("first_group") == F.col("last_group")
    floors = statistics.filter(single & (F.col("rows") >= n)).groupBy(F.col("first_group").alias("__g")).agg(F.max("low").alias("__floor"))
    wanted = statistics.join(floors, statistics.first_group == F.col("__g"), "left")
    wanted = wanted.filter(~(single & F.col("__floor").isNotNull() & (F.col("high") < F.col("__floor"))))
    plan = wanted.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("high", "row_group", "first_group", "last_group")), asc=False).alias("groups"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _best_of_file(row["file"], row["groups"], n).to_batches()

    # the plan is tiny, what it makes the tasks read is not: a row is a file
    found = plan.repartition(max(1, len(_files(spark, path))), "file").mapInArrow(run, CLUSTERED)
    rank = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("tie").asc_nulls_last(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)


def _first_rows(grp: pa.ChunkedArray, n: int) -> np.ndarray:
    """Which rows are among the first n of a run of equal groups."""
    codes = grp.combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, int)
    return np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)])) < n


def _best_of_file(uri: str, groups: list[dict], n: int) -> pa.Table:
    """The first n rows of every group of a file. The file is in the order of groups and ranks, so these are the first rows
    of the group's run, and only groups that fill whole row groups need a floor."""
    floors: dict[str, float] = {}
    found: list[tuple[int, pa.Table]] = []
    with _open(_uri(uri)) as f:
        for group in groups:
            name = group["first_group"] if group["first_group"] == group["last_group"] else None
            if name is not None and group["high"] < floors.get(name, -np.inf):
                continue  # strictly below the N-th score: ties are still read
            rows = f.read_row_group(group["row_group"])
            rows = rows.filter(pa.array(_first_rows(rows.column("grp"), n)))
            found.append((group["row_group"], rows))
            if name is not None and rows.num_rows == n:
                floors[name] = max(floors.get(name, -np.inf), rows.column("score")[n - 1].as_py())
    whole = pa.concat_tables([rows for _, rows in sorted(found, key=lambda x: x[0])])
    return whole.filter(pa.array(_first_rows(whole.column("grp"), n)))
