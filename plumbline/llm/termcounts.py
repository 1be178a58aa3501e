"""Counts of every distinct term, kept up to date by signed deltas.

A store holds, per term, its occurrences and the number of records that have it, in a table partitioned by a hash
bucket of the term. merge() takes changed records only: +1 for a version that came in, -1 for the version it replaces
or for a deleted record. They are aggregated to one signed change per term, and only the buckets that the changes touch
are read and written; the others stay where an earlier merge wrote them. Counts that reach zero leave the store. save()
writes down where the buckets are, and open() takes the store up again in a later run.

Defined results: null lists, null and blank elements have no terms; repeated elements of a record count as several
occurrences and one record. Counting is complete: no term is capped or sampled.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import scratch_path
from plumbline.sources.sinks import write_document
from plumbline.tables import strip


def terms_of(c: Column | str) -> Column:
    """The elements without surrounding white space, in upper case; never null."""
    cleaned = F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.upper(strip(x)))
    return F.coalesce(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def term_deltas(records: DataFrame, terms: str, sign: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One signed change per (keys, term). records: one row per record version, its terms and its sign.

    Occurrences and records come out of one explode over the record's distinct terms, so nothing is shuffled but the
    partially aggregated changes, at most one per term and task.
    """
    all_, one = "__all", "__term"
    rows = records.select(*keys, F.col(sign).cast("long").alias("__sign"), F.col(terms).alias(all_))
    rows = rows.select(*keys, "__sign", all_, F.explode(F.array_distinct(all_)).alias(one))
    occurrences = (F.size(all_) - F.size(F.array_remove(all_, F.col(one)))).cast("long")
    return rows.groupBy(*keys, F.col(one).alias("term")).agg(F.sum(F.col("__sign") * occurrences).alias("occurrences"), F.sum("__sign").alias("records"))


def buckets_for(terms: int, per_bucket: int = 1_000_000) -> int:
    """The number of buckets of a store of about so many terms: a bucket is what one task writes."""
    return max(16, -(-terms // per_bucket))


class TermCounts:
    """A store of counts in the shared folder: a list of bucket tables and the total of records."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "termcounts")
        #: bucket -> folder of the version that last changed it
        self.versions: dict[int, str] = {}
        self.generation = 0

    SCHEMA = "origin string, term string, occurrences bigint, records bigint"

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        """The counts, of the given buckets or of all."""
        wanted = sorted(self.versions) if buckets is None else [b for b in buckets if b in self.versions]
        by_folder: dict[str, list[int]] = {}
        for b in wanted:
            by_folder.setdefault(self.versions[b], []).append(b)
        parts = [self.spark.read.schema(self.SCHEMA + ", bucket int").option("basePath", folder).parquet(*[f"{folder}/bucket={b}" for b in own]).drop("bucket") for folder, own in by_folder.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.SCHEMA)

    def merge(self, deltas: DataFrame, written: bool = False) -> TermCounts:
        """Add signed changes (origin, term, occurrences, records). They are read twice, so they are written first, unless
        they come from a written table."""
        self.generation += 1
        changes_path, folder = f"{self.path}/changes-{self.generation}", f"{self.path}/v{self.generation}"
        bucket = F.pmod(F.xxhash64("origin", "term"), F.lit(self.buckets)).cast("int")
        changes = deltas.withColumn("bucket", bucket)
        if not written:
            changes.write.mode("overwrite").parquet(changes_path)
            changes = self.spark.read.schema(self.SCHEMA + ", bucket int").parquet(changes_path)
        touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())  # at most self.buckets numbers
        if not touched:
            return self
        known = self.counts(touched).withColumn("bucket", bucket)
        merged = known.unionByName(changes).groupBy("origin", "term", "bucket").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        merged = merged.filter((F.col("occurrences") != 0) | (F.col("records") != 0))
        merged.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = {int(r.bucket) for r in self.spark.read.schema(self.SCHEMA + ", bucket int").parquet(folder).select("bucket").distinct().collect()}
        for b in touched:
            if b in written:
                self.versions[b] = folder
            else:
                self.versions.pop(b, None)
        return self

    def manifest(self) -> str:
        return json.dumps({"path": self.path, "buckets": self.buckets, "generation": self.generation, "versions": self.versions})

    def save(self) -> str:
        """Write the manifest beside the buckets; the path that open() takes."""
        write_document(self.spark, f"{self.path}/manifest.json", self.manifest())
        return self.path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TermCounts:
        """The store that an earlier run saved."""
        return cls.restore(spark, spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])

    @classmethod
    def restore(cls, spark: SparkSession, manifest: str) -> TermCounts:
        """The store that a manifest describes, for the next day's changes."""
        said = json.loads(manifest)
        store = cls(spark, said["path"], said["buckets"])
        store.generation, store.versions = said["generation"], {int(k): v for k, v in said["versions"].items()}
        return store


def deliveries_as_changes(df: DataFrame, row_id: str, terms: str, cutover: Column, keys: tuple[str, ...] = ("run_id", "image"), loaded: str = "loaded_at") -> DataFrame:
    """Versions of records as signed changes in two batches: 0 up to the cutover, 1 after it.

    Batch 0 adds the row current at the cutover. Batch 1 adds each newer current row and takes back the one it replaces.
    Columns: batch, sign, terms. Rows superseded within their own batch change nothing and drop out.
    """
    late = F.coalesce(F.col(loaded) > cutover, F.lit(False)).cast("int")
    rows = df.select(*keys, F.col(loaded).alias("__loaded"), F.col(row_id).alias("__id"), F.col(terms).alias("__raw"), late.alias("batch"))
    newest = Window.partitionBy(*keys, "batch").orderBy(F.col("__loaded").desc_nulls_last(), F.col("__id").desc_nulls_last())
    current = rows.withColumn("__rn", F.row_number().over(newest)).filter("__rn = 1")
    both = Window.partitionBy(*keys)
    current = current.withColumn("__replaced", (F.col("batch") == 0) & (F.max("batch").over(both) == 1))
    batch_sign = F.explode(F.when(F.col("__replaced"), F.array(F.struct(F.lit(0).alias("b"), F.lit(1).alias("s")), F.struct(F.lit(1).alias("b"), F.lit(-1).alias("s")))).otherwise(F.array(F.struct(F.col("batch").alias("b"), F.lit(1).alias("s")))))
    return current.select(terms_of("__raw").alias("terms"), batch_sign.alias("__c")).select(F.col("__c.b").alias("batch"), F.col("__c.s").alias("sign"), "terms")


def mark_terms(counts: DataFrame, totals: DataFrame, rare_records: int = 2, common_share: float = 0.6) -> DataFrame:
    """counts with mark: 'rare' up to rare_records records, 'common' above common_share of all records, else 'useful'.

    totals: origin and n_records, one row per origin (a handful of rows).
    """
    share = F.col("records") / F.col("n_records")
    mark = F.when(F.col("records") <= rare_records, "rare").when(share > common_share, "common").otherwise("useful")
    return counts.join(F.broadcast(totals), "origin").withColumn("mark", mark)
