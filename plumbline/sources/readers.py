
from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import base_name, first_text, path_key, stem, truth

#: Suffixes of images (fixed values).
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")
LABELS_VERSION = "qa_benchmark_labels_v1"
#: Keys of a manifest's root that name no entry (fixed values).
RESERVED = ("schema_version", "version", "generator", "generator_name", "generator_version", "created_at", "generated_at", "items", "images", "entries", "meta", "summary", "notes")


# S01, S02
def list_images(spark: SparkSession, folder: str, recursive: bool = False, content: bool = False) -> DataFrame:
    """path, modified, length (and content) of a folder's images by suffix in any case; none where the folder is missing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, modified timestamp, length bigint" + ", content binary" * content)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder).filter(F.lower("path").rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + ")$"))
    # binaryFile reads content only where it is selected
    columns = ["path", F.col("modificationTime").alias("modified"), "length", *["content"] * content]
    return found.select(*columns).orderBy("path")


# S04, S05, S06, S25
def read_json_documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, doc (VARIANT) of whole JSON files. Strict: a file that is no object raises; lenient: it gives an empty one."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    parsed = F.try_parse_json("text")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    empty = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("path"))).cast("variant") if strict else F.parse_json(F.lit("{}"))
    return text.select("path", F.when(is_object, parsed).otherwise(empty).alias("doc"))


# S18
def at_path(doc: Column | str, path: str, kind: str = "string") -> Column:
    """A value by a dotted and indexed path, a.0.b; null where there is none or it is of another type."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, "$" + steps, kind)


# S19
def search_aliases(text: Column | str, aliases: Sequence[str], depth: int = 5) -> Column:
    """The first value, depth first, under one of the keys, as JSON text; null where there is none.

    Keys count as they are spelled. An object that has several of them answers with the one named first among the
    aliases, and is not searched further, even if that value is null. The root is at depth 0, nothing below depth is
    looked at. No built-in walks an unknown document, so this is an Arrow-batched function over JSON text.
    """
    wanted, most = tuple(aliases), depth

    def walk(root):
        waiting = [(root, 0)]
        while waiting:
            node, level = waiting.pop()
            named = [a for a in wanted if a in node] if isinstance(node, dict) else []
            if named:
                if node[named[0]] is not None:
                    return node[named[0]]
            elif level < most:
                inner = node.values() if isinstance(node, dict) else node
                waiting += reversed([(x, level + 1) for x in inner if isinstance(x, (dict, list))])
        return None

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                root = json.loads(t) if t else None
            except ValueError:
                root = None
            found = walk(root) if isinstance(root, (dict, list)) else None
            out.append(None if found is None else json.dumps(found, sort_keys=True))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(F.col(text) if isinstance(text, str) else text)


# S20
def pick(records: Column | str, index: int) -> Column:
    """The record at an index held within the list; null for an empty one."""
    c = F.col(records) if isinstance(records, str) else records
    return F.when(F.size(c) > 0, F.element_at(c, F.least(F.greatest(F.lit(index), F.lit(0)), F.size(c) - 1) + 1))


# S07, S08
LABEL_NODE = "struct<expected_status:string,status:string,weight:double,expected_task_profile:string,expected_view_lane:string,expected_view_lane_detail:string,must_have_reasons:array<string>,must_not_have_reasons:array<string>,notes:string>"


def read_label_bundle(spark: SparkSession, path: str) -> DataFrame:
    """One row per label of a bundle. A wrong version, an empty or repeated key, an unknown status and a weight that is
    negative or not finite raise when the rows are read."""
    schema = f"schema_version string, dataset_role string, benchmark_id string, freeze_tag string, optuna_ready string, items map<string,{LABEL_NODE}>, images map<string,{LABEL_NODE}>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")
    version = F.when(F.trim("schema_version") == LABELS_VERSION, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("labels version must be " + LABELS_VERSION + ", got "), F.coalesce("schema_version", F.lit("none")))))
    rows = doc.select(version.alias("schema_version"), "benchmark_id", truth("optuna_ready").alias("optuna_ready"), F.explode(F.coalesce("items", "images")).alias("key", "node"))
    return normalise_labels(rows.select("schema_version", "benchmark_id", "optuna_ready", F.trim("key").alias("image"), "node.*"))


def normalise_labels(rows: DataFrame) -> DataFrame:
    """Validated labels: status in upper case and known, weight finite and not negative (1 by default), lists distinct."""
    from plumbline.operators.sets import ordered_distinct

    fail = lambda why: F.raise_error(F.concat(F.lit(why + ": "), F.coalesce("image", F.lit(""))))
    state = F.upper(F.trim(F.coalesce("expected_status", "status")))
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    repeated = rows.groupBy("image").agg(F.count("*").alias("__n"))
    out = rows.join(repeated, "image").withColumn("image", F.when((F.col("image") != "") & (F.col("__n") == 1), F.col("image")).otherwise(fail("empty or repeated label key"))).drop("__n")
    out = out.withColumn("expected_status", F.when(state.isin("PASS", "WARN", "FAIL"), state).otherwise(fail("unknown status of label")))
    out = out.withColumn("weight", F.when((weight >= 0) & ~F.isnan(weight) & (weight != float("inf")), weight).otherwise(fail("weight must be finite and not negative for label")))
    return out.withColumn("must_have_reasons", ordered_distinct("must_have_reasons")).withColumn("must_not_have_reasons", ordered_distinct("must_not_have_reasons")).drop("status")


# S09, D08
ENTRY = "struct<image:string,path:string,file:string,prompt_id:string,seed:string,seed_unavailable_reason:string,anchor_source:string,intended_view:string>"


def read_manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, key and fields of a manifest whose entries are a list or an object under items, images or entries, or
    the root's own keys but the reserved ones. seed keeps its text; seed_number is its number, if it is one."""
    doc = read_json_documents(spark, path).select("path", F.to_json("doc").alias("text"))
    lists, maps = [F.from_json(F.get_json_object("text", f"$.{k}"), f"array<{ENTRY}>") for k in ("items", "images", "entries")], [F.from_json(F.get_json_object("text", f"$.{k}"), f"map<string,{ENTRY}>") for k in ("items", "images", "entries")]
    starts = [F.substring(F.ltrim(F.get_json_object("text", f"$.{k}")), 1, 1) for k in ("items", "images", "entries")]
    pairs_list = F.coalesce(*[F.when(s == "[", F.transform(li, lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("value")))) for s, li in zip(starts, lists)])
    pairs_map = F.coalesce(*[F.when(s == "{", F.map_entries(m)) for s, m in zip(starts, maps)])
    named = F.map_filter(F.from_json("text", "map<string,string>"), lambda k, v: ~k.isin(*RESERVED) & v.startswith("{"))
    root = F.map_entries(F.transform_values(named, lambda _, v: F.from_json(v, ENTRY)))
    rows = doc.select(F.posexplode(F.coalesce(pairs_list, pairs_map, root)).alias("ordinal", "e"))
    entry = rows.select("ordinal", "e.key", "e.value.*")
    image = first_text("image", "path", "file", "key")
    return entry.withColumn("image", image).withColumn("path_key", path_key(image)).withColumn("name_key", base_name(image)).withColumn("seed_number", F.col("seed").try_cast("bigint")).filter("image IS NOT NULL")


# S12
LABEL_COLUMNS = ("image", "expected_status", "weight", "expected_task_profile", "expected_view_lane", "expected_view_lane_detail", "must_have_reasons", "must_not_have_reasons", "notes")


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels from CSV; lists may be separated by any of ; , | and their full-width forms."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in LABEL_COLUMNS), multiLine=True, escape='"')
    split = lambda c: F.filter(F.transform(F.split(F.col(c), "[;；,，|]"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.withColumn("weight", F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0))).withColumn("must_have_reasons", split("must_have_reasons")).withColumn("must_not_have_reasons", split("must_not_have_reasons"))


# S17
def sidecars(images: DataFrame, files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """images (path) with sidecar, the file of the same stem whose suffix comes first in suffixes."""
    place = F.coalesce(*[F.when(F.lower("path").endswith(s), F.lit(i)) for i, s in enumerate(suffixes)])
    known = files.select(F.col("path").alias("sidecar"), F.regexp_replace(stem("path"), r"\.[a-z_]+$", "").alias("__stem"), place.alias("__place")).filter("__place IS NOT NULL")
    best = known.groupBy("__stem").agg(F.min_by("sidecar", F.struct("__place", "sidecar")).alias("sidecar"))
    return images.withColumn("__stem", stem("path")).join(best, "__stem", "left").drop("__stem")


# S23
def read_run_snapshots(spark: SparkSession, pattern: str) -> DataFrame:
    """path, run (the folder's name), doc of every run's snapshot file."""
    return read_json_documents(spark, pattern).withColumn("run", F.element_at(F.split("path", "/"), -2))


# S24
def read_prompts(spark: SparkSession, pattern: str, id_pattern: str = r"([A-Za-z]+[_-]?\d+)") -> DataFrame:
    """path, prompt_id parsed from the file's name, and text of prompt files."""
    raw = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.withColumn("prompt_id", F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), id_pattern, 1), F.lit("")))


# S26
def split_by_cache(keys: DataFrame, cache: DataFrame, on: Sequence[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows with a cached value of the wanted version, and those to compute; another version is a miss."""
    valid = cache.filter(F.col("version") == version)
    return keys.join(valid, list(on)), keys.join(valid.select(*on), list(on), "left_anti")


# S15
def anchors_by_role(registry: DataFrame, scanned: DataFrame) -> DataFrame:
    """role, path, source: a role's registered paths, else those found in its folder."""
    listed = registry.filter(F.trim(F.coalesce("path", F.lit(""))) != "").select("role", "path", F.lit("registry").alias("source"))
    rest = scanned.join(listed.select("role").distinct(), "role", "left_anti").select("role", "path", F.lit("folder").alias("source"))
    return listed.unionByName(rest)
