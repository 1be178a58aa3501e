"""Containers of fixed capacity filled with items of many sources in target proportions.

Deficit round-robin serves each source's queue with a quantum per window; an item is served once the deficit covers it,
and what is left of the deficit is carried to the next window. While a queue is not empty, source s has therefore been
served after window w exactly the items that end within (w + 1) quanta of its queue, so the window of an item is known
from the sum of sizes up to it: ceil(sum / quantum) - 1. Such sums add up across partitions, so the deficits are carried
over windows and partitions by one distributed prefix sum, and no task holds a whole queue. With the corpus's own
proportions (the default) all queues end in the same window; with other targets the queues that end late fill the last
windows alone, as no item may be left out.

The items of a window, a bounded number of tokens, are put into containers by best fit decreasing. An item longer than
a container is cut into full containers of its own and a rest that is packed like an item; no other item is split.

Defined results: items of size 0 (null and empty texts) take no container (container_id null, piece 0); null and blank
sources are one source 'unknown'; repeated items are packed each; order within a queue is by a hash of the id, so no
source's old or long items come in one run. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.signatures import sorted_runs
from plumbline.session import materialize
from plumbline.tables import strip

PACKED = "id bigint, piece int, container_id bigint, start int, tokens int"
#: Containers per window: enough to fill them well and few enough for one task.
WINDOW_CONTAINERS = 256
#: A container's id is its window's number times this, plus its number within the window.
WINDOW_STRIDE = 1 << 24


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, start) of each size by best fit decreasing; sizes are at most capacity."""
    free: list[int] = []  # free room, upward, and the containers with that room
    owner: list[int] = []
    container, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(free, size)
        if at == len(free):
            room, box = capacity, count
            count += 1
        else:
            room, box = free.pop(at), owner.pop(at)
        container[i], start[i] = box, capacity - room
        if room > size:
            at = bisect_left(free, room - size)
            free.insert(at, room - size)
            owner.insert(at, box)
    return container, start


def assign_windows(items: DataFrame, capacity: int, window_containers: int, shares: dict[str, float] | None = None) -> DataFrame:
    """items (id, source, size > 0) with their window by deficit round-robin."""
    spark = items.sparkSession
    # range partitions in queue order: a source with a third of all items is cut into many
    queued = items.withColumn("place", F.xxhash64("id", F.lit(3)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    queued = materialize(queued.repartitionByRange(parts, "source", "place", "id").withColumn("part", F.spark_partition_id()), "queues")
    sums = queued.groupBy("source", "part").agg(F.sum("size").alias("tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("queue", F.sum("tokens").over(Window.partitionBy("source")))
    total = queued.agg(F.sum("size")).first()[0] or 0
    window_tokens = float(capacity * window_containers)
    own = F.col("queue") / F.lit(float(max(total, 1)))
    if shares:
        given = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])
        own = F.coalesce(F.try_element_at(given, F.col("source")), own)
    sums = sums.select("source", "part", "before", F.greatest(own * window_tokens, F.lit(1.0)).alias("quantum"))
    inside = Window.partitionBy("source", "part").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    upto = queued.join(sums, ["source", "part"]).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    return upto.select("id", "source", "size", (F.ceil(F.col("upto") / F.col("quantum")) - 1).cast("bigint").alias("window"))


def pack(items: DataFrame, capacity: int = 1024, window_containers: int = WINDOW_CONTAINERS, shares: dict[str, float] | None = None) -> DataFrame:
    """id, piece, container_id, start, tokens. items: id (bigint), source (string), size (bigint)."""
    source = F.lower(strip("source"))
    items = items.select("id", F.coalesce(F.when(source != "", source), F.lit("unknown")).alias("source"), F.coalesce("size", F.lit(0)).alias("size"))
    items = materialize(items, "sizes")  # three passes follow, and sizes may be costly to compute
    windows = assign_windows(items.filter("size > 0"), capacity, window_containers, shares)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches):
            window, ids, sizes = (table.column(c).to_numpy() for c in ("window", "id", "size"))
            edges = np.flatnonzero(np.r_[True, window[1:] != window[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                yield _fill_window(int(window[a]), ids[a:b], sizes[a:b], capacity)

    filled = windows.select("window", "id", "size").repartition("window").sortWithinPartitions("window", F.col("size").desc(), "id").mapInArrow(fill, PACKED)
    empty = items.filter("size = 0").select("id", F.lit(0).alias("piece"), F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("tokens"))
    return filled.unionByName(empty)


def _fill_window(window: int, ids: np.ndarray, sizes: np.ndarray, capacity: int) -> pa.RecordBatch:
    full, rest = sizes // capacity, sizes % capacity
    fitting = np.flatnonzero(rest)
    box, start = best_fit(rest[fitting], capacity)
    boxes = int(box.max()) + 1 if len(box) else 0
    whole = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    columns = (
        np.concatenate([ids[whole], ids[fitting]]),
        np.concatenate([piece, full[fitting]]).astype(np.int32),
        window * WINDOW_STRIDE + np.concatenate([boxes + np.arange(len(whole)), box]),
        np.concatenate([np.zeros(len(whole), int), start]).astype(np.int32),
        np.concatenate([np.full(len(whole), capacity), rest[fitting]]).astype(np.int32),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "piece", "container_id", "start", "tokens"])
