"""Percentiles per group from deterministic, mergeable sketches of collapsed buffers.

A sketch is a set of sorted buffers of K values; each has a level, and stands for K * 2**level values. Values beyond
the last full buffer are kept as they are. Two buffers of one level collapse to one of the next level: their merged
sequence is halved by taking every second position, odd and even starts in turn. Buffers of one level are always
collapsed with each other, lowest level first, so the tree of collapses depends on the counts alone. A collapse at
level l moves no rank by more than 2**l, and the sketch adds these moves up in err, a proven bound. A group of fewer than
2 * K values is not collapsed at all: its percentiles are exact.

Sketches of runs, days or partitions merge by putting their buffers together and collapsing again.

Defined results: null and unusable values are not counted; a group without values has no row; a percentile is the
linear interpolation between the neighbouring values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.running import running_totals

#: Values per buffer.
K = 512
SKETCH = "n bigint, err bigint, levels array<int>, buffers array<double>, loose array<double>"


class Sketch:
    """n values; buffers: level -> list of sorted arrays of K; loose: values not in a buffer yet; err: rank error bound."""

    __slots__ = ("n", "err", "buffers", "loose", "turn")

    def __init__(self):
        self.n, self.err, self.turn = 0, 0, 0
        self.buffers: dict[int, list[np.ndarray]] = {}
        self.loose = np.empty(0)

    def add(self, values: np.ndarray) -> Sketch:
        self.n += len(values)
        self.loose = np.concatenate([self.loose, values]) if len(self.loose) else values
        return self

    def merge(self, n: int, err: int, levels: np.ndarray, buffers: np.ndarray, loose: np.ndarray) -> Sketch:
        self.n, self.err = self.n + n, self.err + err
        for i, level in enumerate(levels):
            self.buffers.setdefault(int(level), []).append(buffers[i * K : (i + 1) * K])
        self.loose = np.concatenate([self.loose, loose]) if len(self.loose) else loose
        return self

    def collapse(self) -> Sketch:
        """Cut loose values to buffers once there are 2 * K of them, and collapse until each level has one buffer."""
        if len(self.loose) >= 2 * K or (self.buffers and len(self.loose) >= K):
            self.loose = np.sort(self.loose)
            full = len(self.loose) // K
            # whole buffers of evenly spread values; what is over stays loose
            over = len(self.loose) - full * K
            kept = np.ones(len(self.loose), bool)
            if over:
                kept[np.linspace(0, len(self.loose) - 1, over).astype(int)] = False
            body, self.loose = self.loose[kept], self.loose[~kept]
            self.buffers.setdefault(0, []).extend(body[i * K : (i + 1) * K] for i in range(full))
        level = 0
        while level <= max(self.buffers, default=-1):
            held = self.buffers.get(level, [])
            while len(held) > 1:
                both = np.sort(np.concatenate([held.pop(), held.pop()]))
                self.turn ^= 1
                self.buffers.setdefault(level + 1, []).append(both[self.turn :: 2])
                self.err += 1 << level
            level += 1
        self.buffers = {k: v for k, v in self.buffers.items() if v}
        return self

    def state(self) -> tuple:
        levels = [k for k in sorted(self.buffers) for _ in self.buffers[k]]
        flat = np.concatenate([b for k in sorted(self.buffers) for b in self.buffers[k]]) if levels else np.empty(0)
        return self.n, self.err, levels, flat, self.loose

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The values, sorted, and the number of values that each and those before it stand for."""
        values = np.concatenate([self.loose, *[b for held in self.buffers.values() for b in held]])
        weights = np.concatenate([np.ones(len(self.loose), np.int64), *[np.full(len(b), 1 << k) for k, held in self.buffers.items() for b in held]])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def percentile(self, p: float) -> tuple[float, float, float]:
        """The percentile and a bracket of values that surely holds both neighbours it lies between."""
        values, upto = self.ranked()
        place = (self.n - 1) * p
        low, high = int(np.floor(place)), int(np.ceil(place))
        at = lambda rank: values[min(np.searchsorted(upto, min(max(rank, 0), self.n - 1), "right"), len(values) - 1)]
        a, b = at(low), at(high)
        if self.err == 0:
            return float(a + (b - a) * (place - low)), float(a), float(b)
        slack = self.err + (1 << max(self.buffers))
        bracket_low = values[0] if low - slack < 0 else at(low - slack)
        bracket_high = values[-1] if high + slack >= self.n else at(high + slack)
        return float(a + (b - a) * (place - low)), float(-np.inf if low - slack < 0 else bracket_low), float(np.inf if high + slack >= self.n else bracket_high)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in a sorted stream; a run comes in pieces where it crosses a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(i).to_pandas().to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for col in names:
            same = (col[1:] == col[:-1]) | ((col[1:] == None) & (col[:-1] == None))  # noqa: E711
            change[1:] |= ~same.astype(bool)
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(col[a] for col in names), batch.slice(a, b - a)


def _rows(found: list[tuple], keys: int, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*found))
    types = [*kinds, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _names(keys: list[str]) -> list[str]:
    return [*keys, "n", "err", "levels", "buffers", "loose"]


def sketch_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One sketch per (string) keys. Every task folds its own rows of a group first, so a hot group is shuffled as one
    bounded sketch per million rows of a task, and a small one as its values."""
    plain = rows.select(*[F.col(k).cast("string") for k in keys], F.col(value).cast("double").alias("__v"))
    names = _names(keys)

    def fold(pending: list[pa.Table]) -> pa.RecordBatch:
        frame = pa.concat_tables(pending).to_pandas()
        found = []
        for key, values in frame.groupby(keys, dropna=False, sort=False)["__v"]:
            key = tuple(None if k is None or k != k else k for k in (key if isinstance(key, tuple) else (key,)))
            found.append((*key, *Sketch().add(values.to_numpy()).collapse().state()))
        return _rows(found, len(keys), [pa.string()] * len(keys), names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            if batch.num_rows:
                pending.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size >= 1_000_000:
                yield fold(pending)
                pending, size = [], 0
        if pending:
            yield fold(pending)

    kinds = ", ".join(f"`{k}` string" for k in keys)
    return merge_sketches(plain.mapInArrow(partial, f"{kinds}, {SKETCH}"), keys)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to one per keys: of partitions, days, or runs into a coarser group.

    Each partition first merges what it has of a group (sorted, streamed), then the groups meet: a coarse group gets
    one bounded sketch from every partition, not one from every fine group.
    """
    names = _names(keys)
    kinds = ", ".join(f"`{k}` string" for k in keys)
    slim = sketches.select(*names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sketch, found = None, None, []
        for key, piece in _groups(batches, len(keys)):
            if key != now:
                if sketch is not None:
                    found.append((*now, *sketch.collapse().state()))
                    if len(found) >= 2000:
                        yield _rows(found, len(keys), [pa.string()] * len(keys), names)
                        found = []
                now, sketch = key, Sketch()
            n, err, levels, buffers, loose = (piece.column(len(keys) + i) for i in range(5))
            level_at, buffer_at = levels.offsets.to_numpy(), buffers.offsets.to_numpy()
            level_of, buffer_of = levels.values.to_numpy(zero_copy_only=False), buffers.values.to_numpy(zero_copy_only=False)
            for i in range(piece.num_rows):
                if level_at[i] != level_at[i + 1]:
                    sketch.merge(0, 0, level_of[level_at[i] : level_at[i + 1]], buffer_of[buffer_at[i] : buffer_at[i + 1]], np.empty(0))
                    if len(sketch.buffers) > 4 or sum(map(len, sketch.buffers.values())) > 64:
                        sketch.collapse()
            sketch.n += int(np.sum(n.to_numpy()))
            sketch.err += int(np.sum(err.to_numpy()))
            values = loose.flatten().to_numpy(zero_copy_only=False)
            sketch.loose = np.concatenate([sketch.loose, values])
            if len(sketch.loose) >= 16 * K:
                sketch.collapse()
        if sketch is not None:
            found.append((*now, *sketch.collapse().state()))
        if found:
            yield _rows(found, len(keys), [pa.string()] * len(keys), names)

    schema = f"{kinds}, {SKETCH}"
    local = slim.sortWithinPartitions(*keys).mapInArrow(merge, schema)
    return local.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def read_percentiles(sketches: DataFrame, keys: list[str], percents: tuple[int, ...]) -> DataFrame:
    """keys, n, err, pct, value, low, high; [low, high] surely holds the two values that the percentile lies between."""
    out = [*keys, "n", "err", "pct", "value", "low", "high"]
    kinds = ", ".join(f"`{k}` string" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                sketch = Sketch().merge(row["n"], row["err"], np.array(row["levels"], int), np.array(row["buffers"], float), np.array(row["loose"], float))
                for p in percents if sketch.n else ():
                    found.append((*[row[k] for k in keys], sketch.n, sketch.err, p, *sketch.percentile(p / 100)))
            if found:
                types = [*[pa.string()] * len(keys), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=out)

    return sketches.mapInArrow(run, f"{kinds}, n bigint, err bigint, pct int, value double, low double, high double")


def refine(rows: DataFrame, approximate: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact values in place of approximate ones: the rows below each bracket are counted, those within it ranked.

    Only (key, value) counts inside the brackets are shuffled, a share of about 2 * err / n of the rows.
    """
    keyed = approximate.filter("err > 0").select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "pct", "low", "high")
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    v = F.col(value).cast("double")
    met = rows.select(*keys, v.alias("__v")).join(keyed, same)
    met = met.filter(F.col("__v") <= F.col("high")).withColumn("__bin", F.when(F.col("__v") < F.col("low"), F.lit(float("-inf"))).otherwise(F.col("__v")))
    counts = met.groupBy(*keys, "n", "pct", "__bin").agg(F.count("*").alias("__c"))
    ranked = running_totals(counts, [*keys, "pct"], [F.col("__bin")], {"__upto": F.col("__c")})
    place = (F.col("n") - 1) * F.col("pct") / 100.0
    pick = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__bin")))
    exact = ranked.groupBy(*keys, "n", "pct").agg(pick(F.floor(place)).alias("__a"), pick(F.ceil(place)).alias("__b"))
    exact = exact.select(*keys, "n", "pct", (F.col("__a") + (F.col("__b") - F.col("__a")) * (place - F.floor(place))).alias("value"))
    return approximate.filter("err = 0").select(*keys, "n", "pct", "value").unionByName(exact)
