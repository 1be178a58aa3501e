"""Signatures as unit vectors, and streams of Arrow batches sorted by a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))


def unit_vectors(df: DataFrame, row_id: str, parts: dict[str, int], least_norm: float = 1e-8, instead: Column | None = None) -> DataFrame:
    """id and vec of the usable rows: each part scaled to length one, the parts joined and scaled to length one.

    The dot product of two vecs is then the mean of the parts' cosines. A row is usable if every part has its number of
    elements, all of them finite and not null, and a norm above least_norm. Other rows, null ones included, drop out.
    instead: what is wanted of the usable rows in place of the vec.
    """
    good: Column = F.lit(True)
    doubles = {name: F.transform(F.col(name), lambda x: x.cast("double")) for name in parts}
    for name, size in parts.items():
        element = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        good = good & F.coalesce((F.size(name) == size) & F.forall(name, element), F.lit(False))
    rows = df.filter(good).select(F.col(row_id).alias("id"), *[doubles[p].alias(f"__{p}") for p in parts], *[_norm(doubles[p]).alias(f"__n_{p}") for p in parts], *([] if instead is None else [instead.alias("__vec")]))
    for name in parts:
        rows = rows.filter(F.col(f"__n_{name}") > least_norm)
    scale = float(np.sqrt(len(parts)))

    def scaled(part: str) -> Column:
        length = F.col(f"__n_{part}") * scale
        return F.transform(F.col(f"__{part}"), lambda x: x / length)

    return rows.select("id", (F.concat(*map(scaled, parts)) if instead is None else F.col("__vec")).alias("vec"))


def usable_signatures(df: DataFrame, row_id: str, parts: dict[str, int], least_norm: float = 1e-8) -> DataFrame:
    """id and vec of the same rows as unit_vectors, the parts joined as they were delivered; see scaled_parts."""
    return unit_vectors(df, row_id, parts, least_norm, F.concat(*parts))


def scaled_parts(sizes: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that makes unit_vectors' vecs of a matrix of signatures as delivered, in double precision."""

    def unit(rows: np.ndarray) -> np.ndarray:
        out, at = rows.astype(float), 0
        for size in sizes:
            part = out[:, at : at + size]
            part /= np.sqrt((part * part).sum(1, keepdims=True) * len(sizes))
            at += size
        return out

    return unit


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.empty((0, width))


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def together(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df in parts tasks, each value of the key whole in one of them and the tasks sorted by it.

    A shuffle on the key itself is left out where the plan already has one, as after a join on it, and adaptive execution
    may read that one locally, so that a value's rows lie in several tasks. One on a hash of the key always stays.
    """
    return df.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key)


def sorted_runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Tables of whole runs of an integer key from batches sorted by it; a table may hold many small runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if held and (cut or held[0].column(column)[0].as_py() != int(key[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
