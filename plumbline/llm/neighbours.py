"""The k most similar vectors of every vector: a forest of random-projection trees and exact reranking.

Every tree halves a bounded sample at the median of its projection on the difference of two random members, down to a
depth that leaves about leaf_rows rows of the whole table to a leaf. The trees, bounded by the sample, are broadcast and
every row is put into its leaf of every tree. A row then searches all trees through one priority queue ordered by the
largest margin by which a node lies on the far side of a split: it pops the nearest node of any tree, descends to a leaf
and queues the siblings it passes, until search_leaves leaves are chosen. All similarities within these leaves are
computed exactly, in double precision and in blocks. A leaf that is much larger than planned, because the sample was too
small for the table, is searched through a forest of its own in the same way.

What is shuffled: neighbouring leaves of a tree form a group of about group_rows rows, one task's share, and a row goes
once to each group that it searches, with the list of its leaves there, and as delivered (signatures of 4-byte numbers
are scaled to unit length where they arrive). Before that it goes to its group of the first tree alone, where its k-th
best similarity so far becomes a floor: of what it finds anywhere later, only what reaches the floor is sent on, and the
k best of these are its neighbours. A floor is the similarity of k real rows, so it costs no neighbour.

Exact copies are searched once, by their smallest id, so a hot group of copies is one row here; of each group only the
k + 1 smallest ids can be anyone's neighbours.

Defined results: similarity downward, then neighbour id upward; a row is not its own neighbour; fewer than k where the
table has fewer other rows. Rows that are not usable must have been dropped (signatures.usable_signatures).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.signatures import lists, matrix, sorted_runs, together
from plumbline.session import materialize, parts_for

#: Production parameters. Measured recall of the ten nearest: see the README.
TREES, LEAF_ROWS, SEARCH_LEAVES, SAMPLE_ROWS = 3, 1024, 24, 65_536
#: Rows of a group of leaves; leaves searched for the floor; the sample grows with the table, up to MOST_SAMPLE rows.
GROUP_ROWS, FLOOR_LEAVES, MOST_SAMPLE = 65_536, 4, 1 << 20
#: Cells of a block of similarities.
BLOCK = 1 << 22


class Forest:
    """Complete binary trees of equal depth; node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        width = sample.shape[1]
        self.trees, self.depth, self.inner = trees, depth, (1 << depth) - 1
        self.normals = np.zeros((trees, self.inner, width))
        self.offsets = np.zeros((trees, self.inner))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(self.inner):
                own = members.pop(node, np.empty(0, int))
                if len(own) >= 2:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    direction = a - b
                    length = np.linalg.norm(direction)
                    direction = direction / length if length > 1e-12 else self._random(rng, width)
                else:
                    direction = self._random(rng, width)
                at = sample[own] @ direction
                cut = float(np.median(at)) if len(own) else 0.0
                self.normals[t, node], self.offsets[t, node] = direction, cut
                right = at > cut
                members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]

    @staticmethod
    def _random(rng: np.random.Generator, width: int) -> np.ndarray:
        direction = rng.normal(size=width)
        return direction / np.linalg.norm(direction)

    def probe(self, rows: np.ndarray, leaves: int, trees: int | None = None) -> np.ndarray:
        """The leaves that each row searches, nearest first; the first ones are its own leaves of all (or the first) trees."""
        count, own, trees = len(rows), np.arange(len(rows)), trees or self.trees
        leaves = max(trees, min(leaves, trees << self.depth))
        cost = np.full((count, trees + leaves * self.depth), np.inf)
        tree_of = np.zeros(cost.shape, np.int16)
        node_of = np.zeros(cost.shape, np.int32)
        cost[:, :trees], tree_of[:, :trees] = 0.0, np.arange(trees)
        chosen = np.empty((count, leaves), np.int64)
        slot = trees
        for turn in range(leaves):
            nearest = np.full(count, turn) if turn < trees else cost.argmin(1)
            price, tree, node = cost[own, nearest], tree_of[own, nearest].astype(int), node_of[own, nearest].astype(int)
            cost[own, nearest] = np.inf
            for step in range(self.depth):
                down = np.flatnonzero(node < self.inner)
                if not len(down):
                    break
                t, i = tree[down], node[down]
                margin = np.einsum("ij,ij->i", rows[down], self.normals[t, i]) - self.offsets[t, i]
                right = margin > 0
                cost[down, slot + step] = np.maximum(price[down], np.abs(margin))
                tree_of[down, slot + step] = t
                node_of[down, slot + step] = 2 * i + 2 - right
                node[down] = 2 * i + 1 + right
            slot += self.depth
            chosen[:, turn] = (tree << self.depth) + node - self.inner
        return chosen


def depth_for(rows: int, sample: int, leaf_rows: int) -> int:
    """Leaves of about leaf_rows rows, but none of fewer than 8 rows of the sample."""
    leaves = min(rows / leaf_rows, sample / 8)
    return max(0, int(np.ceil(np.log2(leaves)))) if leaves > 1 else 0


def best_of(ids: np.ndarray, vecs: np.ndarray, who: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(searcher, neighbour, similarity) of the k most similar of ids for each searcher, none below its least; ties by
    the smaller id."""
    order = np.argsort(ids)
    ids, vecs = ids[order], vecs[order]
    out: list[tuple] = []
    step = max(1, BLOCK // max(1, len(ids)))
    for start in range(0, len(who), step):
        q = who[start : start + step]
        near = rows[start : start + step] @ vecs.T
        at = np.searchsorted(ids, q)
        at = np.minimum(at, len(ids) - 1)
        itself = ids[at] == q
        near[np.flatnonzero(itself), at[itself]] = -np.inf
        floor = least[start : start + step].copy()
        free = np.flatnonzero(floor <= -1)
        if len(free) and near.shape[1] > k:
            floor[free] = np.partition(near[free], near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        i, j = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
        if not len(i):
            continue
        out.append(top_of(q[i], ids[j], near[i, j], k))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(part) for part in zip(*out))


def top_of(who: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids of each searcher, best first."""
    order = np.lexsort((ids, -near, who))
    who, ids, near = who[order], ids[order], near[order]
    # the same neighbour out of several trees has the same similarity and id, so its copies are side by side
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])
    who, ids, near = who[new], ids[new], near[new]
    first = np.ones(len(who), bool)
    first[1:] = who[1:] != who[:-1]
    start = np.flatnonzero(first)
    place = np.arange(len(who)) - np.repeat(start, np.diff([*start, len(who)]))
    keep = place < k
    return who[keep], ids[keep], near[keep]


def search_leaf(ids: np.ndarray, vecs: np.ndarray, who: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray, leaf_rows: int, leaves: int) -> tuple:
    """Exact within a leaf of up to 8 * leaf_rows rows; a larger one gets a forest of its own."""
    if len(ids) <= 8 * leaf_rows:
        return best_of(ids, vecs, who, rows, k, least)
    forest = Forest(vecs, 1, depth_for(len(ids), len(ids), leaf_rows))
    home = forest.probe(vecs, 1)[:, 0]
    parts = []
    for start in range(0, len(who), 65_536):
        visit = forest.probe(rows[start : start + 65_536], leaves)
        for leaf in np.unique(visit):
            inside, asking = np.flatnonzero(home == leaf), np.flatnonzero((visit == leaf).any(1)) + start
            if len(inside) and len(asking):
                parts.append(best_of(ids[inside], vecs[inside], who[asking], rows[asking], k, least[asking]))
    return top_of(*(np.concatenate(p) for p in zip(*parts)), k) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def as_delivered(rows: np.ndarray) -> np.ndarray:
    return rows.astype(float)


def fit_forest(distinct: DataFrame, rows: int, width: int, trees: int, leaf_rows: int, sample_rows: int, unit: Callable = as_delivered) -> Forest:
    """A forest of a sample of about sample_rows rows, or 8 for every leaf up to MOST_SAMPLE, chosen by a hash of the id."""
    share = min(1.0, max(sample_rows, min(MOST_SAMPLE, 8 * rows // leaf_rows)) / max(rows, 1))
    picked = distinct if share == 1.0 else distinct.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = unit(np.array([r.vec for r in picked.orderBy("id").collect()], float).reshape(-1, width))
    return Forest(sample, trees, depth_for(rows, len(sample), leaf_rows))


def _by_group(visit: np.ndarray, trees: int, depth: int, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, offsets, leaves): one entry for every group of 2 ** below leaves that a row visits, with its leaves there."""
    order = np.sort(visit, axis=1)
    group = order >> below
    new = np.ones(order.shape, bool)
    new[:, 1:] = group[:, 1:] != group[:, :-1]
    first = np.flatnonzero(new.ravel())
    return first // order.shape[1], group.ravel()[first], np.r_[first, order.size].astype(np.int32), order.ravel()


def _search_group(table: pa.Table, width: int, unit: Callable, k: int, leaf_rows: int, search_leaves: int) -> tuple:
    """The k best within whole groups of leaves for every row that searches some. table: home, id, vec, floor, leaves."""
    home, ids, floor = (table.column(c).to_numpy() for c in ("home", "id", "floor"))
    vecs = unit(matrix(table.column("vec").combine_chunks(), width))
    leaves = table.column("leaves").combine_chunks()
    asked, asker = leaves.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(leaves.offsets.to_numpy()))
    order, members = np.argsort(asked, kind="stable"), np.argsort(home, kind="stable")
    found = []
    for leaf in np.unique(home[home >= 0]):
        inside = members[slice(*np.searchsorted(home[members], [leaf, leaf + 1]))]
        asking = asker[order[slice(*np.searchsorted(asked[order], [leaf, leaf + 1]))]]
        if len(asking):
            found.append(search_leaf(ids[inside], vecs[inside], ids[asking], vecs[asking], k, floor[asking], leaf_rows, search_leaves))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return top_of(*(np.concatenate(c) for c in zip(*found)), k)


def nearest_neighbours(vectors: DataFrame, k: int = 10, least: float = -2.0, trees: int = TREES, leaf_rows: int = LEAF_ROWS, search_leaves: int = SEARCH_LEAVES, sample_rows: int = SAMPLE_ROWS, unit: Callable = as_delivered) -> DataFrame:
    """id, neighbour, similarity: up to k rows per id. vectors: id (bigint), vec (array of float or double).

    unit: turns a matrix of delivered vecs into unit vectors of doubles. least: neighbours below it are not wanted.
    """
    spark = vectors.sparkSession
    copies = vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    distinct = materialize(copies, "distinct-vectors")
    head = distinct.select(F.count("*").alias("rows"), F.max(F.size("vec")).alias("width"), F.max("n").alias("n")).first()
    if not head.rows:
        return spark.createDataFrame([], "id bigint, neighbour bigint, similarity double")
    width, rows = head.width, head.rows
    fitted = fit_forest(distinct, rows, width, trees, leaf_rows, sample_rows, unit)
    forest, depth = spark.sparkContext.broadcast(fitted), fitted.depth
    # groups: leaves of about GROUP_ROWS rows, but of all trees together two for every core
    groups = max(rows / GROUP_ROWS, 2 * spark.sparkContext.defaultParallelism / trees)
    below = depth - min(depth, int(np.ceil(np.log2(groups))))
    number = vectors.schema["vec"].dataType.simpleString()
    routed = f"grp int, home int, id bigint, vec {number}, floor double, leaves array<int>"

    def sent(batch_ids: pa.Array, delivered: np.ndarray, floor: np.ndarray, home: np.ndarray, visit: np.ndarray) -> pa.RecordBatch:
        """home: the rows' own leaves of some trees; visit: the leaves they search."""
        row, group, offsets, leaves = _by_group(visit, trees, depth, below)
        own = np.full(len(row), -1)
        for t in range(home.shape[1]):
            here = home[row, t] >> below == group
            own[here] = home[row, t][here]
        columns = [pa.array(group.astype(np.int32)), pa.array(own.astype(np.int32)), batch_ids.take(pa.array(row)), lists(delivered[row]), pa.array(floor[row]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "home", "id", "vec", "floor", "leaves"])

    def first_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                delivered = matrix(batch.column(1), width)
                visit = forest.value.probe(unit(delivered), FLOOR_LEAVES, 1)
                home = visit[:, :1]
                # only the leaves beside the own one, in the same group
                visit = np.where(visit >> below == home >> below, visit, home)
                yield sent(batch.column(0), delivered, np.full(len(delivered), least), home, visit)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches):
            who, _, near = _search_group(run, width, unit, k, leaf_rows, FLOOR_LEAVES)
            ids, delivered = run.column("id").to_numpy(), matrix(run.column("vec").combine_chunks(), width)
            # the k-th best of the rows that found k; best first
            last = np.flatnonzero(np.r_[who[1:] != who[:-1], True]) if len(who) else np.empty(0, int)
            held = np.diff(np.r_[-1, last]) >= k
            order = np.argsort(ids)
            floor = np.full(len(ids), least)
            at = order[np.searchsorted(ids[order], who[last[held]])]
            floor[at] = np.maximum(least, near[last[held]] - 1e-12)
            for start in range(0, len(ids), 4096):
                part = slice(start, start + 4096)
                visit = forest.value.probe(unit(delivered[part]), search_leaves)
                yield sent(pa.array(ids[part]), delivered[part], floor[part], visit[:, :trees], visit)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches):
            found = _search_group(run, width, unit, k, leaf_rows, search_leaves)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "neighbour", "similarity"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches):
            found = top_of(*(run.column(i).to_numpy() for i in range(3)), k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "neighbour", "similarity"])

    parts = max(1, (trees << depth) >> below)
    result = "id bigint, neighbour bigint, similarity double"
    in_groups = lambda df, n: df.repartitionById(n, F.col("grp")).sortWithinPartitions("grp")
    floored = in_groups(distinct.select("id", "vec").mapInArrow(first_tree, routed), max(1, parts // trees)).mapInArrow(route, routed)
    pairs = in_groups(floored, parts).mapInArrow(meet, result)
    best = together(pairs, "id", parts_for(spark, rows * k, 5_000_000)).mapInArrow(merge, result)
    return best if head.n == 1 else _with_copies(vectors, distinct, best, k)


def _with_copies(vectors: DataFrame, distinct: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Neighbours of every row where some are exact copies. best: by the smallest ids of the groups of copies."""
    hot = distinct.filter("n > 1").select("vec", F.col("id").alias("group"))
    members = vectors.join(hot, "vec").select("group", "id")
    order = Window.partitionBy("group").orderBy("id")
    first = materialize(members.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1).select("group", F.col("id").alias("member")), "first-copies")
    # candidates of a group: its own first copies, and those of its neighbours' groups
    others = best.join(first.withColumnRenamed("group", "neighbour"), "neighbour", "left").select(F.col("id").alias("group"), F.coalesce("member", "neighbour").alias("neighbour"), "similarity")
    own = first.select("group", F.col("member").alias("neighbour"), F.lit(1.0).alias("similarity"))
    candidates = others.unionByName(own)
    down = Window.partitionBy("group").orderBy(F.col("similarity").desc(), "neighbour")
    candidates = candidates.withColumn("rn", F.row_number().over(down)).filter(F.col("rn") <= k + 1).drop("rn")
    single = distinct.filter("n = 1").select(F.col("id").alias("group"), "id")
    everyone = members.unionByName(single)
    rows = everyone.join(candidates, "group").filter(F.col("id") != F.col("neighbour"))
    per_row = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return rows.withColumn("rn", F.row_number().over(per_row)).filter(F.col("rn") <= k).select("id", "neighbour", "similarity")


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 20_000, unit: Callable = as_delivered) -> DataFrame:
    """The same by brute force for a stated set of query rows, against all rows in blocks; to measure recall with.

    The query set is collected, so it must be a stated one of bounded size.
    """
    asked = queries.orderBy("id").collect()
    width = len(asked[0].vec) if asked else 1
    who, rows = np.array([r.id for r in asked], np.int64), unit(np.array([r.vec for r in asked], float).reshape(-1, width))
    sent = vectors.sparkSession.sparkContext.broadcast((who, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                found = best_of(batch.column(0).to_numpy(), unit(matrix(batch.column(1), width)), *sent.value, k, np.full(len(sent.value[0]), -2.0))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "neighbour", "similarity"])

    found = vectors.select("id", "vec").mapInArrow(run, "id bigint, neighbour bigint, similarity double")
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")
