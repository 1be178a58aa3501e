"""Groups of mutually similar rows by grid density clustering.

The features are quantised to a grid whose cells are WIDE times the reach, the distance at which two rows still belong
together. Every row is put into its cell, and also into the adjacent cell on the lower side of each border that it lies
within reach of, so that two rows within reach always meet in the cell of their smaller coordinates: that is the join of
adjacent cells, without naming the 3^d neighbours of a cell. Cells are counted; one with a single row is not dense and
drops out, one with more rows than a task should hold is quantised again at half the width, and at the last width it is
compared block by block (_links_in_blocks), so no cell is more than a task can hold. In a dense cell the rows within
reach are linked, each to the smallest id of its part, so a part of n rows yields n - 1 links, not all pairs. Minimum
labels are then propagated over the links to convergence, with each round written to the shared folder.

The result equals single linkage at the reach, chains through other rows included; no row is sampled or capped.
Exact copies are linked to their smallest id before anything else.

Defined results: a group is named by its smallest id; rows without a partner form groups of one, which min_size leaves
out; an empty table has no groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.signatures import lists, matrix, sorted_runs, together
from plumbline.session import materialize, parts_for, release

#: Cell widths in reaches; the next one is used where a cell holds more than DENSE rows.
WIDE = (16, 8, 4)
DENSE = 20_000
#: Rows of a task that links cells.
TASK_ROWS = 200_000
LINKS = "id bigint, least bigint"


def mixed(cells: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit key of each row of whole numbers. Equal keys of different cells only cost a comparison."""
    key = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64) ^ np.asarray(start).astype(np.uint64)
    with np.errstate(over="ignore"):
        for column in cells.T:
            key = (key ^ column.astype(np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def place(vecs: np.ndarray, reach: float, width: float, start: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(cell key, row) of every row's cell and of the lower neighbours that it is within reach of."""
    cells = np.floor(vecs / width).astype(np.int64)
    near = vecs - cells * width <= reach
    keys, rows = [mixed(cells, start)], [np.arange(len(vecs))]
    # rows near the same borders move alike
    borders = near @ (1 << np.arange(vecs.shape[1]))
    order = np.argsort(borders, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(borders[order]) > 0]) if len(order) else order
    for own in np.split(order, starts[1:]):
        dims = np.flatnonzero(near[own[0]]) if len(own) else own
        if not len(dims):
            continue
        moves = np.zeros(((1 << len(dims)) - 1, vecs.shape[1]), np.int64)
        moves[:, dims] = list(itertools.product((0, 1), repeat=len(dims)))[1:]
        around = (cells[own][:, None] - moves[None]).reshape(-1, vecs.shape[1])
        row = np.repeat(own, len(moves))
        keys.append(mixed(around, np.asarray(start)[row] if np.ndim(start) else start))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def link(ids: np.ndarray, vecs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its part) for the rows of a cell whose part has other rows; parts: similarity >= least."""
    if len(ids) <= 1500:
        near = vecs @ vecs.T >= least
        np.fill_diagonal(near, True)
        labels, last = ids, None
        while last is None or (labels != last).any():
            last = labels
            labels = np.where(near, labels[None], np.iinfo(np.int64).max).min(1)
    else:
        labels = _link_balls(ids, vecs, least)
    moved = labels != ids
    return ids[moved], labels[moved]


def _link_balls(ids: np.ndarray, vecs: np.ndarray, least: float) -> np.ndarray:
    """For dense cells: cover the rows with balls of half the reach, whose rows are linked without comparing them, then
    compare rows of different balls only while no link joins their parts yet."""
    reach = np.sqrt(max(0.0, 2 - 2 * least))
    inside = 1 - (reach / 2) ** 2 / 2
    left, centres, balls = np.arange(len(ids)), [], []
    while len(left):
        near = vecs[left] @ vecs[left[0]] >= inside
        near[0] = True
        centres.append(left[0])
        balls.append(left[near])
        left = left[~near]
    parent = np.arange(len(balls))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    middle = vecs[centres]
    far = 1 - (2 * reach * (1 + 1e-9)) ** 2 / 2
    for i in range(len(balls)):
        near = middle[i + 1 :] @ middle[i]
        for j in np.flatnonzero(near >= far)[np.argsort(-near[near >= far], kind="stable")] + i + 1:
            a, b = root(i), root(j)
            if a == b:
                continue
            if near[j - i - 1] >= least or _touch(vecs[balls[i]], vecs[balls[j]], least):
                parent[max(a, b)] = min(a, b)
    labels = np.empty(len(ids), np.int64)
    roots = np.array([root(i) for i in range(len(balls))])
    for part in np.unique(roots):
        rows = np.concatenate([balls[i] for i in np.flatnonzero(roots == part)])
        labels[rows] = ids[rows].min()
    return labels


def _touch(a: np.ndarray, b: np.ndarray, least: float, block: int = 2048) -> bool:
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            if (a[i : i + block] @ b[j : j + block].T >= least).any():
                return True
    return False


def _links_in_cells(placed: DataFrame, width: int, least: float, rows: int) -> DataFrame:
    """Links within the cells; placed: cell, id, vec, of about so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches):
            cell, ids = table.column("cell").to_numpy(), table.column("id").to_numpy()
            vecs = matrix(table.column("vec").combine_chunks(), width)
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            sizes = np.diff(edges)
            found = []
            pairs = edges[:-1][sizes == 2]
            near = np.einsum("ij,ij->i", vecs[pairs], vecs[pairs + 1]) >= least
            first, second = ids[pairs[near]], ids[pairs[near] + 1]
            found.append((np.maximum(first, second), np.minimum(first, second)))
            for a, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
                found.append(link(ids[a : a + size], vecs[a : a + size], least))
            who, label = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(label)], names=["id", "least"])

    slim = placed.select("cell", "id", "vec")
    return together(slim, "cell", parts_for(placed.sparkSession, rows, TASK_ROWS)).mapInArrow(run, LINKS)


def _links_in_blocks(hot: DataFrame, width: int, least: float) -> DataFrame:
    """Links within cells of any size; hot: cell, id, vec. No task holds more than about DENSE rows of a cell.

    1. Rows in one box whose diagonal is no longer than the reach are linked to the box's smallest id, uncompared.
    2. The smallest rows of a cell's boxes are compared with each other, in pairs of blocks.
    3. What is then not in the largest part of its cell is compared with all rows of the cell, in pairs of blocks. Two
       rows of the largest part need no comparison, however many there are.
    """
    side = float(np.sqrt((2 - 2 * least) / width)) * (1 - 1e-9)
    half = max(1, DENSE // 2)
    hot = materialize(hot.withColumn("box", F.transform("vec", lambda x: F.floor(x / side))), "hot-cells")
    boxes = materialize(hot.groupBy("cell", "box").agg(F.min(F.struct("id", "vec")).alias("head"), F.count("*").alias("rows")), "boxes")
    linked = hot.join(boxes, ["cell", "box"]).select("id", F.col("head.id").alias("least"))

    blocks = lambda n: F.ceil(n / half).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(n, F.lit(1))).cast("int")
    pair = lambda a, b: F.xxhash64("cell", F.least(a, b), F.greatest(a, b))
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    heads = boxes.join(boxes.groupBy("cell").agg(blocks(F.count("*")).alias("n")), "cell").select("cell", "head.id", "head.vec", "n").withColumn("b", block(F.col("n")))
    met = heads.select("id", "vec", F.explode(F.transform(until(F.col("n")), lambda o: pair(F.col("b"), o))).alias("cell"))
    met = materialize(met, "box-pairs")
    parts = materialize(_links_in_cells(met, width, least, met.count()), "box-links")
    labels = propagate_minima(parts).select(F.col("id").alias("head_id"), "label")
    known = boxes.select("cell", "box", F.col("head.id").alias("head_id"), "rows").join(labels, "head_id", "left").withColumn("label", F.coalesce("label", "head_id"))
    known = materialize(known, "box-parts")
    sizes = known.groupBy("cell", "label").agg(F.sum("rows").alias("rows"))
    main = sizes.groupBy("cell").agg(F.max(F.struct("rows", "label")).alias("main"), F.sum("rows").alias("all"))
    main = main.select("cell", F.col("main.label").alias("main"), blocks(F.col("main.rows")).alias("mains"), blocks(F.col("all") - F.col("main.rows")).alias("others"))
    told = hot.join(known.select("cell", "box", "label"), ["cell", "box"]).join(main.filter("others > 0"), "cell")
    # the blocks of the largest part are numbered from 0, those of the other rows after them
    mains, others, other = F.col("mains"), F.col("others"), F.col("label") != F.col("main")
    told = told.withColumn("b", F.when(other, mains + block(others)).otherwise(block(mains)))
    meets = F.when(other, until(mains + others)).otherwise(F.transform(until(others), lambda o: o + mains))
    rest = materialize(told.select("id", "vec", F.explode(F.transform(meets, lambda o: pair(F.col("b"), o))).alias("cell")), "block-pairs")
    return linked.unionByName(parts).unionByName(_links_in_cells(rest, width, least, rest.count())).filter("id <> least")


def _place_rows(rows: DataFrame, width: int, reach: float, cell_width: float) -> DataFrame:
    """rows: id, vec, and cell where they are placed again within a cell."""
    again = "cell" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 8192):
                batch = whole.slice(start, 8192)
                vecs = matrix(batch.column(1), width)
                key, row = place(vecs, reach, cell_width, batch.column(2).to_numpy() if again else 0)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), lists(vecs[row])], names=["cell", "id", "vec"])

    return rows.select("id", "vec", *["cell"] * again).mapInArrow(run, "cell bigint, id bigint, vec array<double>")


def similarity_links(vectors: DataFrame, least: float) -> DataFrame:
    """Links (id, least) whose connected parts are those of all pairs with similarity >= least."""
    copies = materialize(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct-vectors")
    head = copies.select(F.max(F.size("vec")).alias("width"), F.max("n").alias("n")).first()
    if head.width is None:
        return vectors.sparkSession.createDataFrame([], LINKS)
    reach = float(np.sqrt(2 - 2 * least)) * (1 + 1e-9)
    links = None
    rows = copies.select("id", "vec")
    for turn, wide in enumerate(WIDE):
        placed = materialize(_place_rows(rows, head.width, reach, wide * reach), "placed")
        counts = placed.groupBy("cell").agg(F.count("*").alias("rows"))
        found = counts.agg(F.max("rows").alias("most"), F.sum("rows").alias("rows")).first()
        hot = None
        if found.most > DENSE:
            cells = materialize(counts.filter(F.col("rows") > DENSE).select("cell"), "hot-cells")
            hot, placed = placed.join(cells, "cell"), placed.join(cells, "cell", "left_anti")
        here = _links_in_cells(placed, head.width, least, found.rows)
        links = here if links is None else links.unionByName(here)
        if hot is None:
            break
        rows = hot.select("id", "vec", "cell")
    else:
        links = links.unionByName(_links_in_blocks(rows, head.width, least))
    if head.n > 1:
        groups = copies.filter("n > 1").select("vec", F.col("id").alias("least"))
        links = links.unionByName(vectors.join(groups, "vec").filter("id <> least").select("id", "least"))
    return links


def propagate_minima(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and label, the smallest id of its connected part, of every id in links.

    Each round gives an id the smallest label among its neighbours and itself, and then that label's own label, which
    halves what is left of a chain. The rounds end when one changes nothing.
    """
    links = materialize(links.filter("id <> least").distinct(), "links")
    both = links.select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(links.select(F.col("least").alias("a"), F.col("id").alias("b")))
    held = labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "labels")
    for _ in range(most_rounds):
        offered = both.join(labels, both.b == labels.id).select(F.col("a").alias("id"), "label").unionByName(labels)
        lower = offered.groupBy("id").agg(F.min("label").alias("label"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(hop, "label").select("id", F.least("label", "next").alias("label"))
        changed = jumped.join(labels.withColumnRenamed("label", "was"), "id")
        round_ = materialize(changed.select("id", "label", (F.col("label") != F.col("was")).alias("moved")), "labels")
        release(held)
        held, labels = round_, round_.select("id", "label")
        done = not round_.filter("moved").limit(1).collect()
        if done:
            return labels
    raise RuntimeError(f"labels still move after {most_rounds} rounds")


def cluster_members(vectors: DataFrame, least: float, min_size: int = 8) -> DataFrame:
    """cluster_id and id of every member of a group of at least min_size rows."""
    labels = propagate_minima(similarity_links(vectors, least))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    return labels.join(sizes.select("label"), "label").select(F.col("label").alias("cluster_id"), "id")


def describe_clusters(members: DataFrame, vectors: DataFrame, least: float, typical: int = 5) -> DataFrame:
    """cluster_id, size, densest_rows, typical_ids: the size of each group's densest cell and its smallest ids.

    Here the cells are as wide as half the reach. Equally dense cells: the one with the smallest id.
    """
    width = float(np.sqrt(2 - 2 * least)) / 2
    cell = F.xxhash64(F.transform("vec", lambda x: F.floor(x / width)))
    placed = members.join(vectors, "id").select("cluster_id", "id", cell.alias("cell"))
    # the smallest ids of a cell by a bounded aggregate: no cell's rows are gathered
    ranked = placed.groupBy("cluster_id", "cell").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    best = ranked.groupBy("cluster_id").agg(F.sum("rows").alias("size"), F.max(F.struct("rows", (-F.col("first")).alias("neg"), "cell")).alias("best"))
    best = best.select("cluster_id", "size", F.col("best.rows").alias("densest_rows"), F.col("best.cell").alias("cell"))
    order = Window.partitionBy("cluster_id").orderBy("id")
    chosen = placed.join(best, ["cluster_id", "cell"]).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= typical)
    return chosen.groupBy("cluster_id", "size", "densest_rows").agg(F.sort_array(F.collect_list("id")).alias("typical_ids"))
