"""Decision trees and boosted trees grown by aggregation, for vocabularies of any width.

An entity is a sparse row: the features it has, and the bins of their values.
Rows are stored in blocks.  A level of a tree is one job with one shuffle:
tasks add up by node, feature and bin what is not in the bin of zero, a feature
comes together in one task, and that bin is the node's total less the rest.  So
no row and no statistic is as wide as the vocabulary.  Which entity is in which
node is worked out in its block from the splits, of which a level has at most
2^depth, and totals of nodes go down with the splits.

The best split has the largest sum of squared target over number of rows on
both sides.  For a target of 0 and 1 this is the split of the least Gini
impurity, for a gradient the one of the least variance.
"""

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.runtime import clean_shuffles, release, stored

MAX_BINS = 32
# Precision of the quantiles that bins begin at.
ACCURACY = 10_000

# Rows of a block, at most; sums that a task holds, and groups of bins that it looks at at once.
BLOCK_ROWS, HELD_SUMS, GROUPS_AT_ONCE = 4096, 1 << 21, 1 << 15
# Entries of a block by feature and bin: their rows, features, bins and the bins of zero; and of each row the sign of its
# class, its margin and its target.
_BLOCKS = "n long, s double, rows binary, idxs binary, bins binary, zero_bins binary, signs binary, margins binary, targets binary"
_SUMS = "node long, idx int, zero_bin int, bin int, n long, s double"
_SPLITS = "node long, idx int, bin int, zero_bin int, gain double, n long, s double"
# Nodes of trees on the driver.
_NODES = "tree int, weight double, node long, idx int, bin int, zero_bin int, gain double, n long, prediction double"
NODE_COLUMNS = "tree int, node long, idx int, cut double, bin int, zero_bin int, gain double, n long, prediction double, weight double"


def cut_points(matrix: DataFrame, max_bins: int = MAX_BINS, method: str = "quantile") -> DataFrame:
    """(idx, cuts): values at which the bins of a feature end, ascending, at most ``max_bins`` - 1.

    "quantile" has about as many of the feature's entries in each bin, "width"
    divides the range of its values evenly.
    """
    steps = [k / max_bins for k in range(1, max_bins)]
    if method == "quantile":
        cuts = F.array_sort(F.array_distinct(F.percentile_approx("value", steps, ACCURACY)))
        return matrix.groupBy("idx").agg(cuts.alias("cuts"))
    if method != "width":
        raise ValueError(f"bins are made by quantile or width, not {method}")
    ends = matrix.groupBy("idx").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # Zeros are values as well, which no entry stands for.
    low, high = F.least("low", F.lit(0.0)), F.greatest("high", F.lit(0.0))
    between = F.transform(F.array(*map(F.lit, range(1, max_bins))), lambda k: low + (high - low) * k / max_bins)
    return ends.select("idx", between.alias("cuts"))


def _bin(value: Column, cuts: Column) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(cuts, lambda c: c < value))


@contextmanager
def _rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def binned_rows(matrix: DataFrame, cuts: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored blocks of all entities of ``targets`` (subject_id, target, and sign and margin if trees are boosted).

    Entries in the bin of zero are left out; an entity may have none.
    """
    # A table of one row per feature; Spark sends it to all tasks only while it is small.
    placed = matrix.join(cuts, "idx").select("subject_id", "idx", _bin(F.col("value"), F.col("cuts")).alias("bin"), _bin(F.lit(0.0), F.col("cuts")).alias("zero_bin"))
    entries = F.sort_array(F.collect_list(F.struct("idx", "bin", "zero_bin")))
    rows = placed.filter("bin != zero_bin").groupBy("subject_id").agg(entries.alias("e"))
    zero = F.lit(0.0)
    numbers = [(F.col(c).cast("double") if c in targets.columns else zero).alias(c) for c in ("sign", "margin", "target")]
    filled = targets.join(rows, "subject_id", "left").select(
        *(F.coalesce(f"e.{c}", F.array().cast("array<int>")).alias(c) for c in ("idx", "bin", "zero_bin")), *numbers
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                entries = [np.repeat(np.arange(batch.num_rows), batch.column("idx").value_lengths().to_numpy())]
                entries += [batch.column(c).flatten().to_numpy() for c in ("idx", "bin", "zero_bin")]
                order = np.lexsort((entries[2], entries[1]))
                numbers = (batch.column(c).to_numpy() for c in ("sign", "margin", "target"))
                yield _block(*(e[order] for e in entries), *numbers)

    spark = matrix.sparkSession
    with _rows_at_once(spark, BLOCK_ROWS):
        return stored(filled.mapInArrow(blocks, _BLOCKS))


def _block(rows, idxs, bins, zero_bins, signs, margins, targets) -> pa.RecordBatch:
    kinds = ("<i4", "<i4", "<i4", "<i4", "<f8", "<f8", "<f8")
    parts = [np.ascontiguousarray(v, kind).tobytes() for v, kind in zip((rows, idxs, bins, zero_bins, signs, margins, targets), kinds)]
    names = [c.split(" ")[0] for c in _BLOCKS.split(", ")]
    numbers = [pa.array([len(targets)], pa.int64()), pa.array([float(targets.sum())], pa.float64())]
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array([p], pa.binary()) for p in parts)], names)


class _Block:
    """The arrays of a stored block."""

    def __init__(self, row: dict):
        for name in ("rows", "idxs", "bins", "zero_bins"):
            setattr(self, name, np.frombuffer(row[name], "<i4"))
        for name in ("signs", "margins", "targets"):
            setattr(self, name, np.frombuffer(row[name], "<f8"))

    def routed(self, levels: list[np.ndarray]) -> np.ndarray:
        """Node of every row behind the splits of all ``levels``, each (node, idx, bin, zero_bin) sorted by node."""
        nodes = np.ones(len(self.targets), dtype=np.int64)
        for level in levels:
            at = np.minimum(np.searchsorted(level[:, 0], nodes), len(level) - 1)
            idx, cut, own = level[at, 1], level[at, 2], level[at, 3]
            here = level[at, 0] == nodes
            # Should a row have a feature twice, the smaller bin counts.
            met = np.flatnonzero(self.idxs == idx[self.rows])[::-1]
            own[self.rows[met]] = self.bins[met]
            nodes = np.where(here, 2 * nodes + (own > cut), nodes)
        return nodes


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _Block(row)


def _added(columns: list[np.ndarray], sorted_: bool = False) -> list[np.ndarray]:
    """Sums (node, idx, zero_bin, bin, n, s) with one row for each node, feature and bin, sorted by them."""
    node, idx, _, bin_, _, _ = columns
    if not len(node):
        return columns
    if not sorted_:
        if node.max() < 1 << 22 and bin_.max() < 1 << 10:
            # One number is sorted faster than three.
            order = np.argsort((node.astype(np.int64) << 41) | (idx.astype(np.int64) << 10) | bin_)
        else:
            order = np.lexsort((bin_, idx, node))
        columns = [c[order] for c in columns]
    node, idx, zero, bin_, n, s = columns
    new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (idx[1:] != idx[:-1]) | (bin_[1:] != bin_[:-1])]))
    return [node[new], idx[new], zero[new], bin_[new], np.add.reduceat(n, new), np.add.reduceat(s, new)]


def _arrow(columns: list, layout: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [c.split(" ") for c in layout.split(", ")]
    arrays = [pa.array(values).cast(kinds[kind]) for values, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _best(columns: list[np.ndarray], totals: dict[int, tuple[int, float]]) -> list[tuple]:
    """(node, idx, bin, zero_bin, gain, n and s on the left) of the best split of each node by the features of a task."""
    node, idx, zero, bin_, n, s = _added(columns)
    if not len(node):
        return []
    found: dict[int, tuple] = {}
    begins = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (idx[1:] != idx[:-1])]))
    sizes = np.diff(np.append(begins, len(node)))
    n_all = np.array([totals[k][0] for k in node[begins].tolist()], dtype=float)
    s_all = np.array([totals[k][1] for k in node[begins].tolist()], dtype=float)
    # Features with as many bins go together, so that most tables are narrow.
    for size in np.unique(sizes).tolist():
        alike = np.flatnonzero(sizes == size)
        for a in range(0, len(alike), GROUPS_AT_ONCE):
            some = alike[a : a + GROUPS_AT_ONCE]
            at = begins[some][:, None] + np.arange(size)
            every, whole, rest = n_all[some][:, None], s_all[some][:, None], zero[begins[some]][:, None]
            # The bin of zero takes its place among the others.
            before = (bin_[at] < rest).sum(axis=1)
            row, place = np.arange(len(some)), np.arange(size) + (bin_[at] > rest)
            bins, counts, sums = (np.zeros((len(some), size + 1), kind) for kind in (np.int64, float, float))
            for table, values, left in ((bins, bin_, rest), (counts, n, every), (sums, s, whole)):
                own = values[at]
                np.put_along_axis(table, place, own, axis=1)
                table[row, before] = (left if table is bins else left - own.sum(axis=1, keepdims=True))[:, 0]
            n_left, s_left = np.cumsum(counts, axis=1), np.cumsum(sums, axis=1)
            n_right, s_right = every - n_left, whole - s_left
            with np.errstate(divide="ignore", invalid="ignore"):
                score = s_left * s_left / n_left + s_right * s_right / n_right
                gain = (score - whole * whole / every) / every
            gain = np.where((counts > 0) & (n_right > 0), gain, -np.inf)
            # Of equal gains the first: the smallest feature, then the smallest bin.
            most = gain.argmax(axis=1)
            top, names = gain[row, most], node[begins[some]]
            edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            for k, e in zip(edges, np.append(edges[1:], len(names))):
                g = k + int(top[k:e].argmax())
                if top[g] > 1e-12:
                    i, j = begins[some[g]], most[g]
                    split = (int(names[g]), int(idx[i]), int(bins[g, j]), int(zero[i]), float(top[g]), int(n_left[g, j]), float(s_left[g, j]))
                    _take(found, split)
    return list(found.values())


def _take(found: dict[int, tuple], split: tuple) -> None:
    """Keeps the better split of a node: the larger gain, then the smaller feature and bin."""
    old = found.get(split[0])
    if old is None or (split[4], -split[1], -split[2]) > (old[4], -old[1], -old[2]):
        found[split[0]] = split


def level_splits(blocks: DataFrame, levels: list[np.ndarray], totals: dict[int, tuple[int, float]]) -> dict[int, tuple]:
    """The best split of every node of ``totals`` (rows and sum of the target) that has one, by node.

    A split (node, idx, bin, zero_bin, gain, n, s) sends bins up to ``bin`` to
    the left, that is ``n`` rows with the sum ``s``.  ``gain`` is the drop of the mean squared
    error, above zero; of equal ones the smallest feature and bin.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(sorted(totals))
        held, size = [], 0
        for block in _read(batches):
            nodes = block.routed(levels)
            place = np.minimum(np.searchsorted(wanted, nodes), len(wanted) - 1)
            there = np.flatnonzero((wanted[place] == nodes)[block.rows])
            # Entries are in the order of features and bins already, and few nodes are sorted fast.
            of = place[block.rows[there]]
            there = there[np.argsort(of.astype(np.uint16) if len(wanted) <= 1 << 16 else of, kind="stable")]
            of, targets = nodes[block.rows[there]], block.targets[block.rows[there]]
            entries = [of, block.idxs[there], block.zero_bins[there], block.bins[there], np.ones(len(there), np.int64), targets]
            held.append(_added(entries, sorted_=True))
            size += len(held[-1][0])
            if size > HELD_SUMS:
                held = [_added([np.concatenate(c) for c in zip(*held)])]
                size = len(held[0][0])
                if size > HELD_SUMS // 2:
                    yield _arrow(held[0], _SUMS)
                    held, size = [], 0
        if held:
            yield _arrow(held[0] if len(held) == 1 else _added([np.concatenate(c) for c in zip(*held)]), _SUMS)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [[c.to_numpy() for c in batch.columns] for batch in batches]
        rows = _best([np.concatenate(c) for c in zip(*some)], totals) if some else []
        if rows:
            yield _arrow(list(zip(*rows)), _SPLITS)

    spark = blocks.sparkSession
    # A block is a large row.
    with _rows_at_once(spark, 1):
        added = blocks.mapInArrow(sums, _SUMS)
    found: dict[int, tuple] = {}
    with clean_shuffles(spark):
        for r in added.repartition("idx").mapInArrow(best, _SPLITS).collect():
            _take(found, tuple(r))
    return found


def grow(blocks: DataFrame, max_depth: int) -> tuple[list[tuple], list[np.ndarray]]:
    """Nodes of one tree, (node, idx, bin, zero_bin, gain, n, prediction), and its splits by level.

    Nodes are numbered from 1 at the root, those below k are 2k and 2k + 1.
    Leaves have no feature; the prediction is the mean target of a node.  At
    most 2^depth splits a level come together.
    """
    root = blocks.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    here = {1: (root.n, root.s)} if root.n else {}
    nodes, levels = [], []
    for _ in range(max_depth):
        splits = level_splits(blocks, levels, here) if here else {}
        nodes += [_leaf(k, *total) for k, total in here.items() if k not in splits]
        below = {}
        for k, (node, idx, cut, zero, gain, n, s) in sorted(splits.items()):
            n_all, s_all = here[k]
            nodes.append((node, idx, cut, zero, gain, n_all, s_all / n_all))
            below |= {2 * k: (n, s), 2 * k + 1: (n_all - n, s_all - s)}
        here = below
        if not splits:
            break
        levels.append(np.array([split[:4] for _, split in sorted(splits.items())], dtype=np.int64))
    return nodes + [_leaf(k, *total) for k, total in here.items()], levels


def _leaf(node: int, n: int, s: float) -> tuple:
    return (node, None, None, None, None, n, s / n)


def _named(nodes: list[tuple], cuts: DataFrame) -> DataFrame:
    """Stored ``nodes`` (tree, weight and what :func:`grow` gives) with the value that they split at."""
    # Batches of a local table have a row for every node of the model.
    found = cuts.sparkSession.createDataFrame(nodes, _NODES)
    marked = found.join(cuts, "idx", "left").withColumn("cut", F.get("cuts", F.col("bin")))
    return stored(marked.selectExpr(*(f"CAST({name} AS {kind}) AS {name}" for name, kind in (c.split(" ") for c in NODE_COLUMNS.split(", ")))))


def fit_tree(
    matrix: DataFrame, targets: DataFrame, max_depth: int = 10, max_bins: int = MAX_BINS, method: str = "quantile"
) -> DataFrame:
    """Nodes of a tree, in ``NODE_COLUMNS``, from the long ``matrix`` (subject_id, idx, value) and (subject_id, target).

    With a target of 0 and 1 the prediction of a node is its share of ones.
    """
    cuts = stored(cut_points(matrix, max_bins, method))
    blocks = binned_rows(matrix, cuts, targets)
    nodes, _ = grow(blocks, max_depth)
    found = _named([(0, 1.0, *node) for node in nodes], cuts)
    release(blocks, cuts)
    return found


def fit_boosted(
    matrix: DataFrame,
    targets: DataFrame,
    iterations: int = 50,
    max_depth: int = 5,
    step_size: float = 0.1,
    max_bins: int = MAX_BINS,
    method: str = "quantile",
) -> DataFrame:
    """Nodes of boosted trees for a target of 0 and 1 under the logistic loss.

    The first tree fits the target as -1 and 1 with weight 1, each of the others
    the gradient of what is there so far, with weight ``step_size``.  Rows are
    written once per tree, with their margin.
    """
    cuts = stored(cut_points(matrix, max_bins, method))
    signed = targets.select("subject_id", (2 * F.col("target") - 1).alias("sign"))
    blocks = binned_rows(matrix, cuts, signed.withColumns({"margin": F.lit(0.0), "target": F.col("sign").cast("double")}))
    found = []
    for tree in range(iterations):
        weight = 1.0 if tree == 0 else float(step_size)
        nodes, levels = grow(blocks, max_depth)
        found += [(tree, weight, *node) for node in nodes]
        if tree < iterations - 1:
            before, blocks = blocks, _moved(blocks, nodes, levels, weight)
            release(before)
    named = _named(found, cuts)
    release(blocks, cuts)
    return named


def _moved(blocks: DataFrame, nodes: list[tuple], levels: list[np.ndarray], weight: float) -> DataFrame:
    """Stored ``blocks`` with the predictions of a tree added to the margins, and the gradient there as the target."""
    leaves = sorted((node[0], node[-1]) for node in nodes if node[1] is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = np.array([k for k, _ in leaves]), np.array([v for _, v in leaves])
        for block in _read(batches):
            margins = block.margins + weight * values[np.searchsorted(names, block.routed(levels))]
            with np.errstate(over="ignore"):
                targets = 4 * block.signs / (1 + np.exp(2 * block.signs * margins))
            yield _block(block.rows, block.idxs, block.bins, block.zero_bins, block.signs, margins, targets)

    with _rows_at_once(blocks.sparkSession, 1):
        return stored(blocks.mapInArrow(run, _BLOCKS))


def _stacked(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def spark_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The same columns, as far as they apply, from a tree model that Spark has written to ``folder``.

    Spark numbers nodes in preorder and names both children, so they get new numbers from the root.
    """
    data = spark.read.parquet(f"{folder}/data")
    boosted = "treeID" in data.columns
    raw = data.select("treeID", "nodeData.*") if boosted else data.select(F.lit(0).alias("treeID"), "*")
    raw = stored(raw.select("treeID", "id", "leftChild", "rightChild", "prediction", "gain", "split"))
    here = raw.filter("id = 0").withColumn("node", F.lit(1).cast("long"))
    levels = [here]
    while True:
        inner = here.filter("leftChild >= 0")
        if inner.isEmpty():
            break
        left = inner.select("treeID", F.col("leftChild").alias("id"), (F.col("node") * 2).alias("node"))
        right = inner.select("treeID", F.col("rightChild").alias("id"), (F.col("node") * 2 + 1).alias("node"))
        here = stored(raw.join(left.unionByName(right), ["treeID", "id"]))
        levels.append(here)
    nodes = _stacked(levels)
    if boosted:
        # Tree, parameters and weight; the columns' names differ between versions.
        weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("treeID", "parameters", "weight").drop("parameters")
        nodes = nodes.join(weights, "treeID")
    else:
        nodes = nodes.withColumn("weight", F.lit(1.0))
    leaf = F.col("leftChild") < 0
    return nodes.select(
        F.col("treeID").cast("int").alias("tree"),
        "node",
        F.when(~leaf, F.col("split.featureIndex")).alias("idx"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("cut"),
        F.lit(None).cast("int").alias("bin"),
        F.lit(None).cast("int").alias("zero_bin"),
        "gain",
        F.lit(None).cast("long").alias("n"),
        "prediction",
        "weight",
    )
