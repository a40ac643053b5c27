"""Embedding near-dedup by a forest of random-projection trees.

Every tree splits a node of vectors by a random direction at the median of the
projections, and so on until a leaf is small.  Vectors near a cut go to both
sides, so near vectors that one tree parts are together in others.  Vectors
are compared within the leaves only, in double precision; what reaches the
cosine is a link, and links are united to components.

Nodes are split in rounds of several levels.  A round fits the cuts of a node
on a sample of a fixed size and then sends all vectors of the node down, so no
task holds a large node.  A leaf has at most ``leaf`` vectors.  What cannot be
split, because projections are equal, is compared in pairs of blocks instead.
"""

from collections.abc import Iterator
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_rows, partitions
from riskweave.llm.components import connected
from riskweave.operators.runtime import stored

TREES = 8
LEAF = 512
# Share of a node's vectors that go to both sides of a cut, half of them on each side.
OVERLAP = 0.2
# Vectors of a node that its cuts are fitted on, and levels that such a sample can carry.
SAMPLE = 4096
LEVELS = 5
# A node that has lost less than this share of its vectors in a round is not split again.
LEAST_LOSS = 0.2

_NODE = "tree int, node long, vec_id long, vector binary"
_CUTS = "tree int, node long, cuts binary"


def packed(values: list[float]) -> bytes:
    """A vector as bytes: single precision if that holds it, else double, with a letter in front."""
    x = np.array(values, dtype=np.float64)
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return b"f" + single.tobytes() if (single == x).all() else b"d" + x.tobytes()


def unit(vector: bytes) -> np.ndarray:
    """The vector of length one, in double precision."""
    x = np.frombuffer(vector, dtype="<f4" if vector[:1] == b"f" else "<f8", offset=1)
    # Scaled first, so that the squares of very large and small numbers stay numbers.
    x = x.astype(np.float64)
    x /= np.abs(x).max()
    return x / np.sqrt(x @ x)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that may link, with a hash of the label and the width."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [
                (vec_id, label, packed(values))
                for vec_id, label, values in batch
                if values and None not in values and any(values) and all(map(isfinite, values))
            ]

    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select("vec_id", F.xxhash64("label", F.size("embedding")).alias("label"), "embedding")
    return map_rows(rows, run, "vec_id long, label long, vector binary")


def directions(tree: int, node: int, width: int) -> np.ndarray:
    """The random directions of the cuts below a node, one for each; the same wherever they are worked out."""
    r = np.random.default_rng([tree, node & 0xFFFFFFFF, node >> 32 & 0xFFFFFFFF])
    return r.standard_normal((2**LEVELS - 1, width))


def _fit(leaf: int):
    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        """Lower and upper end of the overlap of every cut; a cut that is not needed has none."""
        tree, node, rows = int(sample["tree"].iloc[0]), int(sample["node"].iloc[0]), int(sample["rows"].iloc[0])
        x = np.stack([unit(v) for v in sample["vector"]])
        ways = directions(tree, node, x.shape[1])
        cuts = np.full((2**LEVELS - 1, 2), np.nan)
        at = {0: np.arange(len(x))}
        for cut in range(len(cuts)):
            own = at.get(cut)
            # A node of the expected size of a leaf, with some room, is one.
            if own is None or len(own) * rows / len(x) <= 0.8 * leaf or len(own) < 8:
                continue
            p = x[own] @ ways[cut]
            low, high = np.quantile(p, [0.5 - OVERLAP / 2, 0.5 + OVERLAP / 2])
            left, right = own[p <= high], own[p >= low]
            # Equal projections cannot be parted; such a node stays whole.
            if max(len(left), len(right)) <= (1 - LEAST_LOSS) * len(own):
                cuts[cut] = low, high
                at[2 * cut + 1], at[2 * cut + 2] = left, right
        return pd.DataFrame({"tree": [tree], "node": [node], "cuts": [cuts.tobytes()]})

    return fit


def _routed(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """Every vector in the nodes that it reaches below its own."""
    known: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        groups: dict[tuple[int, int], list[tuple]] = {}
        fitted = {}
        for tree, node, vec_id, vector, cuts in batch:
            groups.setdefault((tree, node), []).append((vec_id, vector))
            fitted[tree, node] = cuts
        rows = []
        for (tree, node), members in groups.items():
            x = np.stack([unit(v) for _, v in members])
            if (tree, node) not in known:
                if len(known) > 256:
                    known.clear()
                known[tree, node] = directions(tree, node, x.shape[1])
            ways = known[tree, node]
            cuts = np.frombuffer(fitted[tree, node]).reshape(-1, 2)
            at = {0: np.arange(len(x))}
            for cut in range(2 ** (LEVELS + 1) - 1):
                own = at.pop(cut, None)
                if own is None or not len(own):
                    continue
                if cut >= len(cuts) or np.isnan(cuts[cut, 0]):
                    below = _child(node, cut)
                    rows += [(tree, below, *members[k]) for k in own.tolist()]
                    continue
                p = x[own] @ ways[cut]
                at[2 * cut + 1], at[2 * cut + 2] = own[p <= cuts[cut, 1]], own[p >= cuts[cut, 0]]
        yield rows


def _child(node: int, place: int) -> int:
    """A number for a place below a node, spread over 64 bits."""
    value = (node * 0x9E3779B97F4A7C15 + place + 1) & (1 << 64) - 1
    value = (value ^ value >> 31) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    value ^= value >> 32
    return value - (1 << 64) if value >> 63 else value


def _compare(cosine: float):
    def compare(leaf: pd.DataFrame) -> pd.DataFrame:
        # A block against itself holds every vector once, two blocks are told apart by side.
        ids = leaf["vec_id"].to_numpy()
        x = np.stack([unit(v) for v in leaf["vector"]])
        sides = leaf["side"].to_numpy()
        if sides.any() and not sides.all():
            one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
            i, j = np.nonzero(x[one] @ x[two].T >= cosine)
            a, b = ids[one[i]], ids[two[j]]
        else:
            i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
            a, b = ids[i], ids[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return compare


def leaves(heads: DataFrame, trees: int, leaf: int) -> DataFrame:
    """(tree, node, block, side, vec_id, vector): vectors with one (tree, node, block) are to be compared."""
    spark = heads.sparkSession
    roots = heads.groupBy("label").agg(F.count("*").alias("rows"))
    # A label that is a leaf by itself needs one tree.
    grown = heads.join(roots, "label").select(
        F.explode(F.sequence(F.lit(0), F.when(F.col("rows") <= leaf, 0).otherwise(trees - 1))).alias("tree"),
        F.col("label").alias("node"),
        "vec_id",
        "vector",
    )
    now, parent_rows, done = stored(grown), None, []
    while True:
        sizes = now.groupBy("tree", "node").agg(F.count("*").alias("rows"))
        sizes = stored(sizes)
        small = now.join(sizes.filter(F.col("rows") <= leaf).drop("rows"), ["tree", "node"])
        done.append(small.select("tree", "node", F.lit(0).alias("block"), F.lit(0).alias("side"), "vec_id", "vector"))
        large = sizes.filter(F.col("rows") > leaf)
        if large.isEmpty():
            break
        if parent_rows is not None:
            # Nodes as large as the one they came from are compared in blocks.
            stuck = large.join(parent_rows, ["tree", "node"]).filter(
                F.col("rows") > (1 - LEAST_LOSS) * F.col("parent")
            )
            stuck = stored(stuck.select("tree", "node", "rows"))
            if not stuck.isEmpty():
                done.append(_blocks(now.join(stuck, ["tree", "node"]), leaf))
                large = large.join(stuck, ["tree", "node"], "left_anti")
                if large.isEmpty():
                    break
        rows = now.join(large, ["tree", "node"])
        share = F.lit(float(SAMPLE)) / F.col("rows")
        drawn = rows.filter(F.pmod(F.xxhash64("vec_id", "tree", "node"), F.lit(1_000_000)) < share * 1_000_000)
        cuts = stored(drawn.groupBy("tree", "node").applyInPandas(_fit(leaf), _CUTS))
        moved = rows.join(cuts, ["tree", "node"]).select("tree", "node", "vec_id", "vector", "cuts")
        now = stored(map_rows(moved, _routed, _NODE))
        children = large.select("tree", F.col("node").alias("from"), F.col("rows").alias("parent")).withColumn(
            "place", F.explode(F.sequence(F.lit(0), F.lit(2 ** (LEVELS + 1) - 2)))
        )
        named = map_rows(
            children,
            lambda batches: ([(t, _child(f, k), p) for t, f, p, k in batch] for batch in batches),
            "tree int, node long, parent long",
        )
        parent_rows = stored(named)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.repartition(partitions(spark), "tree", "node", "block")


def _blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """Vectors of nodes that cannot be split, in blocks, once for each pair of blocks."""
    blocks = F.ceil(2 * F.col("rows") / leaf).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    return paired.select("tree", "node", pair.alias("block"), side.alias("side"), "vec_id", "vector")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors are compared if their labels are equal and not null.  A vector
    that is null, empty, zero, or holds null or non-finite components links
    with nothing, and neither do vectors of different widths.  ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest
    vec_id that links reach, and ``kept`` says whether it is the vector's own.

    Equal vectors of one label are one class: they link with each other, so
    only one of them goes through the forest and the others are counted with it.  Rows with one vec_id are one vector of several rows; rows
    without have no links and no component.
    """
    rows = stored(usable(vectors))
    classes = rows.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
    classes = stored(classes)
    heads = classes.select("label", F.col("rep").alias("vec_id"), "vector")
    groups = leaves(heads, trees, leaf).groupBy("tree", "node", "block")
    links = stored(groups.applyInPandas(_compare(cosine), "a long, b long").distinct().filter("a != b"))
    weights = classes.groupBy("rep").agg(F.sum("members").alias("members"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(weights.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("members").alias("near"))
    members = rows.join(classes.drop("members"), ["label", "vector"]).select("vec_id", "rep")
    own = members.join(weights, "rep").join(linked, F.col("rep") == F.col("a"), "left")
    counts = own.select("vec_id", "rep", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    known = connected(links.unionByName(members.selectExpr("vec_id AS a", "rep AS b")))
    found = counts.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    ids = vectors.select("vec_id")
    joined = ids.join(found, "vec_id", "left").join(known, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
