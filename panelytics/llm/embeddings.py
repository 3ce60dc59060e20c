"""Vectors of one label with a cosine of at least a threshold, by a cover tree and a dual traversal.

Unit vectors at cosine c are ``sqrt(2 - 2c)`` apart, so links are pairs within that distance. For each label a tree of
nested nets is grown: a node with too many vectors gets children around centres that are as far apart as its candidates
allow, every vector goes to its nearest centre, and each child's covering radius is measured, so bounds are exact
whatever the centres. Pairs of nodes are then taken down the tree, from each root with itself; a pair is cut off when
its centres are further apart than both radii and a link's distance together. The vectors of the leaf pairs that remain
are compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics.llm.batches import mixed
from panelytics.llm.components import components
from panelytics.llm.storage import stored

#: Least cosine of a link.
COSINE = 0.93
#: Vectors of a leaf at most; children of a node at most; vectors of a node that may become centres.
LEAF, CHILDREN, CANDIDATES = 2048, 8, 64
#: Vectors this near to each other are at one place: a node of such is divided by turns.
_ONE_PLACE = 1e-7
#: Bounds are widened by this much, so that rounding never cuts a pair off.
_SLACK = 1e-6


def _can_link(v: Column) -> Column:
    """With a label; not null, empty or zero; all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.Array | list) -> np.ndarray:
    """Rows scaled to length one in double precision, by their largest component first, so that none overflows."""
    x = np.array(vectors.to_pylist() if isinstance(vectors, pa.Array) else [list(v) for v in vectors], np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _centres(own: pd.DataFrame) -> pd.DataFrame:
    """Centres of a node's children: each is the candidate furthest from those before."""
    x = _units(own["v"])
    kept, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(kept) < CHILDREN and far.max() > _ONE_PLACE:
        kept.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[kept[-1]], axis=1))
    return pd.DataFrame({"node": own["node"].iloc[:1], "centres": [x[kept].tolist()]})


def _divided(rows: DataFrame) -> DataFrame:
    """Rows (node, id, v) of nodes that are too large: each in its child, with the child's centre and its distance."""
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id", "node")))
    chosen = rows.select("node", "id").withColumn("turn", turn).where(F.col("turn") <= CANDIDATES).select("node", "id")
    centres = (
        rows.join(chosen, ["node", "id"], "left_semi")
        .select("node", "v")
        .groupBy("node")
        .applyInPandas(_centres, "node string, centres array<array<double>>")
    )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
            x = _units(batch.column(2))
            names, far = np.empty(len(nodes), object), np.zeros(len(nodes))
            own_centres: list = [None] * len(nodes)
            for node in dict.fromkeys(nodes):
                own = np.flatnonzero(nodes == node)
                c = np.array(batch.column(3)[int(own[0])].as_py())
                distance = np.sqrt(np.maximum(2 - 2 * x[own] @ c.T, 0))
                child = distance.argmin(1)
                far[own] = distance.min(1)
                if len(c) == 1:
                    turned = mixed(ids[own].view(np.uint64) + np.uint64(node.count(".")))
                    child = (turned % np.uint64(CHILDREN)).astype(np.int64)
                names[own] = [f"{node}.{k}" for k in child]
                for i, k in zip(own, child, strict=True):
                    own_centres[i] = c[min(k, len(c) - 1)].tolist()
            columns = [pa.array(names, pa.string()), batch.column(1), batch.column(2), batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(own_centres, pa.list_(pa.float64())), pa.array(far)],
                ["node", "id", "v", "parent", "centre", "far"],
            )

    kind = dict(rows.dtypes)["v"]
    return rows.join(centres, "node").select("node", "id", "v", "centres").mapInArrow(
        nearest, f"node string, id long, v {kind}, parent string, centre array<double>, far double"
    )


def grow(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree over rows (node, id, v), whose nodes are the roots: the rows in their leaves, and all nodes below the
    roots as (parent, node, centre, radius). A leaf has LEAF vectors at most."""
    leaves, tree, at_work = None, None, rows
    while True:
        large = stored(at_work.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).select("node"))
        done = at_work.join(large, "node", "left_anti")
        leaves = done if leaves is None else leaves.union(done)
        if large.isEmpty():
            return leaves, tree
        children = stored(_divided(at_work.join(large, "node", "left_semi")))
        nodes = children.groupBy("parent", "node").agg(F.first("centre").alias("centre"), F.max("far").alias("radius"))
        tree = nodes if tree is None else tree.union(nodes)
        at_work = children.select("node", "id", "v")


def _near_pairs(pairs: DataFrame, distance: float) -> DataFrame:
    """Of pairs of nodes with centres and radii, those that may hold a link."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            one, two = (np.array(batch.column(names.index(c)).to_pylist(), np.float64) for c in ("centre_a", "centre_b"))
            r_a, r_b = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("radius_a", "radius_b"))
            near = np.linalg.norm(one - two, axis=1) <= r_a + r_b + distance + _SLACK
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.mapInArrow(step, "a string, b string")


def leaf_pairs(leaves: DataFrame, tree: DataFrame | None, distance: float) -> DataFrame:
    """Pairs (a, b) of leaves, a <= b, that may hold a link: the dual traversal, a level at a time."""
    if tree is None:
        return leaves.select(F.col("node").alias("a")).distinct().withColumn("b", F.col("a"))
    tree = stored(tree)
    inner = tree.select(F.col("parent").alias("node")).distinct()
    roots = inner.join(tree.select("node"), "node", "left_anti").union(
        leaves.select("node").distinct().join(tree.select("node"), "node", "left_anti")
    )
    pairs = stored(roots.select(F.col("node").alias("a"), F.col("node").alias("b")))
    while True:
        open_pairs = pairs.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").union(
            pairs.join(inner.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
        )
        if open_pairs.isEmpty():
            return pairs
        below = [
            tree.select(
                F.col("parent").alias(f"old_{c}"),
                F.col("node").alias(c),
                F.col("centre").alias(f"centre_{c}"),
                F.col("radius").alias(f"radius_{c}"),
            ).union(
                tree.join(inner, "node", "left_anti").select("node", "node", "centre", "radius")  # a leaf stays
            )
            for c in ("a", "b")
        ]
        lone = pairs.join(inner.withColumnRenamed("node", "a"), "a", "left_anti").where("a = b")
        rest = pairs.join(lone, ["a", "b"], "left_anti")
        children = (
            rest.select(F.col("a").alias("old_a"), F.col("b").alias("old_b"))
            .join(below[0], "old_a")
            .join(below[1], "old_b")
            .where("old_a <> old_b or a <= b")
        )
        pairs = stored(lone.union(_near_pairs(children, distance)))


def _links(own: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of two leaves: each vector's number of links (copies counted), and one link to the first vector it reaches."""
    x, ids, copies = _units(own["v"]), own["id"].to_numpy(), own["copies"].to_numpy()
    left = np.flatnonzero(own["node"] == own["a"])
    right = np.flatnonzero(own["node"] == own["b"])
    alike = x[left] @ x[right].T >= cosine
    i, j = np.nonzero(alike)
    i, j = left[i], right[j]
    if own["a"].iloc[0] == own["b"].iloc[0]:
        i, j = i[i < j], j[i < j]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    reach = np.arange(len(ids))
    while True:
        before = reach.copy()
        np.minimum.at(reach, i, before[j])
        np.minimum.at(reach, j, before[i])
        reach = reach[reach]
        if (reach == before).all():
            break
    some = n > 0
    return pd.DataFrame({"id": ids[some], "n": n[some], "first": ids[reach[some]]})


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``vectors``.

    Two rows are linked if their labels are equal and not null and the cosine in double precision is at least
    ``cosine``. Vectors that are null, empty, zero or hold nulls or non-finite numbers are linked with nothing; so are
    vectors of different dimensions. Equal vectors of a label are one vector with copies. Each row counts for itself,
    also if ids repeat; ``component_id`` is the smallest id reachable, a row without an id has none unless it reaches
    one, and is kept.
    """
    v = F.col("embedding")
    base = stored(vectors.select("vec_id", "label", "embedding").withColumn("row", F.monotonically_increasing_id()))
    able = base.where(_can_link(v)).select("label", v.alias("v"), "row")
    classes = stored(able.groupBy("label", "v").agg(F.min("row").alias("id"), F.count("*").alias("copies")))
    rows = classes.select(F.concat_ws("|", F.col("label").cast("string"), F.size("v")).alias("node"), "id", "v")
    leaves, tree = grow(rows)
    pairs = stored(leaf_pairs(leaves, tree, math.sqrt(max(0.0, 2 - 2 * cosine))))
    held = leaves.join(classes.select("id", "copies"), "id")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    compared = stored(
        held.join(sides, "node")
        .groupBy("a", "b")
        .applyInPandas(lambda own: _links(own, cosine), "id long, n long, first long")
    )
    n_links = compared.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(compared.select(F.col("id").alias("a"), F.col("first").alias("b")))
    # copies share their class's links, and have each other
    of_class = (
        classes.join(n_links, "id", "left")
        .join(parts.withColumnRenamed("id", "x"), F.col("id") == F.col("x"), "left")
        .select("label", "v", F.col("copies"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("part"))
    )
    found = stored(
        base.where(_can_link(v))
        .join(of_class.withColumnRenamed("label", "of"), (F.col("label") == F.col("of")) & (v == F.col("v")))
        .select("row", "vec_id", "part", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    )
    smallest = found.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    linked = found.join(smallest, "part").select("row", "n_links", "component_id")
    return base.select("row", "vec_id").join(linked, "row", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
