"""Cost-complexity pruning of a fitted tree: one fit gives the subtrees of every strength.

The cost of a tree is the impurity of its leaves, each weighted by its share of the rows, plus the strength for each leaf.
From the full tree, the inner node whose subtree gains least for each leaf (the weakest link) becomes a leaf,
again and again down to the root. The strength at which a node does so is all that is kept; it tells for any
strength which node of the full tree a row ends in. Rows are counted by leaf and label once, in Spark, and
thereby judge all strengths together.

Trees are as large as the model, which is an object of the driver in any case; rows never come to it.
"""

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftward.session import cut_lineage, shared_folder

NODE_COLUMNS = "id int, left int, right int, n_rows double, impurity double, prediction double"
PATH = "step long, strength double, n_leaves long, cost double"
#: Gains that differ by rounding only are one strength.
EQUAL = 1e-12


@dataclass(frozen=True)
class Tree:
    """Nodes by their number in depth-first order; leaves have no children (-1)."""

    left: np.ndarray
    right: np.ndarray
    n_rows: np.ndarray
    impurity: np.ndarray
    prediction: np.ndarray

    @classmethod
    def of_rows(cls, nodes: DataFrame, least_split: float = 0) -> "Tree":
        """From a node table; inner nodes of fewer than ``least_split`` rows count as leaves."""
        found = nodes.select(F.col("id").cast("int"), "left", "right", "n_rows", "impurity", "prediction").orderBy("id").toArrow()
        columns = {c: found.column(c).to_numpy() for c in found.column_names}
        if not np.array_equal(columns["id"], np.arange(len(columns["id"]))):
            raise ValueError("nodes must be numbered from 0 without gaps")
        inner = columns["n_rows"] >= least_split
        return cls(
            np.where(inner, columns["left"], -1), np.where(inner, columns["right"], -1),
            columns["n_rows"].astype(float), columns["impurity"].astype(float), columns["prediction"].astype(float),
        )

    @property
    def cost(self) -> np.ndarray:
        return self.n_rows / self.n_rows[0] * self.impurity


@dataclass(frozen=True)
class Pruning:
    """The strength at which each node becomes a leaf (infinite: never, below a pruned node; 0 for first leaves)."""

    tree: Tree
    at: np.ndarray
    path: list[tuple[float, int, float]]
    #: Children in the fitted model, whatever the least rows of a split.
    whole_left: np.ndarray
    whole_right: np.ndarray

    def leaves(self, strength: float) -> list[int]:
        """Leaves of the best subtree for a strength, the smallest of equally good ones."""
        out, open_ = [], [0]
        while open_:
            node = open_.pop()
            if self.at[node] <= strength or self.tree.left[node] < 0:
                out.append(node)
            else:
                open_ += [self.tree.right[node], self.tree.left[node]]
        return out

    def steps(self) -> list[tuple[int, float, float, float]]:
        """Number of a leaf of the full tree (depth first), from and below which strength it says what."""
        rows: list[tuple[int, float, float, float]] = []
        number = 0
        open_: list[tuple[int, list[int]]] = [(0, [])]
        while open_:
            node, above = open_.pop()
            chain = [*above, node]
            if self.whole_left[node] >= 0:
                open_ += [(self.whole_right[node], chain), (self.whole_left[node], chain)]
                continue
            until = math.inf
            for end in chain:
                start = -math.inf if self.tree.left[end] < 0 else float(self.at[end])
                if start < until:
                    rows.append((number, start, until, float(self.tree.prediction[end])))
                    until = start
            number += 1
        return rows


def weakest_links(tree: Tree, whole: Tree | None = None) -> Pruning:
    """All strengths of a tree. ``whole`` is the model's tree where ``tree`` has fewer inner nodes."""
    whole = whole or tree
    size = len(tree.left)
    parent = np.full(size, -1)
    inner = np.flatnonzero(tree.left >= 0)
    parent[tree.left[inner]] = inner
    parent[tree.right[inner]] = inner
    cost, below, leaves = tree.cost, tree.cost.copy(), np.ones(size, np.int64)
    reached = [0]
    for node in reached:
        if tree.left[node] >= 0:
            reached += [int(tree.left[node]), int(tree.right[node])]
    for node in reversed(reached):
        if tree.left[node] >= 0:
            a, b = tree.left[node], tree.right[node]
            below[node], leaves[node] = below[a] + below[b], leaves[a] + leaves[b]
    at = np.where(tree.left < 0, 0.0, math.inf)
    gone = np.zeros(size, bool)
    gain = lambda t: (cost[t] - below[t]) / (leaves[t] - 1)
    heap = [(gain(t), t) for t in reached if tree.left[t] >= 0]
    heapq.heapify(heap)
    path = [(0.0, int(leaves[0]), float(below[0]))]
    strength = 0.0
    while heap:
        found, node = heapq.heappop(heap)
        # Entries of earlier gains, and of nodes under a pruned one, are out of date.
        if gone[node] or at[node] <= strength and leaves[node] == 1 or found != gain(node):
            continue
        if found > strength + EQUAL:
            strength = found
        at[node] = strength
        removed = [int(tree.left[node]), int(tree.right[node])]
        while removed:
            t = removed.pop()
            if not gone[t]:
                gone[t] = True
                if tree.left[t] >= 0:
                    removed += [int(tree.left[t]), int(tree.right[t])]
        fewer, more = leaves[node] - 1, cost[node] - below[node]
        t = node
        while t >= 0:
            leaves[t] -= fewer
            below[t] += more
            if t != node:
                heapq.heappush(heap, (gain(t), t))
            t = parent[t]
        if path[-1][0] == strength:
            path.pop()
        path.append((float(strength), int(leaves[0]), float(below[0])))
    return Pruning(tree, at, path, whole.left, whole.right)


def node_table(model: DecisionTreeClassificationModel) -> DataFrame:
    """``id`` (depth first), ``left``, ``right``, ``n_rows``, ``impurity`` and ``prediction`` of a fitted tree's nodes."""
    data = saved(model)[1]
    return data.select(
        "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("rawCount").cast("double").alias("n_rows"), "impurity", "prediction",
    )


def saved(model: DecisionTreeClassificationModel) -> tuple[str, DataFrame]:
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/siftward/tree-{uuid4().hex}"
    model.write().save(path)
    return path, spark.read.parquet(f"{path}/data")


def pruning_of(model: DecisionTreeClassificationModel, least_split: float = 0) -> Pruning:
    nodes = node_table(model)
    return weakest_links(Tree.of_rows(nodes, least_split), Tree.of_rows(nodes))


def path_rows(spark: SparkSession, pruning: Pruning) -> DataFrame:
    """The path: ``strength`` from which a subtree is best, its ``n_leaves`` and ``cost`` (weighted impurity)."""
    rows = [(k, *entry) for k, entry in enumerate(pruning.path)]
    return spark.createDataFrame(rows, PATH)


def accuracies(
    model: DecisionTreeClassificationModel, pruning: Pruning, rows: DataFrame, strengths: Sequence[float]
) -> DataFrame:
    """``strength``, ``n_rows`` and ``n_right`` of rows with ``label``, for all strengths from one grouping of the rows."""
    spark = rows.sparkSession
    ended = model.setLeafCol("_leaf").transform(rows).groupBy(F.col("_leaf").cast("int").alias("leaf"), "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    steps = spark.createDataFrame(pruning.steps(), "leaf int, start double, until double, said double")
    grid = spark.createDataFrame([(float(s),) for s in strengths], "strength double")
    # At most a row for each leaf and label before the strengths come in.
    said = ended.join(steps, "leaf").groupBy("start", "until").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("said") == F.col("label"), F.col("n")).otherwise(0)).alias("right")
    )
    inside = (F.col("strength") >= F.col("start")) & (F.col("strength") < F.col("until"))
    return grid.join(said, inside, "left").groupBy("strength").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("right"), F.lit(0)).alias("n_right")
    )


def pruned_model(model: DecisionTreeClassificationModel, pruning: Pruning, strength: float) -> DecisionTreeClassificationModel:
    """The fitted tree cut down to its best subtree for a strength."""
    spark = SparkSession.active()
    path, data = saved(model)
    ends = set(pruning.leaves(strength))
    order, new, open_ = [], {}, [0]
    while open_:
        node = open_.pop()
        new[node] = len(order)
        order.append(node)
        if node not in ends:
            open_ += [int(pruning.tree.right[node]), int(pruning.tree.left[node])]
    places = [
        (node, new[node], *((-1, -1) if node in ends else (new[int(pruning.tree.left[node])], new[int(pruning.tree.right[node])])))
        for node in order
    ]
    kept = spark.createDataFrame(places, "id int, new_id int, new_left int, new_right int")
    end = F.col("new_left") < 0
    no_split = F.struct(
        F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    cut = data.join(kept, "id").select(
        F.col("new_id").alias("id"), "prediction", "impurity", "impurityStats", "rawCount",
        F.when(end, -1.0).otherwise(F.col("gain")).alias("gain"),
        F.col("new_left").alias("leftChild"), F.col("new_right").alias("rightChild"),
        F.when(end, no_split).otherwise(F.col("split")).alias("split"),
    )
    target = f"{path}-pruned"
    # In order, as the nodes are read again by their number.
    cut_lineage(cut).coalesce(1).sortWithinPartitions("id").write.parquet(f"{target}/data")
    spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{target}/metadata")
    return DecisionTreeClassificationModel.load(target)
