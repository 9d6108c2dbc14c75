"""Trees grown side by side by tasks that each hold the whole training table, a byte for each number.

Spark's own forest goes over the rows for every level of every few thousand nodes and sums up 32 bins of each in every task;
that suits tables of any size, and a large one needs it. A table of at most ``CELLS`` numbers fits in a task as it is, so that
trees, folds and settings can be dealt out instead: a task grows its trees from the first split to the last leaf by itself.

The rules are Spark's: up to 32 bins a feature cut at quantiles, a fresh choice of features for every node of a forest, rows
weighted by a Poisson draw for every tree, the split of most gain, and leaves where rows are pure, too few or too deep. Labels are
0 and 1, for which the gain in Gini impurity is twice that in variance, so forests and boosting share one way to grow.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftward.models.split import in_folds
from siftward.session import cut_lineage, file_system

#: Numbers of a training table that a task may hold: 128 MB as they are read, an eighth of that as bins.
CELLS = 16_000_000
#: Pairs of a tree and a row that are grown together.
SAMPLES = 200_000
#: Trees that are grown together at most.
BLOCK_TREES = 25
#: Sums of a node's bins that are held at once.
SUMS = 4_000_000
BINS = 32
#: Nodes of a model that a task keeps between batches, about 25 bytes each.
KEPT_NODES = 8_000_000
PURE = 1e-12


# --- the training table in a task -------------------------------------------


@dataclass(frozen=True)
class Shared:
    """A stored training table: its files, and how many numbers a row has."""

    files: tuple[str, ...]
    width: int


def shared_rows(rows: DataFrame, folds: int = 1, key: str = "pkg_name", seed: int = 42) -> Shared | None:
    """The ``features`` and ``label`` of all rows, stored with a ``fold``; None if a task cannot hold them or labels are not 0 and 1."""
    first = rows.select("features").first()
    if first is None:
        return None
    width = first["features"].size
    odd = F.count_if(~F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False)))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), odd.alias("odd")).first()
    if not width or seen["n"] * width > CELLS or seen["odd"]:
        return None
    known = in_folds(rows, key, folds, seed) if folds > 1 else rows.withColumn("fold", F.lit(0))
    # In one order wherever the rows were, as trees draw rows by their place.
    order = [c for c in (key,) if c in rows.columns]
    listed = known.select(*order, vector_to_array("features").alias("features"), "label", "fold")
    stored = cut_lineage(listed.coalesce(1).sortWithinPartitions(*order, "label", "features").drop(*order))
    return Shared(tuple(stored.inputFiles()), width)


def read_rows(shared: Shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, labels and folds, in the order they are stored."""
    values, labels, folds = [], [], []
    for file in sorted(shared.files):
        store, path = file_system(file)
        with store.open_input_file(path) as source, pq.ParquetFile(source) as stored:
            for batch in stored.iter_batches(batch_size=8192):
                values.append(matrix(batch.column("features"), shared.width))
                labels.append(batch.column("label").to_numpy(zero_copy_only=False))
                folds.append(batch.column("fold").to_numpy(zero_copy_only=False))
    return np.concatenate(values), np.concatenate(labels), np.concatenate(folds)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def cuts_of(values: np.ndarray) -> list[np.ndarray]:
    """Where each feature is cut: between all of its values if these are few, otherwise as near to even bins as they allow."""
    most = min(BINS, len(values)) - 1
    cuts = []
    for column in values.T:
        known, counts = np.unique(column, return_counts=True)
        middles = known[:-1] + (known[1:] - known[:-1]) / 2
        if len(middles) > most:
            below = np.cumsum(counts)[:-1]
            wanted = len(column) / (most + 1) * np.arange(1, most + 1)
            after = np.clip(np.searchsorted(below, wanted), 1, len(below) - 1)
            near = np.where(wanted - below[after - 1] <= below[after] - wanted, after - 1, after)
            middles = middles[np.unique(near)]
        cuts.append(middles)
    return cuts


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value; what is not above the first cut is in bin 0."""
    out = np.empty(values.shape, np.uint8)
    for k, cut in enumerate(cuts):
        out[:, k] = np.searchsorted(cut, values[:, k], side="left")
    return out


# --- growing -----------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Nodes of some trees, the roots first; the right child follows the left one, and a leaf has feature -1."""

    n: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    #: What each feature gains in each tree.
    gains: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in, for each tree."""
        rows = len(bins)
        at = np.tile(np.arange(self.n, dtype=np.int32), rows)
        row = np.repeat(np.arange(rows, dtype=np.int32), self.n)
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            above = bins[row[open_], self.feature[node]] > self.cut[node]
            at[open_] = node = self.left[node] + above
            open_ = open_[self.feature[node] >= 0]
        return at.reshape(rows, self.n)

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """The values of the leaves of each row, added up over the trees."""
        step = max(1, SAMPLES // self.n)
        parts = [self.value[self.leaves(bins[k : k + step])].sum(axis=1) for k in range(0, len(bins), step)]
        return np.concatenate(parts) if parts else np.zeros(0)


def grow(
    bins: np.ndarray, row: np.ndarray, tree: np.ndarray, weight: np.ndarray, target: np.ndarray, n_trees: int, depth: int,
    least: float, width: int | None = None, draw: np.random.Generator | None = None,
) -> Trees:
    """Trees of samples, each a ``row`` of ``bins`` with its tree, weight and target; ``width`` features are drawn a node."""
    n_features = bins.shape[1]
    some = n_features if width is None else max(1, min(width, n_features))
    n_bins = int(bins.max(initial=0)) + 1
    gains = np.zeros((n_trees, n_features))
    features, cuts, lefts, values = [], [], [], []
    node, size, owner, done = tree, n_trees, np.arange(n_trees), n_trees
    for level in range(depth + 1):
        mass = np.bincount(node, weight, size)
        total = np.bincount(node, weight * target, size)
        square = np.bincount(node, weight * target * target, size)
        value = total / np.maximum(mass, PURE)
        impure = square - total * value > PURE * np.maximum(mass, 1)
        asked = np.flatnonzero(impure & (mass >= 2 * least)) if level < depth and n_bins > 1 else np.zeros(0, np.int64)
        feature, cut, gain = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size)
        step = max(1, SUMS // (some * n_bins))
        for start in range(0, len(asked), step):
            few = asked[start : start + step]
            place = np.full(size, -1)
            place[few] = np.arange(len(few))
            mine = np.flatnonzero(place[node] >= 0)
            at = place[node[mine]]
            if some < n_features:
                chosen = np.argpartition(draw.random((len(few), n_features)), some - 1, axis=1)[:, :some]
            else:
                chosen = np.broadcast_to(np.arange(n_features), (len(few), n_features))
            key = (at[:, None] * some + np.arange(some)) * n_bins + bins[row[mine][:, None], chosen[at]]
            shape = (len(few), some, n_bins)
            w, wy = weight[mine], weight[mine] * target[mine]
            sums = [np.bincount(key.ravel(), np.repeat(x, some), len(few) * some * n_bins).reshape(shape) for x in (w, wy)]
            below, said = (np.cumsum(x, axis=2)[:, :, :-1] for x in sums)
            above, other = mass[few, None, None] - below, total[few, None, None] - said
            with np.errstate(divide="ignore", invalid="ignore"):
                won = said * said / below + other * other / above - (total[few] * value[few])[:, None, None]
            won[(below < least) | (above < least) | (below <= 0) | (above <= 0)] = -np.inf
            best = won.reshape(len(few), -1).argmax(axis=1)
            most = won.reshape(len(few), -1)[np.arange(len(few)), best]
            split = most > PURE * mass[few]
            chosen_best = chosen[np.arange(len(few)), best // (n_bins - 1)]
            feature[few[split]] = chosen_best[split]
            cut[few[split]] = (best % (n_bins - 1))[split]
            gain[few[split]] = most[split]
        split = np.flatnonzero(feature >= 0)
        left = np.zeros(size, np.int32)
        left[split] = done + 2 * np.arange(len(split))
        np.add.at(gains, (owner[split], feature[split]), gain[split])
        features.append(feature)
        cuts.append(cut)
        lefts.append(left)
        values.append(value)
        if not len(split):
            break
        on = np.flatnonzero(feature[node] >= 0)
        row, weight, target, parent = row[on], weight[on], target[on], node[on]
        node = left[parent] - done + (bins[row, feature[parent]] > cut[parent])
        owner, size = np.repeat(owner[split], 2), 2 * len(split)
        done += size
    return Trees(n_trees, *map(np.concatenate, (features, cuts, lefts, values)), gains)


def forest_blocks(trees: int, n_rows: int) -> list[int]:
    """How many trees are grown together, block by block, whatever the number of tasks."""
    block = max(1, min(BLOCK_TREES, SAMPLES // max(1, n_rows), trees))
    return [min(block, trees - k) for k in range(0, trees, block)]


def grown_block(bins: np.ndarray, labels: np.ndarray, n_trees: int, depth: int, least: float, width: int, seed: Sequence[int]) -> Trees:
    """Some trees of a forest."""
    draw = np.random.default_rng(list(seed))
    drawn = draw.poisson(1.0, (n_trees, len(labels)))
    tree, row = np.nonzero(drawn)
    return grow(bins, row, tree, drawn[tree, row].astype(float), labels[row], n_trees, depth, least, width, draw)


def boosted(bins: np.ndarray, labels: np.ndarray, rounds: int, step: float, depth: int) -> Iterator[Trees]:
    """The trees of gradient boosting with Spark's loss, ``2 log(1 + exp(-2 y F))``; values are those added to the margin."""
    signs = 2 * labels - 1
    everyone, one = np.arange(len(labels)), np.ones(len(labels))
    margin = np.zeros(len(labels))
    for k in range(rounds):
        # The first tree is fitted to the labels, and not scaled.
        target = signs if k == 0 else 4 * signs / (1 + np.exp(np.clip(2 * signs * margin, -700, 700)))
        found = grow(bins, everyone, np.zeros(len(labels), np.int64), one, target, 1, depth, 1)
        if k:
            found = Trees(1, found.feature, found.cut, found.left, found.value * step, found.gains)
        margin += found.votes(bins)
        yield found


# --- forests -----------------------------------------------------------------

BLOCK = "block int, trees int, feature binary, cut binary, left binary, value binary, gains binary"


def features_drawn(strategy: str, n_features: int) -> int:
    """Features a node of a forest may look at, for the strategies of Spark that a classifier may name."""
    named = {
        "auto": np.ceil(np.sqrt(n_features)), "sqrt": np.ceil(np.sqrt(n_features)), "all": n_features,
        "log2": np.ceil(np.log2(max(2, n_features))), "onethird": np.ceil(n_features / 3),
    }
    if strategy in named:
        return max(1, int(named[strategy]))
    if strategy.isdigit():
        return max(1, min(int(strategy), n_features))
    return max(1, min(n_features, int(np.ceil(float(strategy) * n_features))))


def tasks_of(spark: SparkSession, n: int) -> DataFrame:
    """Numbers from 0, a part each, or as many parts as four times the cores."""
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))


def dealt_forest(
    shared: Shared, n_rows: int, trees: int, depth: int, least: float, strategy: str, seed: int, columns: Sequence[str]
) -> "DealtForestModel":
    spark = SparkSession.active()
    blocks, width = forest_blocks(trees, n_rows), features_drawn(strategy, shared.width)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = None
        for batch in batches:
            for k in batch.column("id").to_pylist():
                if bins is None:
                    values, labels, _ = read_rows(shared)
                    bins = binned(values, cuts_of(values))
                    del values
                found = grown_block(bins, labels, blocks[k], depth, least, width, (seed, k))
                sums = found.gains.sum(axis=1, keepdims=True)
                shares = (found.gains / np.where(sums > 0, sums, 1)).sum(axis=0)
                parts = (found.feature, found.cut, found.left, found.value, shares)
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([k], pa.int32()), "trees": pa.array([found.n], pa.int32())}
                    | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("feature", "cut", "left", "value", "gains"), parts)}
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in batch.column("id").to_pylist():
                found = cuts_of(read_rows(shared)[0])
                yield pa.RecordBatch.from_pydict({"cuts": pa.array([c.tolist() for c in found], pa.list_(pa.float64()))})

    stored = cut_lineage(tasks_of(spark, len(blocks)).mapInArrow(grown, BLOCK))
    # At most 31 numbers a feature.
    cuts = spark.range(1).coalesce(1).mapInArrow(cut, "cuts array<double>").toArrow().column("cuts").to_pylist()
    total = np.zeros(shared.width)
    for found in stored.select("gains").toArrow().column("gains").to_pylist():
        total += np.frombuffer(found)
    place = np.flatnonzero(total)
    shares = Vectors.sparse(len(total), place.tolist(), (total[place] / total.sum()).tolist())
    return DealtForestModel(stored.inputFiles(), trees, cuts, columns, shares)


@lru_cache(1)
def _kept(files: tuple[str, ...]) -> list[Trees] | None:
    """All blocks, where they are small enough to be kept by a worker."""
    found, nodes = [], 0
    for block in _blocks(files):
        nodes += len(block.feature)
        if nodes > KEPT_NODES:
            return None
        found.append(block)
    return found


def _blocks(files: Sequence[str]) -> Iterator[Trees]:
    for file in sorted(files):
        store, path = file_system(file)
        with store.open_input_file(path) as source, pq.ParquetFile(source) as stored:
            for batch in stored.iter_batches(batch_size=1):
                for r in batch.to_pylist():
                    kinds = (("feature", np.int32), ("cut", np.uint8), ("left", np.int32), ("value", np.float64))
                    yield Trees(r["trees"], *(np.frombuffer(r[c], kind) for c, kind in kinds), np.zeros((0, 0)))


class DealtForestModel(Model, MLReadable, MLWritable):
    """A forest in stored blocks of trees; rows are asked where they are, and stored with the votes."""

    def __init__(
        self, files: Sequence[str] = (), trees: int = 0, cuts: Sequence[Sequence[float]] = (), columns: Sequence[str] = (),
        shares: SparseVector | None = None,
    ):
        super().__init__()
        self.files, self.trees, self.cuts, self.columns = tuple(sorted(files)), trees, list(cuts), list(columns)
        self.featureImportances = shares

    def _transform(self, rows: DataFrame) -> DataFrame:
        features, raw, probability, prediction = self.columns
        files, cuts = self.files, [np.array(c, float) for c in self.cuts]

        @F.arrow_udf("double")
        def asked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                bins = binned(matrix(batch, len(cuts)), cuts)
                votes = np.zeros(len(bins))
                for block in _kept(files) or _blocks(files):
                    votes += block.votes(bins)
                yield pa.array(votes)

        kept = cut_lineage(rows.withColumn("_votes", asked(vector_to_array(features))))
        spam, n = F.col("_votes"), F.lit(float(self.trees))
        return kept.withColumns({
            raw: array_to_vector(F.array(n - spam, spam)),
            probability: array_to_vector(F.array(1 - spam / n, spam / n)),
            # An even vote goes to class 0.
            prediction: (spam > n - spam).cast("double"),
        }).drop("_votes")

    def write(self) -> MLWriter:
        return _DealtWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DealtReader()


class _DealtWriter(MLWriter):
    def __init__(self, stage: DealtForestModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        stage, shares = self.stage, self.stage.featureImportances
        learnt = {
            "trees": stage.trees, "cuts": stage.cuts, "columns": stage.columns,
            "shares": [shares.size, shares.indices.tolist(), shares.values.tolist()],
        }
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata={"learnt": learnt})
        self.sparkSession.read.schema(BLOCK).parquet(*stage.files).write.parquet(f"{path}/blocks")


class _DealtReader(MLReader):
    def load(self, path: str) -> DealtForestModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        learnt = metadata["learnt"]
        files = spark.read.parquet(f"{path}/blocks").inputFiles()
        stage = DealtForestModel(files, learnt["trees"], learnt["cuts"], learnt["columns"], Vectors.sparse(*learnt["shares"]))
        stage._resetUid(metadata["uid"])
        return stage


# --- searches ----------------------------------------------------------------


def _fold(shared: Shared, fold: int, held: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins and labels of the other folds' rows and of the fold's; bins are cut by the rows that teach."""
    if "rows" not in held:
        held["rows"] = read_rows(shared)
    values, labels, folds = held["rows"]
    if held.get("fold") != fold:
        teach = folds != fold
        cuts = cuts_of(values[teach]) if teach.any() else [np.zeros(0)] * shared.width
        held |= {"fold": fold, "bins": binned(values, cuts), "teach": teach}
    bins, teach = held["bins"], held["teach"]
    return bins[teach], labels[teach], bins[~teach], labels[~teach]


def _judged(shared: Shared, tasks: int, said) -> list[tuple[int, int, int, int]]:
    """Number of a setting, rounds, rows and rows told right: what ``said`` yields for each task with its held-out rows."""
    names = ("number", "rounds", "n_rows", "n_right")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for task in batch.column("id").to_pylist():
                rows = list(said(task, held))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)})

    spark = SparkSession.active()
    schema = ", ".join(f"{c} long" for c in names)
    # A part each, as fits differ in length.
    found = cut_lineage(spark.range(0, tasks, 1, tasks).mapInArrow(judged, schema))
    return [tuple(r[c] for c in names) for r in found.where("n_rows > 0").orderBy("number", "rounds").collect()]


def forest_scores(shared: Shared, strategies: Sequence[str], trees: int, depth: int, least: float, folds: int, seed: int):
    """Rows and rows told right by a forest of each strategy, for each fold that has rows."""
    widths = [features_drawn(s, shared.width) for s in strategies]

    def said(task: int, held: dict):
        # The widest forests take longest and go first.
        number, fold = len(widths) - 1 - task // folds, task % folds
        bins, labels, asked, known = _fold(shared, fold, held)
        if len(labels) and len(known):
            votes = np.zeros(len(known))
            for k, n in enumerate(forest_blocks(trees, len(labels))):
                block = grown_block(bins, labels, n, depth, least, widths[number], (seed, number, fold, k))
                votes += block.votes(asked)
            yield number, trees, len(known), int(((votes > trees - votes) == (known == 1)).sum())

    return _judged(shared, len(widths) * folds, said)


def boosting_scores(shared: Shared, draws: Sequence[tuple[int, float, int]], least: int, folds: int):
    """The same of each draw of rounds, step and depth, after each number of rounds from ``least``."""

    def said(task: int, held: dict):
        number, fold = task // folds, task % folds
        rounds, step, depth = draws[number]
        bins, labels, asked, known = _fold(shared, fold, held)
        if len(labels) and len(known):
            margin = np.zeros(len(known))
            for k, found in enumerate(boosted(bins, labels, rounds, step, depth), 1):
                margin += found.votes(asked)
                if k >= least:
                    yield number, k, len(known), int(((margin > 0) == (known == 1)).sum())

    return _judged(shared, len(draws) * folds, said)
