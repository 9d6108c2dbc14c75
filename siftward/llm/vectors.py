"""Operator 11: near-duplicate vectors by Euclidean p-stable hashing, followed by exact cosine checks.

Between unit vectors cosine and distance say the same. Each table projects a vector on ``k`` random Gaussian directions,
shifts, and cuts the line into cells of width ``w``; vectors with the same ``k`` cells share a bucket. Width, ``k`` and the
number of tables follow from the number of vectors, the threshold and the recall wanted for pairs just at it, by the
known collision probability of such a cell; closer pairs are found more surely.

A group of near copies may be a third of all rows, so members of a bucket are not simply paired:

1. Equal vectors are one class with a count.
2. Every member of a bucket is compared with the bucket's smallest class, its leader. Members within half the
   threshold's angle of a leader form its **ball**: any two of them are within the whole angle, hence linked, without looking.
3. Buckets are then pairs of balls instead of pairs of vectors. The angle of two centres and the two radii tell for most
   pairs that all of their members are linked, or none.
4. Pairs of balls that this leaves open are compared member by member, in blocks of bounded size.

So links are exact for every pair whose balls met, and only sums of counts are shuffled, never the links within a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from siftward.llm.common import cut_lineage, met, table
from siftward.llm.components import components

LEAST_COSINE = 0.9
#: Least chance to find a pair just at the threshold.
RECALL = 0.9
#: Cosine of unrelated vectors by which the number of directions is chosen; it decides on cost only.
UNRELATED = 0.0
SEED = 11
#: Buckets of more balls are compared in blocks of about ``BLOCK`` vectors.
PAIRED_BUCKET, BLOCK = 32, 256
#: Angles closer than this are not told apart.
CLOSE = 1e-6
HASHED_ROWS = 512


def collision(distance: float, width: float) -> float:
    """Chance that two points at a distance fall in one cell of a random line."""
    t = width / distance
    tail = math.erfc(t / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Tables:
    width: float
    directions: int
    tables: int

    @classmethod
    def plan(cls, vectors: int, cosine: float = LEAST_COSINE, recall: float = RECALL, unrelated: float = UNRELATED) -> Tables:
        """The cheapest tables: a posting costs 16 bytes and its projections, an unrelated pair that meets about 600."""
        near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2 - 2 * unrelated)
        best = None
        for width in (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0):
            p, q = collision(near, width), collision(far, width)
            for k in range(1, 65):
                n = math.ceil(math.log(1 - recall) / math.log1p(-(p**k)))
                cost = n * (16 + 300 * vectors * q**k + k)
                if best is None or cost < best[0]:
                    best = (cost, cls(width, k, max(n, 1)))
        return best[1]


def by_size(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and their unit vectors as rows of doubles."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        found = values[(ends[rows] - size)[:, None] + np.arange(size)]
        # By the largest component first, whose square might not be a number of a double.
        found = found / np.abs(found).max(1, keepdims=True)
        yield rows, found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


def keys_of(units: np.ndarray, plan: Tables) -> np.ndarray:
    """Bucket of each vector in each table, as 64 bits that stand for table, length and cells."""
    size = units.shape[1]
    draw = np.random.default_rng([SEED, size])
    lines = draw.standard_normal((size, plan.tables * plan.directions))
    shifts = draw.random(plan.tables * plan.directions) * plan.width
    odd = draw.integers(0, 1 << 63, plan.tables * plan.directions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    start = draw.integers(0, 1 << 63, plan.tables, dtype=np.uint64)
    out = np.empty((len(units), plan.tables), np.uint64)
    for at in range(0, len(units), HASHED_ROWS):
        cells = np.floor((units[at : at + HASHED_ROWS] @ lines + shifts) / plan.width).astype(np.int64).view(np.uint64)
        mixed = (cells * odd).reshape(-1, plan.tables, plan.directions).sum(2, dtype=np.uint64) + start
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out[at : at + HASHED_ROWS] = mixed ^ (mixed >> np.uint64(29))
    return out.view(np.int64)


def buckets(vector: str, plan: Tables) -> Column:
    @F.arrow_udf("array<bigint>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.zeros((len(batch), plan.tables), np.int64)
            for rows, units in by_size(batch):
                out[rows] = keys_of(units, plan)
            yield pa.ListArray.from_arrays(np.arange(len(batch) + 1) * plan.tables, out.ravel())

    return hashed(vector)


@F.arrow_udf(DoubleType())
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Exact cosine of two vectors; -1 if they differ in length."""
    out = np.full(len(left), -1.0)
    others = {units.shape[1]: (rows, units) for rows, units in by_size(right)}
    for rows, units in by_size(left):
        if units.shape[1] in others:
            known, theirs = others[units.shape[1]]
            both, a, b = np.intersect1d(rows, known, assume_unique=True, return_indices=True)
            out[both] = np.einsum("ij,ij->i", units[a], theirs[b])
    return pa.array(out)


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each distinct vector: its number ``c``, 128 bits of its content, ``n`` rows, least id, vector."""
    found = rows.where(F.col("h0").isNotNull()).groupBy("h0", "h1").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v")
    )
    return cut_lineage(found.withColumn("c", F.monotonically_increasing_id()))


def with_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` with ``cos`` of their vectors (``id``, ``v``)."""
    left = met(pairs, vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
    both = met(left, vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return both.withColumn("cos", cosine("va", "vb")).drop("va", "vb")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def blocks(members: DataFrame, key: list[str], id_: str, size: str, columns: list[str]) -> DataFrame:
    """Members of each key in lists of about ``BLOCK`` by a hash of the id, so that no list grows with the key."""
    number = F.pmod(F.xxhash64(F.lit(SEED), id_), F.ceil(F.col(size) / BLOCK).cast("long")).alias("block")
    return members.select(*key, number, F.struct(*columns).alias("m")).groupBy(*key, "block").agg(F.collect_list("m").alias("members"))


def crowded_pairs(members: DataFrame, angle: float) -> DataFrame:
    """Pairs of balls of a bucket that may have linked members, for buckets of many balls; block against block."""
    held = cut_lineage(blocks(members, ["key"], "ball", "n_balls", ["ball", "radius", "v"]))
    # Every block goes to each block up to its own, so a bucket's pairs spread over all tasks.
    right = held.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("block"), F.col("members").alias("others"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine, theirs = batch.column("members")[k].values, batch.column("others")[k].values
                ids, others = (np.asarray(x.field("ball")) for x in (mine, theirs))
                radii, other_radii = (np.asarray(x.field("radius")) for x in (mine, theirs))
                right_units = {u.shape[1]: (r, u) for r, u in by_size(theirs.field("v"))}
                for rows, units in by_size(mine.field("v")):
                    if units.shape[1] not in right_units:
                        continue
                    known, other_units = right_units[units.shape[1]]
                    apart = np.arccos(np.clip(units @ other_units.T, -1, 1))
                    a, b = np.nonzero(apart <= angle + radii[rows][:, None] + other_radii[known][None, :] + CLOSE)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows[a]]), pa.array(others[known[b]])], ["x", "y"])

    joined = met(held, right, ["key", "block"]).select("members", "others")
    return joined.mapInArrow(compare, "x long, y long")


def open_links(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Members of open pairs of balls compared one by one: ``c`` and the rows ``add`` it is linked to, with the balls."""
    touched = pairs.select(F.col("a").alias("ball")).union(pairs.select(F.col("b").alias("ball"))).distinct()
    held = cut_lineage(blocks(met(members, touched, "ball"), ["ball"], "c", "size", ["c", "n", "v"]))
    left = met(pairs.select("a", "b"), held.select(F.col("ball").alias("a"), F.col("members").alias("ma")), "a")
    both = met(left, held.select(F.col("ball").alias("b"), F.col("members").alias("mb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(x)[k].values for x in ("ma", "mb")]
                ids, times = ([np.asarray(x.field(f)) for x in sides] for f in ("c", "n"))
                right_units = {u.shape[1]: (r, u) for r, u in by_size(sides[1].field("v"))}
                for rows, units in by_size(sides[0].field("v")):
                    if units.shape[1] not in right_units:
                        continue
                    known, others = right_units[units.shape[1]]
                    linked = units @ others.T >= threshold
                    c = np.concatenate([ids[0][rows], ids[1][known]])
                    add = np.concatenate([linked @ times[1][known], times[0][rows] @ linked])
                    c, add = c[add > 0], add[add > 0]
                    balls = [pa.array(np.full(len(c), batch.column(x)[k].as_py())) for x in ("a", "b")]
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(add), *balls], ["c", "add", "a", "b"])

    return both.select("a", "b", "ma", "mb").mapInArrow(compare, "c long, add long, a long, b long")


def balls_of(classes: DataFrame, postings: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``c`` with its ``ball``, and the pairs of balls (``a`` < ``b``) that share a bucket."""
    angle = math.acos(threshold)
    listed = postings.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("a"), F.max("c").alias("b"))
    listed = cut_lineage(listed.where("m > 1"))
    twos = listed.where("m = 2").select("a", "b")
    more = cut_lineage(met(postings, listed.where("m > 2").select("key", F.col("a").alias("leader")), "key"))
    stars = twos.union(more.where("c <> leader").select(F.col("leader").alias("a"), F.col("c").alias("b"))).distinct()
    vectors = classes.select(F.col("c").alias("id"), "v")
    inside = with_cosines(stars, vectors).where(F.col("cos") >= math.cos(angle / 2 - CLOSE))
    chosen = inside.groupBy(F.col("b").alias("c")).agg(F.min(F.struct(F.col("a").alias("ball"), "cos")).alias("to"))
    placed = met(classes.select("c", "n"), chosen, "c", "left").select(
        "c", "n", F.coalesce("to.ball", "c").alias("ball"), F.coalesce("to.cos", F.lit(1.0)).alias("cos")
    )
    placed = cut_lineage(placed)
    sums = placed.groupBy("ball").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("c").alias("only"), F.min("cos").alias("cos")
    )
    # A single member is its own centre.
    alone = F.col("size") == 1
    reach = F.acos(F.least(F.col("cos"), F.lit(1.0))) + CLOSE
    sums = sums.select(
        "ball", "size", "weight", F.when(alone, F.col("only")).otherwise(F.col("ball")).alias("id"),
        F.when(alone, 0.0).otherwise(reach).alias("radius"),
    )
    balls = cut_lineage(met(sums, vectors, "id").drop("id"))
    where = placed.select("c", "ball")
    of_two = met(met(twos, where.select(F.col("c").alias("a"), F.col("ball").alias("x")), "a"),
                 where.select(F.col("c").alias("b"), F.col("ball").alias("y")), "b")
    entries = cut_lineage(met(more.select("key", "c"), where, "c").select("key", "ball").distinct())
    full = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n_balls"), F.min("ball").alias("x"), F.max("ball").alias("y"))
    full = cut_lineage(full.where("n_balls > 1"))
    many = met(entries, full.where("n_balls > 2").select("key", "n_balls"), "key")
    few = many.where(F.col("n_balls") <= PAIRED_BUCKET)
    # A row meets fewer than ``PAIRED_BUCKET`` others.
    paired = met(few.select("key", F.col("ball").alias("x")), few.select("key", F.col("ball").alias("y")), "key").where("x < y")
    crowded = many.where(F.col("n_balls") > PAIRED_BUCKET)
    centres = met(crowded, balls.select("ball", "radius", "v"), "ball")
    pairs = of_two.select("x", "y").union(full.where("n_balls = 2").select("x", "y")).union(paired.select("x", "y"))
    pairs = ordered_pairs(pairs.union(crowded_pairs(centres, angle))).distinct()
    apart = with_cosines(pairs, balls.select(F.col("ball").alias("id"), "v"))
    for end in ("a", "b"):
        known = balls.select(
            F.col("ball").alias(end), F.col("size").alias(f"size_{end}"), F.col("weight").alias(f"weight_{end}"),
            F.col("radius").alias(f"radius_{end}"),
        )
        apart = met(apart, known, end)
    phi = F.acos(F.greatest(F.least(F.col("cos"), F.lit(1.0)), F.lit(-1.0)))
    reach = F.col("radius_a") + F.col("radius_b")
    single = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    state = (
        F.when(single, F.when(F.col("cos") >= threshold, "all").otherwise("none"))
        .when((F.col("cos") > -1) & (phi + reach <= angle - CLOSE), "all")
        .when(phi - reach > angle + CLOSE, "none")
        .otherwise("open")
    )
    judged = cut_lineage(apart.withColumn("state", state).where("state <> 'none'"))
    members = met(placed.select("c", "n", "ball"), balls.select("ball", "size", "weight"), "ball")
    return cut_lineage(members), judged


def near_vectors(
    docs: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = LEAST_COSINE,
    recall: float = RECALL, plan: Tables | None = None,
) -> DataFrame:
    """Per row: vec_id, ``n_links`` (other rows linked to it), ``component_id`` (smallest id reached), ``kept``.

    Links are pairs with a cosine of ``threshold`` (above 0) or more in doubles. A vector that is null, empty, zero, or
    has a null or non-finite component links with nothing, nor do vectors of different lengths. Equal vectors are linked, also
    rows of one id. Rows without id count as links; they are never the smallest, and a group of such rows only has a null
    component. ``kept``: the id is the component's (both null counts as equal). An empty table gives no rows. Other
    columns are ignored.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    kind = docs.schema[vector].dataType
    exact = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(f"`{vector}`") if exact else F.col(f"`{vector}`").cast("array<double>")
    rows = docs.select(F.col(f"`{key}`").alias("vec_id"), v.alias("v"))
    hashes = {f"h{k}": F.when(usable("v"), F.xxhash64(F.lit(k), "v")) for k in (0, 1)}
    rows = rows.withColumns(hashes)
    classes = classes_of(rows)
    plan = plan or Tables.plan(classes.count(), threshold, recall)
    hashed = cut_lineage(classes.select("c", buckets("v", plan).alias("keys")))
    members, judged = balls_of(classes, hashed.select(F.explode("keys").alias("key"), "c"), threshold)

    whole = judged.where("state = 'all'")
    ball_adds = whole.select(F.col("a").alias("ball"), F.col("weight_b").alias("w"))
    ball_adds = ball_adds.union(whole.select(F.col("b").alias("ball"), F.col("weight_a").alias("w")))
    ball_adds = ball_adds.groupBy("ball").agg(F.sum("w").alias("ball_add"))
    vectors = met(members, classes.select("c", "v"), "c")
    single = cut_lineage(open_links(judged.where("state = 'open'").select("a", "b"), vectors, threshold))
    class_adds = single.groupBy("c").agg(F.sum("add").alias("class_add"))

    links = whole.select("a", "b").union(single.select("a", "b").distinct())
    roots = cut_lineage(components(links))
    rooted = met(members, roots.select(F.col("node").alias("ball"), "root"), "ball", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "ball"))
    counted = met(met(rooted, ball_adds, "ball", "left"), class_adds, "c", "left")
    n_links = F.col("weight") - 1 + F.coalesce("ball_add", F.lit(0)) + F.coalesce("class_add", F.lit(0))
    counted = cut_lineage(met(counted.select("c", "root", n_links.alias("n_links")), classes.select("c", "h0", "h1", "least"), "c"))
    smallest = counted.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = met(counted, smallest, "root").select("h0", "h1", "n_links", "component_id", F.lit(True).alias("known"))
    found = met(rows.select("vec_id", "h0", "h1"), answers, ["h0", "h1"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op11_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


#: Every pair of vectors. The operator finds pairs just at the threshold with a chance of ``RECALL`` only.
ORACLE = r"""
WITH RECURSIVE usable AS MATERIALIZED (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
),
reached(node, other) AS (
    SELECT a, b FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
),
components AS (SELECT node, min(other) AS least FROM reached GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(coalesce(c.least, e.vec_id), e.vec_id) AS component_id,
       coalesce(c.least, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN counted ON counted.a = e.vec_id LEFT JOIN components c ON c.node = e.vec_id
"""
