"""Operator 2: mixing sources to target weights. DataFrame functions only.

Temperature mixing: a source's weight is its token share to the power of an exponent, normalised. The
exponent is bisected in [0, 1], several halvings in each pass over the sources: the largest at which the
weights reach a target entropy, or the smallest (flattest mixture) at which no source is repeated beyond a limit;
of both the larger, so that the limit goes before the target. Entropy only falls with the exponent, and so do repetitions.

Weights become whole-document budgets: the documents of a source fall into blocks by a hash, each epoch
over a source takes its blocks in a permuted order of its own, and of the block in which the
budget ends documents are taken until it is reached. No source is grouped or sorted as a whole: windows
hold the blocks of a source (4096 at most) or the documents of one block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftward.llm.common import columns_of, cut_lineage, free_name, keyed, met, once, table

#: Halvings in one pass, and passes.
HALVINGS, PASSES = 6, 5
BLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """What the mixture has to meet: ``entropy``, ``repeats``, or ``entropy`` as far as ``repeats`` allows.

    ``entropy``: least entropy of the weights, as a share of that of equal weights.
    ``repeats``: most epochs over any source.
    ``budget``: tokens of the mixture. None: with ``repeats`` those of the corpus, with ``entropy`` alone as many as
    the scarcest source allows without repetition, so that a very scarce source leaves little of the others.
    ``block_tokens``: tokens of a block on average; a source has at most 4096 blocks.
    """

    entropy: float | None = None
    repeats: float | None = None
    budget: int | None = None
    block_tokens: int = 20_000
    seed: int = 17

    def __post_init__(self):
        if self.entropy is None and self.repeats is None:
            raise ValueError("set entropy, repeats or both")


def counted(docs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Id, source and tokens (words) of each document; a null source is the source ``''``. ``carried`` columns stay."""
    return docs.select(
        "doc_id",
        *carried,
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    )


def hashed(*parts: Column | str) -> Column:
    """Hex digest of the parts as text; the same in other engines."""
    columns = [F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *columns))


def exponent(shares: DataFrame, mix: Mix, tokens: int) -> float:
    """The bisected exponent, to 2^-30: with both aims the larger of theirs."""
    aims = [aim for aim in ("entropy", "repeats") if getattr(mix, aim) is not None]
    return max(bisected(shares, mix, tokens, aim) for aim in aims)


def bisected(shares: DataFrame, mix: Mix, tokens: int, aim: str) -> float:
    """The exponent of one aim. A repetition limit that the shares themselves break gives 1.

    ``shares`` has one row per source. A pass tries the 2^6 - 1 points that six halvings could reach and
    returns one row for each.
    """
    most = F.log(F.lit(float(max(shares.count(), 1))))

    def met(points: list[float]) -> list[float]:
        at = F.explode(F.array(*[F.lit(x) for x in points])).alias("x")
        raised = shares.select("share", at).withColumn("w", F.pow("share", "x"))
        sums = raised.groupBy("x").agg(
            F.sum("w").alias("z"),
            F.sum(F.col("w") * F.log("w")).alias("wl"),
            F.max(F.col("w") / F.col("share")).alias("r"),
        )
        if aim == "entropy":
            fits = F.log("z") - F.col("wl") / F.col("z") >= mix.entropy * most
        else:
            fits = F.col("r") / F.col("z") * ((mix.budget or tokens) / tokens) <= mix.repeats
        return sorted(row.x for row in sums.where(fits).select("x").collect())

    # Entropy is met below some exponent, a limit of repetitions above one.
    below = aim == "entropy"
    ends = met([0.0, 1.0])
    if below and 1.0 in ends or not below and 1.0 not in ends:
        return 1.0
    if not below and 0.0 in ends:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        parts = 1 << HALVINGS
        points = [low + (high - low) * k / parts for k in range(1, parts)]
        found = met(points)
        if below:
            low, high = max(found, default=low), min(set(points).difference(found), default=high)
        else:
            low, high = max(set(points).difference(found), default=low), min(found, default=high)
    return low if below else high


def weights(docs: DataFrame, mix: Mix) -> DataFrame:
    """Per source: n_docs, n_tokens, share, weight, budget (tokens) and n_blocks. ``docs`` as from ``counted``.

    Sources without tokens have weight and budget 0.
    """
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sources = cut_lineage(sources)
    tokens = sources.agg(F.sum("n_tokens")).first()[0] or 0
    shares = sources.withColumn("share", F.col("n_tokens") / F.lit(float(max(tokens, 1))))
    power = exponent(shares.where("n_tokens > 0"), mix, tokens) if tokens else 1.0
    raised = shares.withColumn("raised", F.when(F.col("n_tokens") > 0, F.pow("share", F.lit(power))).otherwise(0.0))
    total = raised.agg(F.sum("raised")).first()[0] or 1.0
    weighted = raised.withColumn("weight", F.col("raised") / F.lit(total))
    budget = mix.budget
    if budget is None and mix.repeats is None:
        room = F.min(F.when(F.col("weight") > 0, F.col("n_tokens") / F.col("weight")))
        budget = int(weighted.agg(room).first()[0] or 0)
    elif budget is None:
        budget = tokens
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / mix.block_tokens)))
    return weighted.select(
        "source", "n_docs", "n_tokens", "share", "weight",
        F.round(F.col("weight") * F.lit(float(budget))).cast("long").alias("budget"), blocks.cast("long").alias("n_blocks"),
    )


def block_of(n_blocks: str, seed: int, name: Column | str = "doc_id") -> Column:
    digits = F.conv(F.substring(hashed(F.lit(f"{seed}-block"), name), 1, 12), 16, 10).cast("long")
    return (digits % F.col(n_blocks)).alias("block")


def mixed(docs: DataFrame, mix: Mix, carried: Sequence[str] = ()) -> DataFrame:
    """One row for each time a document is taken: doc_id, source, n_tokens, epoch, slot, rank.

    A source is passed over as often as its budget asks: whole epochs take all its documents, the last takes blocks
    in that epoch's permuted order, and of the block where the budget ends the documents up to the one that
    reaches it. ``slot`` is the block's place in its epoch, ``rank`` the document's in its block (repeated rows have
    places of their own). Reading by epoch, slot and rank is the mixture's order. Documents without tokens are
    taken in whole epochs and with their block. ``carried`` columns stay; they deal rows without id to blocks and
    order them, which are one block else.
    """
    rows = cut_lineage(counted(docs, carried))
    plan = cut_lineage(weights(rows, mix))
    # Sources are few beside documents, but not bounded: no broadcast is forced.
    dealt = rows.join(plan.select("source", "n_blocks"), "source")
    name = F.coalesce(*[F.col(c).cast("string") for c in ("doc_id", *carried)], F.lit("null"))
    dealt = dealt.withColumn("block", block_of("n_blocks", mix.seed, name))
    dealt = cut_lineage(dealt.select("doc_id", *carried, "source", "n_tokens", "block"))
    per_block = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    wanted = plan.where("budget > 0 and n_tokens > 0").select(
        "source", "n_tokens", "budget", F.expr("CAST(budget div n_tokens AS INT)").alias("whole")
    )
    epochs = F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("epoch")
    blocks = per_block.join(wanted.withColumnRenamed("n_tokens", "source_tokens"), "source").select("*", epochs)
    blocks = blocks.withColumn("order", hashed(F.lit(f"{mix.seed}-order"), "source", "epoch", "block"))
    by_epoch = Window.partitionBy("source", "epoch").orderBy("order", "block")
    before = F.coalesce(F.sum("block_tokens").over(by_epoch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("slot", F.row_number().over(by_epoch) - 1).withColumn("before", before)
    left = F.col("budget") - F.col("epoch") * F.col("source_tokens") - F.col("before")
    blocks = blocks.withColumn("left", F.when(F.col("epoch") < F.col("whole"), F.col("block_tokens")).otherwise(left))
    taken = blocks.where("left > 0 or epoch < whole").select("source", "block", "epoch", "slot", "left", "block_tokens")
    joined = dealt.join(cut_lineage(taken), ["source", "block"])
    joined = joined.withColumn("order", hashed(F.lit(f"{mix.seed}-rank"), "doc_id", "epoch"))
    in_block = Window.partitionBy("source", "block", "epoch").orderBy("order", "doc_id", "n_tokens", *carried)
    before = F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    ranked = joined.withColumn("rank", F.row_number().over(in_block) - 1).withColumn("before", before)
    kept = ranked.where("left >= block_tokens or before < left")
    return kept.select("doc_id", *carried, "source", "n_tokens", "epoch", "slot", "rank")


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents of the mixture with their columns, a row for each time one is taken.

    Rows are found by all their columns, so that of rows with one id, or without one, just those taken come; equal rows
    come as often as rows of them were taken.
    """
    rows, key = keyed(docs)
    taken = cut_lineage(mixed(rows.select("doc_id", "text", "source", *key), mix, key).select(*key))
    keys = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(keys.where("n > 1").select(*key))
    # As many rows as documents: always by shuffle, also while they are few enough to be broadcast.
    if repeated.isEmpty():
        return met(rows, taken, key).select(*columns_of(docs))
    single = met(rows, taken.join(repeated, key, "left_anti"), key)
    again = met(once(rows, key, repeated), taken.join(repeated, key, "left_semi"), key)
    return single.select(*columns_of(docs)).union(again.select(*columns_of(docs)))


#: A mixture of the corpus's size in which no source is passed over more than one and a quarter times.
MIX = Mix(repeats=1.25)


def mixture(docs: DataFrame, mix: Mix) -> DataFrame:
    """``mixed`` with rows without id dealt to blocks, and ordered in them, by their texts: there may be many of them."""
    tie = free_name(docs, "tie")
    told = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return mixed(docs.withColumn(tie, told), mix, [tie]).drop(tie)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), MIX)


ORACLE = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce(source, '') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
        CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS tie
    FROM documents
), sources AS (
    SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM docs GROUP BY source
), total AS (
    SELECT CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sources
), shares AS (
    SELECT source, n_tokens, n_tokens / CAST(tokens AS DOUBLE) AS share FROM sources, total WHERE n_tokens > 0
), bisect AS (
    SELECT 0 AS k, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
    UNION ALL
    SELECT k + 1, CASE WHEN r <= 1.25 THEN low ELSE mid END, CASE WHEN r <= 1.25 THEN mid ELSE high END
    FROM (
        SELECT k, low, high, (low + high) / 2 AS mid,
            max(pow(share, (low + high) / 2) / share) / sum(pow(share, (low + high) / 2)) AS r
        FROM bisect, shares WHERE k < 30 GROUP BY k, low, high
    )
), power AS (
    SELECT CASE WHEN (SELECT max(1 / share) / count(*) FROM shares) <= 1.25 THEN 0 ELSE high END AS x
    FROM bisect WHERE k = 30
), plan AS (
    SELECT source, n_tokens,
        CAST(round(pow(share, x) / (SELECT sum(pow(share, x)) FROM shares, power) * tokens) AS BIGINT) AS budget,
        CAST(least(4096, greatest(1, ceil(n_tokens / 20000))) AS BIGINT) AS n_blocks
    FROM shares, power, total
), dealt AS (
    SELECT doc_id, tie, source, docs.n_tokens, plan.n_tokens AS source_tokens, budget, CAST(budget // plan.n_tokens AS INT) AS whole,
        CAST('0x' || substr(md5('17-block|' || coalesce(CAST(doc_id AS VARCHAR), tie)), 1, 12) AS BIGINT) % n_blocks AS block
    FROM docs JOIN plan USING (source) WHERE budget > 0
), blocks AS (
    SELECT source, block, epoch, max(whole) AS whole, max(budget) AS budget, max(source_tokens) AS source_tokens,
        sum(n_tokens) AS block_tokens, md5('17-order|' || source || '|' || epoch || '|' || block) AS ord
    FROM dealt, range(0, whole + 1) e(epoch) GROUP BY source, block, epoch
), placed AS (
    SELECT *, row_number() OVER w - 1 AS slot, coalesce(sum(block_tokens) OVER (
        PARTITION BY source, epoch ORDER BY ord, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM blocks WINDOW w AS (PARTITION BY source, epoch ORDER BY ord, block)
), taken AS (
    SELECT source, block, epoch, slot, block_tokens,
        CASE WHEN epoch < whole THEN block_tokens ELSE budget - epoch * source_tokens - before END AS room
    FROM placed WHERE epoch < whole OR budget - epoch * source_tokens - before > 0
), ranked AS (
    SELECT doc_id, source, n_tokens, epoch, slot, room, block_tokens, row_number() OVER w - 1 AS rank,
        sum(n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before
    FROM (
        SELECT dealt.doc_id, tie, source, dealt.n_tokens, epoch, slot, room, block_tokens,
            md5('17-rank|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || epoch) AS ord, block
        FROM dealt JOIN taken USING (source, block)
    ) WINDOW w AS (PARTITION BY source, block, epoch ORDER BY ord, doc_id NULLS FIRST, n_tokens, tie NULLS FIRST)
)
SELECT doc_id, source, n_tokens, CAST(epoch AS INT) AS epoch, CAST(slot AS INT) AS slot, CAST(rank AS INT) AS rank
FROM ranked WHERE room >= block_tokens OR before < room
"""
