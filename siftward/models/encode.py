"""Numbers from features: categories to sparse 0/1 entries, columns to one scale.

Categories are numbered in their order by a scan over ranges and kept as a table, which rows meet by a join; there may
be any number of them, and none comes to the driver or into a plan. Each column's entries are one sparse vector.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, OneHotEncoderModel, SQLTransformer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from siftward.operators.skew import lookup_join, numbered
from siftward.session import cut_lineage

NOT_FEATURES = ("pkg_name", "is_spam")


def split_columns(
    frame: DataFrame, excluded: Sequence[str] = NOT_FEATURES
) -> tuple[list[str], list[str]]:
    """Text columns and number columns, without identifiers and labels."""
    fields = [f for f in frame.schema.fields if f.name not in excluded]
    texts = [f.name for f in fields if isinstance(f.dataType, StringType)]
    numbers = [f.name for f in fields if isinstance(f.dataType, NumericType | BooleanType)]
    return texts, numbers


def category_table(frame: DataFrame, texts: Sequence[str]) -> DataFrame:
    """``c`` (number of the column), ``value``, its ``number`` in order from 0, and ``n`` rows; stored."""
    pairs = frame.select(
        F.inline(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(texts))))
    )
    counted = pairs.filter("value is not null").groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(numbered(counted, [F.asc("c"), F.asc("value")], "place"))
    # One row for each column.
    first = placed.groupBy("c").agg(F.min("place").alias("first"))
    return cut_lineage(
        placed.join(F.broadcast(first), "c").select("c", "value", (F.col("place") - F.col("first")).alias("number"), "n")
    )


class CategoryIndexer(Transformer, MLReadable, MLWritable):
    """Adds each text column's number of a category as ``outputs``: from 0 for the second, beyond all for the first.

    What comes beyond all is encoded as zeros; so are a null and a category that was not seen. Popular
    categories are met by a broadcast of at most a thousand rows, the others by a shuffle.
    """

    def __init__(
        self, columns: Sequence[str] = (), outputs: Sequence[str] = (), sizes: Sequence[int] = (), table: DataFrame | None = None
    ):
        super().__init__()
        self.columns, self.outputs, self.sizes, self.table = list(columns), list(outputs), list(sizes), table

    @classmethod
    def fit(cls, frame: DataFrame, texts: Sequence[str], prefix: str) -> "CategoryIndexer":
        if not texts:
            return cls()
        table = category_table(frame, texts)
        found = {r["c"]: r["size"] for r in table.groupBy("c").agg(F.count(F.lit(1)).alias("size")).collect()}
        sizes = [found.get(i, 0) for i in range(len(texts))]
        return cls(texts, [f"_{prefix}_{c}_number" for c in texts], sizes, table)

    def encoded(self) -> list[int]:
        """Columns with an entry: the first category has none."""
        return [i for i, size in enumerate(self.sizes) if size > 1]

    def _transform(self, rows: DataFrame) -> DataFrame:
        kept = rows.columns
        for i in self.encoded():
            lookup = self.table.where(F.col("c") == i).select(F.col("value").alias("_value"), "n", "number")
            keyed = rows.withColumns({"_value": F.col(f"`{self.columns[i]}`"), "_spread": F.monotonically_increasing_id()})
            joined = lookup_join(keyed, lookup, "_value", "n", "_spread")
            beyond = F.lit(self.sizes[i] - 1)
            place = F.when(F.col("number") > 0, F.col("number") - 1).otherwise(beyond)
            kept = [*kept, self.outputs[i]]
            rows = joined.withColumn(self.outputs[i], place.cast("double")).select(*(F.col(f"`{c}`") for c in kept))
        return rows

    def write(self) -> MLWriter:
        return _IndexerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _IndexerReader()


class _IndexerWriter(MLWriter):
    def __init__(self, stage: CategoryIndexer):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        stage = self.stage
        learnt = {"columns": stage.columns, "outputs": stage.outputs, "sizes": stage.sizes}
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata={"learnt": learnt})
        if stage.table is not None:
            stage.table.write.parquet(f"{path}/categories")


class _IndexerReader(MLReader):
    def load(self, path: str) -> CategoryIndexer:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        learnt = metadata["learnt"]
        table = self.sparkSession.read.parquet(f"{path}/categories") if learnt["columns"] else None
        stage = CategoryIndexer(learnt["columns"], learnt["outputs"], learnt["sizes"], table)
        stage._resetUid(metadata["uid"])
        return stage


def one_hot(spark: SparkSession, indexer: CategoryIndexer) -> list[OneHotEncoderModel]:
    """A fitted encoder for each column. Only the number of entries is learnt, so one row with the last one will do."""
    stages = []
    for i in indexer.encoded():
        name = indexer.outputs[i]
        encoder = OneHotEncoder(inputCols=[name], outputCols=[f"{name}_entries"], handleInvalid="keep", dropLast=True)
        stages.append(encoder.fit(spark.createDataFrame([(float(indexer.sizes[i] - 2),)], f"`{name}` double")))
    return stages


def standardised(frame: DataFrame, columns: dict[str, str]) -> dict[str, str]:
    """SQL of the same columns with mean 0 and population deviation 1.

    A constant column becomes 0.
    """
    if not columns:
        return {}
    names = list(columns)
    stats = frame.agg(
        *(F.avg(F.expr(columns[n])).alias(f"m{i}") for i, n in enumerate(names)),
        *(F.stddev_pop(F.expr(columns[n])).alias(f"d{i}") for i, n in enumerate(names)),
    ).first()

    def scaled(i: int, sql: str) -> str:
        mean, deviation = stats[f"m{i}"] or 0.0, stats[f"d{i}"] or 1.0
        return f"(({sql}) - ({mean!r}D)) / {deviation!r}D"

    return {n: scaled(i, columns[n]) for i, n in enumerate(names)}


def entry_scales(indexer: CategoryIndexer, n_rows: int) -> list[float]:
    """One over the population deviation of each category's entry, in order. Numbers only, as many as a model has weights."""
    if indexer.table is None:
        return []
    share = F.col("n") / F.lit(n_rows)
    scale = F.lit(1.0) / F.sqrt(share * (1 - share))
    rows = indexer.table.where((F.col("number") > 0) & F.col("c").isin(indexer.encoded())).orderBy("c", "number")
    return rows.select(scale.alias("scale")).toArrow().column("scale").to_pylist()


def encoder(frame: DataFrame, output: str = "features", scale: bool = True) -> PipelineModel:
    """Fitted stages from feature columns to one vector: entries of categories, then numbers.

    With ``scale`` all entries have deviation 1. Numbers have mean 0 as well; entries of categories are not moved, which
    would fill every row, and neither trees nor models with a free intercept can tell.
    """
    texts, numbers = split_columns(frame)
    indexer = CategoryIndexer.fit(frame, texts, output)
    entries = one_hot(frame.sparkSession, indexer)
    # A vector has no missing entries; a number that is missing or not a number counts as 0.
    columns = {n: f"coalesce(nanvl(CAST(`{n}` AS DOUBLE), 0.0D), 0.0D)" for n in numbers}
    if scale:
        columns = standardised(frame, columns)
    inputs = [f"_{output}_{name}" for name in columns]
    added = "".join(f", {sql} AS `{target}`" for target, sql in zip(inputs, columns.values(), strict=True))
    names = SQLTransformer(statement=f"SELECT *{added} FROM __THIS__")
    vectors = [c for stage in entries for c in stage.getOutputCols()]
    plain = f"_{output}_plain" if scale else output
    stages = [indexer, *entries, names, VectorAssembler(inputCols=[*vectors, *inputs], outputCol=plain)]
    dropped = [*(c for stage in entries for c in stage.getInputCols()), *vectors, *inputs]
    if scale:
        weights = [*entry_scales(indexer, frame.count()), *(1.0 for _ in inputs)]
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=plain, outputCol=output))
        dropped.append(plain)
    tidy = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`{i}`' for i in dropped)}) FROM __THIS__")
    return PipelineModel([*stages, tidy])


def feature_places(encoding: PipelineModel, output: str = "features") -> DataFrame:
    """``place`` in the vector and name of the ``feature`` for every entry."""
    spark = SparkSession.active()
    indexer = next(s for s in encoding.stages if isinstance(s, CategoryIndexer))
    assembler = next(s for s in encoding.stages if isinstance(s, VectorAssembler))
    parts, before = [], 0
    for i in indexer.encoded():
        named = F.concat(F.lit(f"{indexer.columns[i]}_"), F.col("value"))
        place = (F.col("number") - 1 + before).cast("int")
        parts.append(
            indexer.table.where((F.col("c") == i) & (F.col("number") > 0)).select(place.alias("place"), named.alias("feature"))
        )
        before += indexer.sizes[i] - 1
    numbers = assembler.getInputCols()[len(indexer.encoded()) :]
    rows = [(before + k, n.removeprefix(f"_{output}_")) for k, n in enumerate(numbers)]
    parts.append(spark.createDataFrame(rows, "place int, feature string"))
    return reduce(DataFrame.unionByName, parts)
