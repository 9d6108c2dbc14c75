"""A stratified split that depends on the rows alone."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

# Hex digits of the hash that make a slice; 16 ** 4 slices per label.
SLICE_DIGITS = 4


def stratified_split(
    frame: DataFrame,
    key: str,
    label: str = "is_spam",
    test_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``is_test``: of each label, the rows with the lowest hashes.

    Exactly ``round(test_share * rows)`` rows of each label are for testing.
    Ranking a label as a whole would put half the data into one task, so rows
    are first counted in slices of the hash: slices below the cut are in, those
    above are out, and only rows in the slice of the cut are ranked.
    """
    hashed = frame.withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ).withColumns(
        {
            "_slice": F.substring("_hash", 1, SLICE_DIGITS),
            # Rows without a label are one more label.
            "_label": F.coalesce(F.col(label).cast("string"), F.lit("")),
        }
    )
    slices = hashed.groupBy("_label", "_slice").agg(F.count("*").alias("_n"))
    of_label = Window.partitionBy("_label")
    upto = of_label.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slices.select(
        "_label",
        "_slice",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        "_n",
        F.round(F.sum("_n").over(of_label) * test_share).alias("_wanted"),
    )
    # How many rows of the slice are for testing: all, none, or some.
    taken = placed.select(
        "_label",
        "_slice",
        "_n",
        F.greatest(F.lit(0), F.least("_n", F.col("_wanted") - F.col("_before")))
        .cast("long")
        .alias("_taken"),
    )
    marked = hashed.join(taken, ["_label", "_slice"])
    ranked = F.row_number().over(
        Window.partitionBy("_label", "_slice").orderBy("_hash", key)
    )
    cut = (F.col("_taken") > 0) & (F.col("_taken") < F.col("_n"))
    whole = marked.filter(~cut).withColumn("is_test", F.col("_taken") > 0)
    partly = marked.filter(cut).withColumn("is_test", ranked <= F.col("_taken"))
    columns = [*frame.columns, "is_test"]
    return whole.select(*columns).unionByName(partly.select(*columns))


def in_folds(rows: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0 to ``folds`` - 1) by a hash of the key, the same for a row whatever else is there."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    fold = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")
    return rows.withColumn("fold", F.coalesce(fold, F.lit(0)))
