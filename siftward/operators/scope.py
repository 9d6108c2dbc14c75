"""Restricting large tables to a list of names."""

from pyspark.sql import DataFrame, functions as F

# A list within these bounds is safe to hold on every executor.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def distinct_names(names: DataFrame, column: str = "package_name") -> DataFrame:
    return names.select(F.col(column).alias("name")).filter("name is not null").distinct()


def fits_broadcast(
    names: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Whether a one-column list is within the bounds, by a count and a sum."""
    (column,) = names.columns
    seen = names.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("size")
    ).first()
    return seen["n"] <= rows and seen["size"] <= size


def keep_named(table: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows whose name is on the list.

    As a predicate, which goes below the joins that the table is made of. Use without a broadcast on rows that
    are already aggregated: one name cannot be hot there.
    """
    listed = names.select(F.col(names.columns[0]).alias("_listed"))
    return table.alias("_table").where(listed.where(F.col("_listed") == F.col(f"_table.{column}").outer()).exists())


class Scope:
    """A list of names, applied where its length allows.

    A short list is broadcast and drops unlisted raw rows before any shuffle.
    With a long one that would need a shuffle of raw rows, and every row of a
    hot name would meet in one task; then the packages are aggregated first,
    which combines on the map side, and restricted when there is one row each.
    """

    def __init__(self, names: DataFrame):
        self.names = names
        self.is_short = fits_broadcast(names)

    def early(self, table: DataFrame, column: str = "name") -> DataFrame:
        if not self.is_short:
            return table
        return keep_named(table, column, F.broadcast(self.names))

    def late(self, table: DataFrame, column: str = "name") -> DataFrame:
        if self.is_short:
            return table
        return keep_named(table, column, self.names)
