"""What several operators share: stored tables, files in the shared folder, Arrow batches by bytes."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftward.session import cut_lineage, file_system, shared_folder

__all__ = ["ROW", "byte_slices", "columns_of", "cut_lineage", "file_system", "free_name", "keyed", "met", "new_folder", "one_row_each", "once", "raw",
           "table", "texts", "within"]

#: Columns of a row's key, where a table has none of these names.
ROW = ["row_a", "row_b"]

#: Text held as Python objects at once in a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, longer by as much as it takes to be none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(rows: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in rows.columns]


def keyed(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with two more columns, and their names: 128 bits that are equal for rows equal in all columns only."""
    values = [x for c in rows.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    names = [free_name(rows, name) for name in ROW]
    return rows.withColumns({name: F.xxhash64(F.lit(k), *values) for k, name in enumerate(names)}), names


def once(rows: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """Of the rows with these keys (few beside all) one each, with its key: equal rows are alike."""
    found = rows.join(keys.select(*key), key, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in key])
    row = free_name(rows, "row")
    return found.groupBy(*key).agg(F.first(whole).alias(row)).select(f"{row}.*", *key)


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle at every size: what a stored table takes in memory is not known from its files."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def one_row_each(docs: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (bytes) of the ids, with the other columns of ``ids`` (few rows, one for an id).

    An id on several rows stands for the one whose text has the smallest hash; of it one row comes back, however many it has.
    """
    found = docs.select("doc_id", raw(text).alias("text")).join(F.broadcast(ids), "doc_id")
    others = [c for c in ids.columns if c != "doc_id"]
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return found.groupBy("doc_id", *others).agg(least).select("doc_id", F.col("least.text").alias("text"), *others)


def within(rows: DataFrame, size: str, most: int, *order: Column) -> DataFrame:
    """Of a bounded number of rows the first in order whose sizes add up to ``most``; a larger one is passed over."""
    fitting = rows.where(F.col(size) <= most)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = free_name(rows, "so_far")
    return fitting.withColumn(so_far, F.sum(size).over(running)).where(F.col(so_far) <= most).drop(so_far)


def raw(column: str | Column) -> Column:
    """UTF-8 bytes of a text, so that tasks need not decode it; null becomes empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def byte_slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of about ``limit`` bytes; a longer text is a part alone."""
    if not len(array):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(array)]
    for start, stop in zip(edges, edges[1:]):
        yield array.slice(start, stop - start)


def texts(array: pa.Array) -> list[bytes]:
    return [x or b"" for x in array.to_pylist()]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder of its own for one call, in the storage that all machines share."""
    return f"{shared_folder(spark)}/siftward/{purpose}-{uuid4().hex}"
