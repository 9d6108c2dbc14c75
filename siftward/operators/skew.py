"""Joins and running totals that no single key or range can overload."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siftward.session import cut_lineage

HOT_KEYS = 1000
#: Stored bytes of one part of a table that is spread.
PART_BYTES = 16 << 20
#: Stored bytes of the largest row group a task reads at once.
GROUP_BYTES = 128 << 20
#: Rows of one range of a scan in order.
RANGE_ROWS = 1_000_000


def use_all_cores(rows: DataFrame) -> DataFrame:
    """Spread a table that is stored in fewer splits than there are cores.

    Looks at the list of files, their sizes and, of few Parquet files, their footers. Splits of a file are read by tasks of their
    own where it has a row group for each, so a table with as many of them as cores passes through unchanged, as does one of
    more files than cores: a shuffle of the largest table, once for each reader, would be most of a job's disk. Otherwise
    there are as many parts as cores, and more where a part would be of more than ``PART_BYTES`` of the files, so that a task
    stays bounded however large they are.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if len(files) >= cores or (
        rows.rdd.getNumPartitions() >= cores and sum(len(row_groups(spark, f)) for f in files) >= cores
    ):
        return rows
    return rows.repartition(max(cores, -(-stored_bytes(spark, files) // PART_BYTES)))


def row_groups(spark: SparkSession, file: str) -> list[int]:
    """Compressed bytes of the row groups of a Parquet file that tasks read apart; none of other files.

    Row groups of more than a split's bytes are none either: a table of these is better spread.
    """
    if not file.endswith(".parquet"):
        return []
    hadoop, parquet = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.parquet.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source = parquet.util.HadoopInputFile.fromPath(hadoop.Path(spark._jvm.java.net.URI(file)), conf)
    reader = parquet.ParquetFileReader.open(source)
    try:
        sizes = [group.getCompressedSize() for group in reader.getRowGroups()]
    finally:
        reader.close()
    return sizes if max(sizes, default=0) <= GROUP_BYTES else []


def stored_bytes(spark: SparkSession, files: Sequence[str]) -> int:
    """Size of files named by URIs, in any store that Spark reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    spread: str,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join many rows to a lookup with one row per key, hot keys apart.

    The lookup is read three times, so it should be a stored table.
    ``weight`` says how many rows carry each key. A key with at least one part
    in ``hot_keys`` of all rows is hot, so there are never more hot keys than
    that, and their lookup rows are broadcast. All other keys go through a
    shuffle in which each holds less than that share; rows that already have
    their answer are spread over it by ``spread`` and match nothing.
    """
    values = [c for c in lookup.columns if c not in (key, weight)]
    total = lookup.select(F.sum(weight)).scalar()
    hot = lookup.filter(F.col(weight) * hot_keys >= total).select(
        key, F.struct(*values).alias("_hot")
    )
    cold = lookup.select(
        F.col(key).alias("_key"), F.lit(False).alias("_answered"), F.struct(*values).alias("_cold")
    )
    marked = rows.join(F.broadcast(hot), key, "left")
    answered = F.col("_hot").isNotNull()
    marked = marked.withColumn("_answered", answered).withColumn(
        "_key", F.when(answered, F.col(spread).cast("string")).otherwise(F.col(key))
    )
    joined = marked.join(cold, ["_key", "_answered"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *(found[v].alias(v) for v in values))


def in_ranges(rows: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with ``_range``: their number of a range of ``order``, counted in that order.

    One exchange by range into about ``range_rows`` rows each, stored, since a range's edges come from samples.
    Rows with equal order values share a range, so an order with long ties needs a further column.
    """
    ranges = rows.count() // range_rows + 1
    return cut_lineage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))


def scanned(ranged: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Inclusive running sums in ``order`` of the columns ``totals`` names, for rows of ``in_ranges``.

    Each range gets one more row in front, which carries the sums of all ranges before it, and then sums by itself.
    Work is linear in the rows; nothing is joined or broadcast, and only the windows' one row a range meets in one task.
    """
    sums = ranged.groupBy("_range").agg(*(F.sum(c).alias(c) for c in totals))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    seeds = sums.select("_range", F.lit(True).alias("_seed"), *(F.sum(c).over(before).alias(c) for c in totals))
    both = ranged.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    within = Window.partitionBy("_range").orderBy(F.desc("_seed"), *order)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = both.select("*", *(F.sum(c).over(within).alias(name) for c, name in totals.items()))
    return added.where("not _seed").drop("_seed", "_range")


def running_totals(
    points: DataFrame, order: str, totals: dict[str, str], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Running sums over all rows, from the highest ``order`` down; ``points`` has one row per value of it."""
    falling = [F.desc(order)]
    return scanned(in_ranges(points, falling, range_rows), falling, totals)


def numbered(rows: DataFrame, order: list[Column], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with their place in ``order``, from 1. Rows with equal order values are numbered in any order."""
    ranged = in_ranges(rows.withColumn("_one", F.lit(1).cast("long")), order, range_rows)
    return scanned(ranged, order, {"_one": name}).drop("_one")
