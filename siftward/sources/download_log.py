"""The download log by date, and daily counts from which windows are added up.

Both tables are partitioned by date. Days are replaced as a whole, so a day that is delivered again does no harm, and
only the days that are new or asked for are read.
"""

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from siftward.functions.common import instant
from siftward.sources import schemas
from siftward.sources.readers import read_table

DATED_LOG = StructType([*schemas.FILE_DOWNLOADS.fields, StructField("date", DateType())])
DAILY = StructType([
    StructField("pkg_name", StringType()), StructField("n", LongType()), StructField("date", DateType()),
])


def _replace_days(rows: DataFrame, path: str) -> None:
    # A day may hold a third of all rows: it is split, and small days are put together.
    even = rows.hint("rebalance", "date")
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def store_log(downloads: DataFrame, path: str) -> None:
    """Write a log by the date of its moments; days it has replace those stored. Rows without a moment belong to no day."""
    dated = downloads.select("timestamp", "file", F.to_date("timestamp").alias("date"))
    _replace_days(dated.where("date is not null"), path)


def read_log(spark: SparkSession, path: str, days: Iterable[date] | None = None) -> DataFrame:
    """The stored log, or some days of it."""
    log = read_table(spark, path, DATED_LOG)
    return log if days is None else log.where(F.col("date").isin(*days))


def store_daily(spark: SparkSession, log_path: str, path: str, days: Iterable[date] | None = None) -> None:
    """Count downloads of each package and day; with ``days`` only those are read and replaced."""
    log = read_log(spark, log_path, days)
    counted = log.groupBy("date", F.col("file.project").alias("pkg_name")).agg(F.count(F.lit(1)).alias("n"))
    _replace_days(counted.select("pkg_name", "n", "date"), path)


def window_counts(spark: SparkSession, log_path: str, daily_path: str, as_of: datetime) -> DataFrame:
    """Downloads of the last 30 calendar days and of the last 7 times 24 hours, as ``download_counts`` gives them.

    Days are added up; of the log only the day in which the 7 times 24 hours begin is read.
    """
    edge = as_of - timedelta(days=7)
    daily = read_table(spark, daily_path, DAILY)
    month = daily.where(F.col("date") >= F.lit(as_of.date() - timedelta(days=30)))
    whole = F.when(F.col("date") > F.lit(edge.date()), F.col("n")).otherwise(0)
    dtype = schemas.FILE_DOWNLOADS["timestamp"].dataType
    begun = read_log(spark, log_path, [edge.date()]).where(F.col("timestamp") >= instant(edge, dtype))
    started = begun.groupBy(F.col("file.project").alias("pkg_name")).agg(F.count(F.lit(1)).alias("n_7d"))
    added = month.select("pkg_name", whole.alias("n_7d"), F.col("n").alias("n_30d")).unionByName(
        started.withColumn("n_30d", F.lit(0).cast("long"))
    )
    return added.groupBy("pkg_name").agg(
        F.sum("n_7d").cast("long").alias("n_downloads_7d"), F.sum("n_30d").cast("long").alias("n_downloads_30d")
    )
