"""Time of day, weekday and age of a release."""

from datetime import datetime

from pyspark.sql import Column, functions as F

from siftward import config
from siftward.functions.common import as_column


def hour_bucket(moment: Column | str) -> Column:
    """Quarter of the day; a missing time falls into the last one."""
    hour = F.hour(as_column(moment))
    *early, (_, last) = config.TIME_BUCKETS
    bucket = F
    for last_hour, label in early:
        bucket = bucket.when(hour <= last_hour, label)
    return bucket.otherwise(last)


def weekday(moment: Column | str) -> Column:
    return F.date_format(as_column(moment), "EEEE")


def age_days(moment: Column | str, as_of: datetime) -> Column:
    return F.datediff(F.lit(as_of.date()), F.to_date(as_column(moment))).cast("long")


def time_of_day(bucket: Column | str) -> Column:
    """Bucket label to plain time of day, first match in the fixed order wins."""
    label = F.lower(as_column(bucket).cast("string"))
    result = F
    for time in config.TIMES_OF_DAY:
        result = result.when(label.contains(time), time)
    return result.otherwise("unknown")
