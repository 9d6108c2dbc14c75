"""What a package name looks like."""

from pyspark.sql import Column, functions as F

from siftward import config
from siftward.functions.common import as_column


def name_case(name: Column | str) -> Column:
    name = as_column(name)
    return (
        F.when(name == F.lower(name), "lower")
        .when(name.rlike(config.CAMEL_CASE), "camel")
        .otherwise("mixed")
    )


def name_features(name: Column | str) -> dict[str, Column]:
    name = as_column(name)
    return {
        "n_name_len": F.length(name).cast("long"),
        "has_digit_in_name": name.rlike("[0-9]"),
        "has_dash_or_underscore": name.rlike("[-_]"),
        "cat_name_case": name_case(name),
    }
