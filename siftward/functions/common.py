"""Small helpers the feature expressions share."""

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: Column | str) -> Column:
    """Missing text counts as empty text."""
    return F.coalesce(as_column(value), F.lit(""))


def text_list(value: Column | str) -> Column:
    """A missing list counts as an empty list."""
    return F.coalesce(as_column(value), F.array().cast("array<string>"))


def flag(condition: Column) -> Column:
    """True becomes 1; false and unknown become 0."""
    return F.when(condition, 1).otherwise(0).cast("long")


def contains_any(value: Column, words: Iterable[str]) -> Column:
    return reduce(or_, (value.contains(word) for word in words))


def constants(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(value) for value in values))


def instant(moment, dtype: DataType) -> Column:
    """A literal moment in the type of the column it is compared with.

    Comparing like with like keeps the predicate pushable into the scan.
    """
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(dtype)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
