"""Registered queries and their oracle statements."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftward.queries.tables import Tables, oracle_prefix
from siftward.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, tables: tuple[str, ...] = ()):
    """Register a function of ``Tables``, with its oracle if SQL can state it.

    ``tables`` are the derived tables the oracle reads.
    """

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(configure(spark), folder))

        QUERIES[name] = run
        if oracle is not None:
            prefix = oracle_prefix(tables) if tables else ""
            body = oracle.strip()
            if prefix and body[:5].upper() == "WITH ":
                prefix, body = prefix.rstrip() + ",\n", body[5:]
            ORACLES[name] = prefix + body
        return build

    return register


def joined(*columns: str):
    """Lists as text, so that both engines compare them alike."""
    from pyspark.sql import functions as F

    return {c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in columns}
