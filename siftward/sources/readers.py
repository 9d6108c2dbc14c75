"""Reading metadata, download logs, labels, exports and name lists."""

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType, StringType, StructType

from siftward import config
from siftward.functions.cleaning import as_flag, one_line, parsed_list
from siftward.functions.common import as_column
from siftward.operators.popularity import downloads_since
from siftward.sources import commits, schemas

#: Names the folder of the stages published last.
LATEST = "latest"


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.DISTRIBUTION_METADATA)


def read_downloads(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """The download log, from a moment on if one is given."""
    log = read_table(spark, path, schemas.FILE_DOWNLOADS)
    return downloads_since(log, since) if since else log


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of the table's last commit; of a table without commits, all its files."""
    return read_label_parts(spark, path, commits.state(spark, path)[1])


def read_label_parts(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schemas.LABELS)
    return spark.read.schema(schemas.LABELS).parquet(*(f"{path}/{part}" for part in parts))


def read_latest_stages(spark: SparkSession, folder: str) -> PipelineModel:
    """The fitted stages that ``save_stages`` published last."""
    return PipelineModel.load(f"{folder}/{commits.pointed(spark, f'{folder}/{LATEST}')}")


def repaired(rows: DataFrame) -> DataFrame:
    """Types for exported feature rows that came in as text.

    Text loses its line breaks, lists are parsed, flags become numbers.
    """

    def repair(name: str) -> Column:
        value = F.col(name)
        if name in config.LIST_COLUMNS:
            return parsed_list(value)
        if name in config.FLAG_COLUMNS:
            return as_flag(value)
        if name in schemas.COUNT_FEATURES:
            return value.try_cast("double").cast("long")
        if name in schemas.NUMBER_FEATURES:
            return value.try_cast("double")
        if name in schemas.BOOLEAN_FEATURES:
            return value.try_cast("boolean")
        if name in schemas.MOMENT_FEATURES:
            return F.regexp_replace(value, " UTC$", "Z").try_cast("timestamp")
        return one_line(value)

    return rows.select(*(repair(name).alias(name) for name in rows.columns))


def read_features(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """An exported feature file, as JSON lines or as one JSON document.

    Keys that the export lacks become empty columns; a broken line is an error. One
    JSON document is read by one task, so large exports should be lines.
    """
    raw = spark.read.schema(schemas.RAW_FEATURES).json(path, multiLine=not lines, mode="FAILFAST")
    return repaired(raw)


def read_finished_features(spark: SparkSession, path: str) -> DataFrame:
    """Finished feature rows, ready for a model; a broken line is an error."""
    return spark.read.schema(schemas.FINISHED_FEATURES).json(path, mode="FAILFAST")


# --- lists of spam names ---------------------------------------------------


def archive_package(file_name: Column | str) -> Column:
    """Package of a source archive's file name, null for any other file."""
    return F.nullif(F.regexp_extract(as_column(file_name), config.ARCHIVE_NAME, 1), F.lit(""))


def names_in_listing(entries: DataFrame, path: str, registry: str) -> DataFrame:
    """Packages among the entry paths of a registry archive.

    Only files below the registry's root folder count, and none that is named
    after the registry itself.
    """
    parts = F.split(F.col(path), "/")
    file_name = F.element_at(parts, -1)
    files = entries.filter(
        ~F.col(path).endswith("/")
        & F.element_at(parts, 1).contains(registry)
        & ~file_name.startswith(registry)
    )
    return files.select(archive_package(file_name).alias("package_name")).filter(
        "package_name is not null"
    )


def names_in_manifests(manifests: DataFrame, document: str) -> DataFrame:
    """Keys of JSON objects, one object per row; a broken object is an error."""
    parsed = F.from_json(F.col(document), MapType(StringType(), StringType()), {"mode": "FAILFAST"})
    return manifests.select(F.explode(F.map_keys(parsed)).alias("package_name"))


def read_listing(spark: SparkSession, path: str, registry: str) -> DataFrame:
    """Names from a text file with one archive entry per line."""
    return names_in_listing(spark.read.text(path), "value", registry)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Names from JSON files whose keys are package names; each file is one row."""
    return names_in_manifests(spark.read.text(path, wholetext=True), "value")
