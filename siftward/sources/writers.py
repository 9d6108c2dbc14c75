"""Writing features, labels, name lists, scan records and fitted stages."""

from datetime import datetime
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from siftward.operators.labels import not_listed
from siftward.session import cut_lineage
from siftward.sources import commits
from siftward.sources.readers import LATEST, read_label_parts


def write_features(rows: DataFrame, path: str) -> None:
    """JSON lines with every key in every row."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_labels(mined: DataFrame, path: str, attempts: int = 20) -> None:
    """Add mined packages to the label table, except those it has already; repeated rows are added once.

    Several writers may append at once: each commits on the state it has compared with, and if another was faster
    compares again.
    """
    spark = mined.sparkSession
    labels = cut_lineage(mined.select("package_name", F.col("is_spam").cast("long").alias("is_spam")).distinct())
    for _ in range(attempts):
        number, parts = commits.state(spark, path)
        fresh = labels
        if parts:
            fresh = not_listed(labels, "package_name", read_label_parts(spark, path, parts), "package_name")
        part = f"part-{uuid4().hex}"
        fresh.write.parquet(f"{path}/{part}")
        if commits.commit(spark, path, number + 1, [*parts, part]):
            return
    raise RuntimeError(f"{path}: other writers were faster {attempts} times")


def write_names(names: DataFrame, path: str) -> None:
    """One distinct name per line, in order over all part files."""
    names.select("package_name").distinct().orderBy("package_name").write.mode(
        "overwrite"
    ).text(path)


def iso_moment(name: str, zoned: bool) -> Column:
    """Full ISO form: microseconds if there are any, and the UTC offset of an instant."""
    value = F.col(name)
    micros = F.date_format(value, "SSSSSS")
    return F.concat(
        F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
        F.date_format(value, "xxx") if zoned else F.lit(""),
    )


def json_record(rows: DataFrame) -> Column:
    """Each row as JSON text, moments in full ISO form and missing values as null."""
    fields = [
        iso_moment(field.name, isinstance(field.dataType, TimestampType)).alias(field.name)
        if isinstance(field.dataType, TimestampType | TimestampNTZType)
        else F.col(field.name)
        for field in rows.schema.fields
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def save_stages(model: PipelineModel, folder: str, moment: datetime) -> str:
    """Save fitted stages under their time, read them back, and only then let the pointer to the latest name them.

    Whatever fails on the way, the stages published before stay the latest and readable.
    """
    spark = SparkSession.active()
    name = f"{moment:%Y%m%d_%H%M%S}-{uuid4().hex[:8]}"
    model.write().save(f"{folder}/{name}")
    read_back = PipelineModel.load(f"{folder}/{name}")
    if len(read_back.stages) != len(model.stages):
        raise RuntimeError(f"{folder}/{name}: {len(read_back.stages)} of {len(model.stages)} stages were saved")
    commits.point(spark, f"{folder}/{LATEST}", name)
    return f"{folder}/{name}"
