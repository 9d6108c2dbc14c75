"""Uploads are joined and read once, and a table that is split already is not shuffled."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftward.operators import skew
from siftward.plans import state
from siftward.plans.features import feature_rows, feature_table, package_metadata
from siftward.sources.schemas import DISTRIBUTION_METADATA, FILE_DOWNLOADS

AS_OF = datetime(2024, 3, 1, 12)


@pytest.fixture(scope="module")
def dist(spark, tmp_path_factory):
    fields = DISTRIBUTION_METADATA.fieldNames()
    rows = []
    for k in range(40):
        row = dict.fromkeys(fields) | {"name": f"p{k % 7}", "version": str(k % 3), "upload_time": datetime(2024, 1, 1 + k % 20)}
        row |= {"description": f"text {k}", "requires_dist": ["a", f"p{k % 4}"], "classifiers": ["x"], "keywords": f"w{k % 2}"}
        rows.append(tuple(row[f] for f in fields))
    path = str(tmp_path_factory.mktemp("uploads"))
    spark.createDataFrame(rows, DISTRIBUTION_METADATA).withColumn("marker_column", F.lit(1)).write.parquet(f"{path}/dist")
    return spark.read.parquet(f"{path}/dist")


def times_read(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line and "marker_column" in line for line in plan.split("\n"))


def test_uploads_are_read_once_beside_the_newest_ones(spark, dist):
    log = spark.createDataFrame([], FILE_DOWNLOADS)
    names = spark.createDataFrame([("p1",), ("p2",)], "name string")
    labels = spark.createDataFrame([("p1", 1), ("p3", 0)], "package_name string, is_spam int")
    one = feature_rows(dist, log, names, AS_OF)
    assert times_read(one) == 1 and one.count() == 2
    assert times_read(feature_rows(dist, log, None, AS_OF)) == 1
    assert times_read(feature_table(dist, log, labels, AS_OF, dependents_scope="all")) == 2
    assert times_read(package_metadata(dist, labels.select("package_name"))) == 1
    parts = state.state_of(dist)
    assert {p: times_read(f) for p, f in parts.items()} == {"newest": 1, "values": 0, "files": 0, "days": 0, "required": 0}


def test_a_file_of_many_row_groups_is_not_shuffled(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    cores = spark.sparkContext.defaultParallelism
    values = pa.table({"id": list(range(400_000)), "text": [f"{k * 7919 % 1_000_003:064b}" for k in range(400_000)]})
    for name, size in (("many", 20_000), ("one", 400_000)):
        pq.write_table(values, str(tmp_path / f"{name}.parquet"), row_group_size=size, compression="none", use_dictionary=False)
    for name, whole in (("many", True), ("one", False)):
        rows = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        kept = skew.use_all_cores(rows)
        assert ("Repartition" not in kept._jdf.queryExecution().optimizedPlan().toString()) == whole
        assert kept.rdd.getNumPartitions() >= cores and kept.agg(F.sum("id")).first()[0] == 400_000 * 399_999 // 2
