"""Every registered query against its oracle, and the shape of its plan."""

import pytest
from check_oracle import compare

import __spark_entry__ as contract
from siftward.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF", "InPandas")


# What the training-data part registers is tested in a folder of its own.
OWN = sorted(set(QUERIES) & set(contract.queries()))


@pytest.mark.parametrize("name", OWN)
def test_against_oracle(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNWANTED if word in plan]
    problems, _, rows = compare(spark, FOLDER, name, df)
    assert problems == [] and rows > 0


def test_contract(spark):
    assert set(ORACLES) == set(QUERIES) == set(OWN)
    assert len(contract.entry(spark).columns) == 54
