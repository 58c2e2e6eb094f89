"""Rows of one file, and of few keys, are dealt to many tasks."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.queries.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_no_task_has_most_rows(spark):
    got = QUERIES["buoy_records"](spark, SF).groupBy(F.spark_partition_id()).count().collect()
    n = [r["count"] for r in got]
    assert len(n) >= 4 and max(n) < sum(n) / 2


def test_buoy_readings_are_not_dealt_by_file(spark):
    plan = QUERIES["buoy_records"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_a_station_line_is_made_once(spark):
    """And countries' names are joined, no map of all names that each row is held against."""
    plan = QUERIES["station_history"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Svalbard" not in plan and "element_at" not in plan and "format_string" not in plan
