"""Work tables: shuffle files go once a table is written, and a discarded table is gone while others stay."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomline.llm import common


def test_discarded_tables_are_gone(spark):
    kept, spent = (common.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), name) for name in ("kept", "spent"))
    files = spent.inputFiles()
    common.discard(spent)
    assert kept.count() == 7
    with pytest.raises(PySparkException):
        spark.read.parquet(*files).count()


def test_an_empty_table_can_be_written_and_discarded(spark):
    empty = common.materialize(spark.range(0), "empty")
    assert empty.count() == 0
    common.discard(empty)


def test_materialize_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(common.CLEANUP_SETTING, None)
    common.materialize(spark.range(3).repartition(2), "settings")
    assert spark.conf.get(common.CLEANUP_SETTING, None) == before
    try:
        spark.conf.set(common.CLEANUP_SETTING, "false")
        common.materialize(spark.range(3).repartition(2), "settings")
        assert spark.conf.get(common.CLEANUP_SETTING) == "false"
    finally:
        spark.conf.unset(common.CLEANUP_SETTING)


def test_a_written_result_can_be_used_twice(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    first = common.materialize(counted, "once")
    second = common.materialize(counted, "again")  # its shuffle files went with the first write
    assert sorted(first.collect()) == sorted(second.collect()) == [(k, 100) for k in range(10)]
