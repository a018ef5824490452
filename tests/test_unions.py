"""Rows of a key meet in one task after a union, whatever adaptive execution does to its inputs."""

import __spark_entry__ as entry
import pytest
from compare import connect, same

SF = "/root/testdata/sf0.01"
#: The session's own default for unions, and partitions so small that inputs are merged to different numbers.
MERGED = {
    "spark.sql.unionOutputPartitioning": "true", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
}


@pytest.fixture
def merging(spark):
    before = {k: spark.conf.get(k, None) for k in MERGED}
    for k, v in MERGED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["block_loglik", "excitation_chunked", "state_exposure"])
def test_queries_over_unions_equal_their_twins(merging, name):
    same(entry.queries()[name](merging, SF), connect(SF), entry.oracle_sql()[name])
