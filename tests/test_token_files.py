"""Pruned reads of token files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.sources import token_bin


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """200,000 ids in shards of 70,000, whose blocks are of 65,536 and less."""
    rows = spark.range(0, 200).select(
        (F.col("id") * 1000).alias("start_pos"),
        F.lit(1000).cast("long").alias("n_tokens"),
        F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: ((F.col("id") * 1000 + i) % 60013).cast("int")).alias("ids"),
    )
    path = str(tmp_path_factory.mktemp("tokens") / "store")
    token_bin.write_tokens(rows, path, tokens_per_shard=70_000)
    return path


def _ids(rows):
    return [i for r in sorted(rows.collect(), key=lambda r: r.start_pos) for i in r.ids]


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_bounds_on_start_pos_reach_the_reader(spark, store):
    whole = token_bin.read_tokens(spark, store)
    assert whole.rdd.getNumPartitions() == 3
    starts = [r.start_pos for r in whole.select("start_pos").orderBy("start_pos").collect()]
    some = whole.where("start_pos < 10")
    assert some.rdd.getNumPartitions() == 1
    assert "LessThan(start_pos,10)" in _plan(some).replace(" ", "")
    for test in ("< 70000", "<= 70000", "> 65536", ">= 65536", "= 65536", "= 65537", "> 199999", "< 0", "<> 0", "in (0, 70000)"):
        found = [r.start_pos for r in whole.where(f"start_pos {test}").select("start_pos").orderBy("start_pos").collect()]
        expected = {r.start_pos for r in spark.createDataFrame([(s,) for s in starts], "start_pos long").where(f"start_pos {test}").collect()}
        assert found == sorted(expected), test


def test_other_filters_stay_with_spark(spark, store):
    found = token_bin.read_tokens(spark, store).where("ids[0] = 0 and start_pos >= 0 and start_pos % 2 = 0")
    assert [r.start_pos for r in found.collect()] == [0]


@pytest.mark.parametrize("start,end", [(0, 5), (65_530, 65_540), (69_990, 70_010), (10, 10), (0, 200_000), (199_999, 300_000), (250_000, 300_000)])
def test_positions(spark, store, start, end):
    expected = (np.arange(start, max(start, min(end, 200_000))) % 60013).tolist()
    assert _ids(token_bin.read_positions(spark, store, start, end)) == expected


def test_positions_open_only_their_ranges(spark, store):
    assert token_bin.read_positions(spark, store, 10, 20).rdd.getNumPartitions() == 1
    assert token_bin.read_positions(spark, store, 150_000, 150_010).rdd.getNumPartitions() == 2  # with the short block ahead
    assert token_bin.read_positions(spark, store, 69_000, 71_000).rdd.getNumPartitions() == 2


def test_positions_must_ascend(spark, store):
    with pytest.raises(ValueError):
        token_bin.read_positions(spark, store, 5, 4)
