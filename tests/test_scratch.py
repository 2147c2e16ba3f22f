"""Written tables and joins with them."""

import pytest
from pyspark.sql import functions as F

from fuzzloom import scratch


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_small_in_both_forms(spark, monkeypatch, how):
    """A hot key, nulls and keys without partner: salted and broadcast joins give the same rows."""
    big = spark.createDataFrame([(1 if i % 3 else i % 7, i) for i in range(600)] + [(None, -1), (99, -2)], "k long, v long")
    small = scratch.materialize(spark.createDataFrame([(k, f"w{k}") for k in range(7)] + [(None, "none")], "k long, w string"), "small")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = rows(scratch.join_small(big, small, ["k"], how))
    salted = scratch.join_small(big, small, ["k"], how, limit=0)
    assert rows(salted) == want == rows(big.join(small, "k", how))
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 3)
    few = scratch.join_small(big, small, ["k"], how)
    assert rows(few) == want and "_salt" in few._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_not_broadcast(spark):
    """Names that Parquet packs into little, though a broadcast would hold 160 MB of them."""
    name = F.concat(F.expr("repeat('x', 200000)"), F.col("id").cast("string")).alias("k")
    small = scratch.materialize(spark.range(400).select(name, (F.col("id") * 2).alias("w")), "long")
    big = spark.range(30).select(name, "id")
    assert scratch.table_bytes(small) < scratch.BROADCAST_BYTES
    assert "_salt" in scratch.join_small(big, small, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    few = scratch.materialize(small.filter("w < 40"), "few")
    got = scratch.join_small(big, few, ["k"])
    assert "_salt" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.select("id", "w").collect()) == [(i, 2 * i) for i in range(20)]


def test_spread_runs_nothing(spark):
    """Asking for more partitions mustn't run the shuffles before."""
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    grouped = spark.range(100).mapInArrow(count, "id long").groupBy((F.col("id") % 5).alias("k")).count()
    assert scratch.spread(grouped) is grouped and ran.value == 0
    one = spark.range(100).coalesce(1).filter("id > 3")
    assert scratch.spread(one).count() == 96
