"""Running aggregates over rows in key and time order, without one task for a whole key.

A window over a key runs in one task, however many rows the key has. Here the rows are first cut into ranges of the full order
(key, then order columns), so a key with a third of all rows is spread over many ranges. Each range is scanned on its own; what
a key brings along from earlier ranges is added from a table with at most two rows for each range.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.scratch import materialize

_MERGE = {"max": F.greatest, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
_AGG = {"max": F.max, "sum": F.sum}


def running(rows: DataFrame, keys: list[str], order: list[str], outs: dict[str, tuple[str, str]], ranges: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``outs`` (name -> (``max`` or ``sum``, column)): the aggregate over all rows of the same
    keys up to and including the row, in the order of ``order``.

    ``order`` must put rows that have to see each other in sequence; rows equal in ``order`` come in any sequence. Nulls in
    ``keys`` form a key of their own; null values count for nothing. An empty table gives an empty table.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[_AGG[kind](col).over(here).alias(name) for name, (kind, col) in outs.items()])
    parts = cut.groupBy(*keys, "_range").agg(*[_AGG[kind](col).alias(f"_c_{name}") for name, (kind, col) in outs.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[_AGG[kind](f"_c_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in outs.items()])
    # Only keys that go on from an earlier range have anything to bring: at most one row for each range.
    carry = carry.filter(reduce(or_, [F.col(f"_c_{name}").isNotNull() for name in outs]))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carry), same, "left")
    return joined.select(*rows.columns, *[_MERGE[kind](F.col(name), F.col(f"_c_{name}")).alias(name) for name, (kind, _) in outs.items()])
