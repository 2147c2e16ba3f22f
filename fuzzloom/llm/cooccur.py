"""Items that occur together in a record, and how much more often than chance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.scratch import materialize


def bare(col: Column) -> Column:
    """Lower case, without outer blanks. Blanks other than spaces are rare and take the slower way."""
    low = F.lower(col)
    return F.when(low.rlike(r"(?U)[\s&&[^ ]]"), F.regexp_replace(low, r"(?U)^\s+|\s+$", "")).otherwise(F.trim(low))


def _suffixed(suffix: str) -> Callable[[Column], Column]:
    return lambda v: F.concat(v, F.lit(suffix))


def baskets(rows: DataFrame, key: str, multi: dict[str, str], single: dict[str, str]) -> DataFrame:
    """One written row for each ``key`` with ``items``, its distinct items in order of code points.

    multi, single: column -> suffix of its items; a multi column holds values separated by ``|``. Null and blank values give
    no item; a basket may be empty. Rows with the same key are copies and count once. Other columns are not read.
    """
    once = rows.select(key, *multi, *single).dropDuplicates([key])
    parts = []
    for col, suffix in multi.items():
        values = F.filter(F.transform(F.split(F.col(col), r"\|"), bare), lambda v: v != "")
        parts.append(F.transform(values, _suffixed(suffix)))
    for col, suffix in single.items():
        value = bare(F.col(col))
        parts.append(F.when(value != "", F.array(F.concat(value, F.lit(suffix)))))
    empty = F.array().cast("array<string>")
    items = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p, empty) for p in parts])))
    return materialize(once.select(items.alias("items")), "baskets")


def cooccurrence(written: DataFrame, least_share: tuple[int, int] | None = None) -> DataFrame:
    """Pairs of items with their counts and measures of association, over written ``baskets``.

    Columns: item_a < item_b (by code points), n_both, n_a, n_b, n_all, lift (how many times as often as by chance) and pmi
    (its logarithm to base 2).
    least_share (p, q): only pairs in at least p/q of all baskets. A pair is never in more baskets than either item, so items
    below that share are dropped before pairs are made; the rest are at most q/p times the mean basket in number, which bounds
    what is sent to the tasks. Without it all pairs are counted and marginals are joined by key.

    Every basket emits its ordered pairs once; partial sums are made before the shuffle, so a pair with a third of all baskets
    moves as one row of each task. An empty table gives an empty table.
    """
    n_all = written.count()
    single = written.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    kept = written.select("items")
    if least_share:
        p, q = least_share
        single = materialize(single.filter(F.col("n").cast("decimal(38,0)") * q >= F.lit(n_all).cast("decimal(38,0)") * p), "marginals")
        often = [r.item for r in single.select("item").collect()]
        kept = kept.select(F.filter("items", lambda v: v.isin(often)).alias("items")).filter(F.size("items") > 1)
    else:
        single = materialize(single, "marginals")
    first = kept.select("items", F.posexplode("items").alias("i", "item_a"))
    pairs = first.select("item_a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("item_b"))
    counted = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n_both"))
    if least_share:
        counted = counted.filter(F.col("n_both").cast("decimal(38,0)") * q >= F.lit(n_all).cast("decimal(38,0)") * p)
    side = lambda s: single.select(F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))
    joined = counted.join(side("a"), "item_a").join(side("b"), "item_b")
    lift = F.col("n_both").cast("double") * n_all / F.col("n_a") / F.col("n_b")
    return joined.select("item_a", "item_b", "n_both", "n_a", "n_b", F.lit(n_all).cast("long").alias("n_all"), lift.alias("lift"), F.log2(lift).alias("pmi"))
