"""2x2 counts of concept pairs, crisp or fuzzy, from one pass over the rows.

With N, A = sum of p, B = sum of q and G = sum of p*q the four counts are G, A - G, B - G and N - A - B + G. So all pairs come
from the products of the membership columns: one matrix product for each batch, one small matrix for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.functions.activations import FuzzySet
from fuzzloom.scratch import materialize


def pairs_of(cells: DataFrame) -> DataFrame:
    """(concept_p, concept_q, p_q, p_nq, np_q, np_nq) in both directions from (concept_p, concept_q, g, a, b, n)."""
    g, a, b, n = (F.col(c) for c in "gabn")
    side = lambda p, q, pn, nq: F.struct(F.col(p).alias("concept_p"), F.col(q).alias("concept_q"), g.alias("p_q"), pn.alias("p_nq"), nq.alias("np_q"), (n - a - b + g).alias("np_nq"))
    # Both directions of a pair come from its one row, so what is below is made once.
    return cells.select(F.inline(F.array(side("concept_p", "concept_q", a - g, b - g), side("concept_q", "concept_p", b - g, a - g))))


def discrete_pair(df: DataFrame, left: str, right: str, separator: str = "___") -> DataFrame:
    """Counts of all pairs of values of two discrete columns, also of pairs that never meet.

    The rows are read once, for the counts of the pairs that meet; these are written, being few against the rows, and the rest
    comes from them. Null counts as no value.
    """
    cell = materialize(df.groupBy(left, right).agg(F.count("*").cast("double").alias("g")), "cells")
    margin = lambda c: cell.filter(F.col(c).isNotNull()).groupBy(c).agg(F.sum("g").alias("m"))
    every = margin(right).agg(F.collect_list(F.struct(F.col(right), F.col("m").alias("b")))).scalar()
    total = cell.agg(F.coalesce(F.sum("g"), F.lit(0.0))).scalar()
    name = lambda c: F.concat(F.col(c).cast("string"), F.lit(separator + c))
    filled = margin(left).select(left, F.col("m").alias("a"), F.inline(every)).join(cell, [left, right], "left").fillna(0.0, ["g"])
    return pairs_of(filled.select(name(left).alias("concept_p"), name(right).alias("concept_q"), "g", "a", "b", total.alias("n")))


Member = tuple[Column, FuzzySet | None]


def gram(df: DataFrame, members: dict[str, Member]) -> DataFrame:
    """(i, j, g) with i <= j over the memberships in order, 0 standing for the constant 1: g is the sum of the product.

    A member is a column, and a fuzzy set if the column is a value whose membership counts. Null counts as 0. Each task sends one
    row for each pair of concepts, however many rows it has read.
    """
    n = len(members) + 1
    sets = [s for _, s in members.values()]
    source = df.select(*[c.cast("double").alias(f"m{i}") for i, (c, _) in enumerate(members.values(), 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.ones((len(batch), n))
            for k, s in enumerate(sets):
                v = np.asarray(batch.column(k).to_numpy(zero_copy_only=False), float)
                x[:, k + 1] = np.nan_to_num(v if s is None else s.array(v))
            total += x.T @ x
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    return source.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def memberships_contingency(df: DataFrame, members: dict[str, Member]) -> dict[tuple[str, str], tuple[float, float, float, float]]:
    """Counts of each ordered pair of concepts, on the driver: a map's concepts are few."""
    names = list(members)
    at = {(r.i, r.j): r.g for r in gram(df, members).collect()}
    n = at.get((0, 0), 0.0)
    out = {}
    for x, p in enumerate(names, 1):
        for y, q in enumerate(names, 1):
            if x != y:
                g, a, b = at[min(x, y), max(x, y)], at[0, x], at[0, y]
                out[p, q] = (g, a - g, b - g, n - a - b + g)
    return out


def contingency_frame(df: DataFrame, left: dict[str, Column], right: dict[str, Column]) -> DataFrame:
    """Counts of each pair of a concept in ``left`` and one in ``right``, both directions, as one aggregate without Python.

    For few concepts: all sums are columns of one aggregate.
    """
    a, b = list(left), list(right)
    sums = [F.sum(left[p]).alias(f"a{i}") for i, p in enumerate(a)] + [F.sum(right[q]).alias(f"b{j}") for j, q in enumerate(b)]
    sums += [F.sum(left[p] * right[q]).alias(f"g{i}_{j}") for i, p in enumerate(a) for j, q in enumerate(b)]
    row = df.agg(F.count("*").cast("double").alias("n"), *sums)
    cells = F.array(*[F.struct(F.lit(p).alias("concept_p"), F.lit(q).alias("concept_q"), F.col(f"g{i}_{j}").alias("g"), F.col(f"a{i}").alias("a"), F.col(f"b{j}").alias("b"), F.col("n").alias("n")) for i, p in enumerate(a) for j, q in enumerate(b)])
    return pairs_of(row.select(F.inline(cells)))
