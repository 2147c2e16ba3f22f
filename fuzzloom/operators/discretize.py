"""Fuzzy partitions of a numeric feature: c-means over its distinct values, with the number of clusters estimated.

Rows never reach these kernels, only the distinct values of a feature. With at most ``LARGEST`` of them they come to the driver
as they are; ``column_sets`` tells what is done with more. All random starts take a seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzloom.functions.activations import ClusterSet, FuzzySet, memberships
from fuzzloom.operators.prefix import running
from fuzzloom.scratch import materialize, release

#: Distinct values that are clustered on the driver in any case, and cells that rl-cmeans takes at most.
LARGEST = 4096
#: Distinct values of which cmeans-gap takes its steps on the driver, 8 MB of them; with more it takes the same steps as sums in Spark.
ON_DRIVER = 1 << 20
#: Ranks of a curve that are looked at together.
CHUNK = 1 << 20
#: Fuzzifier of c-means.
FUZZIFIER = 2.5
#: Least number of distinct values of a continuous feature.
FEWEST = 10
EPS = float(np.finfo(np.float64).eps)
STRATEGIES = ("cmeans-gap", "cmeans-sil", "cmeans-cfe", "rl-cmeans")


def _distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").distinct()


def _sorted(x: DataFrame) -> np.ndarray:
    return np.sort(x.toArrow().column("x").to_numpy())


def _ranked(x: DataFrame) -> DataFrame:
    """Distinct values, written, with their rank from 0."""
    ranks = running(x.withColumn("one", F.lit(1).cast("long")), [], ["x"], {"r": ("sum", "one")})
    return materialize(ranks.select("x", (F.col("r") - 1).alias("r")), "ranked")


def distinct_values(df: DataFrame, column: str) -> np.ndarray:
    """Rising distinct values of a column, without null and NaN; if there are more than ``LARGEST``, means of so many cells.

    Cells hold consecutive values and the same number of them, or one more, so each mean stands for as many as any other.
    """
    x = _distinct(df, column)
    few = [r.x for r in x.limit(LARGEST + 1).collect()]
    if len(few) > LARGEST:
        ranked = _ranked(x)
        cell = F.floor(F.col("r") * LARGEST / ranked.count())
        few = [r.m for r in ranked.groupBy(cell.alias("c")).agg(F.avg("x").alias("m")).collect()]
        release(ranked)
    return np.sort(np.array(few, float))


def _columns(u: np.ndarray) -> np.ndarray:
    return u / u.sum(axis=0, keepdims=True)


def cmeans(x: np.ndarray, clusters: int, m: float = FUZZIFIER, error: float = 1e-4, max_iter: int = 250, start: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Membership (clusters x values) and centres.

    At most ``max_iter - 1`` steps, ending when the memberships move by less than ``error`` (Frobenius norm). Memberships and
    distances are kept above the machine's epsilon.
    """
    u = _columns(np.random.default_rng(seed).random((clusters, len(x))) if start is None else np.array(start, float))
    centre = np.zeros(clusters)
    for _ in range(max_iter - 1):
        old = np.maximum(_columns(u), EPS)
        power = old**m
        centre = power @ x / power.sum(axis=1)
        u = memberships(x, centre, m)
        if np.linalg.norm(u - old) < error:
            break
    return u, centre


def partition_coefficient(u: np.ndarray) -> float:
    return float((u * u).sum() / u.shape[1])


def change_points(y: np.ndarray, most: int) -> list[int]:
    """Places where a curve turns from flat to steep or back, against a mean of its steps that forgets by halves.

    Two places apart from each other by less than 1/most of the curve count once; the last place is the curve's end.
    """
    return _turns([np.abs(np.diff(y))], len(y), most)


def _turns(chunks: Iterable[np.ndarray], n: int, most: int) -> list[int]:
    """``change_points`` of a curve of n places from its steps, which come in pieces."""
    mean, steep = 0.0, False
    at: list[int] = []
    k = -1
    for chunk in chunks:
        for d in chunk.tolist():
            k += 1
            if (d > mean and not steep) or (d < mean and steep):
                steep = not steep
                at.append(k)
            if len(at) > 1 and k - at[-2] < n / most:
                at.pop()
            mean = (mean + d) / 2
    if len(at) > 1:
        if n - 1 - at[-1] < n / most:
            at.pop()
        at.append(n - 1)
    return at


def gap_start(x: np.ndarray, most: int) -> tuple[int, np.ndarray | None]:
    """Number of clusters by the change points of a polynomial through the sorted values, and the start it gives: each value's
    distance to the curve at the points."""
    rank = np.arange(len(x))
    # Ranks scaled to -1 .. 1 give the same polynomial with far better condition.
    scaled = 2 * rank / max(len(x) - 1, 1) - 1
    curve = np.polynomial.polynomial.polyval(scaled, np.polynomial.polynomial.polyfit(scaled, x, most))
    at = change_points(curve, most)
    centres = curve[at[:-1] if len(at) > 2 else at]
    return len(at) - 1, np.abs(centres[:, None] - x[None, :]) if len(at) else None


def silhouette(x: np.ndarray, u: np.ndarray, alpha: float = 2.0) -> float:
    """Fuzzy silhouette: how much farther, by membership, the second cluster is than the first, weighted by how sure the first is.

    x rises.
    """
    two = np.argsort(-u, axis=0, kind="stable")[:2]
    here = np.arange(len(x))
    weight = (u[two[0], here] - u[two[1], here]) ** alpha
    # Distances to all values by membership, from running sums over the rising values.
    z = x - x.mean()
    below, moment = np.cumsum(u, axis=1), np.cumsum(u * z, axis=1)
    mean = (z * (2 * below - below[:, -1:]) - (2 * moment - moment[:, -1:])) / max(len(x) - 1, 1)
    a, b = mean[two[0], here], mean[two[1], here]
    top = np.maximum(a, b)
    value = np.divide(b - a, top, out=np.zeros_like(top), where=top > 0)
    return float((weight * value).sum() / weight.sum()) if weight.sum() > 0 else 0.0


def fuzzy_entropy(x: np.ndarray, u: np.ndarray, centre: np.ndarray) -> float:
    """Mean of the clusters' cross entropy against their own entropy and of a between/within ratio; NaN if a membership is 0 or 1.

    The within part takes each membership against the distance of all values to the centre, as the published index does.
    """
    c, n = u.shape
    with np.errstate(all="ignore"):
        own = -(u * np.log2(u) + (1 - u) * np.log2(1 - u)).sum(axis=1) / n
        cross = 0.0
        for i in range(c):
            mid = (u[i] + u) / 2
            each = u[i] * np.log2(u[i] / mid) + (1 - u[i]) * np.log2((1 - u[i]) / (1 - mid))
            cross += 2 * float(np.delete(each, i, axis=0).sum())
        within = float((u.sum(axis=1) * ((x[None, :] - centre[:, None]) ** 2).sum(axis=1)).sum())
        between = float((u.sum(axis=1) * (centre - x.mean()) ** 2).sum())
        ratio = between / (c - 1) * (n - c) / within
        return float((cross * 2 / (c * (c - 1)) / own.mean() + ratio) / 2)


def rl_cmeans(x: np.ndarray, error: float = 5e-4, max_iter: int = 110) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust-learning c-means: begins with every value as a cluster and drops those whose weight falls below 1/n.

    Gives membership (clusters x values), centres and weights. r1 and r2 fade with the steps; r3, the pull towards few clusters,
    is the lesser of two bounds and none once the number holds after step 100.
    """
    n = len(x)
    centre, weight = x.astype(float).copy(), np.full(n, 1 / n)
    r1 = r2 = r3 = 1.0
    u = np.eye(n)
    for t in range(1, max_iter):
        score = (-((x[:, None] - centre[None, :]) ** 2) + r1 * np.log(weight)[None, :]) / r2
        u = np.exp(score - score.max(axis=1, keepdims=True))
        u /= u.sum(axis=1, keepdims=True)
        r1, r2 = np.exp(-t / 10), np.exp(-t / 100)
        now = u.mean(axis=0) + r3 / r1 * weight * (np.log2(weight) - (weight * np.log2(weight)).sum())
        most = (weight * (weight * np.log(weight)).sum()).max()
        r3 = min(float(np.exp(-n * np.abs(now - weight)).mean()), float((1 - u.mean(axis=0).max()) / -most) if most else np.inf)
        keep = now >= 1 / n
        if not keep.any():
            keep[now.argmax()] = True
        if t >= 100 and keep.all():
            r3 = 0.0
        weight = now[keep] / now[keep].sum()
        u = u[:, keep]
        empty = u.sum(axis=1) == 0
        u[empty] = 1 / u.shape[1]
        u /= u.sum(axis=1, keepdims=True)
        moved = u.T @ x / u.sum(axis=0)
        still = len(moved) == len(centre) and np.linalg.norm(moved - centre) < error
        centre = moved
        if len(weight) == 1 or still:
            break
    return u.T, centre, weight


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each value, the first of equally near ones."""
    return np.abs(x[:, None] - centres[None, :]).argmin(axis=1)


def three_clusters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low, middle and high by rank, as triangles with the peak in the middle. Values even in number get a middle value between."""
    if len(x) % 2 == 0:
        k = len(x) // 2
        x = np.concatenate([x[:k], [(x[k - 1] + x[k]) / 2], x[k:]])
    r = np.arange(len(x)) / max((len(x) - 1) / 2, 1)
    return x, np.stack([np.maximum(0, 1 - r), 1 - np.abs(r - 1), np.maximum(0, r - 1)])


def three_clusters_frame(values: DataFrame, column: str) -> DataFrame:
    """(value, low, middle, high): ``three_clusters`` of the distinct values of a column, by ranks counted in ranges of value."""
    ranked = _ranked(_distinct(values, column))
    n = ranked.count()
    half = n // 2
    if n and n % 2 == 0:
        middle = ranked.filter((F.col("r") == half - 1) | (F.col("r") == half)).agg(F.avg("x").alias("x")).select("x", F.lit(half).cast("long").alias("r"))
        ranked, n = ranked.select("x", (F.col("r") + (F.col("r") >= half).cast("long")).alias("r")).unionByName(middle), n + 1
    r = F.col("r") / max((n - 1) / 2, 1.0)
    return ranked.select(F.col("x").alias("value"), F.greatest(F.lit(0.0), 1 - r).alias("low"), (1 - F.abs(r - 1)).alias("middle"), F.greatest(F.lit(0.0), r - 1).alias("high"))


def nearest_frame(values: DataFrame, column: str, centres: np.ndarray) -> DataFrame:
    """``values`` with ``cluster``, the number of the nearest centre, null where the value is null or NaN."""
    schema = T.StructType([*values.schema.fields, T.StructField("cluster", T.IntegerType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(column).to_numpy(zero_copy_only=False), float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(x, centres), pa.int32(), mask=np.isnan(x))], names)

    return values.mapInArrow(run, schema)


@dataclass(frozen=True)
class Partition:
    """Values of a feature, and the membership of each in each cluster."""

    values: np.ndarray
    membership: np.ndarray

    def sets(self) -> list[FuzzySet]:
        """The clusters in rising order of their centres."""
        total = self.membership.sum(axis=1)
        centre = self.membership @ self.values / np.where(total > 0, total, 1)
        return [FuzzySet.of(self.values, u) for u in self.membership[np.argsort(centre, kind="stable")]]


def partition(x: np.ndarray, strategy: str = "cmeans-gap", most: int = 7, max_iter: int = 200, seed: int = 0) -> Partition:
    """Fuzzy partition of sorted distinct values into 2 to ``most`` clusters, or three by rank if the strategy finds fewer than 2.

    cmeans-gap takes number and start from change points; cmeans-sil and cmeans-cfe try every number and keep the best index
    above 0; rl-cmeans finds the number itself. The result depends on nothing but its arguments.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}; there are {', '.join(STRATEGIES)}")
    if len(x) < FEWEST:
        raise ValueError(f"a continuous feature needs {FEWEST} distinct values, there are {len(x)}")
    most = min(most, len(x) // 2)
    best: np.ndarray | None = None
    if strategy == "cmeans-gap":
        clusters, start = gap_start(x, most)
        if clusters > 1:
            best, _ = cmeans(x, clusters, max_iter=max_iter, start=start)
    elif strategy == "rl-cmeans":
        u, _, _ = rl_cmeans(x)
        best = u if len(u) > 1 else None
    else:
        top = 0.0
        for c in range(2, most + 1):
            u, centre = cmeans(x, c, max_iter=max_iter, seed=seed)
            index = silhouette(x, u) if strategy == "cmeans-sil" else fuzzy_entropy(x, u, centre)
            if index > top:
                top, best = index, u
    return Partition(*three_clusters(x)) if best is None else Partition(x, best)


def _sums(values: DataFrame, of: Callable[..., np.ndarray], columns: list[str]) -> np.ndarray:
    """Sum of ``of(*columns)``, a vector for each batch, over written values. Each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = of(*(batch.column(c).to_numpy() for c in columns))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    return np.sum([r.v for r in values.select(*columns).mapInArrow(run, "v array<double>").collect()], axis=0)


def gap_centres(ranked: DataFrame, n: int, most: int) -> np.ndarray | None:
    """Start centres by the change points of a polynomial through all of n ranked values, or None for fewer than two clusters.

    The polynomial comes from its normal equations in Legendre's basis, which stay well conditioned over equal steps.
    """
    size = most + 1
    basis = np.polynomial.legendre

    def normal(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        v = basis.legvander(2 * r / (n - 1) - 1, most)
        return np.concatenate([(v.T @ v).ravel(), v.T @ x])

    got = _sums(ranked, normal, ["x", "r"])
    fit = np.linalg.solve(got[: size * size].reshape(size, size), got[size * size :])
    curve = lambda r: basis.legval(2 * r / (n - 1) - 1, fit)
    steps = (np.abs(np.diff(curve(np.arange(a, min(a + CHUNK, n - 1) + 1)))) for a in range(0, n - 1, CHUNK))
    at = _turns(steps, n, most)
    return curve(np.array(at[:-1] if len(at) > 2 else at)) if len(at) > 2 else None


def cmeans_sums(values: DataFrame, start: np.ndarray, m: float = FUZZIFIER, error: float = 1e-4, max_iter: int = 250) -> np.ndarray:
    """Centres of ``cmeans`` over all written values, in rising order of their clusters' mean, from sums for each cluster.

    The memberships of a step follow from its centres (at first from the distances to ``start``), so no value keeps any.
    """
    c = len(start)

    def step(before: np.ndarray | None, now: np.ndarray | None) -> np.ndarray:
        """Sums for the next centres and for the clusters' means, and the squared move of the memberships."""

        def of(x: np.ndarray) -> np.ndarray:
            first = _columns(np.abs(start[:, None] - x[None, :])) if before is None else memberships(x, before, m)
            old = np.maximum(first, EPS)
            u = old if now is None else memberships(x, now, m)
            power = np.maximum(u, EPS) ** m
            return np.concatenate([power @ x, power.sum(axis=1), u @ x, u.sum(axis=1), [((u - old) ** 2).sum()]])

        return _sums(values, of, ["x"])

    got = step(None, None)
    before, now = None, got[:c] / got[c : 2 * c]
    for k in range(1, max_iter):
        got = step(before, now)
        if got[-1] < error**2 or k == max_iter - 1:
            break
        before, now = now, got[:c] / got[c : 2 * c]
    return now[np.argsort(got[2 * c : 3 * c] / got[3 * c : 4 * c], kind="stable")]


def column_sets(df: DataFrame, column: str, strategy: str = "cmeans-gap", most: int = 7, max_iter: int = 200, seed: int = 0) -> list[FuzzySet]:
    """The sets of ``partition`` over the distinct values of a column, in rising order.

    With more than ``LARGEST`` values the sets of cmeans-gap are computed from the centres; with more than ``ON_DRIVER`` it takes
    its steps as sums over all values in Spark.
    Clusters by rank, cmeans-sil and cmeans-cfe bring all distinct values to the driver. Only rl-cmeans, which is quadratic, takes
    the cells of ``distinct_values``.
    """
    x = _distinct(df, column)
    few = [r.x for r in x.limit(LARGEST + 1).collect()]
    if len(few) <= LARGEST:
        return partition(np.sort(np.array(few, float)), strategy, most, max_iter, seed).sets()
    if strategy == "rl-cmeans":
        return partition(distinct_values(df, column), strategy, most, max_iter, seed).sets()
    if strategy != "cmeans-gap":
        return partition(_sorted(x), strategy, most, max_iter, seed).sets()
    if x.count() <= ON_DRIVER:
        values = _sorted(x)
        clusters, first = gap_start(values, min(most, len(values) // 2))
        if clusters < 2:
            return Partition(*three_clusters(values)).sets()
        u, centre = cmeans(values, clusters, max_iter=max_iter, start=first)
        centre = centre[np.argsort(u @ values / u.sum(axis=1), kind="stable")]
        return [ClusterSet.around(centre, i, float(values[0]), float(values[-1]), FUZZIFIER) for i in range(len(centre))]
    ranked = _ranked(x)
    n, low, high = ranked.agg(F.count("*"), F.min("x"), F.max("x")).first()
    start = gap_centres(ranked, n, min(most, n // 2))
    if start is None:
        sets = Partition(*three_clusters(_sorted(ranked))).sets()
    else:
        centres = cmeans_sums(ranked, start, max_iter=max_iter)
        sets = [ClusterSet.around(centres, i, low, high, FUZZIFIER) for i in range(len(centres))]
    release(ranked)
    return sets
