"""Activation functions of concepts, each as a column expression and as its numpy twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Num = float | Column


@dataclass(frozen=True)
class Activation:
    """A function with at most one parameter, and the parameter's name and default."""

    column: Callable[..., Column]
    array: Callable[..., np.ndarray]
    parameter: str | None = None
    default: float | None = None

    def argument(self, args: dict) -> float | None:
        return None if self.parameter is None else float(args.get(self.parameter, self.default))


def biestate(v: Column) -> Column:
    return F.when(v <= 0, F.lit(0.0)).otherwise(F.lit(1.0))


def threestate(v: Column) -> Column:
    return F.when(v <= 1 / 3, F.lit(0.0)).when(v <= 2 / 3, F.lit(0.5)).otherwise(F.lit(1.0))


def saturation(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def sigmoid(v: Column, lambda_val: Num = 1.0) -> Column:
    return 1 / (1 + F.exp(-lambda_val * v))


def sigmoid_hip(v: Column, lambda_val: Num = 2.0) -> Column:
    e = F.exp(F.least(F.lit(500.0), -lambda_val * v))
    return (1 - e) / (1 + e)


def gceq(v: Column, weight: Num = -1.0) -> Column:
    return F.when(v >= weight, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))).otherwise(F.lit(0.0))


def lceq(v: Column, weight: Num = 1.0) -> Column:
    return F.when(v <= weight, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))).otherwise(F.lit(0.0))


def relm(v: Column, lambda_val: Num = 1.0) -> Column:
    return F.when(v < 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), v / lambda_val))


def _sigmoid_hip(v: np.ndarray, lambda_val: float) -> np.ndarray:
    e = np.exp(np.minimum(500.0, -lambda_val * v))
    return (1 - e) / (1 + e)


def _sigmoid(v: np.ndarray, lambda_val: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-lambda_val * v))


_HIP = Activation(sigmoid_hip, _sigmoid_hip, "lambda_val", 2.0)

#: The functions by the names that maps use.
ACTIVATIONS: dict[str, Activation] = {
    "biestate": Activation(biestate, lambda v: np.where(v <= 0, 0.0, 1.0)),
    "threestate": Activation(threestate, lambda v: np.where(v <= 1 / 3, 0.0, np.where(v <= 2 / 3, 0.5, 1.0))),
    "saturation": Activation(saturation, lambda v: np.clip(v, 0.0, 1.0)),
    "sigmoid": Activation(sigmoid, _sigmoid, "lambda_val", 1.0),
    "sigmoid_hip": _HIP,
    "tan_hip": _HIP,
    "gceq": Activation(gceq, lambda v, w: np.where(v >= w, np.clip(v, -1.0, 1.0), 0.0), "weight", -1.0),
    "lceq": Activation(lceq, lambda v, w: np.where(v <= w, np.clip(v, -1.0, 1.0), 0.0), "weight", 1.0),
    "relm": Activation(relm, lambda v, w: np.where(v < 0, 0.0, np.minimum(1.0, v / w)), "lambda_val", 1.0),
}


def activation(name: str) -> Activation:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation function: {name}; there are {', '.join(ACTIVATIONS)} and fuzzy")
    return ACTIVATIONS[name]


@dataclass(frozen=True)
class FuzzySet:
    """Membership by linear interpolation between points, constant outside them."""

    values: tuple[float, ...]
    membership: tuple[float, ...]

    @staticmethod
    def of(values, membership) -> FuzzySet:
        """Points in rising order of value."""
        points = sorted(zip(map(float, values), map(float, membership), strict=True))
        return FuzzySet(tuple(v for v, _ in points), tuple(m for _, m in points))

    def scaled(self) -> FuzzySet:
        """Values moved by the size of the least and divided by the range so reached; all-zero values stay."""
        low = abs(min(self.values))
        top = low + max(self.values)
        return FuzzySet(tuple((v + low) / top if top else 0.0 for v in self.values), self.membership)

    @cached_property
    def _mirrors(self) -> bool:
        """Values within 0 and 1 stand for sizes: a negative argument gives the negative of what its size is short of 1."""
        return all(0 <= v <= 1 for v in self.values)

    @cached_property
    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.values), np.array(self.membership)

    def _at(self, v: np.ndarray) -> np.ndarray:
        return np.interp(v, *self._arrays)

    def array(self, v: np.ndarray) -> np.ndarray:
        if not self._mirrors:
            return self._at(v)
        m = self._at(np.abs(v))
        return np.where(v < 0, m - 1, m)

    def column(self, v: Column) -> Column:
        """The same as nested conditions over the points, so it stays within generated code."""
        out = self._line(v)
        return F.when(v < 0, -(1 - self._line(F.abs(v)))).otherwise(out) if self._mirrors else out

    def _line(self, v: Column) -> Column:
        x, y = self.values, self.membership
        out = F.when(v.isNull(), F.lit(None)).when(v <= x[0], F.lit(y[0]))
        for k in range(1, len(x)):
            if x[k] > x[k - 1]:
                out = out.when(v <= x[k], F.lit(y[k - 1]) + (v - x[k - 1]) * ((y[k] - y[k - 1]) / (x[k] - x[k - 1])))
        return out.otherwise(F.lit(y[-1]))

    def fuzzify(self, v: Column, least: float, span: float) -> Column:
        """Membership of (v - least) / span: below all points the least membership, above all the greatest, else interpolated
        and kept within 0 and 1."""
        s = (v - least) / span
        within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), self._line(s)))
        return F.when(s < self.values[0], F.lit(min(self.membership))).when(s > self.values[-1], F.lit(max(self.membership))).otherwise(within)


#: Points between neighbouring centres in the table of a ``ClusterSet``.
_STEPS = 64
_EPS = float(np.finfo(np.float64).eps)


def memberships(x: np.ndarray, centre: np.ndarray, m: float) -> np.ndarray:
    """Membership (clusters x values) that c-means gives at its centres. Distances are kept above the machine's epsilon."""
    far = np.maximum(np.abs(centre[:, None] - x[None, :]), _EPS)
    # The least distance of a column goes to 1, so that powers can't overflow.
    u = (far / far.min(axis=0)) ** (-2 / (m - 1))
    return u / u.sum(axis=0, keepdims=True)


@dataclass(frozen=True)
class ClusterSet(FuzzySet):
    """Membership in the cluster ``index`` of c-means with fuzzifier ``m``, computed from the centres; constant outside the points.

    The points are a table of it for whatever takes points only.
    """

    centres: tuple[float, ...] = ()
    index: int = 0
    m: float = 2.5

    @staticmethod
    def around(centres, index: int, low: float, high: float, m: float) -> ClusterSet:
        """The set over values from low to high."""
        ends = np.unique([low, *(c for c in map(float, centres) if low < c < high), high])
        x = np.unique(np.concatenate([np.linspace(a, b, _STEPS + 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]))
        u = memberships(x, np.asarray(centres, float), m)[index]
        return ClusterSet(tuple(x.tolist()), tuple(u.tolist()), tuple(map(float, centres)), int(index), float(m))

    def scaled(self) -> ClusterSet:
        low = abs(min(self.values))
        top = low + max(self.values)
        return replace(self, values=super().scaled().values, centres=tuple((c + low) / top if top else 0.0 for c in self.centres))

    def _at(self, v: np.ndarray) -> np.ndarray:
        inside = np.clip(v, self.values[0], self.values[-1])
        return memberships(inside.ravel(), np.array(self.centres), self.m)[self.index].reshape(inside.shape)

    def _line(self, v: Column) -> Column:
        inside = F.greatest(F.lit(self.values[0]), F.least(F.lit(self.values[-1]), v))
        far = [F.greatest(F.abs(inside - c), F.lit(_EPS)) for c in self.centres]
        parts = [F.pow(far[self.index] / d, F.lit(2 / (self.m - 1))) for d in far]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return F.when(v.isNotNull(), 1 / out)


def fuzzy_set(args: dict) -> FuzzySet:
    """The set of the arguments that ``set_args`` gives, or of points alone."""
    if "centres" not in args:
        return FuzzySet.of(args["val_list"], args["membership"])
    points = FuzzySet.of(args["val_list"], args["membership"])
    return ClusterSet(points.values, points.membership, tuple(map(float, args["centres"])), int(args["cluster"]), float(args["m"]))


def set_args(s: FuzzySet) -> dict:
    """Points of a set, and what it is computed from if it isn't points alone."""
    more = {"centres": list(s.centres), "cluster": s.index, "m": s.m} if isinstance(s, ClusterSet) else {}
    return {"membership": list(s.membership), "val_list": list(s.values), **more}


def defuzzify(*_args) -> None:
    """There is no inverse of a fuzzy set that isn't monotone."""
    raise NotImplementedError("a fuzzy set has no inverse")


def sigmoid_lambda(x: Column, y: Num) -> Column:
    """The lambda with which ``sigmoid`` gives y at x."""
    return -F.log(1 / F.lit(y) - 1) / x


def sigmoid_hip_lambda(x: Column, y: Num) -> Column:
    """The lambda with which ``sigmoid_hip`` gives y at x."""
    return -F.log((1 - F.lit(y)) / (1 + F.lit(y))) / x


def inclination(name: str, x: Column, y: Num) -> Column:
    """The parameter with which a function gives y at the sum of incoming weights; 1 for ``relm``; null where x is 0."""
    if name == "relm":
        return F.lit(1.0)
    solve = {"sigmoid": sigmoid_lambda, "sigmoid_hip": sigmoid_hip_lambda, "tan_hip": sigmoid_hip_lambda}[name]
    return solve(F.nullif(F.abs(x), F.lit(0.0)), y)
