"""Association of two concepts p and q from their 2x2 counts: (p and q, p and not q, not p and q, neither)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Measure = Callable[[Column, Column, Column, Column], Column]


def _over(a: Column, b: Column, at_zero: Column) -> Column:
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def supp(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    return F.try_divide(pq, pq + pn + nq + nn)


def conf(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    return _over(pq, pq + pn, F.lit(0.0))


def lift(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    """Null where q never holds."""
    return F.try_divide(conf(pq, pn, nq, nn), F.try_divide(pq + nq, pq + pn + nq + nn))


def rodr(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    return _over(pq + nn, pn + nq, pq + nn)


def odr(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    return _over(pq * nn, pn * nq, pq * nn)


def pos_inf(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    """The stronger of the case for q and, negated, the case against it; 0 if they are level."""
    case = _over(F.try_divide(pq, pq + pn), pn + nq, F.try_divide(pq, pq + pn))
    against = _over(F.try_divide(pn, pq + pn), pq + nn, F.try_divide(pn, pq + pn))
    return F.when(case > against, case).when(case < against, -against).otherwise(F.lit(0.0))


def bayes(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    n = pq + pn + nq + nn
    return F.when(pq > nq, F.try_divide((pq - nq) / n * (pq + nq), pq + pn)).otherwise(F.lit(0.0))


def simple(pq: Column, pn: Column, nq: Column, nn: Column) -> Column:
    return F.when(pq == pn, F.lit(0.0)).otherwise((pq - pn + nn + nq) / (pq + pn + nq + nn))


MEASURES: dict[str, Measure] = {"supp": supp, "conf": conf, "lift": lift, "rodr": rodr, "odr": odr, "pos_inf": pos_inf, "bayes": bayes, "simple": simple}


def measure(which: str | Measure) -> Measure:
    """A measure by name, or any builder of a column from four columns."""
    if callable(which):
        return which
    if which not in MEASURES:
        raise ValueError(f"unknown measure: {which}; there are {', '.join(MEASURES)}")
    return MEASURES[which]
