"""References to keys that are missing, deleted or arrive later, and what hangs on them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.operators.prefix import running
from fuzzloom.scratch import materialize, release

#: The time of a record whose arrival is unknown: after all others.
NEVER = "9999-12-31 00:00:00"


def _at(col: str):
    return F.coalesce(F.col(col).cast("timestamp_ntz"), F.lit(NEVER).cast("timestamp_ntz"))


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on ``keys`` in which null equals null; the right side's keys go."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same: Column = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def status_at(refs: DataFrame, present: DataFrame, deleted: DataFrame, keys: list[str], ref_id: list[str], at: str) -> DataFrame:
    """Direct orphans among ``refs`` (columns ``keys``, ``ref_id``, ``at``), with a ``status``.

    present: ``keys``, ``at`` of each arrival of a key; deleted: ``keys``, ``at`` of each deletion. A reference at time T is
    ``missing`` if its key never arrives, ``late`` if it arrives only after T, ``deleted`` if a deletion lies after the last
    arrival at or before T and not after T. Others give no row. Repeated arrivals and deletions change nothing. A null key is a
    value like others; a null time counts as after all others. Empty tables are allowed everywhere. Tables are read more than
    once, so they should be written ones.

    Missing and late references come from one join with the first arrival of each key, which is one row for each key. Only keys
    with a deletion are scanned in the order of time, cut into ranges (``running``), so none is a task of its own.
    """
    asked = refs.select(*keys, *ref_id, _at(at).alias("_t"))
    arrivals = present.select(*keys, _at(at).alias("_t"))
    firsts = arrivals.groupBy(*keys).agg(F.min("_t").alias("_first"))
    joined = _matched(asked, firsts, keys, "left").filter("_first IS NULL OR _first > _t")
    absent = joined.withColumn("status", F.when(F.col("_first").isNull(), "missing").otherwise("late"))
    removals = materialize(deleted.select(*keys, _at(at).alias("_t")).distinct(), "removals")
    some = removals.select(*keys).distinct()
    none = F.lit(None).cast("timestamp_ntz")
    events = (
        _matched(arrivals.distinct(), some, keys, "left_semi").select(*keys, "_t", F.lit(0).alias("_kind"), F.col("_t").alias("_in"), none.alias("_out"))
        .unionByName(removals.select(*keys, "_t", F.lit(1).alias("_kind"), none.alias("_in"), F.col("_t").alias("_out")))
        .unionByName(_matched(asked, some, keys, "left_semi").select(*keys, "_t", F.lit(2).alias("_kind"), none.alias("_in"), none.alias("_out"), *ref_id), allowMissingColumns=True)
    )
    seen = running(events, keys, ["_t", "_kind", *ref_id], {"_last_in": ("max", "_in"), "_last_out": ("max", "_out")})
    gone = seen.filter("_kind = 2 AND _last_out > _last_in").withColumn("status", F.lit("deleted"))
    out = [*keys, *ref_id, F.col("_t").alias(at), "status"]
    return gone.select(*out).unionByName(absent.select(*out))


@dataclass(frozen=True)
class ForeignKey:
    """Rows of ``child`` refer by ``child_cols`` to ``parent_cols`` of ``parent``; a reference with a null in it is none."""

    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]


@dataclass
class Cascade:
    """Orphans of each table, direct and inherited, as the fixpoint of semi-joins down the foreign keys.

    tables: name -> (rows, identifying columns). References whose parents come and go are judged before, by ``status_at``: known
    has the direct orphans of a table, with any further columns. In other tables a row is a direct orphan if one of its
    references has no parent row.

    ``direct`` is round 0. ``found`` goes on: rows that refer to an orphan of the round before become inherited orphans, until a
    round finds none; cycles end since a row is found once. Each table's keys are written once, without its other columns; a round
    reads them and what the round before has found, and a broken key is followed once. The rounds are as many as the longest
    chain of orphans.
    """

    tables: dict[str, tuple[DataFrame, list[str]]]
    keys: list[ForeignKey]
    known: dict[str, DataFrame] = field(default_factory=dict)

    def direct(self, name: str) -> DataFrame:
        """Direct orphans of a table: its identifying columns, or the rows of ``known``."""
        if name in self.known:
            return self.known[name]
        rows, ids = self.tables[name]
        parts = []
        for fk in (k for k in self.keys if k.child == name):
            there = self.tables[fk.parent][0].select(*[F.col(p).alias(c) for p, c in zip(fk.parent_cols, fk.child_cols, strict=True)]).distinct()
            parts.append(rows.dropna(subset=list(fk.child_cols)).join(there, list(fk.child_cols), "left_anti").select(*ids))
        return reduce(DataFrame.unionByName, parts).distinct() if parts else rows.select(*ids).limit(0)

    def found(self) -> dict[str, DataFrame]:
        """name -> written rows (identifying columns, ``origin`` direct or inherited, ``depth``)."""
        ids = {name: cols for name, (_, cols) in self.tables.items()}
        rounds = {name: [materialize(self.direct(name).select(*ids[name]).distinct().withColumn("depth", F.lit(0)), f"orphans-{name}")] for name in self.tables}
        ends = {}
        for i, fk in enumerate(self.keys):
            names = [f"_k{j}" for j in range(len(fk.child_cols))]
            side = lambda table, cols, names=names: self.tables[table][0].dropna(subset=list(cols)).select(*ids[table], *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])
            ends[i] = (names, materialize(side(fk.parent, fk.parent_cols), "parents"), materialize(side(fk.child, fk.child_cols), "children"))
        followed: dict[int, DataFrame] = {}
        new = {name: r[0] for name, r in rounds.items()}
        depth = 0
        while new:
            depth += 1
            hits: dict[str, list[DataFrame]] = {}
            for i, fk in enumerate(self.keys):
                if fk.parent not in new:
                    continue
                names, parents, children = ends[i]
                broken = parents.join(new[fk.parent].select(*ids[fk.parent]), ids[fk.parent], "left_semi").select(*names).distinct()
                if i in followed:
                    broken = broken.join(followed[i], names, "left_anti")
                broken = materialize(broken, "broken")
                followed[i] = followed[i].unionByName(broken) if i in followed else broken
                hits.setdefault(fk.child, []).append(children.join(broken, names, "left_semi").select(*ids[fk.child]))
            new = {}
            for name, parts in hits.items():
                fresh = reduce(DataFrame.unionByName, parts).distinct()
                before = reduce(DataFrame.unionByName, rounds[name]).select(*ids[name])
                fresh = materialize(fresh.join(before, ids[name], "left_anti").withColumn("depth", F.lit(depth)), f"orphans-{name}-{depth}")
                if not fresh.isEmpty():
                    rounds[name].append(fresh)
                    new[name] = fresh
        out = {}
        for name, parts in rounds.items():
            origin = F.when(F.col("depth") == 0, "direct").otherwise("inherited")
            out[name] = materialize(reduce(DataFrame.unionByName, parts).select(*ids[name], origin.alias("origin"), "depth"), f"orphans-{name}-all")
            for p in parts:
                release(p)
        for _, parents, children in ends.values():
            release(parents)
            release(children)
        return out
