"""Running a map over a table: every row is a start state, and a batch of rows moves through all steps together.

A step is one matrix product for all rows that move together. Rows stop on their own; those that have leave, and what a decision
function needs of the states so far (sum, maximum, last) goes along instead of the states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzloom.functions.activations import ACTIVATIONS, FuzzySet
from fuzzloom.model import CognitiveMap, Settings
from fuzzloom.scratch import spread


@dataclass(frozen=True)
class Compiled:
    """A map as arrays, sent to the tasks."""

    names: tuple[str, ...]
    settings: Settings
    start: np.ndarray
    raw: tuple[FuzzySet | None, ...]
    weights: np.ndarray
    memory: np.ndarray
    doubled: np.ndarray
    norm: np.ndarray
    calls: tuple[tuple[np.ndarray, str, float | FuzzySet | None], ...]

    def activate(self, x: np.ndarray) -> np.ndarray:
        if len(self.calls) == 1:
            return self._call(x, *self.calls[0][1:])
        out = np.empty_like(x)
        for rows, name, arg in self.calls:
            out[rows] = self._call(x[rows], name, arg)
        return out

    @staticmethod
    def _call(v: np.ndarray, name: str, arg: float | FuzzySet | None) -> np.ndarray:
        if isinstance(arg, FuzzySet):
            return arg.array(v)
        return ACTIVATIONS[name].array(v) if arg is None else ACTIVATIONS[name].array(v, arg)

    def move(self, x: np.ndarray) -> np.ndarray:
        """The next states of ``x``, concepts by rows: excitation of each concept by its relations and, with memory, itself; then its
        activation.

        PAPAGEORGIUS concepts are read as 2A - 1. The excitation of a fuzzy concept is divided by its incoming weights, unless
        their sum is 0 (in matrix mode, not above 0).
        """
        seen = np.where(self.doubled[:, None], 2 * x - 1, x) if self.doubled.any() else x
        return self.activate((self.weights.T @ seen + seen * self.memory[:, None]) / self.norm[:, None])

    def step(self, x: np.ndarray) -> np.ndarray:
        """``move`` for rows by concepts."""
        return self.move(x.T).T


def compile_map(m: CognitiveMap) -> Compiled:
    """In iterative mode equal relations add up and inactive concepts pass nothing on; in matrix mode the last of equal relations
    counts and all concepts pass on."""
    at = {c.name: i for i, c in enumerate(m.concepts)}
    n = len(at)
    w = np.zeros((n, n))
    for o, d, x in m.relations:
        if m.settings.mode == "matrix":
            w[at[o], at[d]] = x
        elif m.concepts[at[o]].active:
            w[at[o], at[d]] += x
    norm = np.ones(n)
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(m.concepts):
        if c.fuzzy is not None:
            total = m.incoming_sum(c.name)
            norm[i] = total if total > 0 or total < 0 and m.settings.mode == "iterative" else 1.0
            groups.setdefault(("fuzzy", c.fuzzy.scaled()), []).append(i)
        else:
            name, args = m.function(c)
            groups.setdefault((name, ACTIVATIONS[name].argument(args)), []).append(i)
    calls = tuple((np.array(columns), name, arg) for (name, arg), columns in groups.items())
    return Compiled(
        tuple(at), m.settings, np.array([c.value for c in m.concepts], float), tuple(c.fuzzy for c in m.concepts), w, np.array([m.uses_memory(c) for c in m.concepts], float),
        np.array([c.excitation == "PAPAGEORGIUS" for c in m.concepts], bool), norm, calls,
    )


#: Numbers of states held at once where all states are wanted; rows of a batch are taken in parts so that a part's stay below it.
HELD = 4_000_000
#: Rows that move together: their states and what is kept of them stay in the processor's caches.
TOGETHER = 16_384


class _Stop:
    """When rows have all their states.

    Let s be the first state that begins the needed run of stable ones: extra_steps - 1 of them in iterative mode, where a state is
    stable if no concept has moved by more than the threshold, and from state max_iter - 1 on in any case (without ``stabilize``,
    only then); extra_steps of them in matrix mode, where the sum over concepts must have moved by less than the threshold. The
    states end with number s + extra_steps - 1; in matrix mode at most max_iter - 1 are kept.
    """

    def __init__(self, s: Settings, rows: int) -> None:
        self.s, self.matrix = s, s.mode == "matrix"
        self.need = s.extra_steps if self.matrix else s.extra_steps - 1
        #: Most states of a row in matrix mode.
        self.limit = max(s.max_iter - 1, 1)
        self.begin, self.streak = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.count = np.full(rows, 1 if self.need == 0 else 0)

    def after(self, t: int, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Take in state t of all rows, given concepts by rows; gives the rows in which it begins a run of stable ones."""
        s = self.s
        if self.matrix:
            stable = np.abs(new.sum(axis=0) - old.sum(axis=0)) < s.stability_diff
        elif t >= s.max_iter - 1:
            stable = np.ones(new.shape[1], bool)
        else:
            stable = (np.abs(new - old) <= s.stability_diff).all(axis=0) if s.stabilize else np.zeros(new.shape[1], bool)
        first = stable & (self.streak == 0)
        self.begin[first] = t
        self.streak = np.where(stable, self.streak + 1, 0)
        ends = (self.count == 0) & (self.streak >= self.need)
        self.count[ends] = self.begin[ends] + s.extra_steps
        return first

    def over(self, t: int) -> np.ndarray:
        """Rows whose last state is number t or an earlier one."""
        return (self.count > 0) & (self.count <= t + 1) | (self.matrix and t + 1 >= self.limit)

    def counts(self) -> np.ndarray:
        """How many states the rows have, once they are over."""
        return np.where(self.count == 0, self.limit, np.minimum(self.count, self.limit)) if self.matrix else self.count

    def keep(self, rows: np.ndarray) -> None:
        self.begin, self.streak, self.count = self.begin[rows], self.streak[rows], self.count[rows]


def trajectories(c: Compiled, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States (steps x rows x concepts) from the start states ``x``, and how many of them are each row's own (see ``_Stop``)."""
    stop = _Stop(c.settings, len(x))
    states = [x]
    while not stop.over(len(states) - 1).all():
        states.append(c.step(states[-1]))
        stop.after(len(states) - 1, states[-2].T, states[-1].T)
    count = stop.counts()
    return np.stack(states[: count.max(initial=1)]), count


def decided(c: Compiled, x: np.ndarray) -> np.ndarray:
    """One value for each row and concept from its states; p is the last state before the stable ones (s - 1 of ``_Stop``).

    LAST: state p. MEAN: the mean of states 0 to p. EXITED: the greatest of the states before p; with p = 0 there is none and the
    value is null (NaN). With p <= 0 (EXITED: p < 0) and with the full window, all states count.

    No states are kept but the last: a running sum or maximum goes along, and where a run of stable states begins it is noted what
    it was before. Rows that have all their states leave.
    """
    s = c.settings
    full = s.decision_window == "full"
    # Concepts by rows, so that sums over concepts run along the rows.
    x = np.ascontiguousarray(x.T)
    out = np.empty_like(x)
    row, stop, t = np.arange(x.shape[1]), _Stop(s, x.shape[1]), 0
    # Sum or maximum of the states so far, as the decision needs; for the maximum also that before the last state.
    upto, before = x.copy(), np.full_like(x, -np.inf)
    # What the decision would be if the run of stable states that began last is the one that ends them, and if the limit does.
    noted, at_limit = np.full_like(x, np.nan), np.full_like(x, np.nan)
    p, limit_p = np.full(x.shape[1], -1), stop.limit - s.extra_steps - 1

    def leave(gone: np.ndarray) -> None:
        n = stop.counts()[gone]
        end = np.full(len(n), -1) if full else n - s.extra_steps - 1
        part = np.where(end == p[gone], noted[:, gone], at_limit[:, gone])
        if s.decision == "LAST":
            out[:, row[gone]] = np.where(end > 0, part, x[:, gone])
        elif s.decision == "MEAN":
            out[:, row[gone]] = np.where(end > 0, part, upto[:, gone]) / np.where(end > 0, end + 1, n)
        else:
            best = np.where(end >= 0, part, upto[:, gone])
            out[:, row[gone]] = np.where(np.isneginf(best), np.nan, best)

    while len(row):
        gone = stop.over(t)
        if gone.any():
            leave(gone)
            stay = ~gone
            row, p = row[stay], p[stay]
            x, upto, before, noted, at_limit = (a[:, stay] for a in (x, upto, before, noted, at_limit))
            stop.keep(stay)
            if not len(row):
                break
        now = {"LAST": x, "MEAN": upto, "EXITED": before}[s.decision]
        if stop.matrix and t == limit_p:
            at_limit = now.copy()
        new = c.move(x)
        t += 1
        first = stop.after(t, x, new)
        if first.any():
            # State t begins the run, so p is t - 1.
            noted[:, first] = now[:, first]
            p[first] = t - 1
        if s.decision == "EXITED":
            before, upto = upto, np.maximum(upto, new)
        elif s.decision == "MEAN":
            upto = upto + new
        x = new
    return out.T


def _parts(c: Compiled, n: int, all_states: bool) -> Iterator[slice]:
    longest = c.settings.max_iter + c.settings.extra_steps
    size = max(1, HELD // max(1, longest * len(c.names))) if all_states else max(1, TOGETHER // max(1, len(c.names) // 8))
    for k in range(0, n, size):
        yield slice(k, k + size)


def starts(c: Compiled, batch: pa.RecordBatch, inputs: dict[str, str]) -> np.ndarray:
    """Start states: the map's own values, and for input concepts the row's; null and NaN give 0. Fuzzy inputs take their membership."""
    x = np.tile(c.start, (len(batch), 1))
    for concept, column in inputs.items():
        i = c.names.index(concept)
        v = np.nan_to_num(np.asarray(batch.column(column).to_numpy(zero_copy_only=False), float))
        x[:, i] = v if c.raw[i] is None else c.raw[i].array(v)
    return x


def infer(df: DataFrame, m: CognitiveMap, inputs: dict[str, str | Column], keep: list[str], outputs: dict[str, str]) -> DataFrame:
    """Columns ``keep`` of each row and, as doubles, the decided values of the concepts ``outputs`` (concept -> column name).

    inputs: concept -> column (or expression) with its start value. One pass without a shuffle.
    """
    c = compile_map(m)
    unknown = [n for n in [*inputs, *outputs] if n not in c.names]
    if unknown:
        raise ValueError(f"unknown concepts: {', '.join(unknown)}")
    fed = {concept: f"_in{i}" for i, concept in enumerate(inputs)}
    source = df.select(*keep, *[(F.col(v) if isinstance(v, str) else v).cast("double").alias(fed[k]) for k, v in inputs.items()])
    schema = T.StructType([*source.schema.fields[: len(keep)], *[T.StructField(n, T.DoubleType()) for n in outputs.values()]])
    at = [c.names.index(n) for n in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = starts(c, batch, fed)
            out = np.empty((len(x), len(at)))
            for part in _parts(c, len(x), False):
                out[part] = decided(c, x[part])[:, at]
            cols = [pa.array(out[:, i], mask=np.isnan(out[:, i])) for i in range(len(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *cols], [*keep, *outputs.values()])

    return spread(source).mapInArrow(run, schema)


def trace(df: DataFrame, m: CognitiveMap, inputs: dict[str, str | Column], keep: list[str]) -> DataFrame:
    """Every state of every row: columns ``keep``, concept, step, value."""
    c = compile_map(m)
    fed = {concept: f"_in{i}" for i, concept in enumerate(inputs)}
    source = df.select(*keep, *[(F.col(v) if isinstance(v, str) else v).cast("double").alias(fed[k]) for k, v in inputs.items()])
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("concept", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(c.names)
        for batch in batches:
            x = starts(c, batch, fed)
            for part in _parts(c, len(x), True):
                states, count = trajectories(c, x[part])
                step, row, concept = np.nonzero(np.broadcast_to(np.arange(len(states))[:, None, None] < count[None, :, None], states.shape))
                again = pa.array(row + part.start)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(again) for k in keep), names.take(pa.array(concept)), pa.array(step, pa.int32()), pa.array(states[step, row, concept])], [*keep, "concept", "step", "value"])

    return spread(source).mapInArrow(run, schema)


def run_map(m: CognitiveMap) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Decided value and states of each concept of one map, from its own start values, on the driver."""
    c = compile_map(m)
    states, count = trajectories(c, c.start[None, :])
    value = decided(c, c.start[None, :])[0]
    return dict(zip(c.names, value.tolist(), strict=True)), {n: states[: count[0], 0, i].tolist() for i, n in enumerate(c.names)}


def is_stable(m: CognitiveMap, states: dict[str, list[float]]) -> bool:
    """Whether no concept has moved by more than the threshold in the last step; False before any step."""
    return all(len(v) > 1 and abs(v[-1] - v[-2]) <= m.settings.stability_diff for v in states.values())


def final_state(m: CognitiveMap, kind: str = "target", names: tuple[str, ...] = ()) -> dict[str, float]:
    value, _ = run_map(m)
    return {n: value[n] for n in m.select(kind, names)}
