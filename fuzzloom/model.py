"""Fuzzy cognitive maps: concepts, weighted relations and settings, as immutable values on the driver.

A map is small; what grows is the table of rows that it is run over. Every change gives a new map.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzloom.functions.activations import FuzzySet, activation, fuzzy_set, set_args

SIMPLE, DECISION, FUZZY, REGRESSOR, MULTI, MULTI_DESC = "SIMPLE", "DECISION", "FUZZY", "REGRESSOR", "MULTI", "MULTI_DESC"
KINDS = (SIMPLE, DECISION, FUZZY, REGRESSOR, MULTI, MULTI_DESC)
TARGETS = (DECISION, REGRESSOR)
EXCITATIONS = ("KOSKO", "PAPAGEORGIUS")
DECISIONS = ("LAST", "MEAN", "EXITED")

CONCEPT_SCHEMA = "concept string, kind string, is_active boolean, use_memory boolean, excitation string, activation string, args map<string,double>, use_map_function boolean, fuzzy_values array<double>, fuzzy_membership array<double>, value double, pos int"
RELATION_SCHEMA = "origin string, destiny string, weight double, seq long"


@dataclass(frozen=True)
class Settings:
    """How a map is run. ``decision_window``: ``stable`` reduces the states before the stable ones, ``full`` all states."""

    max_iter: int = 200
    extra_steps: int = 5
    stabilize: bool = True
    stability_diff: float = 0.001
    decision: str = "MEAN"
    memory: bool = True
    activation: str = "sigmoid_hip"
    args: tuple[tuple[str, float], ...] = ()
    weight: float = 1.0
    mode: str = "iterative"
    decision_window: str = "stable"

    def __post_init__(self) -> None:
        if self.extra_steps <= 0:
            object.__setattr__(self, "extra_steps", 1)
        if self.decision not in DECISIONS:
            raise ValueError(f"unknown decision function: {self.decision}")
        if self.mode not in ("iterative", "matrix"):
            raise ValueError(f"unknown mode: {self.mode}")
        if self.decision_window not in ("stable", "full"):
            raise ValueError(f"unknown decision window: {self.decision_window}")
        activation(self.activation)


@dataclass(frozen=True)
class Concept:
    """``memory`` and ``activation`` of None follow the map. ``fuzzy`` (raw points) takes the place of an activation."""

    name: str
    kind: str = SIMPLE
    active: bool = True
    memory: bool | None = None
    excitation: str = "KOSKO"
    activation: str | None = None
    args: tuple[tuple[str, float], ...] = ()
    fuzzy: FuzzySet | None = None
    value: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown concept type: {self.kind}")
        if self.excitation not in EXCITATIONS:
            raise ValueError(f"unknown excitation function: {self.excitation}")
        if self.activation is not None:
            activation(self.activation)


def vector(args: dict[str, float | Iterable[float]]) -> list[float]:
    """Arguments as numbers, by name and flattened."""
    out: list[float] = []
    for name in sorted(args):
        value = args[name]
        out.extend(map(float, value) if isinstance(value, Iterable) else [float(value)])
    return out


@dataclass(frozen=True)
class CognitiveMap:
    settings: Settings = field(default_factory=Settings)
    concepts: tuple[Concept, ...] = ()
    relations: tuple[tuple[str, str, float], ...] = ()
    defaults: Concept = field(default_factory=lambda: Concept("default"))
    inclination: float | None = None

    # --- definition

    def add_concept(self, name: str, **properties) -> CognitiveMap:
        """Add a concept or define it anew with value 0, keeping its place and relations; unset properties are the defaults'."""
        return self._put(replace(self.defaults, name=name, value=0.0, **_properties(properties)))

    def set_concept(self, name: str, **properties) -> CognitiveMap:
        """Change properties of a concept; memory and activation that aren't given follow the map again."""
        old = self.concept(name)
        if old is None:
            raise ValueError(f"unknown concept: {name}")
        new = _properties(properties)
        if not {"activation", "fuzzy"} & set(new):
            new |= {"activation": None, "args": (), "fuzzy": None}
        return self._put(replace(old, **({"memory": None} | new)))

    def set_defaults(self, **properties) -> CognitiveMap:
        """Properties of concepts added later."""
        return replace(self, defaults=replace(Concept("default"), **_properties(properties)))

    def set_activation(self, name: str, **args: float) -> CognitiveMap:
        """The function of all concepts that follow the map, also of those added later."""
        return replace(self, settings=replace(self.settings, activation=name, args=_pairs(args)))

    def set_decision(self, name: str) -> CognitiveMap:
        return replace(self, settings=replace(self.settings, decision=name))

    def add_relation(self, origin: str, destiny: str, weight: float) -> CognitiveMap:
        """Add a relation, also beside an equal one; ignored if an end isn't there."""
        if self.concept(origin) is None or self.concept(destiny) is None:
            return self
        return replace(self, relations=(*self.relations, (origin, destiny, float(weight))))

    def init_concept(self, name: str, value: float, required: bool = True) -> CognitiveMap:
        """Start value of a concept; a fuzzy one takes its membership of the value."""
        old = self.concept(name)
        if old is None:
            if required:
                raise ValueError(f"unknown concept: {name}")
            return self
        if old.fuzzy is not None:
            value = float(old.fuzzy.array(np.array([float(value)]))[0])
        return self._put(replace(old, value=float(value)))

    def cleared(self) -> CognitiveMap:
        """All values 0."""
        return replace(self, concepts=tuple(replace(c, value=0.0) for c in self.concepts))

    def _put(self, concept: Concept) -> CognitiveMap:
        if self.concept(concept.name) is None:
            return replace(self, concepts=(*self.concepts, concept))
        return replace(self, concepts=tuple(concept if c.name == concept.name else c for c in self.concepts))

    # --- lookup

    def concept(self, name: str) -> Concept | None:
        return next((c for c in self.concepts if c.name == name), None)

    def value(self, name: str) -> float | None:
        c = self.concept(name)
        return None if c is None else c.value

    def outgoing(self, name: str) -> list[tuple[str, float]]:
        return [(d, w) for o, d, w in self.relations if o == name]

    def incoming_sum(self, name: str) -> float:
        return sum(w for _, d, w in self.relations if d == name)

    def uses_memory(self, c: Concept) -> bool:
        return self.settings.memory if c.memory is None else c.memory

    def function(self, c: Concept) -> tuple[str, dict[str, float]]:
        """Name and arguments of the activation; with ``inclination`` y, a sigmoid's lambda is such that it gives y at the size of
        its incoming weights."""
        name, args = (self.settings.activation, dict(self.settings.args)) if c.activation is None else (c.activation, dict(c.args))
        x = abs(self.incoming_sum(c.name))
        if self.inclination is not None and c.fuzzy is None and x:
            y = self.inclination
            if name == "sigmoid":
                args = {"lambda_val": float(-np.log(1 / y - 1) / x)}
            elif name in ("sigmoid_hip", "tan_hip"):
                args = {"lambda_val": float(-np.log((1 - y) / (1 + y)) / x)}
            elif name == "relm":
                args = {"lambda_val": 1.0}
        return name, args

    def select(self, kind: str = "target", names: Iterable[str] = ()) -> list[str]:
        """Concept names: those given, else all (``any``), targets (``target``) or those of a type."""
        wanted = set(names)
        if wanted:
            return [c.name for c in self.concepts if c.name in wanted]
        if kind == "any":
            return [c.name for c in self.concepts]
        return [c.name for c in self.concepts if (c.kind in TARGETS if kind == "target" else c.kind == kind)]

    # --- as tables

    def concept_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.kind, c.active, self.uses_memory(c), c.excitation, *_named(self, c), c.activation is None and c.fuzzy is None, list(c.fuzzy.values) if c.fuzzy else None, list(c.fuzzy.membership) if c.fuzzy else None, c.value, i) for i, c in enumerate(self.concepts)]
        return spark.createDataFrame(rows, CONCEPT_SCHEMA)

    def relation_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*r, i) for i, r in enumerate(self.relations)], RELATION_SCHEMA)

    def topology(self, spark: SparkSession) -> DataFrame:
        """Undirected edges, each once."""
        return self.relation_frame(spark).select(F.least("origin", "destiny").alias("a"), F.greatest("origin", "destiny").alias("b")).distinct()


def _named(m: CognitiveMap, c: Concept) -> tuple[str, dict[str, float]]:
    return ("fuzzy", {}) if c.fuzzy else m.function(c)


def _pairs(args: dict[str, float]) -> tuple[tuple[str, float], ...]:
    return tuple(sorted((k, float(v)) for k, v in args.items()))


def _properties(given: dict) -> dict:
    """Properties of a concept from keyword arguments; others are arguments of the activation."""
    known = {k: v for k, v in given.items() if k in Concept.__dataclass_fields__ and k not in ("name", "args")}
    args = {k: v for k, v in given.items() if k not in known and k != "args"} | dict(given.get("args") or {})
    if known.get("fuzzy") is not None and not isinstance(known["fuzzy"], FuzzySet):
        known["fuzzy"] = fuzzy_set(known["fuzzy"])
    if args:
        known["args"] = _pairs(args)
    return known


# --- JSON


def to_json(m: CognitiveMap) -> str:
    """The map as JSON text. All properties come back by ``from_json``, also types, activity, memory, excitation and fuzzy sets."""
    s = m.settings
    out: dict = {
        "max_iter": s.max_iter, "extra_steps": s.extra_steps, "stop_at_stabilize": s.stabilize, "stability_diff": s.stability_diff, "decision_function": s.decision,
        "memory_influence": s.memory, "activation_function": s.activation, "weight": s.weight, "concepts": [], "relations": [],
    }
    if s.args:
        out["activation_function_args"] = dict(s.args)
    for c in m.concepts:
        d: dict = {"id": c.name, "type": c.kind, "activation": c.value, "is_active": c.active}
        if c.memory is not None and c.memory != s.memory:
            d["use_memory"] = c.memory
        if c.excitation != "KOSKO":
            d["excitation_function"] = c.excitation
        if c.fuzzy is not None:
            d |= {"custom_function": "fuzzy", "custom_function_args": set_args(c.fuzzy)}
        elif c.activation is not None:
            d["custom_function"] = c.activation
            if c.args:
                d["custom_function_args"] = dict(c.args)
        out["concepts"].append(d)
    out["relations"] = [{"origin": o, "destiny": d, "weight": w} for o, d, w in m.relations]
    return json.dumps(out, ensure_ascii=False)


def from_json(text: str) -> CognitiveMap:
    """The map of a JSON text; members that it lacks have their defaults. Every failure is a ``ValueError``.

    ``activation`` is the concept's start value as it is stored, for fuzzy concepts the membership. Both spellings of a concept's
    activity (``is_active``, ``active``) and memory (``use_memory``, ``memory_influence``) are read.
    """
    try:
        d = json.loads(text)
        s = Settings(
            max_iter=int(d.get("max_iter", 200)), extra_steps=int(d.get("extra_steps", 5)), stabilize=bool(d.get("stop_at_stabilize", True)),
            stability_diff=float(d.get("stability_diff", 0.001)), decision=d.get("decision_function", "MEAN"), memory=bool(d.get("memory_influence", True)),
            activation=d.get("activation_function", "sigmoid_hip"), args=_pairs(d.get("activation_function_args") or {}), weight=float(d.get("weight", 1.0)),
        )
        m = CognitiveMap(s)
        for c in d.get("concepts") or []:
            args = c.get("custom_function_args") or {}
            name = c.get("custom_function")
            points = c.get("activation_dict") or (args if name == "fuzzy" else None)
            m = m._put(Concept(
                str(c["id"]), c.get("type") or SIMPLE, bool(c.get("is_active", c.get("active", True))), c.get("use_memory", c.get("memory_influence")), c.get("excitation_function") or "KOSKO",
                None if points else name, () if points or not name else _pairs(args), fuzzy_set(points) if points else None, float(c.get("activation") or 0.0),
            ))
        for r in d.get("relations") or []:
            m = m.add_relation(str(r["origin"]), str(r["destiny"]), float(r["weight"]))
        return m
    except Exception as e:
        raise ValueError(f"Cannot load json data due: {e}") from e
