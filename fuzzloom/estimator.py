"""Fit, predict and score in the manner of an estimator, over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.model import CognitiveMap, Settings
from fuzzloom.operators.kernel import infer
from fuzzloom.operators.learn import Learned, Rules, learn


class MapEstimator:
    """Learns a map from a table and tells the classes of rows by running it.

    Discrete target columns are predicted; a continuous target takes part in the map but gives no prediction.
    """

    def __init__(self, rules: Rules | None = None, settings: Settings | None = None, strategy: str = "cmeans-gap", max_clusters: int = 7, seed: int = 0, infer_types: bool = True, excitation: str = "KOSKO") -> None:
        self.rules = rules or Rules()
        self.settings = settings or Settings(max_iter=250, mode="matrix")
        self.options = {"strategy": strategy, "max_clusters": max_clusters, "seed": seed, "infer": infer_types, "excitation": excitation}
        self.learned: Learned | None = None

    def fit(self, df: DataFrame, targets: list[str], features: list[str] | None = None) -> MapEstimator:
        if not isinstance(df, DataFrame):
            raise TypeError("fit takes a DataFrame")
        missing = [c for c in [*targets, *(features or [])] if c not in df.columns]
        if missing or not targets:
            raise ValueError(f"no such columns: {', '.join(missing)}" if missing else "no target")
        self.learned = learn(df, features or [c for c in df.columns if c not in targets], targets, self.rules, self.settings, **self.options)
        return self

    def _fitted(self) -> Learned:
        if self.learned is None:
            raise RuntimeError("not fitted")
        return self.learned

    @property
    def map(self) -> CognitiveMap:
        return self._fitted().map

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Columns ``keep`` (all by default) and ``predicted_<target>``: the value of the most active concept, the first of equals.

        Targets' own columns aren't looked at. Values that weren't learned start no concept.
        """
        learned = self._fitted()
        keep = df.columns if keep is None else keep
        inputs = {c.name: c.member()[0] for c in learned.concepts if c.feature not in learned.targets and c.feature in df.columns}
        decided = [c for c in learned.concepts if c.feature in learned.targets and c.fuzzy is None]
        names = {c.name: f"_out{i}" for i, c in enumerate(decided)}
        out = infer(df, learned.map, inputs, keep, names)
        picked = [self._pick([c for c in decided if c.feature == t], names).alias(f"predicted_{t}") for t in learned.targets if any(c.feature == t for c in decided)]
        return out.select(*keep, *picked)

    @staticmethod
    def _pick(concepts, names: dict[str, str]) -> Column:
        top = F.greatest(*[F.col(names[c.name]) for c in concepts]) if len(concepts) > 1 else F.col(names[concepts[0].name])
        return F.coalesce(*[F.when(F.col(names[c.name]) == top, F.lit(c.value)) for c in concepts])

    def score(self, df: DataFrame) -> float:
        """Share of right cells over all predicted targets; null where a target's value is null counts as wrong."""
        targets = [t for t in self._fitted().targets]
        predicted = self.predict(df, keep=targets)
        have = [t for t in targets if f"predicted_{t}" in predicted.columns]
        right = reduce(lambda a, b: a + b, [F.coalesce((F.col(t) == F.col(f"predicted_{t}")).cast("double"), F.lit(0.0)) for t in have])
        return predicted.agg(F.avg(right / len(have))).first()[0]
