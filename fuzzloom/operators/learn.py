"""Learning a map from a table: features to concepts, concept pairs to weighted relations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzloom.functions.activations import FuzzySet
from fuzzloom.functions.measures import Measure, measure
from fuzzloom.model import DECISION, FUZZY, REGRESSOR, SIMPLE, CognitiveMap, Settings
from fuzzloom.operators.contingency import memberships_contingency
from fuzzloom.operators.discretize import column_sets

#: Distinct values from which a numeric column is continuous.
CONTINUOUS = 10
#: Most values of a discrete feature, each of which becomes a concept.
MOST_VALUES = 4096


@dataclass(frozen=True)
class FeatureConcept:
    """A concept that stands for a value of a discrete feature or for a cluster of a continuous one."""

    name: str
    feature: str
    info: str
    value: object = None
    fuzzy: FuzzySet | None = None

    def member(self) -> tuple[Column, FuzzySet | None]:
        """What a row's membership comes from: 1 or 0 for a value, the feature itself and the set for a cluster."""
        if self.fuzzy is not None:
            return F.col(self.feature).cast("double"), self.fuzzy
        return F.coalesce((F.col(self.feature) == F.lit(self.value)).cast("double"), F.lit(0.0)), None


@dataclass(frozen=True)
class Rules:
    """How relations come from counts. Measures are names or builders of a column from four columns.

    causality gives the weight; evaluate must exceed threshold in size; sign, if given, makes weights negative where it is below
    sign_threshold. both: relations in both directions, else one: from other features to targets, or within a group of features
    by the greater weight (none if level). all_pairs: also between features that aren't targets. exclusion: weight between
    concepts of one feature, 0 for none.
    """

    causality: str | Measure = "pos_inf"
    evaluate: str | Measure = "supp"
    threshold: float = 0.0
    sign: str | Measure | None = None
    sign_threshold: float = 0.0
    both: bool = True
    all_pairs: bool = True
    exclusion: float = -1.0
    separator: str = "___"


@dataclass(frozen=True)
class Learned:
    map: CognitiveMap
    concepts: tuple[FeatureConcept, ...]
    targets: tuple[str, ...]
    types: dict[str, str] = field(default_factory=dict)


def feature_types(df: DataFrame, columns: list[str], infer: bool = True) -> DataFrame:
    """(feature, n_unique, kind): discrete for text and booleans, and for numbers with fewer than ``CONTINUOUS`` distinct values;
    else continuous. Without ``infer`` all numbers are continuous. One aggregate over all columns; null isn't a value."""
    numeric = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    row = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns])
    kind = lambda c: F.lit("discrete") if not numeric[c] else F.when((F.col(c) < CONTINUOUS) & F.lit(infer), "discrete").otherwise("continuous")
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_unique"), kind(c).alias("kind")) for c in columns])))


def observed(df: DataFrame, columns: list[str], infer: bool = True, most: int = MOST_VALUES) -> tuple[dict[str, str], dict[str, list]]:
    """The kind of each column (see ``feature_types``) and the rising values of the discrete ones, from one pass.

    Each task keeps of a column no more values than tell that it is continuous, or one more than ``most``, so neither rows nor
    columns are multiplied and what reaches the driver is bounded. A discrete column with more values is an error: it isn't a feature
    but a key or a text, and a map can't have a concept for each.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = {c: isinstance(kinds[c], T.NumericType) for c in columns}
    enough = {c: (CONTINUOUS if infer else 1) if numeric[c] else most + 1 for c in columns}
    source = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in columns]
        for batch in batches:
            for i, c in enumerate(columns):
                if len(seen[i]) < enough[c]:
                    fresh = seen[i].union(pc.unique(batch.column(i)).to_pylist()) - {None}
                    seen[i] = fresh if len(fresh) <= enough[c] else set(sorted(fresh)[: enough[c]])
        rows = [(c, v) for c, values in zip(columns, seen, strict=True) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["feature", "value"])

    first = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    found = source.mapInArrow(run, "feature string, value string").distinct().withColumn("_no", first).filter(F.col("_no") <= max(most + 1, CONTINUOUS))
    values: dict[str, list] = {c: [] for c in columns}
    for r in found.collect():
        values[r.feature].append(r.value)
    types = {c: "continuous" if numeric[c] and (not infer or len(values[c]) >= CONTINUOUS) else "discrete" for c in columns}
    of_kind = {T.BooleanType: lambda v: v == "true", T.DecimalType: Decimal, T.FloatType: float, T.DoubleType: float, T.StringType: str}
    out = {}
    for c in columns:
        if types[c] == "discrete":
            if len(values[c]) > most:
                raise ValueError(f"column {c} has more than {most} values; a discrete feature has a concept for each")
            out[c] = sorted(map(of_kind.get(type(kinds[c]), int if numeric[c] else str), values[c]))
    return types, out


def discrete_concepts(df: DataFrame, columns: list[str], separator: str = "___") -> DataFrame:
    """(feature, info, concept) of each distinct value, null not being one; all columns in one pass."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("info")) for c in columns]))
    return df.select(each).filter("info IS NOT NULL").distinct().select("feature", "info", F.concat("info", F.lit(separator), "feature").alias("concept"))


def inner_relations(concepts: DataFrame, exclusion: float = -1.0) -> DataFrame:
    """Both relations between any two concepts of one feature: (origin, destiny, weight)."""
    a, b = concepts.select("feature", F.col("concept").alias("origin")), concepts.select("feature", F.col("concept").alias("destiny"))
    return a.join(b, "feature").filter("origin <> destiny").select("origin", "destiny", F.lit(float(exclusion)).alias("weight"))


def weigh(pairs: DataFrame, rules: Rules) -> DataFrame:
    """(origin, destiny, weight) from counts in both directions, with the columns of ``pairs_of``; zero weights are none.

    If ``pairs`` has ``group`` columns p_target and q_target, single directions follow them.
    """
    four = [F.col(c) for c in ("p_q", "p_nq", "np_q", "np_nq")]
    cause = measure(rules.causality)(*four)
    sign = F.lit(1.0) if rules.sign is None else F.when(F.lit(rules.sign_threshold) > measure(rules.sign)(*four), F.lit(-1.0)).otherwise(F.lit(1.0))
    weighed = pairs.select("*", cause.alias("_cause"), (sign * cause).alias("weight"), measure(rules.evaluate)(*four).alias("_eval"))
    if not rules.both:
        back = four[0], four[2], four[1], four[3]
        reverse = measure(rules.causality)(*back)
        same = F.col("p_target") == F.col("q_target")
        weighed = weighed.filter(F.when(same, F.abs("_cause") > F.abs(reverse)).otherwise(F.col("q_target")))
    if not rules.all_pairs:
        weighed = weighed.filter(F.col("p_target") | F.col("q_target"))
    kept = weighed.filter((F.abs("_eval") > rules.threshold) & (F.col("weight") != 0) & F.col("weight").isNotNull())
    return kept.select(F.col("concept_p").alias("origin"), F.col("concept_q").alias("destiny"), "weight")


def learn(df: DataFrame, features: list[str], targets: list[str], rules: Rules | None = None, settings: Settings | None = None, strategy: str = "cmeans-gap", max_clusters: int = 7, seed: int = 0, infer: bool = True, excitation: str = "KOSKO") -> Learned:
    """A map over the concepts of ``features`` and ``targets``, in column order and rising order of value.

    Rows are read for the features' types and values, and once for all counts; only aggregates reach the driver.
    """
    rules, settings = rules or Rules(), settings or Settings()
    columns = [*features, *[t for t in targets if t not in features]]
    types, value_sets = observed(df, columns, infer)
    concepts: list[FeatureConcept] = []
    for c in columns:
        if types[c] == "discrete":
            concepts += [FeatureConcept(f"{v}{rules.separator}{c}", c, str(v), value=v) for v in value_sets[c]]
        else:
            sets = column_sets(df, c, strategy, max_clusters, seed=seed)
            concepts += [FeatureConcept(f"{i}{rules.separator}{c}", c, str(i), fuzzy=s) for i, s in enumerate(sets)]
    m = CognitiveMap(settings)
    for k in concepts:
        target = k.feature in targets
        kind = (REGRESSOR if target else FUZZY) if k.fuzzy else (DECISION if target else SIMPLE)
        m = m.add_concept(k.name, kind=kind, fuzzy=k.fuzzy, excitation=excitation)
    by_feature: dict[str, list[str]] = {}
    for k in concepts:
        by_feature.setdefault(k.feature, []).append(k.name)
    if rules.exclusion:
        for names in by_feature.values():
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    m = m.add_relation(a, b, rules.exclusion).add_relation(b, a, rules.exclusion)
    counts = memberships_contingency(df, {k.name: k.member() for k in concepts})
    feature = {k.name: k.feature for k in concepts}
    rows = [(p, q, feature[p] in targets, feature[q] in targets, *c) for (p, q), c in counts.items() if feature[p] != feature[q]]
    if rows:
        pairs = df.sparkSession.createDataFrame(rows, "concept_p string, concept_q string, p_target boolean, q_target boolean, p_q double, p_nq double, np_q double, np_nq double")
        order = {n: i for i, n in enumerate(feature)}
        for o, d, w in sorted(map(tuple, weigh(pairs, rules).collect()), key=lambda r: (order[r[0]], order[r[1]])):
            m = m.add_relation(o, d, w)
    return Learned(m, tuple(concepts), tuple(targets), types)
