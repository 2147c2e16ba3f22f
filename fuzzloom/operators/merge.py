"""Several maps as one, as operations on their concept and relation tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzloom.model import CognitiveMap

CONCEPT_STRATEGIES = ("union", "intersection")
VALUE_STRATEGIES = {"highest": F.max, "lowest": F.min, "average": F.avg}


def _check(concepts: str, values: str, relations: str) -> None:
    if concepts not in CONCEPT_STRATEGIES:
        raise ValueError(f"Unknown concept strategy: {concepts}")
    for what, name in (("value", values), ("relation", relations)):
        if name not in VALUE_STRATEGIES:
            raise ValueError(f"Unknown {what} strategy: {name}")


def merge_frames(concepts: DataFrame, relations: DataFrame, concept_strategy: str = "union", value_strategy: str = "highest", relation_strategy: str = "highest", ignore_zeros: bool = False) -> tuple[DataFrame, DataFrame]:
    """concepts (map_no, concept, value) and relations (map_no, origin, destiny, weight) -> (concept, value), (origin, destiny, weight).

    Values are merged over the maps that have the concept, weights over all relations between two concepts; a relation stays if
    both its ends do. Ends are compared as columns, so no name can run into another. Works for any number of maps.
    """
    _check(concept_strategy, value_strategy, relation_strategy)
    merged = concepts.groupBy("concept").agg(VALUE_STRATEGIES[value_strategy]("value").alias("value"), F.count_distinct("map_no").alias("_maps"))
    if concept_strategy == "intersection":
        every = concepts.agg(F.count_distinct("map_no").alias("_all"))
        merged = merged.join(F.broadcast(every), F.col("_maps") == F.col("_all"))
    if ignore_zeros:
        merged = merged.filter("value <> 0")
    merged = merged.select("concept", "value")
    strongest: Column = VALUE_STRATEGIES[relation_strategy]("weight").alias("weight")
    arcs = relations.groupBy("origin", "destiny").agg(strongest)
    for end in ("origin", "destiny"):
        arcs = arcs.join(merged.select(F.col("concept").alias(end)), end, "left_semi")
    return merged, arcs.select("origin", "destiny", "weight")


def join_maps(spark: SparkSession, maps: list[CognitiveMap], concept_strategy: str = "union", value_strategy: str = "highest", relation_strategy: str = "highest", ignore_zeros: bool = False) -> CognitiveMap:
    """One map from several: settings of the first, each concept's definition from the first map that has it; of none, a default map."""
    _check(concept_strategy, value_strategy, relation_strategy)
    if not maps:
        return CognitiveMap()
    definition = {}
    for m in maps:
        for c in m.concepts:
            definition.setdefault(c.name, c)
    concepts = spark.createDataFrame([(i, c.name, c.value) for i, m in enumerate(maps) for c in m.concepts], "map_no int, concept string, value double")
    relations = spark.createDataFrame([(i, *r) for i, m in enumerate(maps) for r in m.relations], "map_no int, origin string, destiny string, weight double")
    values, arcs = merge_frames(concepts, relations, concept_strategy, value_strategy, relation_strategy, ignore_zeros)
    value = {r.concept: r.value for r in values.collect()}
    out = CognitiveMap(maps[0].settings, tuple(replace(c, value=value[n]) for n, c in definition.items() if n in value))
    order = {n: i for i, n in enumerate(definition)}
    for r in sorted(arcs.collect(), key=lambda r: (order[r.origin], order[r.destiny])):
        out = out.add_relation(r.origin, r.destiny, r.weight)
    return out
