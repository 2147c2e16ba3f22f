"""Queries over maps: functions, learning, inference, merging, discretization and sources; each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzloom.estimator import MapEstimator
from fuzzloom.functions.activations import ACTIVATIONS, FuzzySet, inclination, memberships
from fuzzloom.functions.measures import MEASURES
from fuzzloom.model import CognitiveMap, Settings, from_json, to_json
from fuzzloom.operators.contingency import contingency_frame, discrete_pair
from fuzzloom.operators.discretize import FUZZIFIER, cmeans, distinct_values, fuzzy_entropy, nearest_frame, partition, partition_coefficient, rl_cmeans, silhouette, three_clusters_frame
from fuzzloom.operators.kernel import infer, trace
from fuzzloom.operators.learn import Rules, discrete_concepts, feature_types, inner_relations, learn, weigh
from fuzzloom.operators.merge import merge_frames
from fuzzloom.scratch import place
from fuzzloom.sources.datasets import factorize, factorize_some, load_arff, load_csv_dataset, load_dataset, split_plain, summary
from fuzzloom.streaming.scoring import drain, read_stream, score_stream

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scalar functions

_V = "(c_acctbal / 1000.0::DOUBLE)"
_CLAMP = f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_V}))"
_ACTIVATION_SQL = {
    "biestate": f"CASE WHEN {_V} <= 0 THEN 0.0 ELSE 1.0 END",
    "threestate": f"CASE WHEN {_V} <= 1.0::DOUBLE / 3 THEN 0.0 WHEN {_V} <= 2.0::DOUBLE / 3 THEN 0.5 ELSE 1.0 END",
    "saturation": f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_V}))",
    "sigmoid": f"1 / (1 + exp(-1.0::DOUBLE * {_V}))",
    "sigmoid_hip": f"(1 - exp(-2.0::DOUBLE * {_V})) / (1 + exp(-2.0::DOUBLE * {_V}))",
    "gceq": f"CASE WHEN {_V} >= 0.25::DOUBLE THEN {_CLAMP} ELSE 0.0 END",
    "lceq": f"CASE WHEN {_V} <= 0.25::DOUBLE THEN {_CLAMP} ELSE 0.0 END",
    "relm": f"CASE WHEN {_V} < 0 THEN 0.0 ELSE least(1.0::DOUBLE, {_V} / 3.0::DOUBLE) END",
}
_ACTIVATION_ARG = {"gceq": 0.25, "lceq": 0.25, "relm": 3.0}


def _act(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.col("c_acctbal") / 1000.0
        f = ACTIVATIONS[name]
        out = f.column(v, _ACTIVATION_ARG[name]) if name in _ACTIVATION_ARG else f.column(v)
        return _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(out.cast("double")), 6).alias("total"))

    return query


PRICES = FuzzySet.of([900.0, 1000.0, 1200.0, 1500.0, 1800.0], [0.1, 0.4, 1.0, 0.6, 0.2])


def act_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PRICES.column(F.col("p_retailprice"))
    return _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum(m), 6).alias("total"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct value's membership, as a table instead of a plot."""
    return _table(spark, sf_dir, "part").select("p_retailprice").distinct().select("p_retailprice", F.round(PRICES.column(F.col("p_retailprice")), 9).alias("membership"))


UNIT = FuzzySet.of([0.1, 0.3, 0.6, 0.9], [0.2, 0.7, 1.0, 0.4])


def fuzzyfication(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = UNIT.fuzzify(F.col("p_retailprice"), 800.0, 1500.0)
    return _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.sum(m), 6).alias("total"))


def fuzzy_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a fuzzy set over the sizes of parts, scaled; its points are sorted whatever their order."""
    sizes = [float(r[0]) for r in _table(spark, sf_dir, "part").select("p_size").distinct().collect()]
    points = FuzzySet.of(sizes, sizes)
    return spark.createDataFrame(list(zip(points.values, points.scaled().values, strict=True)), "p_size double, scaled double").select("p_size", F.round("scaled", 9).alias("scaled"))


def _line_sql(v: str, s: FuzzySet | None, x=None, y=None) -> str:
    x, y = x or s.values, y or s.membership
    parts = [f"WHEN {v} <= {x[0]}::DOUBLE THEN {y[0]}::DOUBLE"]
    parts += [f"WHEN {v} <= {x[k]}::DOUBLE THEN {y[k - 1]}::DOUBLE + ({v} - {x[k - 1]}::DOUBLE) * ({y[k]}::DOUBLE - {y[k - 1]}::DOUBLE) / ({x[k]}::DOUBLE - {x[k - 1]}::DOUBLE)" for k in range(1, len(x))]
    return f"CASE {' '.join(parts)} ELSE {y[-1]}::DOUBLE END"


# --- association and relations

_COUNTS = """
cell AS (SELECT o_orderpriority AS p, o_orderstatus AS q, count(*)::DOUBLE AS g FROM orders GROUP BY 1, 2),
a AS (SELECT p, sum(g) AS a FROM cell GROUP BY 1), b AS (SELECT q, sum(g) AS b FROM cell GROUP BY 1),
one AS (
  SELECT a.p || '___o_orderpriority' AS concept_p, b.q || '___o_orderstatus' AS concept_q, coalesce(g, 0) AS g, a, b, (SELECT sum(g) FROM cell) AS n
  FROM a CROSS JOIN b LEFT JOIN cell ON cell.p = a.p AND cell.q = b.q
),
pairs AS (
  SELECT concept_p, concept_q, g AS p_q, a - g AS p_nq, b - g AS np_q, n - a - b + g AS np_nq, false AS p_target, true AS q_target FROM one
  UNION ALL SELECT concept_q, concept_p, g, b - g, a - g, n - a - b + g, true, false FROM one
)
"""
_N = "(p_q + p_nq + np_q + np_nq)"
_CONF = "CASE WHEN p_q + p_nq = 0 THEN 0.0 ELSE p_q / (p_q + p_nq) END"
_POS, _NEG = (f"CASE WHEN {d} = 0 THEN {x} / (p_q + p_nq) ELSE {x} / {d} / (p_q + p_nq) END" for x, d in (("p_q", "(p_nq + np_q)"), ("p_nq", "(p_q + np_nq)")))
_MEASURE_SQL = {
    "supp": f"p_q / {_N}",
    "conf": _CONF,
    "lift": f"(p_q / (p_q + p_nq)) / ((p_q + np_q) / {_N})",
    "rodr": "CASE WHEN p_nq + np_q = 0 THEN p_q + np_nq ELSE (p_q + np_nq) / (p_nq + np_q) END",
    "odr": "CASE WHEN p_nq * np_q = 0 THEN p_q * np_nq ELSE p_q * np_nq / (p_nq * np_q) END",
    "pos_inf": f"CASE WHEN ({_POS}) > ({_NEG}) THEN ({_POS}) WHEN ({_POS}) < ({_NEG}) THEN -({_NEG}) ELSE 0.0 END",
    "bayes": f"CASE WHEN p_q > np_q THEN (p_q - np_q) / {_N} * ((p_q + np_q) / {_N}) / ((p_q + p_nq) / {_N}) ELSE 0.0 END",
    "simple": f"CASE WHEN p_q = p_nq THEN 0.0 ELSE (p_q - p_nq + np_nq + np_q) / {_N} END",
}


def _orders_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = discrete_pair(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    target = lambda c: F.col(c).endswith("___o_orderstatus")
    return pairs.withColumn("p_target", target("concept_p")).withColumn("q_target", target("concept_q"))


def _rel(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = MEASURES[name](*[F.col(c) for c in ("p_q", "p_nq", "np_q", "np_nq")])
        return _orders_pairs(spark, sf_dir).select("concept_p", "concept_q", F.round(value, 9).alias("value"))

    return query


def _weighed(rules: Rules) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return weigh(_orders_pairs(spark, sf_dir), rules).withColumn("weight", F.round("weight", 9))

    return query


THRESHOLD = Rules("conf", "supp", threshold=0.0667)
SIGN = Rules("conf", "supp", sign="lift", sign_threshold=1.0)
SINGLE = Rules("conf", "supp", both=False)
TARGET_ONLY = Rules("conf", "supp", all_pairs=False)


def incl_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = weigh(_orders_pairs(spark, sf_dir), Rules("conf")).groupBy("destiny").agg(F.sum("weight").alias("w"))
    return sums.select("destiny", F.round(inclination("sigmoid", F.col("w"), 0.95), 6).alias("sigmoid"), F.round(inclination("sigmoid_hip", F.col("w"), 0.95), 6).alias("hip"), inclination("relm", F.col("w"), 0.95).alias("relm"))


def contingency_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    flags = {f"{v}___l_returnflag": (F.col("l_returnflag") == v).cast("double") for v in ("A", "N", "R")}
    out = contingency_frame(rows, {"discount": F.col("l_discount") * 10}, flags)
    return out.select("concept_p", "concept_q", *[F.round(c, 4).alias(c) for c in ("p_q", "p_nq", "np_q", "np_nq")])


def inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_relations(discrete_concepts(_table(spark, sf_dir, "customer"), ["c_mktsegment"]))


TYPED = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def types_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_types(_table(spark, sf_dir, "lineitem").select(*TYPED), TYPED)


# --- sources


def factorize_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return factorize(rows, ["lang", "source"], ["doc_id"])


def factorize_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return factorize_some(rows, ["p_partkey"])


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("lang", "source").dropDuplicates()


def load_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the data sets with commas by the plain reader: quotes mean nothing and lines of another length are left out."""
    return split_plain(_table(spark, sf_dir, "csv_lines").select(F.col("raw_line").alias("value")), ["a", "b", "c", "d"])[0]


def _arff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations written as an ARFF file and loaded again."""
    quoted = F.concat(F.lit("'"), F.col("n_name"), F.lit("'"))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("at"), F.concat_ws(",", "n_nationkey", quoted, "n_regionkey").alias("value"))
    head = ["% nations", "@RELATION nation", "@ATTRIBUTE key INTEGER", "@attribute 'the name' string", "@attribute region {0,1,2,3,4}", "", "@DATA"]
    return load_arff(spark, _text_file(spark, head, rows, "arff")).withColumnRenamed("the name", "name")


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_table(spark, sf_dir, "learning_rows"))


def _text_file(spark: SparkSession, lines: list[str], rows: DataFrame, kind: str) -> str:
    """The lines, then the rows in order, as one file in the shared folder."""
    path = place(spark, f"file.{kind}")
    head = spark.createDataFrame([(-len(lines) + i, line) for i, line in enumerate(lines)], "at long, value string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a header, repeated lines, a line that repeats the header and lines of another length, as codes by first appearance."""
    rows = _table(spark, sf_dir, "nation").select((100 - F.col("n_nationkey")).cast("long").alias("at"), F.concat_ws(",", "n_name", F.concat(F.lit("region "), "n_regionkey")).alias("value"))
    more = spark.createDataFrame([(200, "name,region"), (201, "too,long,line"), (202, "short"), (203, "name,region")], "at long, value string")
    return load_csv_dataset(spark, _text_file(spark, ["name,region", "x,y,z"], rows.unionByName(rows).unionByName(more), "csv"), True)


def load_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose columns get types, repeated rows once, text and few whole numbers as codes."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("at"), F.concat_ws(",", "n_nationkey", "n_regionkey", F.concat("n_regionkey", F.lit(".5"))).alias("value"))
    return load_dataset(spark, _text_file(spark, ["key,region,half"], rows.unionByName(rows), "csv"), True)


# --- inference

ORDER_CONCEPTS = ["price", "urgent", "open", "late", "risk"]
ORDER_ARCS = [("price", "risk", 0.6), ("urgent", "late", -0.5), ("open", "late", 0.7), ("late", "risk", 0.8), ("risk", "open", -0.4), ("risk", "price", 0.1), ("late", "urgent", 0.3)]

_IN_SQL = {"price": "o_totalprice / 500000.0::DOUBLE", "urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "open": "CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"}


def order_inputs() -> dict:
    return {"price": F.col("o_totalprice") / 500000.0, "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("double"), "open": (F.col("o_orderstatus") == "O").cast("double")}


STEPS = 8


def order_map(**settings) -> CognitiveMap:
    """A map of five concepts that takes ``STEPS`` steps in any case and gives its last state."""
    m = CognitiveMap(Settings(**{"max_iter": STEPS, "extra_steps": 2, "stabilize": False, "decision": "LAST", "memory": False, "decision_window": "full", **settings}))
    for c in ORDER_CONCEPTS:
        m = m.add_concept(c, kind="DECISION" if c in ("late", "risk") else "SIMPLE")
    for a in ORDER_ARCS:
        m = m.add_relation(*a)
    return m


def papageorgius_map() -> CognitiveMap:
    m = order_map(memory=True, activation="sigmoid")
    return m.set_concept("late", excitation="PAPAGEORGIUS").set_concept("price", excitation="PAPAGEORGIUS")


def inactive_map() -> CognitiveMap:
    return order_map(memory=True).set_concept("late", active=False)


RISK = {"membership": [0.1, 0.5, 1.0, 0.3], "val_list": [0.0, 1.0, 2.0, 4.0]}


def normalized_map() -> CognitiveMap:
    return order_map(activation="sigmoid").set_concept("risk", kind="FUZZY", fuzzy=RISK)


def edited_map() -> CognitiveMap:
    """A map whose concepts take defaults, whose functions are changed afterwards and whose values are cleared and set."""
    m = CognitiveMap(Settings(max_iter=STEPS, extra_steps=2, stabilize=False, decision="MEAN", memory=False, decision_window="full")).set_defaults(memory=True, kind="DECISION")
    for c in ORDER_CONCEPTS:
        m = m.add_concept(c).init_concept(c, 0.9)
    for a in ORDER_ARCS:
        m = m.add_relation(*a)
    m = m.set_activation("sigmoid", lambda_val=1.0).set_decision("LAST").cleared().init_concept("late", 0.25).init_concept("nowhere", 1.0, required=False)
    out = dict(m.outgoing("late"))
    return m.init_concept("risk", m.value("late") + out["risk"]).set_concept("open", memory=False)


def _sums(m: CognitiveMap) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = infer(_table(spark, sf_dir, "orders"), m, order_inputs(), ["o_orderstatus"], {c: c for c in ORDER_CONCEPTS})
        return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 5).alias(c) for c in ORDER_CONCEPTS])

    return query


def _recursion(m: CognitiveMap, steps: int, begin: dict[str, str] | None = None) -> str:
    """Common table expressions that end with r(n, key, concept, v): all states of all orders, by recursion over the steps."""
    active = {c.name: c.active for c in m.concepts}
    arcs = [(o, d, w) for o, d, w in m.relations if active[o]] + [(c.name, c.name, 1.0 if m.uses_memory(c) else 0.0) for c in m.concepts]
    values = ", ".join(f"('{o}', '{d}', {w!r}::DOUBLE)" for o, d, w in arcs)
    seen = " ".join(f"WHEN '{c.name}' THEN 2 * v - 1" for c in m.concepts if c.excitation == "PAPAGEORGIUS")
    read = f"CASE r.concept {seen} ELSE v END" if seen else "v"
    act = {"sigmoid_hip": "(1 - exp(-2.0::DOUBLE * ({s}))) / (1 + exp(-2.0::DOUBLE * ({s})))", "sigmoid": "1 / (1 + exp(-1.0::DOUBLE * ({s})))"}[m.settings.activation]
    total = f"sum({read} * w)"
    out = act.format(s=total)
    for c in m.concepts:
        if c.fuzzy is not None:
            # RISK, scaled by hand: from 0 to 4.
            x, y = (0.0, 0.25, 0.5, 1.0), (0.1, 0.5, 1.0, 0.3)
            mean = f"({total} / {m.incoming_sum(c.name)!r}::DOUBLE)"
            fuzzy = f"CASE WHEN {mean} < 0 THEN -(1 - ({_line_sql(f'abs({mean})', None, x, y)})) ELSE {_line_sql(mean, None, x, y)} END"
            out = f"CASE WHEN destiny = '{c.name}' THEN {fuzzy} ELSE {out} END"
    start = " UNION ALL ".join(f"SELECT o_orderkey AS key, '{c.name}' AS concept, {(_IN_SQL | (begin or {})).get(c.name, '0.0::DOUBLE')} AS v FROM orders" for c in m.concepts)
    return f"""arcs(origin, destiny, w) AS (VALUES {values}),
r(n, key, concept, v) AS (
  SELECT 0, key, concept, v FROM ({start})
  UNION ALL SELECT r.n + 1, r.key, destiny, {out} FROM r JOIN arcs ON origin = r.concept WHERE r.n < {steps} GROUP BY r.n, r.key, destiny
)"""


def infer_matrix_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix mode with a wider threshold, so that orders stop on their own at different steps."""
    out = infer(_table(spark, sf_dir, "orders"), matrix_map(stability_diff=0.02, max_iter=40), order_inputs(), ["o_orderkey"], {"risk": "risk", "late": "late"})
    return out.select("o_orderkey", F.round("risk", 7).alias("risk"), F.round("late", 7).alias("late"))


def _sums_sql(m: CognitiveMap, begin: dict[str, str] | None = None) -> str:
    cols = ", ".join(f"round(sum(v) FILTER (WHERE concept = '{c}'), 5) AS \"{c}\"" for c in ORDER_CONCEPTS)
    return f"WITH RECURSIVE {_recursion(m, STEPS, begin)} SELECT o_orderstatus, count(DISTINCT o_orderkey) AS n, {cols} FROM r JOIN orders ON key = o_orderkey WHERE r.n = {STEPS} GROUP BY 1"


STABLE = Settings(max_iter=30, extra_steps=3, stability_diff=0.02, memory=True)


def stable_map(decision: str = "MEAN") -> CognitiveMap:
    return replace(order_map(), settings=replace(STABLE, decision=decision))


def stability_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have how many states."""
    states = trace(_table(spark, sf_dir, "orders"), stable_map(), order_inputs(), ["o_orderkey"])
    return states.filter("concept = 'risk'").groupBy("o_orderkey").agg(F.count("*").alias("states")).groupBy("states").agg(F.count("*").alias("n"))


def _decision(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = infer(_table(spark, sf_dir, "orders"), stable_map(name), order_inputs(), ["o_orderkey"], {"risk": "risk", "late": "late"})
        return out.select("o_orderkey", F.round("risk", 7).alias("risk"), F.round("late", 7).alias("late"))

    return query


_LONG = STABLE.max_iter + STABLE.extra_steps
#: s and p of each order: the first state that begins extra_steps - 1 stable ones, and the state before it.
_STOP = f"""moved AS (SELECT n, key, abs(v - lag(v) OVER (PARTITION BY key, concept ORDER BY n)) AS d FROM r),
flat AS (SELECT n, key, (max(d) <= {STABLE.stability_diff}::DOUBLE OR n >= {STABLE.max_iter - 1})::INT AS ok FROM moved WHERE n > 0 GROUP BY n, key),
runs AS (SELECT n, key, min(ok) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN CURRENT ROW AND {STABLE.extra_steps - 2} FOLLOWING) AS ok FROM flat),
stop AS (SELECT key, min(n) AS s, min(n) - 1 AS p FROM runs WHERE ok = 1 AND n <= {STABLE.max_iter - 1} GROUP BY key)"""


def _decision_sql(name: str) -> str:
    e = STABLE.extra_steps
    value = {
        "LAST": f"max(v) FILTER (WHERE n = CASE WHEN p > 0 THEN p ELSE s + {e - 1} END)",
        "MEAN": f"avg(v) FILTER (WHERE n <= CASE WHEN p > 0 THEN p ELSE s + {e - 1} END)",
        "EXITED": "max(v) FILTER (WHERE n < p)",
    }[name]
    return f"""WITH RECURSIVE {_recursion(stable_map(), _LONG)}, {_STOP},
each AS (SELECT r.key, concept, {value} AS v FROM r JOIN stop ON r.key = stop.key GROUP BY r.key, concept)
SELECT key AS o_orderkey, round(max(v) FILTER (WHERE concept = 'risk'), 7) AS risk, round(max(v) FILTER (WHERE concept = 'late'), 7) AS late FROM each GROUP BY key"""


def final_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided values of target concepts only."""
    m = order_map()
    targets = {c: c for c in m.select("target")}
    out = infer(_table(spark, sf_dir, "orders"), m, order_inputs(), [], targets)
    return out.agg(*[F.round(F.sum(c), 5).alias(c) for c in targets])


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean state of target concepts in the first steps, as a table instead of a plot."""
    m = order_map()
    states = trace(_table(spark, sf_dir, "orders"), m, order_inputs(), ["o_orderstatus"]).filter(F.col("concept").isin(m.select("target")) & (F.col("step") < 5))
    return states.groupBy("o_orderstatus", "concept", "step").agg(F.round(F.avg("value"), 7).alias("mean"))


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_map().topology(spark)


def map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts and relations of a map after the way through JSON."""
    m = from_json(to_json(normalized_map()))
    concepts = m.concept_frame(spark).select("concept", "kind", "activation", F.lit(None).cast("string").alias("destiny"), F.lit(None).cast("double").alias("weight"))
    arcs = m.relation_frame(spark).select(F.col("origin").alias("concept"), F.lit("RELATION").alias("kind"), F.lit("").alias("activation"), "destiny", "weight")
    return concepts.unionByName(arcs)


def matrix_map(**settings) -> CognitiveMap:
    return replace(order_map(memory=True), settings=Settings(mode="matrix", memory=True, **settings))


def _matrix_sql(cte: str, s: Settings) -> str:
    """Decided values d(key, concept, v) of the states r(n, key, concept, v) by the rules of matrix mode, decision MEAN.

    s is the first step that begins extra_steps steps in which the sum over concepts moves by less than the threshold; at most
    max_iter - 1 states are kept.
    """
    e, most = s.extra_steps, s.max_iter - 1
    return f"""{cte},
total AS (SELECT n, key, sum(v) AS v FROM r GROUP BY n, key),
flat AS (SELECT n, key, (abs(v - lag(v) OVER (PARTITION BY key ORDER BY n)) < {s.stability_diff}::DOUBLE)::INT AS ok FROM total),
runs AS (SELECT n, key, sum(ok) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN CURRENT ROW AND {e - 1} FOLLOWING) AS ok FROM flat),
stop AS (SELECT key, least(coalesce(min(n) FILTER (WHERE ok = {e}) + {e}, {most}), {most}) AS states FROM runs GROUP BY key),
d AS (SELECT r.key, concept, avg(v) FILTER (WHERE n <= CASE WHEN states - {e + 1} > 0 THEN states - {e + 1} ELSE states - 1 END) AS v FROM r JOIN stop ON r.key = stop.key GROUP BY r.key, concept)"""


def infer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix mode over the same orders, with its own rules of stopping."""
    m = matrix_map()
    out = infer(_table(spark, sf_dir, "orders"), m, order_inputs(), ["o_orderstatus"], {c: c for c in ORDER_CONCEPTS})
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 5).alias(c) for c in ORDER_CONCEPTS])


# --- estimator


def _estimator() -> MapEstimator:
    return MapEstimator(Rules("conf"), Settings(mode="matrix", max_iter=60))


def predict_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    fitted = _estimator().fit(rows, ["o_orderstatus"], ["o_orderpriority", "o_totalprice"])
    return fitted.predict(rows, ["o_orderkey", "o_orderstatus"])


def score_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predict_orders(spark, sf_dir)
    return out.agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == F.col("predicted_o_orderstatus")).cast("double")).alias("accuracy"))


def predict_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit over discrete features only, and what it predicts for each order."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    fitted = _estimator().fit(rows, ["o_orderstatus"], ["o_orderpriority"])
    return fitted.predict(rows, ["o_orderkey", "o_orderstatus"])


def score_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimator's own score, and the share of orders for each predicted class."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    fitted = _estimator().fit(rows, ["o_orderstatus"], ["o_orderpriority"])
    return spark.createDataFrame([(round(fitted.score(rows), 9),)], "accuracy double")


def fit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that a fit over discrete features gives, exclusions included."""
    learned = learn(_table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderstatus"], Rules("conf"))
    return learned.map.relation_frame(spark).select("origin", "destiny", F.round("weight", 9).alias("weight"))


# --- merging



def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A map for each status of orders: quarters and priorities as concepts with their share, conf as weights."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("map_no"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("q"), F.col("o_orderpriority").alias("p"))
    cell = rows.groupBy("map_no", "p", "q").agg(F.count("*").cast("double").alias("g"))
    total = cell.groupBy("map_no").agg(F.sum("g").alias("n"))
    side = lambda c: cell.groupBy("map_no", F.col(c).alias("concept")).agg(F.sum("g").alias("m"))
    # One concept is known to one map only, and one is 0 in a map.
    concepts = side("p").filter("NOT (concept = '5-LOW' AND map_no <> 'F')").unionByName(side("q")).join(total, "map_no").select("map_no", "concept", F.when((F.col("concept") == "Q1") & (F.col("map_no") == "F"), 0.0).otherwise(F.col("m") / F.col("n")).alias("value"))
    arcs = cell.join(side("p").withColumnRenamed("concept", "p"), ["map_no", "p"]).select("map_no", F.col("p").alias("origin"), F.col("q").alias("destiny"), (F.col("g") / F.col("m")).alias("weight"))
    return concepts, arcs


def _join(concept: str, value: str, relation: str, zeros: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        values, arcs = merge_frames(*_slices(spark, sf_dir), concept, value, relation, zeros)
        return values.select(F.col("concept").alias("origin"), F.lit("").alias("destiny"), F.round("value", 9).alias("weight")).unionByName(arcs.withColumn("weight", F.round("weight", 9)))

    return query


def _join_sql(concept: str, value: str, relation: str, zeros: bool = False) -> str:
    having = "HAVING count(DISTINCT map_no) = (SELECT count(DISTINCT map_no) FROM concepts)" if concept == "intersection" else ""
    return f"""WITH cell AS (SELECT o_orderstatus AS map_no, o_orderpriority AS p, 'Q' || quarter(o_orderdate) AS q, count(*)::DOUBLE AS g FROM orders GROUP BY 1, 2, 3),
total AS (SELECT map_no, sum(g) AS n FROM cell GROUP BY 1), pm AS (SELECT map_no, p, sum(g) AS m FROM cell GROUP BY 1, 2), qm AS (SELECT map_no, q, sum(g) AS m FROM cell GROUP BY 1, 2),
concepts AS (SELECT map_no, p AS concept, m / n AS v FROM pm JOIN total USING (map_no) WHERE NOT (p = '5-LOW' AND map_no <> 'F') UNION ALL SELECT map_no, q, CASE WHEN q = 'Q1' AND map_no = 'F' THEN 0.0 ELSE m / n END FROM qm JOIN total USING (map_no)),
merged AS (SELECT concept, {value}(v) AS v FROM concepts GROUP BY 1 {having}), kept AS (SELECT * FROM merged {'WHERE v <> 0' if zeros else ''}),
arcs AS (SELECT p, q, {relation}(g / m) AS w FROM cell JOIN pm USING (map_no, p) WHERE p IN (SELECT concept FROM kept) AND q IN (SELECT concept FROM kept) GROUP BY 1, 2)
SELECT concept AS origin, '' AS destiny, round(v, 9) AS weight FROM kept UNION ALL SELECT p, q, round(w, 9) FROM arcs"""


# --- discretization


def _cmeans(strategy: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """(value, cluster, membership) of the sizes of parts."""
        part = partition(distinct_values(_table(spark, sf_dir, "part"), "p_size"), strategy, seed=7)
        c, v = np.meshgrid(np.arange(len(part.membership)), part.values, indexing="ij")
        return spark.createDataFrame(pa.table({"value": v.ravel(), "cluster": c.ravel().astype(np.int32), "membership": part.membership.ravel()}))

    return query


def rl_cmeans_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centre, weight = rl_cmeans(distinct_values(_table(spark, sf_dir, "part"), "p_size"))
    return spark.createDataFrame(pa.table({"cluster": np.arange(len(centre), dtype=np.int32), "centre": centre, "weight": weight}))


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_clusters_frame(_table(spark, sf_dir, "lineitem"), "l_quantity").select("value", *[F.round(c, 9).alias(c) for c in ("low", "middle", "high")])


CENTRES = (5.0, 18.0, 31.0, 47.0)


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = nearest_frame(_table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", np.array(CENTRES))
    return placed.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


#: Steps of ``cmeans_run``, none left out.
CMEANS_STEPS = 12


def cmeans_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, cluster, membership) of the sizes of parts after a fixed number of c-means steps from a fixed start."""
    x = distinct_values(_table(spark, sf_dir, "part"), "p_size")
    u, _ = cmeans(x, len(CENTRES), error=0.0, max_iter=CMEANS_STEPS + 1, start=np.abs(np.array(CENTRES)[:, None] - x[None, :]))
    c, v = np.meshgrid(np.arange(len(u)), x, indexing="ij")
    return spark.createDataFrame(pa.table({"value": v.ravel(), "cluster": c.ravel().astype(np.int32), "membership": np.round(u.ravel(), 7)}))


def cluster_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette, entropy index and partition coefficient of the sizes of parts around fixed centres."""
    x, centres = distinct_values(_table(spark, sf_dir, "part"), "p_size"), np.array(CENTRES) + 0.25
    u = memberships(x, centres, FUZZIFIER)
    row = tuple(round(float(v), 7) for v in (silhouette(x, u), fuzzy_entropy(x, u, centres), partition_coefficient(u)))
    return spark.createDataFrame([row], "silhouette double, entropy double, coefficient double")


# --- streaming


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, each scored by a map of two concepts."""
    m = CognitiveMap(Settings(max_iter=1, extra_steps=2, stabilize=False, decision="LAST", memory=True, decision_window="full", activation="sigmoid")).add_concept("value").add_concept("alarm", kind="DECISION").add_relation("value", "alarm", 0.5)
    path = f"{sf_dir}/events.parquet"
    # A pattern, as a stream's source may not be named as a single file.
    events = read_stream(spark, f"{path}*", spark.read.parquet(path).schema)
    scored = score_stream(events, m, {"value": F.col("value") / 100.0}, ["event_type"], {"alarm": "alarm"})
    return drain(scored, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("alarm"), 5).alias("alarm"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"act_{name}": _act(name) for name in _ACTIVATION_SQL}
    out |= {f"rel_{name}": _rel(name) for name in _MEASURE_SQL}
    out |= {"act_fuzzy": act_fuzzy, "membership": membership, "fuzzyfication": fuzzyfication, "fuzzy_scale": fuzzy_scale, "incl_lambda": incl_lambda, "contingency_fuzzy": contingency_fuzzy}
    out |= {"relation_threshold": _weighed(THRESHOLD), "relation_sign": _weighed(SIGN), "single_direction": _weighed(SINGLE), "target_only": _weighed(TARGET_ONLY)}
    out |= {"inner_relations": inner, "feature_types": types_of, "factorize": factorize_lang, "factorize_cond": factorize_cond, "dedup": dedup, "load_plain": load_plain, "load_arff": _arff, "dataset_summary": dataset_summary}
    out |= {"infer_kosko": _sums(order_map()), "infer_memory": _sums(order_map(memory=True)), "infer_papageorgius": _sums(papageorgius_map()), "infer_inactive": _sums(inactive_map()), "infer_normalized": _sums(normalized_map()), "infer_matrix": infer_matrix}
    out |= {"stability_step": stability_step, "decision_last": _decision("LAST"), "decision_mean": _decision("MEAN"), "decision_exited": _decision("EXITED"), "final_state_filter": final_state_filter, "trajectory": trajectory, "topology": topology, "map_json": map_json}
    out |= {"infer_matrix_stops": infer_matrix_stops, "infer_edited": _sums(edited_map()), "load_csv": load_csv, "load_typed": load_typed}
    out |= {"predict_discrete": predict_discrete, "score_discrete": score_discrete, "cmeans_run": cmeans_run, "cluster_indices": cluster_indices}
    out |= {"predict_orders": predict_orders, "score_orders": score_orders, "fit_orders": fit_orders}
    out |= {"join_union_avg": _join("union", "average", "average"), "join_intersect_max": _join("intersection", "highest", "highest"), "join_min_nozero": _join("union", "lowest", "lowest", True)}
    out |= {"cmeans_gap": _cmeans("cmeans-gap"), "cmeans_sil": _cmeans("cmeans-sil"), "cmeans_cfe": _cmeans("cmeans-cfe"), "rl_cmeans": rl_cmeans_centres, "three_clusters": three, "nearest_centroid": nearest_centroid, "stream_scores": stream_scores}
    return out


def _codes_sql(table: str, key: str, columns: list[str], rest: list[str]) -> str:
    ctes = ", ".join(f"f_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY min({key})) - 1 AS code FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})" for c in columns)
    joins = " ".join(f"LEFT JOIN f_{c} ON t.{c} = f_{c}.v" for c in columns)
    return f"WITH {ctes} SELECT {', '.join([*rest, *(f'coalesce(f_{c}.code, -1) AS {c}' for c in columns)])} FROM {table} t {joins}"


def oracle_sql() -> dict[str, str]:
    out = {f"act_{n}": f"SELECT c_mktsegment, count(*) AS n, round(sum({sql}), 6) AS total FROM customer GROUP BY 1" for n, sql in _ACTIVATION_SQL.items()}
    out |= {f"rel_{n}": f"WITH {_COUNTS} SELECT concept_p, concept_q, round({sql}, 9) AS value FROM pairs" for n, sql in _MEASURE_SQL.items()}
    out["act_fuzzy"] = f"SELECT p_brand, count(*) AS n, round(sum({_line_sql('p_retailprice', PRICES)}), 6) AS total FROM part GROUP BY 1"
    out["membership"] = f"SELECT DISTINCT p_retailprice, round({_line_sql('p_retailprice', PRICES)}, 9) AS membership FROM part"
    s = "((p_retailprice - 800.0::DOUBLE) / 1500.0::DOUBLE)"
    within = f"CASE WHEN {s} < 0.1::DOUBLE THEN 0.2::DOUBLE WHEN {s} > 0.9::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_line_sql(s, UNIT)})) END"
    out["fuzzyfication"] = f"SELECT p_brand, round(sum({within}), 6) AS total FROM part GROUP BY 1"
    out["fuzzy_scale"] = "WITH e AS (SELECT abs(min(p_size)) AS lo, max(p_size) AS hi FROM part) SELECT DISTINCT p_size::DOUBLE AS p_size, round((p_size + lo)::DOUBLE / (lo + hi), 9) AS scaled FROM part, e"
    w = f"WITH {_COUNTS}, w AS (SELECT concept_p AS origin, concept_q AS destiny, {_CONF} AS weight, p_q / {_N} AS e, p_target, q_target, CASE WHEN p_q + np_q = 0 THEN 0.0 ELSE p_q / (p_q + np_q) END AS back, {_MEASURE_SQL['lift']} AS l FROM pairs)"
    cols = "SELECT origin, destiny, round(weight, 9) AS weight FROM w WHERE weight <> 0 AND e > "
    out["relation_threshold"] = f"{w} {cols} 0.0667::DOUBLE"
    out["relation_sign"] = f"{w} SELECT origin, destiny, round(CASE WHEN l < 1 THEN -weight ELSE weight END, 9) AS weight FROM w WHERE weight <> 0 AND e > 0"
    out["single_direction"] = f"{w} {cols} 0 AND (CASE WHEN p_target = q_target THEN weight > back ELSE q_target END)"
    out["target_only"] = f"{w} {cols} 0 AND (p_target OR q_target)"
    out["incl_lambda"] = f"{w}, s AS (SELECT destiny, abs(sum(weight)) AS x FROM w WHERE weight <> 0 AND e > 0 GROUP BY 1) SELECT destiny, round(-ln(1 / 0.95::DOUBLE - 1) / x, 6) AS sigmoid, round(-ln((1 - 0.95::DOUBLE) / (1 + 0.95::DOUBLE)) / x, 6) AS hip, 1.0::DOUBLE AS relm FROM s"
    four = "round({0}, 4) AS p_q, round({1}, 4) AS p_nq, round({2}, 4) AS np_q, round({3}, 4) AS np_nq"
    out["contingency_fuzzy"] = f"""WITH s AS (SELECT v, sum(l_discount * 10 * (l_returnflag = v)::INT) AS g, sum(l_discount * 10) AS a, sum((l_returnflag = v)::INT)::DOUBLE AS b, count(*)::DOUBLE AS n
  FROM lineitem, (VALUES ('A'), ('N'), ('R')) t(v) GROUP BY v)
SELECT 'discount' AS concept_p, v || '___l_returnflag' AS concept_q, {four.format('g', 'a - g', 'b - g', 'n - a - b + g')} FROM s
UNION ALL SELECT v || '___l_returnflag', 'discount', {four.format('g', 'b - g', 'a - g', 'n - a - b + g')} FROM s"""
    out["inner_relations"] = "WITH v AS (SELECT DISTINCT c_mktsegment || '___c_mktsegment' AS c FROM customer) SELECT a.c AS origin, b.c AS destiny, -1.0::DOUBLE AS weight FROM v a JOIN v b ON a.c <> b.c"
    text = ("l_returnflag", "l_linestatus")
    out["feature_types"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, {repr('discrete') if c in text else f'''CASE WHEN count(DISTINCT {c}) < 10 THEN 'discrete' ELSE 'continuous' END'''} AS kind FROM lineitem" for c in TYPED)
    out["factorize"] = _codes_sql("documents", "doc_id", ["lang", "source"], ["doc_id"])
    out["factorize_cond"] = """WITH b AS (SELECT p_brand AS v, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1),
s AS (SELECT p_size AS v, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1),
k AS (SELECT count(DISTINCT p_size) <= 10 OR count(DISTINCT p_size) < 0.2 * count(*) AS yes FROM part)
SELECT p_partkey, CASE WHEN yes THEN s.code ELSE p_size END AS p_size, b.code AS p_brand, p_retailprice FROM part JOIN b ON p_brand = b.v JOIN s ON p_size = s.v CROSS JOIN k"""
    out["dedup"] = "SELECT DISTINCT lang, source FROM documents"
    parts = "string_split(raw_line, ',')"
    out["load_plain"] = f"SELECT DISTINCT {', '.join(f'{parts}[{i + 1}] AS {c}' for i, c in enumerate('abcd'))} FROM csv_lines WHERE len({parts}) = 4"
    out["load_arff"] = "SELECT n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation"
    out["dataset_summary"] = "SELECT 8::INT AS n_features, count(*) AS n_rows, 'class' AS target, count(DISTINCT \"class\") AS n_classes FROM learning_rows"
    for name, m in {"kosko": order_map(), "memory": order_map(memory=True), "papageorgius": papageorgius_map(), "inactive": inactive_map(), "normalized": normalized_map()}.items():
        out[f"infer_{name}"] = _sums_sql(m)
    out["infer_edited"] = _sums_sql(edited_map(), {"late": "0.25::DOUBLE", "risk": "1.05::DOUBLE"})
    whole = Settings(mode="matrix", memory=True)
    sums = ", ".join(f"round(sum(v) FILTER (WHERE concept = '{c}'), 5) AS \"{c}\"" for c in ORDER_CONCEPTS)
    out["infer_matrix"] = f"WITH RECURSIVE {_matrix_sql(_recursion(order_map(memory=True), whole.max_iter - 2), whole)} SELECT o_orderstatus, count(DISTINCT o_orderkey) AS n, {sums} FROM d JOIN orders ON key = o_orderkey GROUP BY 1"
    short = Settings(mode="matrix", memory=True, stability_diff=0.02, max_iter=40)
    out["infer_matrix_stops"] = f"WITH RECURSIVE {_matrix_sql(_recursion(order_map(memory=True), short.max_iter - 2), short)} SELECT key AS o_orderkey, round(max(v) FILTER (WHERE concept = 'risk'), 7) AS risk, round(max(v) FILTER (WHERE concept = 'late'), 7) AS late FROM d GROUP BY key"
    out["stability_step"] = f"WITH RECURSIVE {_recursion(stable_map(), _LONG)}, {_STOP} SELECT s + {STABLE.extra_steps} AS states, count(*) AS n FROM stop GROUP BY 1"
    out |= {f"decision_{n.lower()}": _decision_sql(n) for n in ("LAST", "MEAN", "EXITED")}
    base = _recursion(order_map(), STEPS)
    out["final_state_filter"] = f"WITH RECURSIVE {base} SELECT round(sum(v) FILTER (WHERE concept = 'late'), 5) AS late, round(sum(v) FILTER (WHERE concept = 'risk'), 5) AS risk FROM r WHERE n = {STEPS}"
    out["trajectory"] = f"WITH RECURSIVE {base} SELECT o_orderstatus, concept, n::INT AS step, round(avg(v), 7) AS mean FROM r JOIN orders ON key = o_orderkey WHERE n < 5 AND concept IN ('late', 'risk') GROUP BY 1, 2, 3"
    values = ", ".join(f"('{o}', '{d}', {x!r}::DOUBLE)" for o, d, x in ORDER_ARCS)
    out["topology"] = f"SELECT DISTINCT least(o, d) AS a, greatest(o, d) AS b FROM (VALUES {values}) t(o, d, w)"
    out["map_json"] = f"""SELECT o AS concept, 'RELATION' AS kind, '' AS activation, d AS destiny, w AS weight FROM (VALUES {values}) t(o, d, w)
UNION ALL SELECT c, k, a, NULL, NULL FROM (VALUES {", ".join(f"('{c.name}', '{c.kind}', '{'fuzzy' if c.fuzzy else 'sigmoid'}')" for c in normalized_map().concepts)}) t(c, k, a)"""
    exclusive = " UNION ALL ".join(f"SELECT a.v || '___{c}', b.v || '___{c}', -1.0 FROM (SELECT DISTINCT {c} AS v FROM orders) a JOIN (SELECT DISTINCT {c} AS v FROM orders) b ON a.v <> b.v" for c in ("o_orderpriority", "o_orderstatus"))
    out["fit_orders"] = f"{w} {cols} 0 UNION ALL {exclusive}"
    # The fitted map itself, run over the priorities, each of which is one start state.
    fit = Settings(mode="matrix", max_iter=60)
    learned = f"""{w}, link AS ({cols.replace('round(weight, 9)', 'weight')} 0 UNION ALL {exclusive}),
names AS (SELECT DISTINCT origin AS c FROM link),
arcs(origin, destiny, w) AS (SELECT origin, destiny, weight FROM link UNION ALL SELECT c, c, 1.0 FROM names),
r(n, key, concept, v) AS (
  SELECT 0, p, c, (c = p || '___o_orderpriority')::INT::DOUBLE FROM names, (SELECT DISTINCT o_orderpriority AS p FROM orders)
  UNION ALL SELECT r.n + 1, r.key, destiny, (1 - exp(-2.0::DOUBLE * sum(v * arcs.w))) / (1 + exp(-2.0::DOUBLE * sum(v * arcs.w))) FROM r JOIN arcs ON origin = r.concept WHERE r.n < {fit.max_iter - 2} GROUP BY r.n, r.key, destiny
)""".replace("WITH", "WITH RECURSIVE", 1)
    predicted = f"{_matrix_sql(learned, fit)}, best AS (SELECT key, arg_max(replace(concept, '___o_orderstatus', ''), v) AS predicted FROM d WHERE concept LIKE '%o_orderstatus' GROUP BY key)"
    out["predict_discrete"] = f"{predicted} SELECT o_orderkey, o_orderstatus, predicted AS predicted_o_orderstatus FROM orders JOIN best ON key = o_orderpriority"
    out["score_discrete"] = f"{predicted} SELECT round(avg((predicted = o_orderstatus)::INT), 9) AS accuracy FROM orders JOIN best ON key = o_orderpriority"
    first = "row_number() OVER (ORDER BY min(place)) - 1"
    out["load_csv"] = f"""WITH f AS (SELECT n_name AS name, 'region ' || n_regionkey AS region, 100 - n_nationkey AS place FROM nation UNION ALL SELECT 'name', 'region', 200),
a AS (SELECT name, {first} AS code FROM f GROUP BY name), b AS (SELECT region, {first} AS code FROM f GROUP BY region)
SELECT DISTINCT a.code AS name, b.code AS region FROM f JOIN a USING (name) JOIN b USING (region)"""
    out["load_typed"] = "SELECT n_nationkey::INT AS key, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS region, n_regionkey + 0.5::DOUBLE AS half FROM nation"
    out |= {"join_union_avg": _join_sql("union", "avg", "avg"), "join_intersect_max": _join_sql("intersection", "max", "max"), "join_min_nozero": _join_sql("union", "min", "min", True)}
    out["three_clusters"] = """WITH d AS (SELECT DISTINCT l_quantity::DOUBLE AS x FROM lineitem), o AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM d),
-- An even number of values gets one between the two in the middle.
all_x AS (SELECT x FROM o UNION ALL SELECT avg(x) FROM o WHERE n % 2 = 0 AND k IN (n // 2, n // 2 + 1) HAVING count(*) = 2),
v AS (SELECT x AS value, (row_number() OVER (ORDER BY x) - 1) / greatest((count(*) OVER () - 1) / 2.0::DOUBLE, 1.0) AS r FROM all_x)
SELECT value, round(greatest(0, 1 - r), 9) AS low, round(1 - abs(r - 1), 9) AS middle, round(greatest(0, r - 1), 9) AS high FROM v"""
    starts = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(CENTRES))
    near = "pow(greatest(abs(x - c), 2.220446049250313e-16::DOUBLE), -2 / 1.5::DOUBLE)"
    out["cmeans_run"] = f"""WITH RECURSIVE v AS (SELECT DISTINCT p_size::DOUBLE AS x FROM part), s(k, c) AS (VALUES {starts}),
u0 AS (SELECT k, x, abs(x - c) / sum(abs(x - c)) OVER (PARTITION BY x) AS u FROM v, s),
r(n, k, c) AS (
  SELECT 1, k, sum(pow(u, 2.5) * x) / sum(pow(u, 2.5)) FROM u0 GROUP BY k
  UNION ALL SELECT n + 1, k, sum(pow(u, 2.5) * x) / sum(pow(u, 2.5)) FROM (SELECT n, k, x, {near} / sum({near}) OVER (PARTITION BY x) AS u FROM r, v WHERE n < {CMEANS_STEPS}) GROUP BY n, k
)
SELECT x AS value, k::INT AS cluster, round({near} / sum({near}) OVER (PARTITION BY x), 7) AS membership FROM r, v WHERE n = {CMEANS_STEPS}"""
    shifted = ", ".join(f"({i}, {c + 0.25}::DOUBLE)" for i, c in enumerate(CENTRES))
    out["cluster_indices"] = f"""WITH v AS (SELECT DISTINCT p_size::DOUBLE AS x FROM part), s(k, c) AS (VALUES {shifted}), n AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mid FROM v),
u AS (SELECT k, c, x, {near} / sum({near}) OVER (PARTITION BY x) AS u FROM v, s),
far AS (SELECT a.x, a.k, any_value(a.u) AS u, sum(b.u * abs(a.x - b.x)) / (any_value(n) - 1) AS d FROM u a JOIN u b ON a.k = b.k CROSS JOIN n GROUP BY a.x, a.k),
two AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY u DESC, k) AS place FROM far),
sil AS (SELECT pow(max(u) FILTER (WHERE place = 1) - max(u) FILTER (WHERE place = 2), 2) AS w, max(d) FILTER (WHERE place = 1) AS a, max(d) FILTER (WHERE place = 2) AS b FROM two WHERE place < 3 GROUP BY x),
own AS (SELECT avg(h) AS h FROM (SELECT -sum(u * log2(u) + (1 - u) * log2(1 - u)) / any_value(n) AS h FROM u, n GROUP BY k)),
crossed AS (SELECT 2 * sum(a.u * log2(a.u / ((a.u + b.u) / 2)) + (1 - a.u) * log2((1 - a.u) / (1 - (a.u + b.u) / 2))) AS h FROM u a JOIN u b ON a.x = b.x AND a.k <> b.k),
spread AS (SELECT sum(w) AS within, sum(b) AS between_ FROM (SELECT sum(u) * sum(pow(x - c, 2)) AS w, sum(u) * pow(any_value(c) - any_value(mid), 2) AS b FROM u, n GROUP BY k))
SELECT round((SELECT sum(w * (b - a) / greatest(a, b)) / sum(w) FROM sil), 7) AS silhouette,
  round((crossed.h * 2 / 12 / own.h + between_ / 3 * (n - 4) / within) / 2, 7) AS entropy, round((SELECT sum(u * u) FROM u) / n, 7) AS coefficient FROM own, crossed, spread, n"""
    far = ", ".join(f"abs(l_quantity - {c}::DOUBLE)" for c in CENTRES)
    out["nearest_centroid"] = f"SELECT (list_position([{far}], list_min([{far}])) - 1)::INT AS cluster, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1"
    logistic = "1 / (1 + exp(-({0})))"
    v = '"value" / 100.0::DOUBLE'
    second = logistic.format(f"0.5::DOUBLE * ({logistic.format(v)}) + ({logistic.format('0.5::DOUBLE * ' + v)})")
    out["stream_scores"] = f"SELECT event_type, count(*) AS n, round(sum({second}), 5) AS alarm FROM events GROUP BY 1"
    return out
