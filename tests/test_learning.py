"""Functions, counts, learning, discretization, merging and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzloom.estimator import MapEstimator
from fuzzloom.functions.activations import ACTIVATIONS, ClusterSet, FuzzySet, inclination
from fuzzloom.functions.measures import MEASURES, measure
from fuzzloom.model import CognitiveMap, Settings, from_json, to_json
from fuzzloom.operators import discretize as D
from fuzzloom.operators.contingency import contingency_frame, discrete_pair, memberships_contingency
from fuzzloom.operators.learn import Rules, feature_types, learn, observed
from fuzzloom.operators.merge import join_maps
from fuzzloom.sources import datasets as S

TABLE = [("x", 5, 2.3, "v1"), ("y", 7, 4.8, "v1"), ("z", 3, 28.01, "v2"), ("w", 1, 15.7, "v2")]

# Function, argument, value -> result.
POINTS = [
    ("biestate", None, 0.5, 1), ("biestate", None, -0.5, 0), ("threestate", None, 0.30, 0), ("threestate", None, 0.60, 0.5), ("threestate", None, 0.75, 1), ("saturation", None, -60, 0),
    ("saturation", None, 75, 1), ("sigmoid", 1, 1, 0.7310585786300049), ("sigmoid", 1, -1, 0.2689414213699951), ("sigmoid", 50, -1, 1.928749847963918e-22), ("sigmoid_hip", 2, 1, 0.7615941559557649),
    ("tan_hip", 2, -1, -0.7615941559557649), ("gceq", 0.5, 0.7, 0.7), ("gceq", 0.5, 7, 1), ("gceq", 0.5, 0.3, 0), ("gceq", -3.5, -7, 0), ("gceq", -3.5, -2, -1), ("lceq", 0.5, 0.7, 0), ("lceq", 0.5, 7, 0),
    ("lceq", 0.5, 0.3, 0.3), ("lceq", -3.5, -7, -1), ("lceq", -3.5, -2, 0), ("relm", 2, -1, 0), ("relm", 2, 1, 0.5), ("relm", 2, 5, 1), ("sigmoid_hip", 2, -1000, -1), ("sigmoid", 1, -1000, 0),
]
SETS = [([0, 1], [5, 15], 10, 0.5), ([0, 1], [5, 15], 4, 0), ([0, 1], [5, 15], 16, 1), ([0, 0.5, 1], [5, 15, 20], 7, 0.1), ([0, 0.5, 1], [5, 15, 20], 16, 0.6), ([0.25, 0.5, 1, 0.5, 0.25], [0.2, 0.4, 0.6, 0.8, 1], -1, -0.75), ([0.25, 0.5, 1, 0.5, 0.25], [0.2, 0.4, 0.6, 0.8, 1], -0.5, -0.25), ([0, 1], [-4, -2], -3, 0.5)]
COUNTS = {"supp": 1 / 6, "lift": 2 / 3, "odr": 1 / 4, "rodr": 1 / 2, "pos_inf": -1 / 3, "simple": 1 / 3}


def test_points_in_both_forms(spark):
    columns, want = [], []
    for name, arg, v, result in POINTS:
        f = ACTIVATIONS[name]
        got = f.array(np.array([float(v)])) if arg is None else f.array(np.array([float(v)]), float(arg))
        assert got[0] == pytest.approx(result, abs=1e-12)
        columns.append((f.column(F.lit(float(v))) if arg is None else f.column(F.lit(float(v)), float(arg))).cast("double"))
        want.append(result)
    for membership, values, v, result in SETS:
        s = FuzzySet.of(values, membership)
        assert s.array(np.array([float(v)]))[0] == pytest.approx(result)
        columns.append(s.column(F.lit(float(v))))
        want.append(result)
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert list(row) == pytest.approx(want, abs=1e-12)


def test_measures(spark):
    four = [F.lit(float(x)) for x in (1, 2, 2, 1)]
    row = spark.range(1).select(*[MEASURES[m](*four).alias(m) for m in COUNTS], MEASURES["conf"](*[F.lit(1.0)] * 4).alias("conf"), MEASURES["bayes"](*[F.lit(float(x)) for x in (4, 1, 2, 3)]).alias("bayes")).first()
    assert {m: row[m] for m in COUNTS} == pytest.approx(COUNTS) and row.conf == 0.5 and row.bayes == pytest.approx(0.2 * 0.6 / 0.5)
    nothing = [F.lit(0.0)] * 4
    assert spark.range(1).select(*[m(*nothing).alias(n) for n, m in MEASURES.items()]).first() is not None
    with pytest.raises(ValueError):
        measure("nope")


def test_inclination(spark):
    x = F.lit(-2.0)
    row = spark.range(1).select(inclination("sigmoid", x, 0.9).alias("a"), inclination("sigmoid_hip", x, 0.9).alias("b"), inclination("relm", x, 0.9).alias("c"), inclination("sigmoid", F.lit(0.0), 0.9).alias("d")).first()
    assert 1 / (1 + np.exp(-row.a * 2)) == pytest.approx(0.9) and np.tanh(row.b) == pytest.approx(0.9) and row.c == 1 and row.d is None


def test_counts_agree_and_add_up(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    one = {(r[0], r[1]): tuple(r)[2:] for r in discrete_pair(df, "o_orderpriority", "o_orderstatus").collect()}
    values = [(c, r[0]) for c in ("o_orderpriority", "o_orderstatus") for r in df.select(c).distinct().collect()]
    members = {f"{v}___{c}": (F.col(c) == v).cast("double") for c, v in values}
    two = memberships_contingency(df, {k: (m, None) for k, m in members.items()})
    left, right = ({k: m for k, m in members.items() if k.endswith(c)} for c in ("priority", "status"))
    three = {(r[0], r[1]): tuple(r)[2:] for r in contingency_frame(df, left, right).collect()}
    n = df.count()
    for pair, four in one.items():
        assert four == pytest.approx(two[pair]) and four == pytest.approx(three[pair]) and sum(four) == n
    fuzzy = FuzzySet.of([0, 500_000], [0, 1])
    g = memberships_contingency(df, {"price": (F.col("o_totalprice"), fuzzy), "F": (members["F___o_orderstatus"], None)})
    assert sum(g["price", "F"]) == pytest.approx(n) and g["price", "F"][0] == pytest.approx(df.filter("o_orderstatus = 'F'").agg(F.sum(F.least(F.col("o_totalprice") / 500_000, F.lit(1.0)))).first()[0])


def test_known_relations(spark):
    df = spark.createDataFrame(TABLE, "f1 string, f2 int, f3 double, class string")
    learned = learn(df, ["f1"], ["class"], Rules("conf"))
    got = {(o, d): w for o, d, w in learned.map.relations}
    for c, vs in (("v1", "xy"), ("v2", "wz")):
        for v in vs:
            assert got[f"{c}___class", f"{v}___f1"] == 0.5 and got[f"{v}___f1", f"{c}___class"] == 1
    assert all(got[f"{a}___f1", f"{b}___f1"] == -1 for a in "wxyz" for b in "wxyz" if a != b) and got["v1___class", "v2___class"] == -1
    assert len(got) == 12 + 2 + 8
    single = {(o, d) for o, d, _ in learn(df, ["f1", "f2"], ["class"], Rules("conf", both=False, exclusion=0)).map.relations}
    assert ("x___f1", "v1___class") in single and ("v1___class", "x___f1") not in single and ("x___f1", "5___f2") not in single
    only = {(o, d) for o, d, _ in learn(df, ["f1", "f2"], ["class"], Rules("conf", all_pairs=False, exclusion=0)).map.relations}
    assert only and all("class" in o + d for o, d in only)
    own = learn(df, ["f1"], ["class"], Rules(lambda pq, pn, nq, nn: pq * 10, exclusion=0)).map
    assert own.relations[0][2] == 10
    assert {r.feature: r.kind for r in feature_types(df, ["f1", "f2"], infer=False).collect()} == {"f1": "discrete", "f2": "continuous"}


def test_estimator(spark):
    rows = [("a" if i % 2 else "b", float(i % 2 * 100 + i % 13), i % 3 == 0, "yes" if i % 2 else "no") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x double, flag boolean, class string")
    e = MapEstimator(Rules("conf"), Settings(mode="matrix", max_iter=60))
    with pytest.raises(RuntimeError):
        e.predict(df)
    with pytest.raises(ValueError):
        e.fit(df, ["nope"])
    with pytest.raises(TypeError):
        e.fit([1], ["class"])
    e.fit(df, ["class"])
    assert e.score(df) == 1.0 and e.learned.types == {"k": "discrete", "x": "continuous", "flag": "discrete", "class": "discrete"}
    new = spark.createDataFrame([("a", 101.0, True), (None, None, None), ("unknown", 5.0, False)], "k string, x double, flag boolean")
    got = [r.predicted_class for r in e.predict(new).collect()]
    assert got[0] == "yes" and got[2] == "no" and len(got) == 3
    assert e.map.select("target") == ["no___class", "yes___class"]


def test_cmeans_and_strategies():
    rng = np.random.default_rng(4)
    x = np.unique(np.concatenate([rng.normal(m, 0.6, 40) for m in (0, 10, 20)]))
    u, centre = D.cmeans(x, 3, seed=1)
    assert np.allclose(u.sum(axis=0), 1) and np.sort(centre) == pytest.approx([0, 10, 20], abs=0.6) and 0.8 < D.partition_coefficient(u) <= 1
    for strategy in D.STRATEGIES:
        p = D.partition(x, strategy, seed=3)
        assert len(p.membership) >= 2 and p.membership.shape[1] == len(p.values) and np.allclose(p.membership.sum(axis=0), 1)
        assert np.array_equal(p.membership, D.partition(x, strategy, seed=3).membership)
    assert len(D.partition(x, "cmeans-sil", seed=3).membership) == 3
    assert list(D.nearest(np.array([1.0, 5.0, 9.0]), np.array([0.0, 10.0]))) == [0, 0, 1]
    values, three = D.three_clusters(np.arange(10.0))
    assert len(values) == 11 and three[1].argmax() == 5 and np.allclose(three.sum(axis=0), 1) and three[:, 0].tolist() == [1, 0, 0]
    with pytest.raises(ValueError):
        D.partition(x, "nope")
    with pytest.raises(ValueError):
        D.partition(np.arange(9.0))


def test_many_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(D, "LARGEST", 16)
    x = D.distinct_values(spark.range(1000).selectExpr("cast(id as double) as x"), "x")
    assert len(x) == 16 and np.all(np.diff(x) > 0) and x.mean() == pytest.approx(499.5, abs=1)


@pytest.mark.parametrize("strategy", ["cmeans-gap", "cmeans-sil", "cmeans-cfe"])
@pytest.mark.parametrize("shape", ["modes", "skewed"])
def test_all_distinct_values_shape_the_sets(spark, monkeypatch, strategy, shape):
    rng = np.random.default_rng(5)
    x = np.unique(np.concatenate([rng.normal(m, 0.5, k) for m, k in ((0, 300), (10, 80), (40, 220))]) if shape == "modes" else rng.lognormal(5, 2, 600))
    df = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate(x)] * 2, "x double, class string")
    want = D.partition(x, strategy).sets()
    monkeypatch.setattr(D, "LARGEST", 64)
    monkeypatch.setattr(D, "CHUNK", 100)
    # Steps on the driver and as sums in Spark.
    for on_driver in (D.ON_DRIVER, 64) if strategy == "cmeans-gap" else (64,):
        monkeypatch.setattr(D, "ON_DRIVER", on_driver)
        m = learn(df, ["x"], ["class"], Rules("conf"), strategy=strategy).map
        got = [c.fuzzy for c in m.concepts if c.fuzzy]
        assert len(got) == len(want) >= 2
        for g, w in zip(got, want, strict=True):
            assert g.array(x) == pytest.approx(w.array(x), abs=1e-6)
        back = [c.fuzzy for c in from_json(to_json(m)).concepts if c.fuzzy]
        assert back == got


def test_set_from_centres_in_both_forms(spark):
    for s in (ClusterSet.around([2.0, 30.0, 7.0], 1, -5.0, 40.0, 2.5), ClusterSet.around([0.2, 0.7], 0, 0.0, 1.0, 2.5)):
        for one in (s, s.scaled()):
            x = np.array([*one.values[::9], -0.4, 0.33, 100.0, -100.0])
            rows = spark.createDataFrame([(float(v),) for v in x], "x double").select(one.column(F.col("x")).alias("m")).collect()
            assert [r.m for r in rows] == pytest.approx(one.array(x), abs=1e-12)
            assert np.array_equal(one.array(x[None, :]), one.array(x)[None, :])
        x = np.array(s.values)
        low = abs(x.min())
        assert s.scaled()._at((x + low) / (low + x.max())) == pytest.approx(s._at(x), abs=1e-9)


def three_maps():
    base = CognitiveMap().add_concept("concept_1").add_concept("concept_2", kind="DECISION", activation="gceq", weight=0.3)
    one = base.init_concept("concept_1", 0.25).add_relation("concept_1", "concept_2", 0.25)
    two = base.init_concept("concept_1", 0.5).add_concept("concept_4").init_concept("concept_4", 0.3).add_relation("concept_4", "concept_2", 0.2).add_relation("concept_1", "concept_2", 0.75)
    three = base.init_concept("concept_1", 0.75).add_concept("concept_3").add_relation("concept_1", "concept_4", -0.3911).add_relation("concept_2", "concept_3", 0.8911)
    return [one, two, three]


def test_merge(spark):
    m = join_maps(spark, three_maps(), "union", "average", "average")
    assert {c.name: c.value for c in m.concepts} == pytest.approx({"concept_1": 0.5, "concept_2": 0, "concept_4": 0.3, "concept_3": 0})
    assert {(o, d): w for o, d, w in m.relations} == pytest.approx({("concept_1", "concept_2"): 0.5, ("concept_4", "concept_2"): 0.2, ("concept_2", "concept_3"): 0.8911})
    assert m.concept("concept_2").kind == "DECISION" and m.function(m.concept("concept_2")) == ("gceq", {"weight": 0.3})
    for strategy, value in (("highest", 0.75), ("lowest", 0.25)):
        m = join_maps(spark, three_maps(), "intersection", strategy, strategy)
        assert [(c.name, c.value) for c in m.concepts] == [("concept_1", value), ("concept_2", 0)] and m.relations == (("concept_1", "concept_2", value),)
    assert [c.name for c in join_maps(spark, three_maps(), "union", "highest", "highest", True).concepts] == ["concept_1", "concept_4"]
    assert join_maps(spark, []) == CognitiveMap()
    for bad in (("nope", "highest", "highest"), ("union", "nope", "highest"), ("union", "highest", "nope")):
        with pytest.raises(ValueError, match="Unknown"):
            join_maps(spark, three_maps(), *bad)


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text('a,b,class\n1,x,"p\n2,y,q\n1,x,"p\n3,z\n')
    got = S.load_csv_dataset(spark, str(tmp_path / "d.csv"))
    assert sorted(map(tuple, got.collect())) == [("1", "x", '"p'), ("2", "y", "q")] and {t for _, t in got.dtypes} == {"string"}
    assert sorted(map(tuple, S.load_csv_dataset(spark, str(tmp_path / "d.csv"), True).collect())) == [(0, 0, 0), (1, 1, 1)]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n2,y\n")
    typed = S.load_dataset(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, typed.collect())) == [(1, "x"), (2, "y")]
    assert sorted(map(tuple, S.load_dataset(spark, str(tmp_path / "t.csv"), True).collect())) == [(0, 0), (1, 1)]
    (tmp_path / "e.arff").write_text("% c\n@relation r\n@attribute 'a b' REAL\n@attribute c {x,'y z'}\n@data\n1.5,x\n?, 'y z'\n1.5,x\n")
    arff = S.load_dataset(spark, str(tmp_path / "e.arff"))
    assert sorted(map(tuple, arff.collect()), key=str) == [(1.5, "x"), (None, "y z")]
    (tmp_path / "bad.arff").write_text("@attribute a real\n@attribute b real\n@data\n1\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        S.load_dataset(spark, str(tmp_path / "bad.arff")).collect()
    with pytest.raises(ValueError, match="Unknown dataset format"):
        S.load_dataset(spark, "x.json")
    assert tuple(S.summary(got).first()) == (3, 2, "class", 2)
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "o int, v string")
    assert [r.v for r in S.factorize(df, ["v"], ["o"]).orderBy("o").collect()] == [0, -1, 1, 0]
    assert S.as_frame(spark, {"a": [1, 2], "b": ["x", "y"]}).columns == ["a", "b"]
    assert S.as_frame(spark, np.array([[1.0, 2.0]]), offset=3).columns == ["3", "4"] and S.as_frame(spark, [1, 2]).count() == 2


def test_observed_values_are_bounded(spark):
    rows = [(i, f"t{i % 40}", i % 9, i % 10, i / 7, i % 2 == 0, None) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, t string, few int, more int, x double, b boolean, nothing string").repartition(3)
    kinds, values = observed(df, ["t", "few", "more", "x", "b", "nothing"])
    assert kinds == {"t": "discrete", "few": "discrete", "more": "continuous", "x": "continuous", "b": "discrete", "nothing": "discrete"}
    assert values == {"t": sorted(f"t{i}" for i in range(40)), "few": list(range(9)), "b": [False, True], "nothing": []}
    assert observed(df, ["few", "t"], infer=False)[0] == {"few": "continuous", "t": "discrete"}
    with pytest.raises(ValueError, match="column t has more than 39 values"):
        observed(df, ["few", "t"], most=39)


def test_csv_codes_follow_the_file(spark, tmp_path):
    lines = ["a,b"] + [f"v{k % 700},{(k * 13) % 5}" for k in range(3000, 0, -1)] + ["a,b", "a,b", "x"]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    seen: dict = {}
    rows = dict.fromkeys(tuple(x.split(",")) for x in lines[1:] if x.count(",") == 1)
    want = [tuple(seen.setdefault((i, v), len([k for k in seen if k[0] == i])) for i, v in enumerate(r)) for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = S.load_csv_dataset(spark, str(tmp_path / "big.csv"), True)
        assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 1 and sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_nearest_and_three_clusters_as_tables(spark):
    df = spark.createDataFrame([(1.0, "a"), (4.0, "b"), (None, "c"), (float("nan"), "d"), (9.0, "e"), (2.5, "f")], "x double, cluster_name string")
    got = {r.cluster_name: r.cluster for r in D.nearest_frame(df, "x", np.array([1.0, 4.0])).collect()}
    assert got == {"a": 0, "b": 1, "c": None, "d": None, "e": 1, "f": 0}
    for values in ([1.0, 2.0, 5.0, 9.0], [1.0, 2.0, 5.0], [3.0], []):
        frame = D.three_clusters_frame(spark.createDataFrame([(v,) for v in [*values, *values]] + [(None,)], "v double"), "v").orderBy("value").collect()
        if values:
            x, u = D.three_clusters(np.array(values))
            assert [tuple(r) for r in frame] == [tuple(map(float, r)) for r in zip(x, *u, strict=True)]
        else:
            assert frame == []
