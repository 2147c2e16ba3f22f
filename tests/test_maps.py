"""Maps, JSON, inference and its known results."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzloom.functions.activations import ACTIVATIONS, FuzzySet, defuzzify
from fuzzloom.functions.decisions import DECIDERS
from fuzzloom.model import CognitiveMap, Settings, from_json, to_json, vector
from fuzzloom.operators.kernel import compile_map, decided, final_state, infer, is_stable, run_map, trace, trajectories

NAMES = ["result_1", "result_2", "input_1", "input_2", "input_3", "input_4", "input_5"]
ARCS = [
    ("input_1", "result_1", 0.5), ("input_2", "result_1", 1), ("input_4", "result_2", 0.5), ("input_5", "result_2", 1), ("input_1", "input_4", -0.3),
    ("input_1", "input_3", 0.7), ("input_5", "input_2", -0.3), ("input_5", "input_3", 0.7), ("result_2", "input_3", 0.5), ("result_1", "input_3", 0.5),
]
# The known results of the seven-concept map.
KNOWN = {
    ("sigmoid_hip", ()): [0.056969360711939906, -0.06113548755394814, 0.05, 0.034888503362331805, 0.09792163723261006, -0.034888503362331805, -0.05],
    ("sigmoid", ()): [0.5994700184028905, 0.5755041378442186, 0.5, 0.44379910825937535, 0.7851790048472618, 0.3963131391906254, 0.4],
    ("biestate", ()): [0.2, 0, 0.05, 0.12, 0.3, -0.02, -0.05],
    ("threestate", ()): [0.0625, 0, 0.0625, 0.025, 0.125, -0.025, -0.0625],
    ("saturation", ()): [0.06, 0, 0.05, 0.035, 0.13, -0.02, -0.05],
    ("gceq", (("weight", 0.0001),)): [0.06, 0, 0.05, 0.035, 0.13, -0.02, -0.05],
    ("lceq", (("weight", 0.0001),)): [0, -0.0675, 0.05, 0.02, 0.06625, -0.035, -0.05],
}
GOLDEN = {"memory": False, "decision_window": "full"}


def seven(**settings) -> CognitiveMap:
    m = CognitiveMap(Settings(**{**GOLDEN, **settings}))
    for n in NAMES:
        m = m.add_concept(n, kind="DECISION" if n.startswith("result") else "SIMPLE")
    for a in ARCS:
        m = m.add_relation(*a)
    for n, v in zip(NAMES[2:], (0.5, 0.2, 1, -0.2, -0.5), strict=True):
        m = m.init_concept(n, v)
    return m


@pytest.mark.parametrize("mode", ["iterative", "matrix"])
@pytest.mark.parametrize(("function", "args"), KNOWN)
def test_known_results(function, args, mode):
    got, _ = run_map(seven(activation=function, args=args, mode=mode))
    assert [got[n] for n in NAMES] == pytest.approx(KNOWN[function, args], abs=1e-15)


@pytest.mark.parametrize("mode", ["iterative", "matrix"])
def test_mixed_and_fuzzy_maps(mode):
    m = seven(mode=mode)
    m = m.add_concept("result_1", kind="DECISION", activation="gceq", weight=0.003, excitation="PAPAGEORGIUS", memory=True)
    m = m.add_concept("result_2", kind="DECISION", activation="sigmoid", lambda_val=10, excitation="PAPAGEORGIUS", memory=True)
    m = m.add_concept("input_1", activation="threestate", excitation="PAPAGEORGIUS", memory=True).init_concept("input_1", 0.59)
    got, _ = run_map(m)
    assert [got[n] for n in NAMES] == pytest.approx([0, 0.00012648385157387873, 0.07375, 0.04361062920291475, -0.6816478125020062, 0.18674101269496457, -0.0625], abs=1e-15)
    f = CognitiveMap(Settings(activation="sigmoid", mode=mode, **GOLDEN)).add_concept("r1", kind="DECISION").add_concept("r2", kind="DECISION")
    f = f.add_concept("c1", activation="threestate").add_concept("c2", activation="threestate")
    f = f.add_concept("c3", kind="FUZZY", fuzzy={"membership": [0.25, 0.5, 1, 0.5, 0.25], "val_list": [1, 2, 3, 4, 5]})
    for a in [("c3", "r1", 0.5), ("c3", "r2", 0.5), ("r1", "c1", 1), ("r2", "c2", 1), ("c1", "c3", 0.7), ("c1", "r2", -0.3), ("c2", "c3", 0.8), ("c2", "r1", -0.2)]:
        f = f.add_relation(*a)
    got, _ = run_map(f.init_concept("c1", -1).init_concept("c2", -1))
    assert list(got.values()) == pytest.approx([0.4687996143920417, 0.4625401367231719, 0.3, 0.3, 0.3], abs=1e-15)


def literal(m):
    """One concept at a time, one step at a time, for iterative mode."""
    s, states = m.settings, {c.name: [c.value] for c in m.concepts}
    left, t = s.extra_steps - 1, 1
    while left > 0:
        stable = t > 1 and is_stable(m, states) and s.stabilize or t >= s.max_iter
        left = left - 1 if stable else s.extra_steps - 1
        now = {}
        for c in m.concepts:
            read = lambda d: 2 * states[d.name][-1] - 1 if d.excitation == "PAPAGEORGIUS" else states[d.name][-1]
            v = sum(read(m.concept(o)) * w for o, d, w in m.relations if d == c.name and m.concept(o).active) + (read(c) if m.uses_memory(c) else 0)
            name, args = m.function(c)
            f = ACTIVATIONS[name]
            now[c.name] = float(f.array(np.array([v])) if f.parameter is None else f.array(np.array([v]), f.argument(args))[0])
        for n, v in now.items():
            states[n].append(v)
        t += 1
    return states


@pytest.mark.parametrize("settings", [{"extra_steps": 1}, {"extra_steps": 2}, {"max_iter": 4}, {"max_iter": 3, "extra_steps": 3}, {"stabilize": False, "max_iter": 9}, {"memory": True}, {"memory": True, "activation": "sigmoid", "stability_diff": 0.1}])
def test_stop_rule(settings):
    m = seven(decision_window="stable", **settings)
    m = m.add_relation("input_5", "result_2", 0.4).set_concept("input_1", active=False)
    want = literal(m)
    _, got = run_map(m)
    for n in NAMES:
        assert got[n] == pytest.approx(want[n], abs=1e-12)
    p = len(want["input_3"]) - m.settings.extra_steps - 1
    x = want["input_3"]
    assert run_map(m)[0]["input_3"] == pytest.approx(sum(x[: p + 1]) / (p + 1) if p > 0 else sum(x) / len(x))
    exited = run_map(m.set_decision("EXITED"))[0]["input_3"]
    assert exited == pytest.approx(max(x[:p]) if p > 0 else max(x)) or p == 0 and exited != exited


def test_matrix_mode_rules():
    m = seven(mode="matrix", max_iter=3).set_concept("input_1", active=False).add_relation("input_1", "result_1", 0.25)
    _, states = run_map(m)
    assert len(states["input_1"]) == 2
    alone = seven(mode="iterative").add_relation("input_1", "result_1", 0.25)
    assert run_map(m)[1]["result_1"][1] != run_map(alone)[1]["result_1"][1]


def test_definition():
    m = CognitiveMap().add_concept("a", kind="DECISION", lambda_val=3, activation="sigmoid").add_concept("b")
    assert m.add_relation("a", "nowhere", 1).relations == ()
    m = m.add_relation("a", "b", 0.5).add_relation("a", "b", 0.25)
    assert m.incoming_sum("b") == 0.75 and m.outgoing("a") == [("b", 0.5), ("b", 0.25)] and m.value("c") is None
    assert m.init_concept("c", 1, required=False) == m
    for wrong in (lambda: m.init_concept("c", 1), lambda: m.set_concept("c"), lambda: m.add_concept("x", activation="nope"), lambda: m.set_decision("nope"), lambda: m.add_concept("x", kind="nope"), lambda: CognitiveMap(Settings(mode="nope"))):
        with pytest.raises(ValueError):
            wrong()
    assert m.set_concept("a", value=0.5).concept("a").activation is None
    assert m.add_concept("a").value("a") == 0 and len(m.add_concept("a").relations) == 2
    assert m.set_defaults(kind="DECISION", memory=False).add_concept("d").concept("d").kind == "DECISION"
    assert m.set_activation("relm", lambda_val=2).function(m.concept("b")) == ("relm", {"lambda_val": 2.0})
    assert vector({"b": [1, 2], "a": 3}) == [3, 1, 2] and Settings(extra_steps=0).extra_steps == 1
    assert replace(m, inclination=0.9).function(m.concept("b"))[1]["lambda_val"] == pytest.approx(3.925919, abs=1e-5)
    assert m.select("target") == ["a"] and m.select("any") == ["a", "b"] and m.select("SIMPLE") == ["b"] and m.select(names=["b"]) == ["b"]
    assert set(final_state(m)) == {"a"}
    with pytest.raises(NotImplementedError):
        defuzzify()


def test_json_round_trip():
    m = seven(stability_diff=0.01).add_concept("f", fuzzy={"membership": [0, 1], "val_list": [1, 3]}, kind="FUZZY").init_concept("f", 2)
    m = m.add_concept("g", activation="gceq", weight=0.3, active=False, memory=True, excitation="PAPAGEORGIUS")
    back = from_json(to_json(m))
    assert replace(back, settings=replace(back.settings, decision_window="full")) == m and back.value("f") == 0.5
    for bad in ("", "{", '{"concepts": [{}]}', '{"activation_function": "nope"}', "[]"):
        with pytest.raises(ValueError, match="Cannot load json data due"):
            from_json(bad)
    assert from_json("{}") == CognitiveMap()


def test_batches_agree_with_single_runs(spark):
    m = seven(memory=True, decision_window="stable")
    rows = [(i, i / 10 - 1, (i * 7 % 11) / 11) for i in range(25)] + [(99, None, float("nan"))]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = {r.id: (r.x, r.y) for r in infer(df, m, {"input_1": "a", "input_5": "b"}, ["id"], {"result_1": "x", "result_2": "y"}).collect()}
    for i, a, b in rows:
        one = run_map(m.init_concept("input_1", a or 0.0).init_concept("input_5", b if b == b else 0.0))[0]
        assert got[i] == pytest.approx((one["result_1"], one["result_2"]), abs=1e-12)
    states = trace(df.filter("id = 3"), m, {"input_1": "a", "input_5": "b"}, ["id"])
    want = run_map(m.init_concept("input_1", rows[3][1]).init_concept("input_5", rows[3][2]))[1]
    assert [r.value for r in states.filter("concept = 'input_3'").orderBy("step").collect()] == pytest.approx(want["input_3"])
    with pytest.raises(ValueError):
        infer(df, m, {"nope": "a"}, ["id"], {})


def test_fuzzy_set_scale():
    s = FuzzySet.of([5, 1, 3], [0.25, 1, 0.5]).scaled()
    assert s.membership == (1.0, 0.5, 0.25) and s.values == pytest.approx((1 / 3, 2 / 3, 1.0))


def test_decisions_over_stored_states(spark):
    rows = [(0, [0.5, 0.25, 0.75, 0.1, 0.2], p) for p in (-1, 0, 1, 2, 4)] + [(1, [0.5], -1)]
    df = spark.createDataFrame(rows, "id int, x array<double>, p int")
    got = df.select("x", "p", *[f(F.col("x"), F.col("p")).alias(n) for n, f in DECIDERS.items()]).collect()
    for r in got:
        x, p = r.x, r.p
        assert r.LAST == (x[p] if p > 0 else x[-1])
        assert r.MEAN == pytest.approx(sum(x[: p + 1]) / (p + 1) if p > 0 else sum(x) / len(x))
        assert r.EXITED == (None if p == 0 else max(x[:p]) if p > 0 else max(x))


def row_by_row(c, x):
    """States of one row by the rules' own words: (states, p)."""
    s = c.settings
    e, states, streak, begin = s.extra_steps, [x], 0, None
    most = max(s.max_iter - 1, 1) if s.mode == "matrix" else 10**9
    need = e if s.mode == "matrix" else e - 1
    end = 1 if need == 0 else None
    while end is None or len(states) < min(end, most):
        if len(states) >= most:
            break
        states.append(c.step(states[-1][None, :])[0])
        t, move = len(states) - 1, states[-1] - states[-2]
        stable = abs(move.sum()) < s.stability_diff if s.mode == "matrix" else (np.abs(move) <= s.stability_diff).all() and s.stabilize or t >= s.max_iter - 1
        begin, streak = (t if streak == 0 else begin, streak + 1) if stable else (None, 0)
        if end is None and streak >= need:
            end = begin + e
    return states, (-1 if s.decision_window == "full" else len(states) - e - 1)


def test_running_decisions_against_stored_states():
    rng = np.random.default_rng(3)
    ends = set()
    for _ in range(250):
        mode, decision = rng.choice(["iterative", "matrix"]), str(rng.choice(["LAST", "MEAN", "EXITED"]))
        settings = Settings(
            max_iter=int(rng.integers(1, 14)), extra_steps=int(rng.integers(1, 5)), stabilize=bool(rng.integers(2)), stability_diff=float(rng.choice([0.001, 0.05, 0.3])),
            decision=decision, memory=bool(rng.integers(2)), activation=str(rng.choice(["sigmoid", "sigmoid_hip", "saturation"])), mode=str(mode), decision_window=str(rng.choice(["stable", "full"])),
        )
        m = CognitiveMap(settings)
        for k in range(4):
            m = m.add_concept(f"c{k}")
        for _ in range(7):
            m = m.add_relation(f"c{rng.integers(4)}", f"c{rng.integers(4)}", float(rng.uniform(-1, 1)))
        c = compile_map(m)
        x = rng.uniform(-1, 1, (9, 4))
        got = decided(c, x)
        stored, count = trajectories(c, x)
        for i in range(len(x)):
            states, p = row_by_row(c, x[i])
            assert count[i] == len(states) and np.allclose(stored[: count[i], i], states)
            v = np.array(states)
            want = {"LAST": lambda: v[p] if p > 0 else v[-1], "MEAN": lambda: v[: p + 1].mean(axis=0) if p > 0 else v.mean(axis=0), "EXITED": lambda: v.max(axis=0) if p < 0 else v[:p].max(axis=0) if p else np.full(4, np.nan)}[decision]()
            assert np.allclose(got[i], want, equal_nan=True)
            ends.add((mode, decision, len(states) < settings.max_iter, p > 0))
    assert len(ends) > 18 and not len(decided(c, x[:0]))
