import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb

from fuzzloom.operators.prefix import running
from fuzzloom.operators.references import Cascade, ForeignKey, status_at
from fuzzloom.plans.data import p3_found, p3_report

REC = "rec_id long, map_id string, received_at timestamp_ntz, fcm_json string"
DEL = "map_id string, concept_id string, deleted_at timestamp_ntz, id string"


def text(v):
    return v.strip() if isinstance(v, str) else json.dumps(v)


def entries(obj, field):
    e = obj.get(field) if isinstance(obj, dict) else None
    return [(i, x) for i, x in enumerate(e if isinstance(e, list) else [e]) if isinstance(x, dict)]


def brute(records, deletions):
    first = {}
    for rec, m, at, js in records:
        if rec not in first or at < first[rec][1]:
            first[rec] = (m, at, js)
    come, gone, ends = defaultdict(list), defaultdict(list), []
    for rec, (m, at, js) in first.items():
        try:
            obj = json.loads(js)
        except (TypeError, ValueError):
            continue
        for _, c in entries(obj, "concepts"):
            if c.get("id") is not None:
                come[m, text(c["id"])].append(at)
        for pos, r in entries(obj, "relations"):
            ends += [(rec, pos, e, m, at, text(r[e])) for e in ("origin", "destiny") if r.get(e) is not None]
    for m, c, at in deletions:
        gone[m.strip(), c.strip()].append(at)
    out = []
    for rec, pos, e, m, at, i in ends:
        seen = [t for t in come[m, i] if t <= at]
        if not come[m, i]:
            out.append((rec, pos, e, "missing"))
        elif not seen:
            out.append((rec, pos, e, "late"))
        elif any(max(seen) < d <= at for d in gone[m, i]):
            out.append((rec, pos, e, "deleted"))
    return sorted(out)


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    records = duckdb.sql(f"select rec_id, map_id, received_at, fcm_json from '{sf}/fcm_records.parquet'").fetchall()
    deletions = duckdb.sql(f"select map_id, concept_id, deleted_at from '{sf}/concept_deletions.parquet'").fetchall()
    want = brute(records, deletions)
    assert sorted(tuple(r) for r in p3_found(spark, sf).collect()) == want
    assert {w[3] for w in want} == {"missing", "late", "deleted"}


def test_ties_and_empty(spark, write):
    t = datetime(2024, 1, 1)
    both = '{"concepts": [{"id": "a"}], "relations": [{"origin": "a", "destiny": "b"}]}'
    d = write(fcm_records=(REC, [(1, "m", t, both), (2, "m", t + timedelta(1), both), (3, None, t, both)]), concept_deletions=(DEL, [("m ", " a", t, "x"), ("m", "a", t, None), ("m", "a", None, None)]))
    # The deletion at the time of the last arrival isn't after it.
    assert sorted(tuple(r) for r in p3_found(spark, d).collect()) == [(i, 0, "destiny", "missing") for i in (1, 2, 3)]
    d = write(fcm_records=(REC, []), concept_deletions=(DEL, []))
    assert p3_found(spark, d).count() == 0 and p3_report(spark, d).count() == 0


def test_running_crosses_ranges(spark):
    rows = [("hot", i, 1, i % 7) for i in range(500)] + [(None, i, 1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, o int, one long, v int")
    got = {(r.k, r.o): (r.s, r.m) for r in running(df, ["k"], ["o"], {"s": ("sum", "one"), "m": ("max", "v")}, 7).collect()}
    assert got == {(k, o): (o + 1, min(o, 6) if k else o) for k, o, _, _ in rows}


def test_cascade_rounds_and_cycles(spark):
    a = spark.createDataFrame([(1, None), (2, 9), (3, 2), (4, 3), (5, 6), (6, 5)], "id int, up int")
    b = spark.createDataFrame([(10, 4), (11, 1), (12, 77), (13, None)], "bid int, a int")
    keys = [ForeignKey("a", ("up",), "a", ("id",)), ForeignKey("b", ("a",), "a", ("id",))]
    got = Cascade({"a": (a, ["id"]), "b": (b, ["bid"])}, keys).found()
    assert sorted(tuple(r) for r in got["a"].collect()) == [(2, "direct", 0), (3, "inherited", 1), (4, "inherited", 2)]
    assert sorted(tuple(r) for r in got["b"].collect()) == [(10, "inherited", 3), (12, "direct", 0)]


def test_status_against_plain_rule(spark):
    """Many arrivals and deletions of few keys, null keys and times among them."""
    rng = random.Random(6)
    t = lambda: None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40))
    name = lambda: rng.choice(["hot", "hot", "a", "b", None])
    come, gone = [(name(), t()) for _ in range(60)], [(name(), t()) for _ in range(60)]
    refs = [(name() if rng.random() < 0.9 else "never", i, t()) for i in range(400)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = status_at(frame(refs, "k string, i int, at timestamp_ntz"), frame(come, "k string, at timestamp_ntz"), frame(gone, "k string, at timestamp_ntz"), ["k"], ["i"], "at").collect()
    end = datetime(9999, 12, 31)
    want = set()
    for k, i, at in refs:
        at = at or end
        seen = [x or end for c, x in come if c == k]
        before = [x for x in seen if x <= at]
        if not seen:
            want.add((i, "missing"))
        elif not before:
            want.add((i, "late"))
        elif any(max(before) < (x or end) <= at for g, x in gone if g == k):
            want.add((i, "deleted"))
    assert {(r.i, r.status) for r in got} == want and len(got) == len(want) and {s for _, s in want} == {"missing", "late", "deleted"}
