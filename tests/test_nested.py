import json
from datetime import datetime

import duckdb

from fuzzloom.operators import nested
from fuzzloom.plans.data import p1_found, p1_intervals

SCHEMA = "rec_id long, map_id string, received_at timestamp_ntz, fcm_json string, child string, pos int"


def text(v):
    if v is None:
        return ""
    return v.strip() if isinstance(v, str) else json.dumps(v)


def brute(rows):
    """rows: (rec_id, received_at, fcm_json)."""
    first = {}
    for rec, at, js in rows:
        if rec not in first or at < first[rec][0]:
            first[rec] = (at, js)
    out = []
    for rec, (_, js) in first.items():
        try:
            obj = json.loads(js)
        except (TypeError, ValueError):
            continue
        for field, child in (("concepts", "concept"), ("relations", "relation")):
            entries = obj.get(field) if isinstance(obj, dict) else None
            entries = entries if isinstance(entries, list) else [entries]
            for pos, e in enumerate(entries):
                if not isinstance(e, dict):
                    continue
                out.append((rec, child, pos, text(e.get("id")) if child == "concept" else text(e.get("origin")) + ">" + text(e.get("destiny")), 0))
                args = e.get("custom_function_args") if child == "concept" else None
                if isinstance(args, str):
                    try:
                        args = json.loads(args)
                    except ValueError:
                        args = None
                if isinstance(args, list):
                    args = [(a["name"], a["value"]) for a in args]
                elif isinstance(args, dict):
                    args = list(args.items())
                for name, value in args or []:
                    n = len(value) if isinstance(value, list) else 1
                    out += [(rec, "arg", pos, name, i) for i in range(n)]
    return sorted(out)


def test_against_plain_walk(spark, small):
    rows = duckdb.sql(f"select rec_id, received_at, fcm_json from '{small}/fcm_records.parquet'").fetchall()
    got = sorted(tuple(r) for r in p1_found(spark, small).collect())
    assert got == brute(rows) and len(got) > 500


def test_odd_records(spark, write):
    t = datetime(2024, 1, 1)
    js = [
        None, "", "{", "[1]", "3", '{"concepts": NaN}', '{"concepts": null, "relations": {}}',
        '{"concepts": {"id": 7, "custom_function_args": "[{\\"name\\": \\"a\\", \\"value\\": [1, null]}]"}}',
        '{"concepts": [null, 5, {"id": " x ", "custom_function_args": {"e": [], "n": null, "s": "t"}}], "relations": [null, {"origin": 1.0}]}',
        '{"concepts": [' + ",".join(f'{{"id": {i}}}' for i in range(3000)) + "]}",
    ]
    rows = [(i, "m", t, j, "clash", 99) for i, j in enumerate(js)] + [(8, "m", datetime(2025, 1, 1), "{}", None, None)]
    got = sorted(tuple(r) for r in p1_found(spark, write(fcm_records=(SCHEMA, rows))).collect())
    assert [r for r in got if r[0] < 9] == [
        (6, "relation", 0, ">", 0), (7, "arg", 0, "a", 0), (7, "arg", 0, "a", 1), (7, "concept", 0, "7", 0),
        (8, "arg", 2, "n", 0), (8, "arg", 2, "s", 0), (8, "concept", 2, "x", 0), (8, "relation", 1, "1.0>", 0),
    ]
    assert len([r for r in got if r[0] == 9]) == 3000


def test_text_that_looks_like_an_empty_array(spark, write):
    js = '{"concepts": [{"id": "x", "custom_function_args": {"s": " [] ", "e": [], "l": ["[]", 1]}}]}'
    got = sorted(tuple(r) for r in p1_found(spark, write(fcm_records=(SCHEMA, [(1, "m", datetime(2024, 1, 1), js, None, None)]))).collect())
    assert got == [(1, "arg", 0, "l", 0), (1, "arg", 0, "l", 1), (1, "arg", 0, "s", 0), (1, "concept", 0, "x", 0)]


def test_small_batches(spark, small, monkeypatch):
    want = sorted(map(tuple, p1_found(spark, small).collect()))
    monkeypatch.setattr(nested, "EMITTED", 1)
    assert sorted(map(tuple, p1_found(spark, small).collect())) == want


def test_empty(spark, write):
    assert p1_found(spark, write(fcm_records=(SCHEMA, []))).count() == 0


def test_any_depth(spark, write):
    """A record nested beyond the interpreter's recursion keeps its concepts, and broken ones of that depth are broken."""
    deep = "[" * 60_000 + "1.50" + "]" * 60_000
    good = '{"x": ' + deep + ', "concepts": [{"id": ' + '{"a": ' * 20_000 + '[1, "t\\u00e9", null, true, {}]' + "}" * 20_000 + '}, {"id": "b"}]}'
    rows = [(1, "m", datetime(2024, 1, 1), good, None, None), (2, "m", datetime(2024, 1, 1), good[:-1], None, None), (3, "m", datetime(2024, 1, 1), good + "]", None, None)]
    got = sorted(tuple(r) for r in p1_found(spark, write(fcm_records=(SCHEMA, rows))).collect())
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 1)] and got[0][3].endswith('[1, "té", null, true, {}]' + "}" * 20_000)


def test_parse_without_recursion():
    texts = ['{"a": [1, 2.50, -3e4], "b": {"c": [], "d": {}}, "a": "x\\n"}', "[]", "3", '"s"', " [ null , true,false ] ", "[1,]", "[1 2]", "{1: 2}", '{"a" 1}', "", "[", '{"a":', "nul", "[01]", "1 1", "{,}", '["a\nb"]']
    for text in texts:
        try:
            want = json.loads(text, parse_int=nested._Number, parse_float=nested._Number)
        except ValueError:
            want = ValueError
        try:
            got = nested._parse_deep(text.strip())
        except ValueError:
            got = ValueError
        assert got == want, text
    assert nested.as_text(nested.parse('{"a": [1, 2.50], "b": "é"}')) == '{"a": [1, 2.50], "b": "é"}' and nested.as_text(nested.parse("[]")) == "[]"


def test_intervals_hold_exactly_what_is_inside(spark, small):
    rows = p1_intervals(spark, small).collect()
    assert rows and all(r.n == r.as_linked for r in rows)


def test_generic_tables(spark):
    """Other paths, a table within a table, members of nodes that are no objects, and half a surrogate pair."""
    shape = nested.Shape({"box": nested.Table("a.boxes[]", ("name",)), "leaf": nested.Table("a.boxes[].leaves[]", ("value",), up=(("box", "box", "name"), ("box_pos", "box", "pos")), objects=False)})
    df = spark.createDataFrame([(1, '{"a": {"boxes": [{"leaves": [1, [2, 3]], "name": "p"}, 5, {"leaves": ["\\ud800x"]}]}, "boxes": [1]}', "clash")], "id long, js string, kind string")
    rows = nested.shred(df, ["id"], "js", shape)
    leaves = [tuple(r)[3:] for r in nested.table(rows, ["id"], shape, "leaf").orderBy("pre").collect()]
    assert leaves == [(0, False, "1", "p", "0"), (1, False, "[2, 3]", "p", "0"), (0, False, "?x", None, "2")]
    assert [tuple(r)[3:] for r in nested.table(rows, ["id"], shape, "box").orderBy("pre").collect()] == [(0, False, "p"), (2, False, None)]
