import re

import duckdb
import pytest

from fuzzloom.plans.data import p4_assembled, p4_found, p4_rejects, p4_rows
from fuzzloom.sources import strict_csv
from fuzzloom.sources.strict_csv import assemble, judge


def brute(raw, columns, sep, classes):
    """By the rule's own words, with a pattern instead of a reader."""
    raw = raw.rstrip("\r")
    s = re.escape(sep)
    field = rf'(?:"((?:[^"]|"")*)"|((?!")[^"{s}]*))'
    if not re.fullmatch(rf"{field}(?:{s}{field})*", raw):
        return "broken_quoting"
    fields, at = [], 0
    while True:
        m = re.compile(field).match(raw, at)
        fields.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end() + 1
        if m.end() >= len(raw):
            break
    if len(fields) != len(columns):
        return "column_count"
    return None if fields[columns.index("class")].strip() in classes else "invalid_value"


def test_against_pattern(spark):
    sf = "/root/testdata/sf0.01"
    files = {r[0]: r[1:] for r in duckdb.sql(f"select file_id, column_list, sep_char, class_set from '{sf}/csv_files.parquet'").fetchall()}
    sets = dict(duckdb.sql(f"select class_set, list(class) from '{sf}/class_values.parquet' group by 1").fetchall())
    lines = set(duckdb.sql(f"select line_id, file_id, raw_line from '{sf}/csv_lines.parquet'").fetchall())
    want = {}
    for line, f, raw in lines:
        columns, sep, cs = files[f]
        if r := brute(raw, columns, sep, sets[cs]):
            want[line] = r
    got = [tuple(r) for r in p4_found(spark, sf).collect()]
    assert dict(got) == want and len(got) == len(want) and set(want.values()) == {"broken_quoting", "column_count", "invalid_value"}
    assert p4_rows(spark, sf).count() == len(lines) - len(want)


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ("a,low", None), ('"a",low', None), ('"a"x,low', "broken_quoting"), ('a"b,low', "broken_quoting"), ('"a,low', "broken_quoting"),
        ('"a""b",low', None), ('"a\nb",low', None), ("a\nb,low", None), ("a,low\r\r", None), ("a, low ", None), ("a,", "invalid_value"), ("a,Low", "invalid_value"),
        ("", "column_count"), (None, "column_count"), ("a,low,x", "column_count"), ('"a\\"b",low', "broken_quoting"), ('a,"low"\r', None), ('"",low', None), ('"""",low', None), ('""",low', "broken_quoting"),
        ("x" * 300_000 + ",low", None), ("\r,low", None), ('a, "low"', "broken_quoting"),
    ],
)
def test_judge(raw, reason):
    assert judge(raw, ["F1", "class"], ",", {"low"})[0] == reason


def test_many_files_and_edges(spark, write, monkeypatch):
    d = write(
        csv_lines=("line_id long, file_id int, line_no long, raw_line string, reason string", [(1, 1, 1, "a;x", None), (1, 1, 1, "a;x", None), (2, 1, 2, "a;y", "clash"), (3, 9, 1, "a;x", None), (4, None, 1, None, None), (5, 2, 1, "x", None)]),
        csv_files=("file_id int, column_list array<string>, sep_char string, class_set string", [(1, ["F1", "class"], ";", "s"), (2, ["F1"], ",", None), (None, None, None, None)]),
        class_values=("class_set string, class string", [("s", "x"), (None, "y")]),
    )
    want = [(2, "invalid_value"), (3, "column_count"), (4, "column_count")]
    assert sorted(tuple(r) for r in p4_found(spark, d).collect()) == want
    monkeypatch.setattr(strict_csv, "MOST_FILES", 0)
    assert sorted(tuple(r) for r in p4_found(spark, d).collect()) == want


def test_no_separator_with_few_and_many_files(spark, write, monkeypatch):
    d = write(
        csv_lines=("line_id long, file_id int, raw_line string", [(i, i, "a,x") for i in (1, 2, 3)] + [(4, 9, 'a"b'), (5, None, "a,x")]),
        csv_files=("file_id int, column_list array<string>, sep_char string, class_set string", [(1, ["F1", "class"], None, "s"), (2, ["F1", "class"], "", "s"), (3, ["F1", "class"], ",", "s")]),
        class_values=("class_set string, class string", [("s", "x")]),
    )
    want = [(1, "column_count"), (2, "column_count"), (4, "broken_quoting"), (5, "column_count")]
    for most in (10, 0):
        monkeypatch.setattr(strict_csv, "MOST_FILES", most)
        assert sorted(tuple(r) for r in p4_found(spark, d).collect()) == want


def test_assemble(spark):
    lines = ['a,"b', 'c"', "d", None, '"x', "y", 'z"'] * 30
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, no int, line string")
    got = [(r.no, r.line) for r in assemble(df, "file", "no", "line").orderBy("no").collect()]
    one = ['a,"b\nc"', "d", "", '"x\ny\nz"']
    assert [g[1] for g in got] == one * 30 and [g[0] for g in got][:5] == [0, 2, 3, 4, 7]


def test_rejects_and_assembled_files(spark, write):
    d = write(
        csv_lines=("line_id long, file_id int, raw_line string", [(1, 1, "1.5,low"), (2, 1, " x ,low"), (3, 1, ",low"), (4, 1, "2,high"), (5, 1, '3,"low\n"'), (6, 1, '"3\n\n,1",low'), (7, 1, 'a"'), (8, 1, None), (8, 1, None)]),
        csv_files=("file_id int, column_list array<string>, sep_char string, class_set string", [(1, ["F2", "class"], ",", "s")]),
        class_values=("class_set string, class string", [("s", "low")]),
    )
    got = sorted((tuple(r) for r in p4_rejects(spark, d).collect()), key=str)
    assert got == [(2, 1, "invalid_number", "F2", " x "), (4, 1, "invalid_value", "class", None), (6, 1, "invalid_number", "F2", "3\n\n,1"), (7, 1, "broken_quoting", None, None), (8, 1, "column_count", None, None)]
    assert {(r.f2, r.line_id) for r in p4_rows(spark, d).collect()} == {(1.5, 1), (None, 2), (None, 3), (3.0, 5), (None, 6)}
    assert {r.outcome: r.n for r in p4_assembled(spark, d).collect()} == {"loaded": 5, "invalid_value": 1, "column_count": 1}
