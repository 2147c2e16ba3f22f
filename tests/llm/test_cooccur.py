import itertools
import math
from collections import Counter

import duckdb
import pytest

from fuzzloom.llm.queries import oracle_sql, p2_found, p2_pairs

SCHEMA = "row_id long, f1 string, class string, item string, n long"


@pytest.mark.parametrize("name", ["p2_found", "p2_pairs"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"create view learning_rows as select * from '{small}/learning_rows.parquet'")
    frame = {"p2_found": p2_found, "p2_pairs": p2_pairs}[name](spark, small)
    names = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(*names).collect()))
    want = sorted(con.sql(f"select {', '.join(names)} from ({oracle_sql()[name]})").fetchall())
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert all(math.isclose(a, b, abs_tol=2e-6) if isinstance(a, float) else a == b for a, b in zip(g, w, strict=True))


def test_dirty_baskets(spark, write):
    wide = "|".join(f"w{i:03d}" for i in range(300))
    rows = [(1, " A|a ||B\t", " C", "x", 1), (1, " A|a ||B\t", " C", "y", 2), (2, None, None, None, None), (3, "a|b| É", "", None, None), (4, " | ", "c", None, None), (5, wide, None, None, None)]
    d = write(learning_rows=(SCHEMA, rows))
    sets = [{"a___f1", "b___f1", "c___class"}, set(), {"a___f1", "b___f1", "é___f1"}, {"c___class"}, {f"w{i:03d}___f1" for i in range(300)}]
    one = Counter(x for s in sets for x in s)
    two = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): (r.n_both, r.n_a, r.n_b, r.n_all) for r in p2_pairs(spark, d).collect()}
    assert got == {(a, b): (n, one[a], one[b], 5) for (a, b), n in two.items()}
    assert {tuple(r) for r in p2_found(spark, d).collect()} == {p for p, n in two.items() if n * 500 >= 5 and n * 5 >= 2 * one[p[0]] * one[p[1]]}


def test_empty(spark, write):
    d = write(learning_rows=(SCHEMA, []))
    assert p2_found(spark, d).count() == 0 and p2_pairs(spark, d).count() == 0
