import duckdb
import numpy as np
from pyspark.sql import functions as F

from fuzzloom.llm import reading as R
from fuzzloom.llm.queries import p8_found
from fuzzloom.scratch import materialize

DOCS = "doc_id long, text string, level int, votes string"
LABELS = "doc_id long, rater string, reading_level int, rated_at timestamp, text string"


def test_held_out_accuracy(spark):
    """Documents on which two raters or more agree, left out of the fit, get that level in 95 of 100 cases or more."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/reading_labels.parquet")
    rated = R.ratings(labels)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    train = materialize(rated.filter(~held), "train")
    blocks = R.blocks_of(docs)
    profiled = R.profiles(blocks, R.word_grades(blocks, train))
    got = R.predict(profiled, train, R.fit(profiled, train)).join(rated.filter(held), "doc_id").collect()
    agreed = [r for r in got if max(r.votes) == sum(r.votes) >= 2]
    assert len(agreed) > 80 and np.mean([r.reading_level == r.level for r in agreed]) >= 0.95
    right = np.mean([r.reading_level == r.level for r in got])
    print("documents left out:", len(got), "right:", right)
    assert right >= 0.9


def test_every_long_document_once(spark, small):
    want = {d for d, t in duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall() if len((t or "").split()) >= 25}
    got = p8_found(spark, small).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) and {r.reading_level for r in got} <= set(R.LEVELS)


def test_odd_input(spark, write):
    easy, hard = "the dog sees a cat and ", "notwithstanding jurisdiction supersedes methodology whereas "
    docs = [(i, (easy if i % 2 else hard) * 6, None, "x") for i in range(40)]
    docs += [(100, None, 1, "x"), (101, "", 1, "x"), (102, "1 2 3 " * 20, 1, "x"), (103, easy * 30_000, 1, "x"), (None, hard * 6, 1, "x"), (104, "word " * 24, 1, "x")]
    labels = [(i, f"r{k}", 1 if i % 2 else 4, None, "clash") for i in range(30) for k in (0, 0, 1)]
    labels += [(None, "r", 2, None, None), (3, None, None, None, None), (4, "r", 9, None, None), (999, "r", 2, None, None)]
    got = {r.doc_id: r.reading_level for r in p8_found(spark, write(documents=(DOCS, docs), reading_labels=(LABELS, labels))).collect()}
    assert set(got) == {*range(40), 102, 103, None}
    assert all(got[i] == (1 if i % 2 else 4) for i in range(40)) and got[103] == 1 and got[None] == 4


def test_empty(spark, write):
    assert p8_found(spark, write(documents=(DOCS, []), reading_labels=(LABELS, []))).count() == 0
    got = p8_found(spark, write(documents=(DOCS, [(1, "a b " * 20, 1, "x")]), reading_labels=(LABELS, []))).collect()
    assert [tuple(r) for r in got] == [(1, 1)]
