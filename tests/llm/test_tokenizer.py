import random

import duckdb
from tokenizers import Tokenizer

from fuzzloom.llm import blocks
from fuzzloom.llm.queries import p6_decoded, p6_ids
from fuzzloom.llm.tokenizer import FOLDER, decode

SCHEMA = "doc_id long, text string, ids array<int>, block long, word string"


def reference():
    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_against_library(spark, small):
    encode = reference()
    texts = dict(duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())
    got = p6_ids(spark, small).collect()
    assert len(got) == len(texts) and all(r.ids == encode(texts[r.doc_id]) for r in got)
    assert {r.doc_id: r.text for r in p6_decoded(spark, small).collect()} == {d: t or "" for d, t in texts.items()}


def test_odd_texts(spark, write, monkeypatch):
    rng = random.Random(1)
    odd = [None, "", " ", "\n\n \t x\r\n", "<|endoftext|> <|startoftext|>", "I'll we've 12'S don't", "a" * 20_000, "​﻿\x00\x07\x1c\x85\xa0　x", "👩‍🔬🧪 été ﬁ 漢字 עברית ½²Ⅷ", "x" + " " * 5000 + "y", "�" * 9]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x1FFFF), 32, 10])) for _ in range(rng.randrange(200))) for _ in range(300)]
    d = write(documents=(SCHEMA, [*((i, t, None, 5, "clash") for i, t in enumerate(odd)), (None, "null id", None, None, None), (3, "again", None, None, None)]))
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 2000)
    encode = reference()
    want = [(i, tuple(encode(t))) for i, t in enumerate(odd)] + [(None, tuple(encode("null id"))), (3, tuple(encode("again")))]
    got = [(r.doc_id, tuple(r.ids)) for r in p6_ids(spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r.doc_id: r.text for r in p6_decoded(spark, d).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(odd) if i != 3)


def test_empty_and_bad_ids(spark, write):
    assert p6_ids(spark, write(documents=(SCHEMA, []))).count() == 0
    df = spark.createDataFrame([(1, None), (2, [-1, 60_000, 64]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(df).collect()} == {1: None, 2: "��a", 3: ""}
