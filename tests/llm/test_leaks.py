import random

import numpy as np
import pytest

from fuzzloom.llm import leaks as L
from fuzzloom.llm.queries import p7_found, p7_items

DOCS = "doc_id long, text string, item_id int, suite string"
ITEMS = "item_id int, suite string, lang string, item_text string, doc_id long"


def holds(text, item):
    """By plain alignment of every word with every word."""
    most = len(item) // 6
    best = [[[0] * (len(text) + 1) for _ in range(most + 1)]]
    for i, w in enumerate(item, 1):
        row = [[0] * (len(text) + 1) for _ in range(most + 1)]
        for e in range(most + 1):
            for j in range(len(text) + 1):
                v = 0
                if j and text[j - 1] == w:
                    v = best[i - 1][e][j - 1] + 1
                if e:
                    v = max(v, best[i - 1][e - 1][j] + 1)
                    if j:
                        v = max(v, best[i - 1][e - 1][j - 1] + 1, row[e - 1][j])
                        v = max(v, row[e - 1][j - 1])
                row[e][j] = v
                if (e == 0 and v >= 12) or v >= max(20, 6 * e):
                    return True
        best.append(row)
    return False


def mutate(rng, words, vocabulary, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        if r < 2 * share / 3:
            out.append(rng.choice(vocabulary))
            continue
        out.append(w)
        if r > 1 - share / 3:
            out.append(rng.choice(vocabulary))
    return out


@pytest.mark.parametrize("size", [25, 400])
def test_search_against_plain_alignment(spark, write, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(size)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(12, 50))] for _ in range(14)]
    items.append(items[0][:30] + items[1][:20])
    # Longer than one part.
    items.append([rng.choice(vocabulary) for _ in range(190)])
    docs = []
    for _ in range(110):
        it = rng.choice([*items, items[-1], items[-1]])
        a = rng.randrange(len(it) - 8)
        part = it[a : a + rng.randrange(8, 60)]
        around = [[rng.choice(vocabulary) for _ in range(rng.randrange(15))] for _ in range(2)]
        docs.append(around[0] + mutate(rng, part, vocabulary, rng.choice([0, 0.1, 0.16, 0.2, 0.3])) + around[1])
    # Changes as far apart as can be: one in six, and one more.
    long = items[0] = [f"w{i % size}" for i in range(3, 48)]
    docs += [[("x" if i % 6 == k else w) for i, w in enumerate(long[:n])] for k in (4, 5) for n in (20, 23, 24, 25, 30, 42)]
    docs += [[("x" if i % 5 == 4 else w) for i, w in enumerate(long[:24])], long[:11], long[:12], long[:17] + ["x"], []]
    d = write(documents=(DOCS, [(i, " ".join(w), 9, "x") for i, w in enumerate(docs)]), eval_items=(ITEMS, [(i, "s", "en", " ".join(w), 1) for i, w in enumerate(items)]))
    want = {(r, i) for r, doc in enumerate(docs) for i, it in enumerate(items) if holds(doc, it)}
    assert {tuple(r) for r in p7_found(spark, d).collect()} == want
    assert len(want) > 25 and any(holds(doc, items[0]) for doc in docs[110:])


def test_long_items(spark, write):
    """Items of thousands of words are taken in parts; passages over the parts' borders are found."""
    rng = random.Random(12)
    item = [f"v{rng.randrange(3000)}" for _ in range(4000)]
    docs = [item[k : k + 12] for k in range(30, 50)] + [[w if i % 7 else "x" for i, w in enumerate(item[k : k + 45])] for k in (0, 33, 61, 3940)] + [[w if i % 4 else "x" for i, w in enumerate(item[:400])], item[3989:]]
    d = write(documents=(DOCS, [(i, " ".join(w), 9, "x") for i, w in enumerate(docs)]), eval_items=(ITEMS, [(1, "s", "en", " ".join(item), 1)]))
    assert sorted(r.doc_id for r in p7_found(spark, d).collect()) == [*range(24)]


def test_winnowing_guarantee():
    rng = random.Random(2)
    for _ in range(200):
        shared = [rng.randrange(1, 30) for _ in range(L.K + L.WINDOW - 1)]
        sides = []
        for _ in range(2):
            ids = np.array([rng.randrange(0, 30) for _ in range(9)] + shared + [rng.randrange(0, 30) for _ in range(9)], np.uint64)
            key, ok = L._grams(ids)
            sides.append({int(key[i]) for i in L._winnow(key, ok) if 9 <= i < 9 + L.WINDOW})
        assert sides[0] & sides[1]


def test_words():
    assert L.words("> L’ÉTÉ de Keva-\n> meind&nbsp;et <b>the</b> co­op​era te — a|b\r\n- Straße<br>x [t](http://u/v) <|endoftext|>fin") == "lete de kevameind et the coopera te a b strasse x t fin".split()
    assert L.words(None) == L.words("") == [] and L.words("1431. The 2 < 3 & 4 > 1") == ["1431", "the", "2", "3", "4", "1"]


def test_odd_tables(spark, write, monkeypatch):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    docs = [(1, " ".join(passage), 9, "x"), (2, "<b>" + "\n> ".join(passage[2:14]).upper() + "</b>", 9, "x"), (3, " ".join(passage[:11]), 9, "x"), (4, None, 9, "x"), (5, "", 9, "x"), (1, " ".join(passage), 9, "x"), (6, "q " * 200_000 + " ".join(passage[4:]), 9, "x"), (None, " ".join(passage), 9, "x")]
    items = [(7, "s", "en", " ".join(passage), 1), (7, "s", "en", " ".join(passage), 1), (8, "s", "en", None, 1), (9, "s", "en", "too short", 1), (None, "s", "en", " ".join(passage), 1), (10, "s", None, " ".join(reversed(passage)), 1)]
    d = write(documents=(DOCS, docs), eval_items=(ITEMS, items))
    want = [(None, 7), (1, 7), (2, 7), (6, 7)]
    got = lambda: sorted(map(tuple, p7_found(spark, d).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got() == want
    assert [tuple(r) for r in p7_items(spark, d).collect()] == [(7, "s", "en", 4)]
    # A bitmap that is full lets all pass; a join that isn't broadcast finds the same.
    monkeypatch.setattr(L, "BITS", 8)
    assert got() == want
    monkeypatch.setattr(L.join_small, "__defaults__", ("inner", 0))
    assert got() == want


def test_empty(spark, write):
    assert p7_found(spark, write(documents=(DOCS, []), eval_items=(ITEMS, []))).count() == 0
    assert p7_found(spark, write(documents=(DOCS, [(1, "a b", 1, "x")]), eval_items=(ITEMS, []))).count() == 0
