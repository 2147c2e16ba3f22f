"""Reading level of documents from the grades at which their words are acquired."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.llm.blocks import cut, documents_of, reassemble, words_of
from fuzzloom.scratch import join_small, materialize

LEVELS = (1, 2, 3, 4)
#: Rated documents that a word must be in to have a grade, and the pseudo-documents that pull its distribution to even shares.
MIN_DOCS, PRIOR = 5, 2.0
#: Quantiles of a document's known-word grades that its level is told from.
QUANTILES = (0.05, 0.15, 0.25, 0.35, 0.5, 0.65, 0.75, 0.85, 0.95)
#: Most rated documents that the calibration is fitted on (those with the least hash of doc_id).
MAX_FIT = 20_000
#: Parts of the rated documents; the grades that a part is told come from the others.
FOLDS = 5
#: Pairs of ratings taken to agree, of how many, beside those that the ratings hold.
PAIRS = (9, 10)
#: Pieces between white space that a document must have.
MIN_PIECES = 25

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _splitter() -> Callable[[str], list[str]]:
    return words


def ratings(labels: DataFrame) -> DataFrame:
    """Written (doc_id, level, votes): the most frequent rating of each document (ties: the lower) and the number of each level.

    A rater's repeated rating counts once; ratings off the scale and rows without doc_id or level count for nothing.
    """
    once = labels.select("doc_id", "rater", F.col("reading_level").cast("int").alias("r")).distinct().filter(F.col("doc_id").isNotNull() & F.col("r").isin(*LEVELS))
    votes = [F.count(F.when(F.col("r") == k, 1)).cast("int").alias(f"v{k}") for k in LEVELS]
    counted = once.groupBy("doc_id").agg(*votes)
    most = F.greatest(*[F.col(f"v{k}") for k in LEVELS])
    level = F.coalesce(*[F.when(F.col(f"v{k}") == most, k) for k in LEVELS])
    return materialize(counted.select("doc_id", level.alias("level"), F.array(*[F.col(f"v{k}") for k in LEVELS]).alias("votes")), "ratings")


def _fold(doc_id):
    """The fold of a document; those without doc_id are in the first."""
    return F.coalesce(F.pmod(doc_id, F.lit(FOLDS)), F.lit(0))


def _seen(blocks: pa.Table, levels: pa.Table) -> pa.Table:
    """(word, fold, level, n): in how many of a block's rated documents of each fold and level a word is."""
    rows = blocks.combine_chunks()
    is_doc = pc.is_null(rows.column("word"))
    docs, words_ = rows.filter(is_doc), rows.filter(pc.invert(is_doc))
    level_of = dict(zip(levels.column("doc").to_pylist(), levels.column("level").to_pylist(), strict=True))
    names = np.empty(len(words_), object)
    names[words_.column("no").to_numpy()] = words_.column("word").to_pylist()
    seqs, keys = docs.column("seq").combine_chunks(), [np.empty(0, np.int64)]
    flat, ends = seqs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(seqs.value_lengths().to_numpy())])
    for i, doc in enumerate(docs.column("doc_id").to_pylist()):
        if doc in level_of:
            keys.append(np.unique(flat[ends[i] : ends[i + 1]]).astype(np.int64) * (FOLDS * 8) + (doc % FOLDS) * 8 + level_of[doc])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return pa.table({"word": pa.array(names[key // (FOLDS * 8)].tolist(), pa.string()), "fold": pa.array(key // 8 % FOLDS, pa.int32()), "level": pa.array(key % 8, pa.int32()), "n": pa.array(n, pa.int64())})


def word_grades(blocks: DataFrame, rated: DataFrame) -> DataFrame:
    """Written (word, grades): the mean level at which a word is met, as each fold of the documents is told it: from the others.

    Counted is in how many rated documents of each level the word is; each level's count is put against the level's documents,
    so that a level rated more often weighs no more. A word in fewer than ``MIN_DOCS`` of the documents that count has no grade.
    No document's grades come from its own rating, so those that are rated look like all others.

    blocks: written blocks of ``cut``. Only numbers of documents are joined with the ratings; texts stay where they are.
    """
    levels = join_small(documents_of(blocks).select("block", "doc_id"), rated, ["doc_id"]).select(F.col("block").alias("at"), F.col("doc_id").alias("doc"), "level")
    found = blocks.select("block", "word", "doc_id", "no", "seq").groupBy("block").cogroup(levels.groupBy("at")).applyInArrow(_seen, "word string, fold int, level int, n long")
    cells = [(k, f) for k in LEVELS for f in range(FOLDS)]
    counts = found.groupBy("word").agg(*[F.sum(F.when((F.col("level") == k) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{k}_{f}") for k, f in cells])
    of = {(r.level, r.fold): r.n for r in rated.groupBy("level", _fold(F.col("doc_id")).alias("fold")).agg(F.count("*").alias("n")).collect()}

    def grade(fold: int) -> Column:
        others = [f for f in range(FOLDS) if f != fold]
        n = {k: reduce(add, [F.col(f"n{k}_{f}") for f in others]) for k in LEVELS}
        documents = {k: sum(of.get((k, f), 0) for f in others) for k in LEVELS}
        total = sum(documents.values())
        # A level's share: its documents with the word, scaled as if all levels had equally many documents.
        share = [(n[k] * (total / len(LEVELS) / documents[k]) if documents[k] else F.lit(0.0)) + PRIOR / len(LEVELS) for k in LEVELS]
        return F.when(reduce(add, n.values()) >= MIN_DOCS, reduce(add, [k * s for k, s in zip(LEVELS, share, strict=True)]) / reduce(add, share))

    grades = counts.select("word", F.array(*[grade(f) for f in range(FOLDS)]).alias("grades"))
    return materialize(grades.filter(F.exists("grades", lambda g: g.isNotNull())), "grades")


def _profile(documents: pa.Table, found: pa.Table) -> pa.Table:
    """Quantiles and mean of the grades of each document's known words; null lists without any."""
    docs = documents.combine_chunks()
    seq = docs.column("seq").combine_chunks()
    flat, n = seq.flatten().to_numpy(), seq.value_lengths().to_numpy().astype(np.int64)
    size = max(int(flat.max(initial=-1)), int(np.max(found.column("no").to_numpy(), initial=-1))) + 1
    grade = np.full((size, FOLDS), np.nan)
    if len(found):
        grade[found.column("no").to_numpy()] = found.column("grades").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(found), FOLDS)
    fold = docs.column("doc_id").fill_null(0).to_numpy() % FOLDS
    doc = np.repeat(np.arange(len(n)), n)
    g = grade[flat, fold[doc]]
    known = ~np.isnan(g)
    doc, g = doc[known], g[known]
    order = np.lexsort((g, doc))
    g = g[order]
    count = np.bincount(doc, minlength=len(n))
    start = np.cumsum(count) - count
    some = count > 0
    at = np.array(QUANTILES)[None, :] * np.maximum(count[some, None] - 1, 0) + start[some, None]
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, (start + count - 1)[some, None])
    q = g[low] + (g[high] - g[low]) * (at - low)
    mean = np.add.reduceat(g, start[some]) / count[some] if some.any() else np.empty(0)
    rows = np.concatenate([q, mean[:, None]], axis=1)
    full = np.full((len(n), len(QUANTILES) + 1), np.nan)
    full[some] = rows
    lists = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), len(QUANTILES) + 1).cast(pa.list_(pa.float64()))
    return pa.table({"doc_id": docs.column("doc_id"), "pieces": docs.column("pieces"), "q": lists})


def blocks_of(documents: DataFrame) -> DataFrame:
    """Written blocks of the documents' words: each text is read and split once."""
    return cut(documents, _splitter, "words")


def profiles(blocks: DataFrame, grades: DataFrame) -> DataFrame:
    """Written (doc_id, pieces, q) of each document with ``MIN_PIECES`` or more: words are looked up by a join, corpus-wide."""
    found = join_small(words_of(blocks), grades, ["word"]).select("block", "no", "grades")
    return materialize(reassemble(blocks, found, _profile, "doc_id long, pieces int, q array<double>").filter(F.col("pieces") >= MIN_PIECES), "profiles")


class Calibration:
    """Multinomial logistic regression from profiles to levels. Without known words a document has the rated shares of the levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> None:
        k, ok = len(LEVELS), ~np.isnan(x).any(axis=1) if len(x) else np.zeros(0, bool)
        self.shares = np.log((np.bincount(y, minlength=k) + 1.0) / (len(y) + k))
        x, y = x[ok], y[ok]
        width = len(QUANTILES) + 1
        self.mean, self.sd = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(width), np.ones(width))
        z = self._spread(x)
        self.w = np.zeros((z.shape[1], k))
        if not len(x):
            self.w[-1] = self.shares
            return
        aim = np.eye(k)[y]
        # Accelerated gradient steps, no longer than the curvature allows.
        step = 1 / (0.5 * np.linalg.norm(z, 2) ** 2 / len(z) + ridge)
        seen, t = self.w, 1.0
        for _ in range(rounds):
            p = _softmax(z @ seen)
            new = seen - step * (z.T @ (p - aim) / len(z) + ridge * seen)
            t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            seen, self.w = new + (before - 1) / t * (new - self.w), new

    def _spread(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.sd
        return np.concatenate([z, z * z - 1, np.ones((len(z), 1))], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.shares, (len(x), 1))
        ok = ~np.isnan(x).any(axis=1)
        if ok.any():
            out[ok] = np.log(_softmax(self._spread(x[ok]) @ self.w) + 1e-12)
        return out


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), len(QUANTILES) + 1)


def fit(profiled: DataFrame, rated: DataFrame, most: int = MAX_FIT) -> Calibration:
    """Fitted on at most ``most`` rated documents."""
    sample = profiled.join(rated, "doc_id").select("q", "level").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow().combine_chunks()
    if not len(sample):
        return Calibration(np.empty((0, len(QUANTILES) + 1)), np.empty(0, np.int64))
    return Calibration(_matrix(sample.column("q").combine_chunks()), sample.column("level").to_numpy().astype(np.int64) - 1)


def rater_right(rated: DataFrame) -> float:
    """Chance that a rating is the true level, from how often two ratings of one document agree.

    Two raters agree if both are right, or (about half of the time) if both are wrong, as a wrong rating is a neighbouring level:
    a = r**2 + (1 - r)**2 / 2. Without repeated ratings the pairs of ``PAIRS`` speak alone.
    """
    v = F.col("votes")
    total = F.aggregate(v, F.lit(0), lambda s, x: s + x)
    row = rated.select((total * (total - 1) / 2).alias("pairs"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x * (x - 1) / 2).alias("agree")).agg(F.sum("pairs"), F.sum("agree")).first()
    a = ((row[1] or 0) + PAIRS[0]) / ((row[0] or 0) + PAIRS[1])
    return min(max((1 + max(1 - 6 * (0.5 - a), 0.0) ** 0.5) / 3, 0.5), 0.999)


def _rating_model(right: float) -> np.ndarray:
    """log P(rating | level), rows by level."""
    p = np.full((len(LEVELS), len(LEVELS)), 1e-4)
    for k in range(len(LEVELS)):
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(LEVELS)]
        p[k, k] = right
        p[k, near] = (1 - right) / len(near)
    return np.log(p)


def predict(profiled: DataFrame, rated: DataFrame, model: Calibration, use_ratings: bool = True) -> DataFrame:
    """(doc_id, reading_level): the level most likely by the document's words and, where there are any, its ratings."""
    rating = _rating_model(rater_right(rated))
    joined = profiled.join(rated.select("doc_id", "votes"), "doc_id", "left") if use_ratings else profiled.withColumn("votes", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            odds = model.log_odds(_matrix(batch.column("q")))
            votes = np.array([v or [0] * len(LEVELS) for v in batch.column("votes").to_pylist()], float)
            level = (odds + votes @ rating.T).argmax(axis=1) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(level, pa.int32())], ["doc_id", "reading_level"])

    return joined.select("doc_id", "q", "votes").mapInArrow(run, "doc_id long, reading_level int")


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level) of each document (doc_id, text) with ``MIN_PIECES`` or more pieces between white space.

    Null, empty and short texts give no row. A text without any known word has the most frequent level. Without ratings all
    levels are equally likely and the lowest is given. Other columns are not read.
    """
    rated = ratings(labels)
    blocks = blocks_of(documents)
    profiled = profiles(blocks, word_grades(blocks, rated))
    return predict(profiled, rated, fit(profiled, rated))
