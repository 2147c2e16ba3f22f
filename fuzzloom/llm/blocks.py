"""A corpus as blocks of documents with each block's distinct words, so that words can be looked up corpus-wide.

Exploding a corpus to one row for each word would shuffle every occurrence twice. Here a block of documents is exploded inside
its task: documents become sequences of numbers, and each distinct word of the block one row. Only those rows move: by word, so
that each is looked up once, and back by block, where the sequences take their words' results by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.scratch import materialize, spread

#: A block ends with the document that brings it to so many characters.
BLOCK_CHARS = 8_000_000

BLOCK_SCHEMA = "block long, word string, doc_id long, no int, pieces int, seq array<int>"
_ARROW = pa.schema([("block", pa.int64()), ("word", pa.string()), ("doc_id", pa.int64()), ("no", pa.int32()), ("pieces", pa.int32()), ("seq", pa.list_(pa.int32()))])


class Numbers(dict):
    """Word -> its number in the block, given when it is first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _block(number: int, ids: list, rows: list, words: Numbers, pieces: list) -> pa.RecordBatch:
    names = list(words)
    d, w = len(ids), len(names)
    ends = np.zeros(d + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.fromiter((n for r in rows for n in r), np.int32, int(ends[-1]))
    offsets = pa.array(np.concatenate([ends, np.full(w, ends[-1], np.int32)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(d + w, number, np.int64)), pa.array([None] * d + names, pa.string()), pa.array([*ids, *[None] * w], pa.int64()),
            pa.array([None] * d + list(range(w)), pa.int32()), pa.array([*pieces, *[None] * w], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat)),
        ],
        schema=_ARROW,
    )


def cut(documents: DataFrame, splitter: Callable[[], Callable[[str], list[str]]], label: str) -> DataFrame:
    """Written blocks of ``documents`` (doc_id, text): a row for each document and for each distinct word of a block.

    Document rows have doc_id, ``pieces`` (its pieces between white space) and ``seq`` (the numbers of its words in order); word
    rows have ``word`` and its number ``no``. splitter makes, once a task, the function from text to words. A null text has no
    words. Every input row gives one document row, whatever its doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, rows, pieces, words, chars = [], [], [], Numbers(), 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                ids.append(doc)
                pieces.append(len(text.split()))
                rows.append(list(map(words.__getitem__, split(text))))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield _block(number, ids, rows, words, pieces)
                    number += 1
                    ids, rows, pieces, words, chars = [], [], [], Numbers(), 0
            if ids:
                yield _block(number, ids, rows, words, pieces)
                number += 1

    return materialize(spread(documents.select("doc_id", "text")).mapInArrow(run, BLOCK_SCHEMA), label)


def documents_of(blocks: DataFrame) -> DataFrame:
    return blocks.filter("word IS NULL").select("block", "doc_id", "pieces", "seq")


def words_of(blocks: DataFrame) -> DataFrame:
    # A name of its own for the block, so that both sides can meet again.
    return blocks.filter("word IS NOT NULL").select(F.col("block").alias("block"), "no", "word")


def reassemble(blocks: DataFrame, results: DataFrame, build: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each block's documents with the results of its words: build(documents, results) -> rows of ``schema``.

    results: block, no and further columns, at most one row for each word. A block's two sides meet in one task; both are bounded
    by the block.
    """
    return documents_of(blocks).groupBy("block").cogroup(results.groupBy("block")).applyInArrow(build, schema)
