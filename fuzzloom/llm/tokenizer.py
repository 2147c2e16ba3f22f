"""Encoding of a whole corpus with a public byte-level BPE, each distinct word once."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.llm.blocks import cut, reassemble, words_of
from fuzzloom.scratch import join_small, materialize

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: How text is split before the merges, as the vocabulary's publisher states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _splitter() -> Callable[[str], list[str]]:
    import regex

    return regex.compile(PATTERN).findall


def _encoder(path: str) -> Callable[[str], list[int]]:
    import tiktoken

    # The pattern takes a word whole, whatever it holds; it has been split already.
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(block, no, ids) for (block, no, word): each distinct word of the corpus is encoded once and joined back.

    The distinct words are found with partial sets before the shuffle, so a word of every block is one row of each task. Coming
    back, they are broadcast if they are few and salted if not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(list(map(encode, batch.column("word").to_pylist())), pa.list_(pa.int32()))], ["word", "ids"])

    encoded = materialize(words.select("word").distinct().mapInArrow(run, "word string, ids array<int>"), "encoded")
    return join_small(words, encoded, ["word"]).select("block", "no", "ids")


def _join_ids(documents: pa.Table, words: pa.Table) -> pa.Table:
    """Documents of one block with the ids of their words in place."""
    docs, found = documents.combine_chunks(), words.combine_chunks()
    seq = docs.column("seq").combine_chunks()
    flat, ends = seq.flatten().to_numpy(), np.concatenate([[0], np.cumsum(seq.value_lengths().to_numpy())])
    size = len(found)
    lens, starts = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    pool = np.empty(0, np.int32)
    if size:
        ids = found.column("ids").combine_chunks()
        no, n = found.column("no").to_numpy(), ids.value_lengths().to_numpy()
        lens[no], starts[no] = n, np.cumsum(n) - n
        pool = ids.flatten().to_numpy()
    n = lens[flat]
    after = np.cumsum(n)
    total = int(after[-1]) if len(after) else 0
    at = np.arange(total) + np.repeat(starts[flat] - (after - n), n)
    offsets = np.concatenate([[0], after])[ends]
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pool[at], pa.int32()))})


def encode(documents: DataFrame, folder: str = FOLDER, name: str = RANKS) -> DataFrame:
    """(doc_id, ids) of each row of ``documents`` (doc_id, text), without special tokens.

    Null and empty text have an empty list. Strings that look like special tokens are ordinary text. Rows with a null or repeated
    doc_id are encoded like others. Other columns are not read. Texts are split whole, however long.

    One row for each distinct word of a block of documents is joined with the words' ids and shuffled by block; texts themselves
    never move.
    """
    path = f"{folder}/{name}"
    blocks = cut(documents, _splitter, "tokens")
    return reassemble(blocks, encode_words(words_of(blocks), path), _join_ids, "doc_id long, ids array<int>")


def token_table(path: str) -> Column:
    """The bytes of each token by id, as characters up to 255; a constant of the plan."""
    ranks = load_ranks(path)
    tokens = [""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token.decode("latin-1")
    return F.split(F.lit("\u0100".join(tokens)), "\u0100")


def decode(encoded: DataFrame, folder: str = FOLDER, name: str = RANKS) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the bytes of each token joined in order. A null list gives a null text, an id outside the
    vocabulary and bytes that are no UTF-8 give U+FFFD.

    The token-byte table has a fixed size and is joined by position within each row: taking documents apart into tokens for a join
    of tables would shuffle every token to put them together again.
    """
    tokens = token_table(f"{folder}/{name}")
    joined = F.array_join(F.transform("ids", lambda i: F.coalesce(F.get(tokens, i), F.lit("\xff"))), "")
    return encoded.select("doc_id", F.make_valid_utf8(F.encode(joined, "ISO-8859-1").cast("string")).alias("text"))
