"""Passages of held-out test items inside a corpus.

Winnowing: of every ``WINDOW`` neighbouring k-grams of words the one with the least hash is kept, on both sides. Two texts that
share ``K + WINDOW - 1`` words in a row thus share a kept k-gram. Fingerprints of the corpus and of the test items meet in a join;
pairs with enough of them near one diagonal are extended over their words and decided exactly.

The corpus is read once and its texts are never shuffled. A bitmap of fixed size tells which fingerprints can't be any test
item's, so that most never leave the task that made them; where it is full it lets all pass, and nothing is lost.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.scratch import join_small, materialize, spread

#: Words in a k-gram and k-grams in a window: any four shared words in a row are seen.
K, WINDOW = 3, 2
#: Shared words in a row; words of a stretch with changes; words for each change in it.
EXACT, STRETCH, PER_CHANGE = 12, 20, 6
#: A stretch of twice ``STRETCH`` words or more can be cut into pieces of ``STRETCH`` to so many, one of which has no more changes for
#: its words than the whole. So nothing longer need be followed, and no more changes than these.
LONGEST = 2 * STRETCH - 1
MOST = LONGEST // PER_CHANGE
#: Items are taken in parts of 2 * BLOCK words that begin every BLOCK words, so any piece lies in one part.
BLOCK = LONGEST + 1
#: Kept k-grams that a piece shares at least on at most so many further diagonals: one of L words with e <= L / 6 changes has
#: (L - 4e - 3) / 2 of them or more on e further diagonals, for 0 to 6 changes 5, 7, 5, 3, 3, 4 and 5.
NEAR = ((3, 4), (4, 5), (5, 6))
SHARED = 3
#: Of all k-grams such a piece shares L - 2 - 3e or more, the least for 3 changes in 20 words.
SHARED_ALL = 9
#: Bits of the bitmap of fingerprints of test items.
BITS = 1 << 23
#: Words of documents that are looked up together, cells of the alignments made together, and words that a task remembers.
BATCH_WORDS, BATCH_CELLS, REMEMBERED = 2_000_000, 4_000_000, 1_000_000
#: Diagonals of an alignment's start.
SPAN = 16

_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]+")
_BREAKS = re.compile(r"\r\n?|[\x0b\x0c\x85  ]")
_TAG = re.compile(r"<\|[^<>|]*\|>|</?[a-zA-Z][^<>]*>|<!--.*?-->", re.DOTALL)
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|th|tr|table|h[1-6])\b[^<>]*>", re.IGNORECASE)
_LINK = re.compile(r"\]\([^()\s]*\)")
_LINE_MARK = re.compile(r"(?m)^[ \t]*(?:(?:[>|*•·+#-]+|\d{1,2}[.)])[ \t]+)+")
_HYPHEN = re.compile(r"[-‐‑][ \t]*\n[ \t]*")
_JOINED = re.compile(r"['’ʼ‘`´]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text without what makes no difference: letter case, accents, punctuation, white space, marks before lines,
    hyphens at their ends, invisible characters, character references and markup. Apostrophes join, other signs part words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text).replace("|><|", "|> <|"))
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = _BREAKS.sub("\n", _CONTROL.sub("", text))
    if "](" in text:
        text = _LINK.sub(" ", text)
    text = _HYPHEN.sub("", _LINE_MARK.sub("", text))
    return _WORD.findall(_JOINED.sub("", text).casefold())


class _Hashes(dict):
    """Word -> its 64-bit hash, never 0."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return h


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-gram at each place but the last K - 1, and whether it is one: 0 stands between texts."""
    n = max(len(words) - K + 1, 0)
    key, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(K):
            part = words[k : k + n]
            key = key * np.uint64(0x9E3779B97F4A7C15) + part
            ok &= part > 0
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32)), ok


def _winnow(key: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Places of the kept k-grams: in each window the rightmost with the least hash."""
    h = np.where(ok, key, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(h) < WINDOW:
        return np.flatnonzero(ok)
    views = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    at = np.arange(len(views)) + (WINDOW - 1 - views[:, ::-1].argmin(axis=1))
    kept = np.zeros(len(h), bool)
    kept[at] = True
    return np.flatnonzero(kept & ok)


_PRINTS = "row long, id long, words array<long>, at array<int>, key array<long>"


def fingerprints(texts: DataFrame, id_column: str, text: str, least_words: int, least_prints: int, bitmap=None) -> DataFrame:
    """(row, id, words, at, key) of each text with ``least_words`` or more and, of the kept k-grams that pass the bitmap,
    ``least_prints`` or more: hashes of its words, places and hashes of those k-grams. Rows are numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        number = TaskContext.get().partitionId() << 40
        bits = bitmap.value if bitmap is not None else None

        def emit(ids: pa.Array, rows: list[list[int]]) -> pa.RecordBatch:
            nonlocal number
            size = np.array([len(r) for r in rows], np.int64)
            # Zeros after each text, so that no k-gram spans two.
            begin = np.cumsum(size + K) - (size + K)
            flat = np.zeros(int((size + K).sum()), np.uint64)
            flat[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)] = np.fromiter((x for r in rows for x in r), np.uint64, int(size.sum()))
            key, ok = _grams(flat)
            place = _winnow(key, ok)
            if bits is not None:
                at = key[place] & np.uint64(8 * len(bits) - 1)
                place = place[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            text_of = np.searchsorted(begin, place, "right") - 1
            count = np.bincount(text_of, minlength=len(rows))
            good = np.flatnonzero((size >= least_words) & (count >= least_prints))
            mine = np.isin(text_of, good)
            place, text_of = place[mine], text_of[mine]
            first = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            wanted = np.repeat(begin[good] - (np.cumsum(size[good]) - size[good]), size[good]) + np.arange(int(size[good].sum()))
            numbers = pa.array(number + np.arange(len(good)), pa.int64())
            number += len(good)
            return pa.RecordBatch.from_arrays(
                [
                    numbers, ids.take(pa.array(good)).cast(pa.int64()), pa.ListArray.from_arrays(first(size[good]), pa.array(flat[wanted].view(np.int64))),
                    pa.ListArray.from_arrays(first(count[good]), pa.array((place - begin[text_of]).astype(np.int32))), pa.ListArray.from_arrays(first(count[good]), pa.array(key[place].view(np.int64))),
                ],
                ["row", "id", "words", "at", "key"],
            )

        for batch in batches:
            if len(hashes) > REMEMBERED:
                hashes.clear()
            rows, begun, total = [], 0, 0
            for i, value in enumerate(batch.column(1).to_pylist()):
                rows.append(list(map(hashes.__getitem__, words(value))))
                total += len(rows[-1])
                if total >= BATCH_WORDS or i == len(batch) - 1:
                    yield emit(batch.column(0).slice(begun, len(rows)), rows)
                    rows, begun, total = [], i + 1, 0

    return spread(texts.select(id_column, text)).mapInArrow(run, _PRINTS)


def candidates(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """(row, item_row, part, span): documents (written, of ``fingerprints``) and parts of items that share ``SHARED`` kept k-grams on near
    diagonals, and where their alignment begins.

    The join is by fingerprint, with the items' side broadcast if it is small and salted if it isn't.
    """
    mine = documents.select("row", F.inline(F.arrays_zip("at", "key")))
    hits = join_small(mine, prints, ["key"]).select("row", "item_row", "part", (F.col("at") - F.col("pos")).alias("diagonal"), "changes")
    near = Window.partitionBy("row", "item_row", "part").orderBy("diagonal")
    within = [F.lead("diagonal", n - 1).over(near) - F.col("diagonal") <= F.least("changes", F.lit(e)) for n, e in NEAR]
    dense = hits.withColumn("_dense", reduce(or_, [F.coalesce(c, F.lit(False)) for c in within])).filter("_dense")
    return dense.select("row", "item_row", "part", F.floor(F.col("diagonal") / SPAN).cast("int").alias("span")).distinct()


class _Lanes:
    """Texts and items word by word along the diagonals from ``lane`` on, for many tasks together."""

    def __init__(self, text: pa.ListArray, item: pa.ListArray, lane: np.ndarray) -> None:
        self.size, self.n = (a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for a in (text, item))
        self.flat, self.items = (a.flatten().to_numpy(zero_copy_only=False) for a in (text, item))
        self.begin, self.start = np.cumsum(self.size) - self.size, np.cumsum(self.n) - self.n
        self.lane = lane[:, None] + np.arange(SPAN + 2 * MOST)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each word of the items: which have one, which places are inside the text, and where the words are the same."""
        for i in range(int(self.n.max())):
            at, live = self.lane + i, (i < self.n)[:, None]
            inside = (at >= 0) & (at < self.size[:, None]) & live
            here = self.items[np.minimum(self.start + i, len(self.items) - 1)]
            yield live, inside, inside & (self.flat[np.clip(self.begin[:, None] + at, 0, len(self.flat) - 1)] == here[:, None])


def _share(lanes: _Lanes) -> np.ndarray:
    """How many k-grams of its item each text has near the diagonals."""
    count = np.zeros(len(lanes.n), np.int64)
    run = np.zeros(lanes.lane.shape, np.int8)
    for _, _, same in lanes:
        run = np.where(same, np.minimum(run + 1, K), 0)
        count += (run == K).sum(axis=1)
    return count


def _align(lanes: _Lanes) -> np.ndarray:
    """Whether each text holds a passage of its item near the diagonals.

    best[e] is, for each diagonal, the most words of the item in a stretch that ends here with at most e words changed, dropped
    or added; a stretch may begin anywhere. One step takes all one word of their items on.
    """
    most = min(int(lanes.n.max()) // PER_CHANGE, MOST)
    best = np.zeros((most + 1, *lanes.lane.shape), np.int16)
    good = np.zeros(len(lanes.n), bool)
    least = np.array([EXACT, *(max(STRETCH, PER_CHANGE * e) for e in range(1, most + 1))])[:, None, None]
    for live, inside, same in lanes:
        now = np.empty_like(best)
        now[0] = np.where(same, best[0] + 1, 0)
        for e in range(1, most + 1):
            step = np.where(same, best[e] + 1, np.where(inside, best[e - 1] + 1, 0))
            step[:, :-1] = np.maximum(step[:, :-1], best[e - 1][:, 1:] + 1)  # a word of the item is dropped
            step[:, 1:] = np.maximum(step[:, 1:], now[e - 1][:, :-1])  # a word is added
            now[e] = np.maximum(step, now[e - 1])
        good |= ((now >= least) & live).any(axis=(0, 2))
        best = now
    return good


def aligned(tasks: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id) of tasks (doc_id, item_id, lane, text, item) whose text holds a passage of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pick(batch: pa.RecordBatch, test, cells: int) -> pa.RecordBatch:
            step, good = BATCH_CELLS // (cells * (SPAN + 2 * MOST)), [np.empty(0, bool)]
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                good.append(test(_Lanes(part.column("text"), part.column("item"), part.column("lane").to_numpy())))
            return batch.filter(pa.array(np.concatenate(good)))

        for batch in batches:
            near = pick(batch, lambda lanes: _share(lanes) >= SHARED_ALL, 1)
            # Items of like length are aligned together.
            near = near.take(pc.sort_indices(pc.list_value_length(near.column("item"))))
            yield pick(near, _align, MOST + 1).select(["doc_id", "item_id"])

    return tasks.mapInArrow(run, "doc_id long, item_id int")


def leaks(documents: DataFrame, test_items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document's text holds ``EXACT`` words of the item in a row, or a stretch of at least
    ``STRETCH`` of its words with at most one in ``PER_CHANGE`` changed, dropped or added; words as ``words`` gives them.

    documents: doc_id, text; test_items: item_id, item_text. Null and empty texts hold nothing and items of under ``EXACT`` words
    can't be found. Rows with the same item_id are one item with several texts. A pair is given once. Texts are searched whole,
    and items of any length; the cost of an item grows with its length alone. Other columns are not read.
    """
    items = materialize(fingerprints(test_items.filter("item_id IS NOT NULL"), "item_id", "item_text", EXACT, 0), "items")
    last = F.greatest(F.ceil(F.size("words") / BLOCK).cast("int") - 2, F.lit(0))
    parts = materialize(items.select(F.col("row").alias("item_row"), "id", "words", F.explode(F.sequence(F.lit(0), last)).alias("part")).select("item_row", "part", F.col("id").cast("int").alias("item_id"), F.slice("words", F.col("part") * BLOCK + 1, 2 * BLOCK).alias("item")), "parts")
    each = items.select("row", last.alias("last"), F.size("words").alias("n"), F.inline(F.arrays_zip("at", "key")))
    own = F.floor(F.col("at") / BLOCK).cast("int")
    placed = each.select("*", F.explode(F.array_distinct(F.array(F.greatest(own - 1, F.lit(0)), F.least(own, F.col("last"))))).alias("part"))
    changes = F.least(F.least(F.col("n") - F.col("part") * BLOCK, F.lit(2 * BLOCK)) / PER_CHANGE, F.lit(MOST)).cast("int")
    prints = materialize(placed.select("key", F.col("row").alias("item_row"), "part", (F.col("at") - F.col("part") * BLOCK).alias("pos"), changes.alias("changes")), "prints")

    set_bits = prints.select(F.col("key").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()
    bitmap = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(bitmap, set_bits >> 3, (1 << (set_bits & 7)).astype(np.uint8))
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    seen = materialize(fingerprints(documents, "doc_id", "text", EXACT, SHARED, sent), "seen")
    spans = materialize(candidates(seen, prints), "spans")
    tasks = join_small(join_small(seen.select("row", "id", "words"), spans, ["row"]), parts, ["item_row", "part"])
    lane = F.col("span") * SPAN - MOST
    text = F.slice("words", F.greatest(lane, F.lit(0)) + 1, F.size("item") + SPAN + 2 * MOST)
    return aligned(tasks.select(F.col("id").alias("doc_id"), "item_id", F.least(lane, F.lit(0)).alias("lane"), text.alias("text"), "item")).distinct()
