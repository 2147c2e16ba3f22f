"""Delimited text, with the rows that fail to parse kept apart and their reason."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.operators.prefix import running

BROKEN, COUNT, INVALID = "broken_quoting", "column_count", "invalid_value"

#: Most file layouts that travel with the tasks; with more, each line brings its own from a join.
MOST_FILES = 10_000

csv.field_size_limit(sys.maxsize)


class Broken(ValueError):
    """The quoting of a record is broken."""


def split_record(raw: str, sep: str) -> list[str]:
    """Fields of one record by the strict reader; ``Broken`` if its quoting is.

    Line breaks are hidden from the reader, which has rules of its own for them. It takes quotes inside bare fields as text, so
    the fields are then laid over the record again: one that doesn't begin with a quote there may hold none.
    """
    hidden = raw
    swaps = []
    if "\n" in raw or "\r" in raw:
        free = (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in raw and c != sep)
        swaps = [(c, next(free)) for c in "\r\n"]
        for c, put in swaps:
            hidden = hidden.replace(c, put)
    try:
        rows = list(csv.reader([hidden], delimiter=sep, strict=True))
    except csv.Error as e:
        raise Broken(str(e)) from e
    fields = rows[0] if rows and rows[0] else [""]
    if '"' in hidden:
        at = 0
        for field in fields:
            quoted = hidden.startswith('"', at)
            if not quoted and '"' in field:
                raise Broken("quote in a bare field")
            at += len(field) + (field.count('"') + 2 if quoted else 0) + 1
    for c, put in swaps:
        fields = [f.replace(put, c) for f in fields]
    return fields


def judge(raw: str | None, columns: list[str] | None, sep: str | None, classes: frozenset | set | None) -> tuple[str | None, list[str] | None]:
    """The reason for which a record can't be loaded, or None and its fields.

    Carriage returns at the end are dropped. A null record has no fields, one of an unknown file no columns: both
    ``column_count``; so is any record of a file whose separator isn't one character. With no column ``class`` no value is
    invalid.
    """
    if raw is None:
        return COUNT, None
    if sep is None or len(sep) != 1 or sep in '"\r\n':
        return COUNT, None
    try:
        fields = split_record(raw.rstrip("\r"), sep)
    except Broken:
        return BROKEN, None
    if columns is None or len(fields) != len(columns):
        return COUNT, None
    if "class" in columns:
        value = fields[columns.index("class")].strip()
        if not value or value not in (classes or ()):
            return INVALID, None
    return None, fields


def load_lines(lines: DataFrame, files: DataFrame, classes: DataFrame) -> DataFrame:
    """Each line once: line_id, file_id, reason (null if it loads), values (column name -> text, null unless it loads).

    lines: line_id, file_id, raw_line, one record each. files: file_id, column_list, sep_char, class_set. classes: class_set,
    class. Lines with the same ``line_id`` are copies and count once. Further columns of the tables are not read. A file named
    twice takes one of its layouts (the least by columns).
    """
    once = lines.select("line_id", "file_id", "raw_line").dropDuplicates(["line_id"])
    sets = classes.groupBy("class_set").agg(F.collect_set("class").alias("classes"))
    layouts = (
        files.filter("file_id IS NOT NULL").groupBy("file_id").agg(F.min(F.struct("column_list", "sep_char", "class_set")).alias("s"))
        .select("file_id", "s.*").join(sets, "class_set", "left").select("file_id", "column_list", "sep_char", "classes")
    )
    schema = "line_id long, file_id int, reason string, values map<string,string>"
    out = pa.schema([("line_id", pa.int64()), ("file_id", pa.int32()), ("reason", pa.string()), ("values", pa.map_(pa.string(), pa.string()))])
    few = layouts.limit(MOST_FILES + 1).collect()
    carried = {r.file_id: (r.column_list, r.sep_char, frozenset(r.classes or ())) for r in few} if len(few) <= MOST_FILES else None
    if carried is None:
        once = once.join(layouts.withColumn("known", F.lit(True)), "file_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids = batch.column("raw_line").to_pylist(), batch.column("file_id").to_pylist()
            if carried is not None:
                specs = [carried.get(i, (None, ",", None)) for i in ids]
            else:
                specs = [(c, s if known else ",", set(k or ())) for c, s, k, known in zip(*(batch.column(n).to_pylist() for n in ("column_list", "sep_char", "classes", "known")), strict=True)]
            got = [judge(r, *spec) for r, spec in zip(raw, specs, strict=True)]
            values = [list(dict(zip(spec[0], fields, strict=True)).items()) if fields is not None else None for (_, fields), spec in zip(got, specs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("line_id").cast(pa.int64()), batch.column("file_id").cast(pa.int32()), pa.array([r for r, _ in got], pa.string()), pa.array(values, out.field("values").type)], schema=out)

    return once.mapInArrow(run, schema)


def assemble(lines: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """Physical lines joined to records: file, first ``order`` of the record, ``text`` with line breaks inside quotes.

    A record ends where the quotes of the file so far are even in number. That number is a running sum over the lines, taken in
    ranges (``running``), so one long file isn't one task. A null line counts as empty. After a quote that never closes the
    following lines belong to its record, up to the next odd line.
    """
    base = lines.select(F.col(file).alias("_f"), F.col(order).alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("_x"))
    base = base.withColumn("_q", (F.length("_x") - F.length(F.replace("_x", F.lit('"'), F.lit("")))).cast("long"))
    base = running(base, ["_f"], ["_o"], {"_s": ("sum", "_q")})
    # A line starts a record if the quotes before it are even.
    base = base.withColumn("_start", ((F.col("_s") - F.col("_q")) % 2 == 0).cast("long"))
    base = running(base, ["_f"], ["_o"], {"_rec": ("sum", "_start")})
    parts = F.array_sort(F.collect_list(F.struct("_o", "_x")))
    return base.groupBy("_f", "_rec").agg(parts.alias("_p")).select(F.col("_f").alias(file), F.col("_p")[0]["_o"].alias(order), F.concat_ws("\n", F.col("_p._x")).alias(text))


