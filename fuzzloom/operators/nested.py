"""Nested JSON records as flat tables that keep their parent-child links.

Every node of a record gets an interval from one depth-first walk: ``pre`` when the walk enters it and ``post`` when it leaves,
both from one counter. A node lies inside another exactly if its interval does, so any ancestor is found by containment, without
a path of foreign keys. ``shred`` does the walk and gives the rows of all wanted tables at once: members of a node and what its row
takes over from ancestors are found by searching intervals, for a whole batch of records together. Records are never split, so
no node has to move to meet its parent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Number(str):
    """A JSON number as it is written."""


_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_BLANKS = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _reject(name: str):
    raise ValueError(name)


def _parse_deep(text: str):
    """``json.loads`` without recursion, for texts nested deeper than it allows."""
    root: list = []
    # Open containers with the key under which their next value goes; a list takes it at its end.
    open_: list[list] = [[root, None]]
    at, wants = _BLANKS.match(text, 0).end(), "value"

    def key(at: int) -> int:
        if text[at : at + 1] != '"':
            raise ValueError("key")
        open_[-1][1], at = scanstring(text, at + 1, True)
        at = _BLANKS.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("colon")
        return _BLANKS.match(text, at + 1).end()

    while True:
        if wants == "value":
            c = text[at : at + 1]
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif c and c in "{[":
                value, at = ({} if c == "{" else []), at + 1
            elif m := _NUMBER.match(text, at):
                value, at = _Number(m[0]), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError("value")
                value, at = _WORDS[word], at + len(word)
            into, name = open_[-1]
            if isinstance(into, dict):
                into[name] = value
            else:
                into.append(value)
            at = _BLANKS.match(text, at).end()
            wants = "more"
            if isinstance(value, (dict, list)) and c in ("{", "["):
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    at = _BLANKS.match(text, at + 1).end()
                else:
                    open_.append([value, None])
                    at = key(at) if c == "{" else at
                    wants = "value"
        elif len(open_) == 1:
            if at != len(text):
                raise ValueError("extra data")
            return root[0]
        else:
            c, into = text[at : at + 1], open_[-1][0]
            if c == ",":
                at = _BLANKS.match(text, at + 1).end()
                at = key(at) if isinstance(into, dict) else at
                wants = "value"
            elif c == ("}" if isinstance(into, dict) else "]"):
                open_.pop()
                at = _BLANKS.match(text, at + 1).end()
            else:
                raise ValueError("delimiter")


def parse(text: str | None):
    """The value of a JSON text of any depth; ``ValueError`` for null, empty and broken text and for NaN or Infinity."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_reject)
    except RecursionError:
        return _parse_deep(text)


def dump(value) -> str:
    """A parsed value as JSON text again, numbers as they were written."""
    out: list[str] = []
    stack: list = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, _Number):
            out.append(x)
        elif isinstance(x, dict):
            parts: list = [("{",)]
            for i, (k, v) in enumerate(x.items()):
                parts += [((", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ",), v]
            stack.extend(reversed([*parts, ("}",)]))
        elif isinstance(x, list):
            parts = [("[",)]
            for i, v in enumerate(x):
                parts += [(", ",), v] if i else [v]
            stack.extend(reversed([*parts, ("]",)]))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def as_text(value) -> str | None:
    """A scalar as text without outer blanks, null as null, a container as JSON."""
    if value is None:
        return None
    if isinstance(value, str):
        return value.strip()
    return dump(value)


@dataclass(frozen=True)
class Table:
    """Nodes of one type as rows.

    path: members from the root, ``[]`` standing for the elements of an array. fields: members of the node that its row has as
    text. up: columns of the row that come from nodes it lies in, as (column, table, field), the field ``pos`` being a position.
    objects: whether only objects count; other nodes at the path keep their position and give no row.
    once: columns of which equal rows of a record are told by ``again``. known: (column, field, table, field): whether the row's
    field is a field of any of the table's nodes in the same record.
    """

    path: str
    fields: tuple[str, ...] = ()
    up: tuple[tuple[str, str, str], ...] = ()
    objects: bool = True
    once: tuple[str, ...] = ()
    known: tuple[tuple[str, str, str, str], ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.fields, *(c for c, _, _ in self.up), *(c for c, *_ in self.known))


@dataclass(frozen=True)
class Shape:
    """Tables of a record and what is made regular before the walk.

    single: paths whose value stands for the array that holds it alone. named: paths of named values, which may be an object, a
    list of objects with ``name`` and ``value``, or a text with either; they become a list of objects with name, ``array`` (whether
    the value was one) and ``values``, a list in any case.
    """

    tables: dict[str, Table]
    single: frozenset[str] = frozenset()
    named: frozenset[str] = frozenset()


@dataclass
class _Place:
    """A wanted path: what is below it, and the nodes found there."""

    members: dict[str, _Place] = field(default_factory=dict)
    single: bool = False
    named: bool = False
    table: str | None = None
    text: bool = False
    objects: bool = False
    pre: list[int] = field(default_factory=list)
    post: list[int] = field(default_factory=list)
    pos: list[int] = field(default_factory=list)
    value: list[str | None] = field(default_factory=list)

    @property
    def kept(self) -> bool:
        return self.table is not None or self.text

    def at(self, path: str) -> _Place:
        here = self
        for step in path.replace("[]", ".[]").split("."):
            here = here.members.setdefault(step, _Place()) if step else here
        return here

    def clear(self) -> None:
        self.pre, self.post, self.pos, self.value = [], [], [], []
        for x in self.members.values():
            x.clear()


def _places(shape: Shape) -> _Place:
    root = _Place()
    for name, t in shape.tables.items():
        place = root.at(t.path)
        place.table, place.objects = name, t.objects
        for f in t.fields:
            if f == "value":
                place.text = True
            else:
                place.at(f).text = True
    for path in shape.single:
        root.at(path).single = True
    for path in shape.named:
        root.at(path).named = True
    return root


def _pairs(value) -> list[dict]:
    if isinstance(value, str) and not isinstance(value, _Number):
        try:
            value = parse(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        found = value.items()
    else:
        found = [(as_text(x.get("name")), x.get("value")) for x in value if isinstance(x, dict)] if isinstance(value, list) else []
    return [{"name": k, "array": isinstance(v, list), "values": v if isinstance(v, list) else [v]} for k, v in found]


def walk(root, places: _Place, clock: int = 0) -> int:
    """Label every node of one parsed record, from ``clock`` on, and keep those at wanted places. Gives the clock after it."""
    nowhere = _Place()
    stack: list = [(root, places, 0)]
    while stack:
        top = stack.pop()
        clock += 1
        if len(top) == 2:
            post, at = top
            if post is not None:
                post[at] = clock
            continue
        value, place, pos = top
        if place.named:
            value = _pairs(value)
        elif place.single and not isinstance(value, list):
            value = [value]
        kept = place.kept and (not place.objects or isinstance(value, dict))
        inner = isinstance(value, (dict, list))
        if kept:
            place.pre.append(clock)
            place.pos.append(pos)
            place.value.append(as_text(value) if place.text else None)
            place.post.append(clock + 1)
        if not inner:
            clock += 1
            continue
        stack.append((place.post, len(place.post) - 1) if kept else (None, 0))
        below = place.members
        if isinstance(value, dict):
            stack.extend([(v, below.get(k, nowhere), i) for i, (k, v) in enumerate(value.items())][::-1])
        elif value:
            element = below.get("[]", nowhere)
            stack.extend([(v, element, i) for i, v in enumerate(value)][::-1])
    return clock


def _owner(place: _Place, pre: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Number of the node at ``place`` whose interval holds each given one, or -1. Nodes of one path never hold each other, so it
    can only be the last one entered before."""
    outer_pre, outer_post = np.array(place.pre, np.int64), np.array(place.post, np.int64)
    at = np.searchsorted(outer_pre, pre, "right") - 1
    inside = at >= 0
    inside[inside] = outer_post[at[inside]] >= post[inside]
    return np.where(inside, at, -1)


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # halves of surrogate pairs
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


#: Nodes after which a task hands on what it has.
EMITTED = 100_000

ROW = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("pre", T.IntegerType()), T.StructField("post", T.IntegerType()),
    T.StructField("pos", T.IntegerType()), T.StructField("again", T.BooleanType()), T.StructField("texts", T.ArrayType(T.StringType())),
])


def _rows(shape: Shape, places: _Place, begins: list[int]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, list, list, pa.Array]]:
    """For each table: its name, record, pre, post, pos, again and texts of its rows, from the nodes of several records."""
    starts = np.array(begins, np.int64)
    made: dict[str, dict[str, list]] = {}
    for name, t in shape.tables.items():
        place = places.at(t.path)
        pre, post = np.array(place.pre, np.int64), np.array(place.post, np.int64)
        record = np.searchsorted(starts, pre, "right") - 1
        columns: dict[str, list] = {"pos": place.pos}
        for f in t.fields:
            if f == "value":
                columns[f] = place.value
                continue
            child = place.at(f)
            owner = _owner(place, np.array(child.pre, np.int64), np.array(child.post, np.int64))
            got: list = [None] * len(pre)
            for o, v in zip(owner.tolist(), child.value, strict=True):
                if o >= 0:
                    got[o] = v
            columns[f] = got
        for column, table, f in t.up:
            owner = _owner(places.at(shape.tables[table].path), pre, post).tolist()
            source = made[table][f]
            columns[column] = [None if o < 0 or source[o] is None else str(source[o]) for o in owner]
        for column, f, table, other in t.known:
            there = set(zip(made[table]["record"], made[table][other], strict=True))
            columns[column] = ["1" if v is not None and (r, v) in there else None for r, v in zip(record.tolist(), columns[f], strict=True)]
        made[name] = columns | {"record": record.tolist()}
        again = [False] * len(pre)
        if t.once:
            seen: set = set()
            for i, row in enumerate(zip(made[name]["record"], *(columns[c] for c in t.once), strict=True)):
                if row in seen:
                    again[i] = True
                else:
                    seen.add(row)
        wide = len(t.columns)
        flat = [v for row in zip(*(columns[c] for c in t.columns), strict=True) for v in row] if wide else []
        texts = pa.ListArray.from_arrays(pa.array(np.arange(len(pre) + 1, dtype=np.int32) * wide), _strings(flat))
        yield name, record, pre - starts[record], post - starts[record], place.pos, again, texts


def shred(records: DataFrame, keys: list[str], text: str, shape: Shape) -> DataFrame:
    """Rows of all tables of ``shape``: ``keys`` and the columns of ``ROW``; ``table`` gives one of them with named columns.

    Tables named in ``up`` and ``known`` must come before those that use them. A record whose text is no valid JSON (also null,
    empty, NaN as a number) has no nodes; JSON may be of any depth. Other columns of ``records`` are ignored, so their names can't
    clash. An empty table gives an empty table.
    """
    source = records.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *ROW.fields])
    names = [*keys, *ROW.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(shape)

        def emit(batch: pa.RecordBatch, taken: list[int], begins: list[int]) -> Iterator[pa.RecordBatch]:
            of_record = np.array(taken, np.int64)
            for name, record, pre, post, pos, again, texts in _rows(shape, places, begins):
                if len(pre):
                    index = pa.array(of_record[record])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in keys), pa.array([name] * len(pre), pa.string()), pa.array(pre, pa.int32()), pa.array(post, pa.int32()), pa.array(pos, pa.int32()), pa.array(again, pa.bool_()), texts], names)
            places.clear()

        for batch in batches:
            taken: list[int] = []
            begins: list[int] = []
            clock = 0
            for i, value in enumerate(batch.column("_text").to_pylist()):
                try:
                    root = parse(value)
                except ValueError:
                    continue
                taken.append(i)
                begins.append(clock)
                clock = walk(root, places, clock)
                if clock >= 2 * EMITTED:
                    yield from emit(batch, taken, begins)
                    taken, begins, clock = [], [], 0
            yield from emit(batch, taken, begins)

    return source.mapInArrow(run, schema)


def table(rows: DataFrame, keys: list[str], shape: Shape, name: str) -> DataFrame:
    """One table of ``shred``: ``keys``, pre, post, pos, again and its columns by name."""
    named = [F.col("texts")[i].alias(c) for i, c in enumerate(shape.tables[name].columns)]
    return rows.filter(F.col("kind") == name).select(*keys, "pre", "post", "pos", "again", *named)


def first_received(records: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each ``key``: that with the earliest ``at`` (nulls last; of equal ones any, equal rows being copies)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).asc_nulls_last()))
    return records.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
