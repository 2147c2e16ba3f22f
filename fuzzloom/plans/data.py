"""Queries p1, p3 and p4: nested records, orphan references, rows that fail to parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzloom.operators.nested import Shape, Table, first_received, shred, table
from fuzzloom.operators.references import Cascade, ForeignKey, status_at
from fuzzloom.scratch import materialize
from fuzzloom.sources.strict_csv import assemble, load_lines

KEYS = ["rec_id", "map_id", "received_at"]
#: Java's form of Python's strip(): blanks of any script at either end.
OUTER_BLANKS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"

_CONCEPT = Table("concepts[]", ("id", "type", "activation"))
#: Concepts and relations of a record, and the arguments of its concepts.
PIECES = Shape(
    {
        "concept": _CONCEPT,
        "relation": Table("relations[]", ("origin", "destiny", "weight")),
        "named": Table("concepts[].custom_function_args[]", ("name",), up=(("concept_pos", "concept", "pos"), ("concept_id", "concept", "id"))),
        "arg": Table(
            "concepts[].custom_function_args[].values[]", ("value",), objects=False,
            up=(("name", "named", "name"), ("concept_pos", "named", "concept_pos"), ("concept_id", "named", "concept_id")), once=("concept_pos", "name", "pos"),
        ),
    },
    single=frozenset({"concepts", "relations"}), named=frozenset({"concepts[].custom_function_args"}),
)
#: What references need: ids of concepts, and the ends of relations with whether their own record has the concept.
ENDS = Shape(
    {
        "concept": Table("concepts[]", ("id",)),
        "relation": Table("relations[]", ("origin", "destiny"), known=(("origin_here", "origin", "concept", "id"), ("destiny_here", "destiny", "concept", "id"))),
    },
    single=frozenset({"concepts", "relations"}),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, sf_dir: str, keys: list[str], shape: Shape) -> DataFrame:
    """Rows of all tables of each record, the earliest delivery of each ``rec_id`` counting."""
    records = _table(spark, sf_dir, "fcm_records").select(*KEYS, "fcm_json")
    return shred(first_received(records, "rec_id", "received_at"), keys, "fcm_json", shape)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of all kinds by label. A name repeated in the list of one concept's arguments gives its elements once."""
    rows = pieces(spark, sf_dir, ["rec_id"], PIECES).filter("kind <> 'named' AND NOT again")
    text = lambda i: F.coalesce(F.col("texts")[i], F.lit(""))
    arg = F.col("kind") == "arg"
    label = F.when(arg, text(1)).when(F.col("kind") == "concept", text(0)).otherwise(F.concat(text(0), F.lit(">"), text(1)))
    return rows.select(
        "rec_id", F.col("kind").alias("child"), F.when(arg, F.col("texts")[2].cast("int")).otherwise(F.col("pos")).alias("pos"),
        label.alias("label"), F.when(arg, F.col("pos")).otherwise(F.lit(0)).alias("item_no"),
    )


def p1_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts with their type and start value; a value that is no number is null."""
    rows = table(pieces(spark, sf_dir, ["rec_id"], PIECES), ["rec_id"], PIECES, "concept")
    return rows.select("rec_id", "pos", F.coalesce("id", F.lit("")).alias("id"), "type", F.expr("try_cast(activation AS double)").alias("activation"))


def p1_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with their weight; a weight that is no number is null."""
    rows = table(pieces(spark, sf_dir, ["rec_id"], PIECES), ["rec_id"], PIECES, "relation")
    return rows.select("rec_id", "pos", "origin", "destiny", F.expr("try_cast(weight AS double)").alias("weight"))


def p1_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of an argument, with the concept whose interval holds it; ``number`` is null for values that are none."""
    rows = table(pieces(spark, sf_dir, ["rec_id"], PIECES), ["rec_id"], PIECES, "arg")
    return rows.select("rec_id", F.col("concept_pos").cast("int").alias("concept_pos"), "concept_id", F.coalesce("name", F.lit("")).alias("name"), F.col("pos").alias("item_no"), F.expr("try_cast(value AS double)").alias("number"))


def p1_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links told by the labels alone: concepts and the values of their arguments as tables of intervals, joined by containment,
    counted for each map.

    A value belongs to the concept of its record with pre < value's pre and value's post < post.
    """
    rows = materialize(pieces(spark, sf_dir, ["rec_id", "map_id"], PIECES), "nodes")
    side = lambda kind, *cols: table(rows, ["rec_id", "map_id"], PIECES, kind).select("rec_id", "map_id", *[F.col(c).alias(f"{kind}_{c}") for c in ("pre", "post", *cols)])
    inside = side("arg", "concept_pos").join(side("concept", "pos"), ["rec_id", "map_id"]).filter("concept_pre < arg_pre AND arg_post < concept_post")
    return inside.groupBy("map_id").agg(F.count("*").alias("n"), F.sum((F.col("concept_pos") == F.col("arg_concept_pos").cast("int")).cast("long")).alias("as_linked"))


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Written arrivals of concept ids, and ends of relations, of which those whose own record has the concept are marked."""
    rows = materialize(pieces(spark, sf_dir, KEYS, ENDS).withColumn("map_id", F.regexp_replace("map_id", OUTER_BLANKS, "")).select(*KEYS, "kind", "pos", "texts"), "ends")
    text = F.col("texts")
    arrived = rows.filter("kind = 'concept' AND texts[0] IS NOT NULL").select("map_id", text[0].alias("id"), "received_at")
    end = lambda name, i: F.struct(F.lit(name).alias("end_name"), text[i].alias("id"), text[i + 2].isNotNull().alias("here"))
    ends = rows.filter("kind = 'relation'").select(*KEYS, "pos", F.inline(F.array(end("origin", 0), end("destiny", 1)))).filter("id IS NOT NULL")
    return arrived, ends


_CARRIES = ForeignKey("relation", ("map_id", "origin"), "relation", ("map_id", "destiny"))


def _cascade(spark: SparkSession, sf_dir: str) -> tuple[Cascade, DataFrame]:
    """Orphans among relations, and the relations' ends.

    Ends are judged by when their concepts come and go. An end whose own record has the concept arrives together with it, so no
    deletion can lie between and it is no orphan. Below an orphan, a relation carries on what its origin holds, so it is a child of
    each relation of the map whose destiny is its origin.
    """
    arrived, ends = _ends(spark, sf_dir)
    gone = _table(spark, sf_dir, "concept_deletions").select(
        F.regexp_replace("map_id", OUTER_BLANKS, "").alias("map_id"), F.regexp_replace("concept_id", OUTER_BLANKS, "").alias("id"), F.col("deleted_at").alias("received_at")
    ).filter("received_at IS NOT NULL")
    direct = status_at(ends.filter("NOT here"), arrived, gone, ["map_id", "id"], ["rec_id", "pos", "end_name"], "received_at")
    one = lambda name: F.max(F.when(F.col("end_name") == name, F.col("id"))).alias(name)
    relations = ends.groupBy("rec_id", "pos", "map_id", "received_at").agg(one("origin"), one("destiny"))
    return Cascade({"relation": (relations, ["rec_id", "pos"])}, [_CARRIES], {"relation": direct}), relations


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round 0 of the cascade: the direct orphans."""
    return _cascade(spark, sf_dir)[0].direct("relation").select("rec_id", "pos", "end_name", "status")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans for each table, end and month: direct ones by status, and relations that inherit."""
    cascade, relations = _cascade(spark, sf_dir)
    bad = materialize(cascade.direct("relation"), "direct")
    found = Cascade({"relation": (materialize(relations, "relations"), ["rec_id", "pos"])}, [_CARRIES], {"relation": bad})
    inherited = found.found()["relation"].filter("origin = 'inherited'").select("rec_id", "pos").join(found.tables["relation"][0], ["rec_id", "pos"])
    month = F.date_format("received_at", "yyyy-MM").alias("month")
    counted = bad.select("end_name", month, "status").unionByName(inherited.select(F.lit("origin").alias("end_name"), month, F.lit("inherited").alias("status")))
    return counted.groupBy(F.lit("fcm_records.relations").alias("table_name"), "end_name", "month", "status").agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_lines(_table(spark, sf_dir, "csv_lines"), _table(spark, sf_dir, "csv_files"), _table(spark, sf_dir, "class_values"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter("reason IS NOT NULL").select("line_id", "reason")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that load, as typed rows."""
    get = lambda name: F.element_at("values", name)
    numbers = [F.expr(f"try_cast(trim(element_at(values, '{c}')) AS double)").alias(c.lower()) for c in ("F2", "F3", "F4")]
    return _lines(spark, sf_dir).filter("reason IS NULL").select("line_id", "file_id", get("F1").alias("f1"), *numbers, F.regexp_replace(get("class"), OUTER_BLANKS, "").alias("class"))


def p4_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that didn't come through: lines that don't load with their reason, and fields of loaded lines whose text is no
    number though their column holds numbers (``invalid_number`` with column and text).

    Such fields are null in ``p4_rows``; the lines load all the same. Blank fields are missing values and no faults.
    """
    lines = materialize(_lines(spark, sf_dir), "lines")
    none = F.lit(None).cast("string")
    failed = lines.filter("reason IS NOT NULL").select("line_id", "file_id", "reason", F.when(F.col("reason") == "invalid_value", "class").alias("column"), none.alias("value"))
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.element_at("values", c).alias("value")) for c in ("F2", "F3", "F4")]))
    fields = lines.filter("reason IS NULL").select("line_id", "file_id", F.lit("invalid_number").alias("reason"), each)
    return failed.unionByName(fields.filter("trim(value) <> '' AND try_cast(trim(value) AS double) IS NULL"))


def p4_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as physical lines, cut at every line break and put together again by their quotes; how many records of each file
    load, and how many fail for which reason.

    Left out are records with an odd number of quotes, after which a reader of physical lines can't know where the next begins.
    """
    lines = _table(spark, sf_dir, "csv_lines").select("line_id", "file_id", "raw_line").dropDuplicates(["line_id"])
    even = lines.filter("raw_line IS NULL OR (length(raw_line) - length(replace(raw_line, '\"', ''))) % 2 = 0")
    physical = even.select("line_id", "file_id", F.posexplode(F.split(F.coalesce("raw_line", F.lit("")), "\n", -1)).alias("no", "text"))
    records = assemble(physical.select("file_id", F.struct("line_id", "no").alias("at"), "text"), "file_id", "at", "text")
    judged = load_lines(records.select(F.xxhash64("at").alias("line_id"), "file_id", F.col("text").alias("raw_line")), _table(spark, sf_dir, "csv_files"), _table(spark, sf_dir, "class_values"))
    return judged.groupBy("file_id", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_concepts": p1_concepts, "p1_relations": p1_relations, "p1_args": p1_args, "p1_intervals": p1_intervals, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_rows": p4_rows, "p4_rejects": p4_rejects, "p4_assembled": p4_assembled}


_NODES = """
rec AS (SELECT rec_id, arg_min(map_id, received_at) AS map_id, min(received_at) AS ts, arg_min(fcm_json, received_at) AS t FROM fcm_records GROUP BY rec_id),
js AS (SELECT rec_id, trim(map_id) AS map_id, ts, t::JSON AS j FROM rec WHERE t IS NOT NULL AND json_valid(t)),
lists AS (
  SELECT rec_id, map_id, ts, 'concept' AS child, CASE json_type(j, '$.concepts') WHEN 'ARRAY' THEN json_extract(j, '$.concepts[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.concepts')] END AS l FROM js WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT rec_id, map_id, ts, 'relation', CASE json_type(j, '$.relations') WHEN 'ARRAY' THEN json_extract(j, '$.relations[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.relations')] END FROM js WHERE json_type(j) = 'OBJECT'
),
entries AS (SELECT * FROM (SELECT rec_id, map_id, ts, child, unnest(l) AS e, (generate_subscripts(l, 1) - 1)::INT AS pos FROM lists) WHERE json_type(e) = 'OBJECT')
"""
_ARGS = f"""WITH {_NODES},
raw AS (SELECT rec_id, map_id, pos, e ->> '$.id' AS id, CASE json_type(e, '$.custom_function_args') WHEN 'VARCHAR' THEN try_cast(e ->> '$.custom_function_args' AS JSON) ELSE e -> '$.custom_function_args' END AS a FROM entries WHERE child = 'concept'),
named AS (
  SELECT rec_id, map_id, pos, id, k AS name, json_extract(a, '$."' || k || '"') AS v FROM (SELECT rec_id, map_id, pos, id, a, unnest(json_keys(a)) AS k FROM raw WHERE json_type(a) = 'OBJECT')
  UNION ALL SELECT rec_id, map_id, pos, id, x ->> '$.name', x -> '$.value' FROM (SELECT rec_id, map_id, pos, id, unnest(json_extract(a, '$[*]')) AS x FROM raw WHERE json_type(a) = 'ARRAY')
),
vals AS (
  SELECT rec_id, map_id, pos, id, name, v, item_no::INT AS item_no FROM (
    SELECT rec_id, map_id, pos, id, name, unnest(json_extract(v, '$[*]')) AS v, generate_subscripts(json_extract(v, '$[*]'), 1) - 1 AS item_no FROM named WHERE json_type(v) = 'ARRAY')
  UNION ALL SELECT rec_id, map_id, pos, id, name, v, 0 FROM named WHERE v IS NULL OR json_type(v) <> 'ARRAY'
)
"""
_P1 = f"""{_ARGS}
SELECT rec_id, child, pos, CASE child WHEN 'concept' THEN coalesce(trim(e ->> '$.id'), '') ELSE coalesce(trim(e ->> '$.origin'), '') || '>' || coalesce(trim(e ->> '$.destiny'), '') END AS label, 0::INT AS item_no FROM entries
UNION ALL SELECT rec_id, 'arg', pos, name, item_no FROM vals"""
_SEEN = f"""{_NODES},
come AS (SELECT DISTINCT map_id, trim(e ->> '$.id') AS id, ts FROM entries WHERE child = 'concept' AND e ->> '$.id' IS NOT NULL),
gone AS (SELECT DISTINCT trim(map_id) AS map_id, trim(concept_id) AS id, deleted_at AS ts FROM concept_deletions),
ends AS (SELECT rec_id, map_id, ts, pos, n AS end_name, trim(e ->> ('$.' || n)) AS id FROM entries, (VALUES ('origin'), ('destiny')) v(n) WHERE child = 'relation' AND e ->> ('$.' || n) IS NOT NULL),
seen AS (
  SELECT x.rec_id, x.pos, x.end_name, x.map_id, x.id, x.ts, count(c.ts) AS ever, max(c.ts) FILTER (WHERE c.ts <= x.ts) AS last
  FROM ends x LEFT JOIN come c ON c.map_id = x.map_id AND c.id = x.id GROUP BY ALL
)
, bad AS (
  SELECT rec_id, pos, end_name, ts, CASE WHEN ever = 0 THEN 'missing' WHEN last IS NULL THEN 'late' ELSE 'deleted' END AS status FROM seen s
  WHERE ever = 0 OR last IS NULL OR EXISTS (SELECT 1 FROM gone g WHERE g.map_id = s.map_id AND g.id = s.id AND g.ts > last AND g.ts <= s.ts)
)"""
_REPORT = f"""WITH RECURSIVE {_SEEN},
rel AS (SELECT rec_id, map_id, ts, pos, trim(e ->> '$.origin') AS origin, trim(e ->> '$.destiny') AS destiny FROM entries WHERE child = 'relation'),
-- Relations that carry on what the destiny of an orphan holds.
hit(rec_id, pos, map_id, destiny) AS (
  SELECT c.rec_id, c.pos, c.map_id, c.destiny FROM rel p SEMI JOIN bad ON bad.rec_id = p.rec_id AND bad.pos = p.pos JOIN rel c ON c.map_id = p.map_id AND c.origin = p.destiny
  UNION SELECT c.rec_id, c.pos, c.map_id, c.destiny FROM hit JOIN rel c ON c.map_id = hit.map_id AND c.origin = hit.destiny
),
counted AS (
  SELECT end_name, ts, status FROM bad
  UNION ALL SELECT 'origin', rel.ts, 'inherited' FROM rel SEMI JOIN hit ON hit.rec_id = rel.rec_id AND hit.pos = rel.pos ANTI JOIN bad ON bad.rec_id = rel.rec_id AND bad.pos = rel.pos
)
SELECT 'fcm_records.relations' AS table_name, end_name, strftime(ts, '%Y-%m') AS month, status, count(*) AS n FROM counted GROUP BY ALL"""
# A separator is put before the line, so that every field, also an empty one, is matched with one.
_ONCE = "once AS (SELECT line_id, any_value(file_id) AS file_id, rtrim(any_value(raw_line), chr(13)) AS r FROM csv_lines GROUP BY line_id)"
_ASSEMBLED = r"""src AS (SELECT line_id, any_value(file_id) AS file_id, coalesce(any_value(raw_line), '') AS x FROM csv_lines GROUP BY line_id),
cut AS (SELECT line_id, file_id, unnest(string_split(x, chr(10))) AS x, generate_subscripts(string_split(x, chr(10)), 1) AS no FROM src WHERE (len(x) - len(replace(x, '"', ''))) % 2 = 0),
odd AS (SELECT *, len(x) - len(replace(x, '"', '')) AS q, sum(len(x) - len(replace(x, '"', ''))) OVER (PARTITION BY file_id ORDER BY line_id, no) AS upto FROM cut),
numbered AS (SELECT *, sum(((upto - q) % 2 = 0)::INT) OVER (PARTITION BY file_id ORDER BY line_id, no) AS rec FROM odd),
once AS (SELECT rec AS line_id, file_id, rtrim(string_agg(x, chr(10) ORDER BY line_id, no), chr(13)) AS r FROM numbered GROUP BY rec, file_id)"""
_JUDGED = r"""
j AS (SELECT line_id, o.file_id, column_list, class_set, sep_char || r AS r, CASE sep_char WHEN '|' THEN '\|' ELSE sep_char END AS s FROM once o JOIN csv_files f ON f.file_id = o.file_id),
f AS (SELECT *, '(?s)' || s || '("(?:[^"]|"")*"|[^"' || s || ']*)' AS field FROM j),
g AS (SELECT *, regexp_full_match(r, '(?s)(?:' || s || '("(?:[^"]|"")*"|[^"' || s || ']*))+') AS ok, regexp_extract_all(r, field, 1) AS v FROM f),
h AS (SELECT line_id, file_id, ok, column_list, class_set, list_transform(v, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM g),
c AS (SELECT *, trim(v[list_position(column_list, 'class')], ' ' || chr(9) || chr(10) || chr(13)) AS class FROM h),
judged AS (
  SELECT *, CASE WHEN NOT ok THEN 'broken_quoting' WHEN len(v) <> len(column_list) THEN 'column_count'
    WHEN NOT EXISTS (SELECT 1 FROM class_values k WHERE k.class_set = c.class_set AND k."class" = c.class) THEN 'invalid_value' END AS reason
  FROM c
)
"""


_P4 = f"WITH {_ONCE},{_JUDGED}"


def oracle_sql() -> dict[str, str]:
    value = lambda n: f"trim(v[list_position(column_list, '{n}')])"
    number = lambda n: f"try_cast(trim(v[list_position(column_list, '{n}')]) AS DOUBLE) AS {n.lower()}"
    return {
        "p1_found": _P1,
        "p1_concepts": f"WITH {_NODES} SELECT rec_id, pos, coalesce(trim(e ->> '$.id'), '') AS id, trim(e ->> '$.type') AS type, try_cast(e ->> '$.activation' AS DOUBLE) AS activation FROM entries WHERE child = 'concept'",
        "p1_relations": f"WITH {_NODES} SELECT rec_id, pos, trim(e ->> '$.origin') AS origin, trim(e ->> '$.destiny') AS destiny, try_cast(e ->> '$.weight' AS DOUBLE) AS weight FROM entries WHERE child = 'relation'",
        "p1_args": _ARGS + "SELECT rec_id, pos AS concept_pos, trim(id) AS concept_id, name, item_no, try_cast(v ->> '$' AS DOUBLE) AS number FROM vals",
        "p1_intervals": _ARGS + "SELECT r.map_id, count(*) AS n, count(*) AS as_linked FROM vals a JOIN rec r ON r.rec_id = a.rec_id GROUP BY r.map_id",
        "p3_found": f"WITH {_SEEN} SELECT rec_id, pos, end_name, status FROM bad",
        "p3_report": _REPORT,
        "p4_found": _P4 + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p4_rows": _P4 + f"SELECT line_id, file_id, v[list_position(column_list, 'F1')] AS f1, {number('F2')}, {number('F3')}, {number('F4')}, class FROM judged WHERE reason IS NULL",
        "p4_rejects": _P4 + "SELECT line_id, file_id, reason, CASE reason WHEN 'invalid_value' THEN 'class' END AS \"column\", NULL::VARCHAR AS value FROM judged WHERE reason IS NOT NULL"
        + "".join(f" UNION ALL SELECT line_id, file_id, 'invalid_number', '{c}', v[list_position(column_list, '{c}')] FROM judged WHERE reason IS NULL AND {value(c)} <> '' AND try_cast({value(c)} AS DOUBLE) IS NULL" for c in ("F2", "F3", "F4")),
        "p4_assembled": f"WITH {_ASSEMBLED},{_JUDGED} SELECT file_id, coalesce(reason, 'loaded') AS outcome, count(*) AS n FROM judged GROUP BY ALL",
    }
