"""Datasets from text files, their summary, and columns as codes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzloom.operators.prefix import running


def split_plain(lines: DataFrame, columns: list[str], text: str = "value", separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """Rows of text columns, each once, and the lines with another number of fields.

    Fields are what lies between separators; quotes mean nothing. A null line is rejected.
    """
    parts = F.split(F.col(text), re.escape(separator), -1)
    fits = F.coalesce(F.size(parts) == len(columns), F.lit(False))
    rows = lines.filter(fits).select(*[parts[i].alias(c) for i, c in enumerate(columns)]).distinct()
    return rows, lines.filter(~fits)


def load_csv_dataset(spark: SparkSession, path: str, factorize_columns: bool = False) -> DataFrame:
    """A comma-separated file with a header as text columns; lines of another length are left out and repeated rows count once.

    With ``factorize_columns`` every column becomes codes, in the order in which values first appear in the file. Of a folder the
    first line of its first file is the header.
    """
    # A line's place: its split of the file, and its number in the task that reads the split.
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select("value", place.alias("_at"))
    top = lines.agg(F.min_by("value", "_at").alias("header"), F.min("_at").alias("_at")).first()
    if top.header is None:
        raise ValueError(f"{path} is empty")
    columns = top.header.split(",")
    parts = F.split(F.col("value"), ",", -1)
    first = F.struct(*[F.lit(v).alias(k) for k, v in top["_at"].asDict().items()])
    fits = lines.filter((F.size(parts) == len(columns)) & (F.col("_at") != first)).select(*[parts[i].alias(c) for i, c in enumerate(columns)], "_at")
    rows = fits.groupBy(*columns).agg(F.min("_at").alias("_at"))
    return (factorize(rows, columns, ["_at"]) if factorize_columns else rows).drop("_at")


_ATTRIBUTE = re.compile(r"\s*@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+?)\s*$", re.IGNORECASE)
_ARFF_TYPES = {"numeric": "double", "real": "double", "integer": "long"}


def load_arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF file: numeric, real and integer attributes as numbers, others as text; ``?`` is null, ``%`` begins a comment.

    The header is read on the driver, data lines by the CSV reader of the tasks (fields may be in single quotes). Lines with
    another number of fields end the load. Sparse rows in braces aren't supported.
    """
    lines = spark.read.text(path)
    head = [r.value for r in lines.filter(F.col("value").rlike(r"(?i)^\s*@")).collect()]
    fields = []
    for line in head:
        if m := _ATTRIBUTE.match(line):
            fields.append((m[1].strip("'\""), _ARFF_TYPES.get(m[2].lower(), "string")))
    if not fields:
        raise ValueError(f"{path} declares no attributes")
    data = lines.filter(~F.col("value").rlike(r"^\s*(@|%|$)")).select("value")
    schema = ", ".join(f"`{n}` string" for n, _ in fields)
    parsed = data.select(F.from_csv("value", schema, {"quote": "'", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": "?"}).alias("r"), (F.size(F.split("value", ",")) < len(fields)).alias("short"))
    checked = parsed.select(F.when(F.col("short"), F.raise_error(F.lit("wrong number of fields"))).otherwise(F.col("r")).alias("r"))
    return checked.select(*[F.col("r")[n].cast(t).alias(n) for n, t in fields])


def load_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated file with a header; each column has the narrowest type that all its values have, and a malformed line ends
    the load."""
    return spark.read.option("header", True).option("inferSchema", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def load_dataset(spark: SparkSession, path: str, factorize_columns: bool = False, max_int_uniques: int = 10, int_factor: float = 0.2) -> DataFrame:
    """A dataset by its extension (csv or arff), repeated rows once, and on request with columns as codes (``factorize_some``)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "arff"):
        raise ValueError(f"Unknown dataset format: {kind}")
    rows = (load_typed_csv if kind == "csv" else load_arff)(spark, path).dropDuplicates()
    return factorize_some(rows, rows.columns, max_int_uniques, int_factor) if factorize_columns else rows


def summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """(n_features, n_rows, target, n_classes); the target is ``class`` if there is such a column, else the last one."""
    target = target or ("class" if "class" in df.columns else df.columns[-1])
    return df.agg(F.lit(len(df.columns)).alias("n_features"), F.count("*").alias("n_rows"), F.lit(target).alias("target"), F.count_distinct(target).alias("n_classes"))


def factorize(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The columns as codes from 0 in the order in which their values first appear by ``order``; null is -1.

    Only a column's distinct values are put in order, in ranges; rows are joined with them once for each column.
    """
    out, key = df, F.struct(*[F.col(c) for c in order])
    for c in columns:
        first = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.min(key).alias("_first")).select("_v", "_first", F.lit(1).alias("_all"), F.lit(1).alias("_one"))
        codes = running(first, ["_all"], ["_first", "_v"], {"_code": ("sum", "_one")}).select(F.col("_v"), (F.col("_code") - 1).cast("long").alias("_code"))
        out = out.join(codes.withColumnRenamed("_code", f"_code_{c}"), F.col(c) == F.col("_v"), "left").drop("_v")
    return out.select(*[F.coalesce(F.col(f"_code_{c}"), F.lit(-1)).alias(c) if c in columns else F.col(c) for c in df.columns])


def factorize_some(df: DataFrame, order: list[str], max_int_uniques: int = 10, int_factor: float = 0.2) -> DataFrame:
    """Text columns as codes, and whole numbers with at most ``max_int_uniques`` values or fewer than ``int_factor`` of the rows."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if ints:
        row = df.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in ints]).first()
        ints = [c for c in ints if row[c] <= max_int_uniques or row[c] < int_factor * row["_n"]]
    return factorize(df, [c for c in df.columns if c in text or c in ints], order)


def as_frame(spark: SparkSession, data, names: list[str] | None = None, offset: int = 0) -> DataFrame:
    """A DataFrame from a dict of columns, rows, one column of values or a DataFrame; unnamed columns are numbered from ``offset``."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, dict):
        names, data = list(data), list(zip(*data.values(), strict=True))
    rows = [tuple(r) if isinstance(r, (list, tuple)) or hasattr(r, "tolist") and hasattr(r, "__len__") else (r,) for r in data]
    if not rows:
        raise ValueError("no rows to take a schema from")
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows]
    return spark.createDataFrame(rows, names or [str(offset + i) for i in range(len(rows[0]))])


