"""Written intermediate tables, and broadcasts behind a check of their size.

Lineage is cut by writing a table into the shared folder that the session names in ``spark.checkpoint.dir``. Tasks on any
executor can read it again, so a lost executor costs only its running tasks. The folder is taken from the session; only where
the setting is missing (tests on one machine) a temporary folder stands in for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its Parquet files, in rows and in bytes as a broadcast holds it, that is sent whole to every executor.
BROADCAST_BYTES, BROADCAST_ROWS, BROADCAST_MEMORY = 16 << 20, 1 << 20, 128 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    global _own_dir
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="fuzzloom-")
    return _own_dir


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def place(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/fuzzloom-{uuid.uuid4().hex}-{label}"
    fs, jpath = _fs(spark, path)
    fs.deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back. The files go when the driver ends."""
    spark = df.sparkSession
    path = place(spark, label)
    df.write.parquet(path)
    _fs(spark, path)[0].deleteOnExit(_fs(spark, path)[1])
    back = spark.read.schema(df.schema).parquet(path)
    back._fuzzloom_path = path
    return back


def table_bytes(df: DataFrame) -> int:
    """Size in bytes of a table made by ``materialize``."""
    fs, jpath = _fs(df.sparkSession, df._fuzzloom_path)
    return int(fs.getContentSummary(jpath).getLength())


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that no later plan reads."""
    fs, jpath = _fs(df.sparkSession, df._fuzzloom_path)
    fs.delete(jpath, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work in Python that takes far longer than moving its input.

    A table of a few small files would be one task. Tables with enough partitions, as all large ones, and streams stay as they are.
    """
    if df.isStreaming:
        return df
    # Asking a plan with a shuffle for its partitions would run the shuffle; what comes from one is spread already.
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() not in _NARROW:
            return df
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Plans whose partitions are known without running anything.
_NARROW = {"Project", "Filter", "LogicalRelation", "Relation", "LogicalRDD", "LocalRelation", "Range", "MapInArrow", "Union", "SubqueryAlias"}


def _fits(small: DataFrame, on: list[str]) -> bool:
    """Whether a broadcast of ``small`` is within ``BROADCAST_ROWS`` and ``BROADCAST_MEMORY``.

    It holds the rows and their keys once more, unpacked: long texts that are much alike take far less in Parquet. Columns of no
    fixed width count by the length of their text.
    """
    size = F.lit(32 + 8 * (len(small.columns) + len(on)))
    for name, kind in small.dtypes:
        if kind in ("string", "binary") or "<" in kind:
            size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) * (1 + (name in on))
    rows, held = small.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_MEMORY


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a written table: broadcast if its files are within ``limit`` and its rows and their bytes in memory within
    ``BROADCAST_ROWS`` and ``BROADCAST_MEMORY``; else a shuffled join with salted keys.

    In the shuffled form each row of ``small`` is given once for each of 16 salts and rows of ``big`` take a salt from their
    position, so a key with a third of all rows is spread over 16 tasks.
    """
    if table_bytes(small) <= limit and _fits(small, on):
        return big.join(F.broadcast(small), on, how)
    salts = F.explode(F.array(*[F.lit(i) for i in range(16)]))
    salted = small.withColumn("_salt", salts)
    spread = F.pmod(F.xxhash64(*[c for c in big.columns]), F.lit(16)).cast("int")
    return big.withColumn("_salt", spread).join(salted, [*on, "_salt"], how).drop("_salt")
