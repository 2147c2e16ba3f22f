"""Scoring of streams: a map is run over each row by itself, so a stream takes the same plan as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from fuzzloom.model import CognitiveMap
from fuzzloom.operators.kernel import infer
from fuzzloom.scratch import place


def score_stream(stream: DataFrame, m: CognitiveMap, inputs: dict[str, str | Column], keep: list[str], outputs: dict[str, str]) -> DataFrame:
    """``infer`` over a streaming DataFrame. There is no state, so rows may come late and in any order."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return infer(stream, m, inputs, keep, outputs)


def drain(scored: DataFrame, label: str) -> DataFrame:
    """All that the source holds now, written exactly once as Parquet under the shared folder and read back."""
    spark = scored.sparkSession
    here = place(spark, f"stream-{label}")
    query = scored.writeStream.format("parquet").option("path", f"{here}/out").option("checkpointLocation", f"{here}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{here}/out")


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
