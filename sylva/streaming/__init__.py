"""Filters over unbounded input: stateless programs on Structured Streaming, and running folds by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.api import jq_documents


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines as files arrive in a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "doc")


def filtered(stream: DataFrame, program: str, column: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """Evaluate a filter on each document of a stream; outputs keep no state, so any output mode and restart will do."""
    return jq_documents(stream, column, program, keep=keep)


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running sums of ``value`` by ``key`` in update mode: with each batch, the new total and count of the keys it holds."""
    return stream.groupBy(F.col(key).cast("string").alias("key")).agg(F.sum(F.col(value).cast("double")).alias("total"), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, ts: str, length: str, late: str, keys: list[str], aggregates: dict) -> DataFrame:
    """Event-time windows with a watermark; ``aggregates``: name -> aggregate column."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
