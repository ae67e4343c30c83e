"""Documents as DataFrames: one row a document, with the file it came from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """JSON lines: a value a line; blank lines are no documents. Splittable."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias(column), F.col("_metadata.file_path").alias("filename"))


def json_sequence(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """RFC 7464: values after record separators."""
    return spark.read.option("lineSep", "\x1e").text(path).filter(F.trim("value") != "").select(F.trim(F.regexp_replace("value", "\n$", "")).alias(column), F.col("_metadata.file_path").alias("filename"))


def raw_lines(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """Each line a string."""
    return spark.read.text(path).select(F.col("value").alias(column), F.col("_metadata.file_path").alias("filename"))


def documents(spark: SparkSession, path: str, format_: str | None = None, column: str = "doc") -> DataFrame:
    """Whole files split into documents, printed one by one as JSON: (doc, document_index, filename)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sylva.functions.values import encode
        from sylva.sources.codecs import READERS, format_of
        from sylva.sources.nodes import to_value

        for batch in batches:
            for text, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = [encode(to_value(d)) for d in READERS[format_ or format_of(name)](text)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(range(len(docs)), pa.int32()), pa.array([name] * len(docs), pa.string())], names=[column, "document_index", "filename"])

    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("filename"))
    return files.mapInArrow(run, f"{column} string, document_index int, filename string")


def events(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Streaming form of each JSON text: rows of (position, path, leaf); a closing event has no leaf."""
    from sylva.api import jq_documents

    out = jq_documents(df, column, "tostream", keep=keep)
    return out.select(*(keep or []), "position", F.get_json_object("value", "$[0]").alias("path"), F.get_json_object("value", "$[1]").alias("leaf"), "error")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A line a row."""
    df.select(column).write.text(path)


def write_split(df: DataFrame, column: str, name: str, path: str) -> None:
    """A folder for each value of ``name``, one line a row within it."""
    df.select(F.col(column).alias("value"), F.col(name)).write.partitionBy(name).text(path)
