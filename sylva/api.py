"""Entry points: programs over tables and over columns of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.plans.jq_planner import NotPlanned, plan


def jq(df: DataFrame, program: str, mode: str = "slurp", variables: dict | None = None, order: list[str] | None = None) -> DataFrame:
    """Run a JSON filter over a table.

    mode "slurp": the table is one array of row objects; "stream": each row is an input. ``variables`` are values, or
    DataFrames that are read as arrays of rows ($name[]) or lookups (columns key, value). ``order`` names the columns that
    order the rows. A program without a typed plan is evaluated row by row in stream mode; over the whole array it is refused.
    """
    try:
        return plan(df, program, mode, variables, order)
    except NotPlanned:
        if mode != "stream" or any(isinstance(v, DataFrame) for v in (variables or {}).values()):
            raise
    text = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("__doc"))
    return jq_documents(text, "__doc", program, variables).select("value")


def jq_documents(df: DataFrame, column: str, program: str, variables: dict | None = None, keep: list[str] | None = None, raw: bool = False, spread: int = 0) -> DataFrame:
    """Evaluate a filter on each JSON text of a column: a row an output, in order ``position``; errors go to ``error``.

    ``raw``: the column holds plain strings, each an input string. ``spread``: deal the rows to so many tasks first, where
    they lie in few large partitions and evaluation outweighs a shuffle.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sylva.functions.jq_builtins import Halt
        from sylva.functions.values import JqError, decode_all, encode
        from sylva.operators.jq_eval import Program

        compiled = Program(program, variables)
        def outputs(doc: str | None) -> Iterator[tuple[str | None, str | None]]:
            try:
                for value in [doc] if raw else decode_all(doc or ""):
                    for x in compiled.run(value):
                        yield encode(x), None
            except Halt as e:
                if e.shown:
                    yield None, e.value if isinstance(e.value, str) else encode(e.value)
            except (JqError, *_FAULTS) as e:
                yield None, _fault(e)

        def given(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            at, places, out, errors = zip(*rows, strict=True) if rows else [()] * 4
            kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(at, pa.int64())).columns if batch.num_columns > 1 else []
            return pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int32()), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=[*keep, "position", "value", "error"])

        for batch in batches:
            rows, held = [], 0
            for at, doc in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for place, (value, error) in enumerate(outputs(doc)):
                    rows.append((at, place, value, error))
                    held += len(value or "")
                    if len(rows) >= _ROWS or held >= _CHARACTERS:
                        yield given(batch, rows)
                        rows, held = [], 0
            yield given(batch, rows)

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields) if keep else ""
    return _spread(df.select(*keep, F.col(column).cast("string").alias("__doc")), spread).mapInArrow(run, types + "position int, value string, error string")


def _fault(e: Exception) -> str:
    """What goes to ``error`` where a document, however odd, breaks its reader or a filter."""
    if isinstance(e, RecursionError):
        return "nested too deep"
    return getattr(e, "message", lambda: str(e) or type(e).__name__)()


#: What a document's evaluation may end in; anything else is a fault of ours or of the machine and ends the job.
_FAULTS = (ValueError, ArithmeticError, LookupError, TypeError, AttributeError, RecursionError)
#: Outputs given on at a time, and their characters.
_ROWS, _CHARACTERS = 4_096, 4 << 20


def _spread(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n) if n else df


def sort_keys(df: DataFrame, column: str, name: str = "sort_key") -> DataFrame:
    """Add the order-preserving binary key of a JSON text column, for Spark to sort, group and join by."""

    def key(texts):
        import pandas as pd

        from sylva.functions.values import decode, sort_key

        return pd.Series([None if t is None else sort_key(decode(t)) for t in texts])

    return df.withColumn(name, F.pandas_udf(key, "binary")(F.col(column)))


def yq_documents(df: DataFrame, column: str, expression: str, input_format: str = "yaml", output_format: str = "yaml", keep: list[str] | None = None, spread: int = 0, options: dict | None = None) -> DataFrame:
    """Evaluate a YAML expression on each text of a column: printed matches in ``value``; errors go to ``error``.

    ``options``: those of the formats and the language by their names on the command line, as {"csv-separator": ";"}.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sylva.functions.values import JqError
        from sylva.operators.yq_eval import yq
        from sylva.sources.nodes import YqError

        for batch in batches:
            out, errors = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    out.append(yq(expression, text or "", input_format, output_format, options))
                    errors.append(None)
                except (YqError, JqError, *_FAULTS) as e:
                    out.append(None)
                    errors.append(str(e) if isinstance(e, (YqError, JqError)) else _fault(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array(errors, pa.string())], names=[*keep, "value", "error"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields) if keep else ""
    return _spread(df.select(*keep, F.col(column).cast("string").alias("__doc")), spread).mapInArrow(run, types + "value string, error string")


def register(spark) -> None:
    """SQL functions: jq(text, program) gives the outputs as an array of JSON texts, yq(text, expression, from, to) a text.

    A document's fault gives null.
    """

    def jq_texts(texts, programs):
        import pandas as pd

        from sylva.functions.values import JqError, decode_all, encode
        from sylva.operators.jq_eval import Program

        compiled: dict[str, Program] = {}
        out = []
        for text, program in zip(texts, programs, strict=True):
            run = compiled.get(program) or compiled.setdefault(program, Program(program, None))
            try:
                out.append(None if text is None else [encode(x) for v in decode_all(text) for x in run.run(v)])
            except (JqError, *_FAULTS):
                out.append(None)
        return pd.Series(out)

    def yq_text(texts, expressions, sources, targets):
        import pandas as pd

        from sylva.functions.values import JqError
        from sylva.operators.yq_eval import yq
        from sylva.sources.nodes import YqError

        out = []
        for text, expression, source, target in zip(texts, expressions, sources, targets, strict=True):
            try:
                out.append(None if text is None else yq(expression, text, source, target))
            except (YqError, JqError, *_FAULTS):
                out.append(None)
        return pd.Series(out)

    spark.udf.register("jq", F.pandas_udf(jq_texts, "array<string>"))
    spark.udf.register("yq", F.pandas_udf(yq_text, "string"))


def converted(df: DataFrame, column: str, input_format: str, output_format: str, keep: list[str] | None = None) -> DataFrame:
    """Each text of a column in another format."""
    return yq_documents(df, column, ".", input_format, output_format, keep)
