"""Tokenizers, normalisers and flat maps of one's own, for SQL and data frames.

A tokenizer or flat map becomes a table function: ``SELECT d.id, t.* FROM docs d, LATERAL my_tokens(d.text) AS t``. What is
registered is an Arrow function that gives an array for each text, and a SQL function that takes it apart, so the plan is that of the
built-in tokenizer: one Arrow pass where the rows are, then a generator; nothing is exchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .text import in_runs

TOKEN = T.StructType([T.StructField("tok_start", T.IntegerType()), T.StructField("tok_end", T.IntegerType()), T.StructField("word", T.StringType())])
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def regex_spans(pattern: str) -> Callable[[str], Iterable[tuple[int, int]]]:
    """A tokenizer whose tokens are the matches of a pattern."""
    found = re.compile(pattern)
    return lambda text: (m.span() for m in found.finditer(text))


def tokenizer(spans: Callable[[str], Iterable[tuple[int, int]]]):
    """An Arrow function from text to an array of ``TOKEN``, from one that gives the spans of a text's tokens in order. A null
    text gives null."""
    return flat_map(lambda text: [(a, z, text[a:z]) for a, z in spans(text)], TOKEN)


def flat_map(make: Callable[[str], Iterable[tuple]], row: T.StructType):
    """An Arrow function from text to an array of rows."""
    kind = T.ArrayType(row)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        arrow = to_arrow_type(kind)
        fields = list(arrow.value_type)

        def made(part: pa.Array) -> pa.Array:
            rows, ends = [], [0]
            for t in part.to_pylist():
                rows += () if t is None else make(t)
                ends.append(len(rows))
            columns = [pa.array([x[i] if i < len(x) else None for x in rows], f.type) for i, f in enumerate(fields)]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields), type=arrow, mask=part.is_null())

        return in_runs(made, texts)

    return run


def register_flat_map(spark: SparkSession, name: str, function, row: T.StructType) -> None:
    """Make ``name`` a SQL table function of one text: ``idx`` (from 0) and the fields of ``row``; texts that are null or give no
    rows have none. ``name_array`` is the array itself. A second registration replaces the first."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"no name of a function: {name}")
    spark.udf.register(f"{name}_array", function)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row.fields)
    taken = ", ".join(f"col.`{f.name}`" for f in row.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE(idx INT, {fields}) RETURN SELECT pos, {taken} FROM posexplode({name}_array(t))")


def register_tokenizer(spark: SparkSession, name: str, function) -> None:
    """``register_flat_map`` for a tokenizer: any Arrow function from text to an array of ``TOKEN``."""
    register_flat_map(spark, name, function, TOKEN)


def register_normaliser(spark: SparkSession, name: str, change: Callable[[str], str]) -> None:
    """Make ``name`` a SQL function from text to text; null stays null. A batch's repeated texts are changed once."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        distinct = texts.dictionary_encode()
        changed = in_runs(lambda part: pa.array([None if t is None else change(t) for t in part.to_pylist()], pa.string()), distinct.dictionary)
        return changed.take(distinct.indices)

    spark.udf.register(name, run)
