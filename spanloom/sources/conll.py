"""CoNLL-style token tables: reading, writing and text reconstruction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import runs
from ..operators.chains import all_scores
from ..operators.markup import parse_coref, unclosed
from ..operators.sweep import nest
from . import files

ROWS = "file string, line_no int, line string"
_ROW = T.StructType([T.StructField("row_idx", T.IntegerType()), T.StructField("cols", T.ArrayType(T.StringType()))])


def lines(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """file (its name), line_no and line of the files of a path, with a suffix of all those below it that end so."""
    reader = spark.read
    if suffix:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def documents(rows: DataFrame) -> DataFrame:
    """file, doc_no, doc_id, row_idx, cols of all rows between #begin document and #end document; other # lines are skipped."""
    w = Window.partitionBy("file").orderBy("line_no")
    begin, end = F.col("line").startswith("#begin document"), F.col("line").startswith("#end document")
    df = rows.withColumn("doc_no", F.sum(F.when(begin, 1).otherwise(0)).over(w)).withColumn("closed", F.sum(F.when(end, 1).otherwise(0)).over(w)).withColumn("doc_id", F.last(F.when(begin, F.substring("line", 17, 1 << 30)), ignorenulls=True).over(w))
    df = df.where((F.col("doc_no") > F.col("closed")) & ~F.col("line").startswith("#"))
    row = F.row_number().over(Window.partitionBy("file", "doc_no").orderBy("line_no")) - 1
    return df.select("file", "doc_no", "doc_id", row.alias("row_idx"), F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", "\\s+")).alias("cols"))


def documents_of(texts: DataFrame) -> DataFrame:
    """``documents`` of texts (file, value) that each hold a whole file, found where the text is, as a row for each with ``rows``, the
    array of its row_idx and cols: nothing is exchanged. Documents without rows are none."""
    src = texts.select("file", F.col("value").cast("string").alias("value"))
    schema = T.StructType([src.schema["file"], *(T.StructField(n, t) for n, t in (("doc_no", T.LongType()), ("doc_id", T.StringType()), ("rows", T.ArrayType(_ROW))))])

    def run(batches):
        for b in batches:
            for a, z in runs(b.column(1)):
                whose, docs = [], []
                for i, text in enumerate(b.column(1)[a:z].to_pylist()):
                    found = _documents(text or "")
                    whose += [i] * len(found)
                    docs += found
                if docs:
                    no, ids, rows = zip(*docs)
                    yield pa.RecordBatch.from_arrays([b.column(0)[a:z].take(pa.array(whose)), pa.array(no, pa.int64()), pa.array(ids, pa.string()), _rows(rows)], names=schema.names)

    return src.mapInArrow(run, schema)


def _documents(text: str) -> list[tuple[int, str, list[str]]]:
    """doc_no, doc_id and rows, each a line, of the documents of a text that have any. A line that ends a document counts against all that
    have begun, as in ``documents``."""
    out, begun, closed, doc_id, rows = [], 0, 0, None, []
    for line in text.split("\n"):
        if not line.startswith("#"):
            if begun > closed:
                rows.append(line)
        elif line.startswith("#begin document"):
            if rows:
                out.append((begun, doc_id, rows))
            begun, doc_id, rows = begun + 1, line[16:], []
        elif line.startswith("#end document"):
            closed += 1
    if rows:
        out.append((begun, doc_id, rows))
    return out


def _rows(docs: tuple[list[str], ...]) -> pa.Array:
    """Rows of documents as lists of row_idx and cols, which are cut as ``documents`` does."""
    lines = pa.array([x for rows in docs for x in rows], pa.string())
    first = np.cumsum([0, *map(len, docs)])
    idx = np.arange(len(lines)) - np.repeat(first[:-1], np.diff(first))
    cols = pc.split_pattern_regex(lines, "[ \\t\\n\\x0b\\f\\r]+")
    cols = pc.if_else(pc.equal(lines, ""), pa.scalar([], cols.type), cols)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(idx.astype(np.int32)), cols], names=["row_idx", "cols"]))


def words(docs: DataFrame, k: int) -> DataFrame:
    """``column`` of ``documents_of``, as file, doc_no, doc_id and ``words``: the k-th column of the rows that have it, in their order and joined by
    one space. Documents without such a row are left out."""
    found = F.transform(F.filter("rows", lambda r: F.size(r.cols) > k), lambda r: F.struct(r.row_idx.alias("row_idx"), r.cols[k].alias("word")))
    found = docs.select("file", "doc_no", "doc_id", F.sort_array(found).alias("words")).where(F.size("words") > 0)
    return found.withColumn("words", F.array_join(F.transform("words", lambda x: x.word), " "))


def scan(spark: SparkSession, path: str, split: int = files.SPLIT) -> DataFrame:
    """file, doc_no, doc_id, row_idx, cols like ``documents``, by the data source of CoNLL files: splits of any size and no windows.
    doc_no is the byte at which the document begins."""
    return files.read(spark, "conll", path, split=split).withColumnRenamed("at", "doc_no")


def latest(docs: DataFrame) -> DataFrame:
    """Of the documents of a file that have the same id only the last one."""
    last = docs.groupBy("file", "doc_id").agg(F.max("doc_no").alias("doc_no"))
    return docs.join(last, ["file", "doc_id", "doc_no"], "left_semi")


def column(docs: DataFrame, k: int) -> DataFrame:
    """The k-th column of rows that have it."""
    return docs.where(F.size("cols") > k).select("file", "doc_no", "doc_id", "row_idx", F.col("cols")[k].alias("word"))


def text(docs: DataFrame, k: int) -> DataFrame:
    """file, doc_no, doc_id, text: words joined by one space, a line break for a blank row."""
    keys = ["file", "doc_no"]
    w = Window.partitionBy(*keys).orderBy("row_idx")
    blank = F.size("cols") == 0
    glue = F.when(blank | F.coalesce(F.lag(blank).over(w), F.lit(True)), "").otherwise(" ")
    p = docs.select(*keys, "doc_id", "row_idx", F.concat(glue, F.when(blank, "\n").otherwise(F.coalesce(F.col("cols")[k], F.lit("")))).alias("t"))
    return p.groupBy(*keys, "doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "t"))), lambda x: x.t), "").alias("text"))


def mentions(docs: DataFrame, k: int) -> DataFrame:
    """file, doc_no, doc_id, seq, m_start, m_end, entity of the chain brackets in the last column, as places in ``text``; seq is
    the order in which they are closed. A stray bracket costs no other mention (see ``unclosed_brackets`` for them)."""
    keys = ["file", "doc_no"]
    w = Window.partitionBy(*keys).orderBy("row_idx")
    blank = F.size("cols") == 0
    word = F.coalesce(F.col("cols")[k], F.lit(""))
    glue = F.when(blank | F.coalesce(F.lag(blank).over(w), F.lit(True)), 0).otherwise(1)
    size = F.when(blank, 1).otherwise(F.length(word))
    rows = docs.withColumns({"glue": glue, "size": size, "is_word": ~blank}).withColumn("end", F.sum(F.col("glue") + F.col("size")).over(w))
    rows = rows.where("is_word").select(*keys, "doc_id", F.col("row_idx").alias("tok_idx"), F.element_at("cols", -1).alias("coref"), (F.col("end") - F.col("size")).alias("start"), "end")
    spans = parse_coref(rows, keys)
    at = rows.select(*keys, "doc_id", F.col("tok_idx").alias("first_tok"), F.col("start").cast("int").alias("m_start"))
    to = rows.select(*keys, F.col("tok_idx").alias("last_tok"), F.col("end").cast("int").alias("m_end"))
    m = spans.join(at, [*keys, "first_tok"]).join(to, [*keys, "last_tok"])
    order = Window.partitionBy(*keys).orderBy("place", "entity")
    return m.select(*keys, "doc_id", F.row_number().over(order).alias("seq"), "m_start", "m_end", "entity")


def unclosed_brackets(docs: DataFrame) -> DataFrame:
    """file, doc_no, entity, tok_idx, is_open of brackets without a partner."""
    rows = docs.where(F.size("cols") > 0).select("file", "doc_no", F.col("row_idx").alias("tok_idx"), F.element_at("cols", -1).alias("coref"))
    return unclosed(rows, ["file", "doc_no"])


def paired_folders(spark: SparkSession, gold: str, other: str, suffix: str = "conll") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines of gold, lines of other, names without partner): the files of both folders and all below them that have the same
    name, each set as if it were one file; the names are those of ``other`` that gold lacks."""
    a, b = lines(spark, gold, suffix), lines(spark, other, suffix)
    names_a, names_b = a.select("file").distinct(), b.select("file").distinct()
    return a.join(names_b, "file", "left_semi"), b.join(names_a, "file", "left_semi"), names_b.join(names_a, "file", "left_anti")


def concatenated(rows: DataFrame) -> DataFrame:
    """The lines of all files, by name, as those of one file."""
    size = rows.groupBy("file").agg((F.max("line_no") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(size.select("file", before.alias("before")), "file").select(F.lit("all").alias("file"), (F.col("line_no") + F.col("before")).alias("line_no"), "line")


def compare_folders(spark: SparkSession, gold: str, other: str, suffix: str = "conll") -> DataFrame:
    """doc_id, metric and fractions of the coreference scores of the documents that paired files of two folders have."""
    sides = []
    for ann, rows in enumerate(paired_folders(spark, gold, other, suffix)[:2]):
        docs = documents(rows).where(F.size("cols") > 0)
        tokens = docs.select("file", "doc_no", F.col("row_idx").alias("tok_idx"), F.element_at("cols", -1).alias("coref"))
        ids = docs.select("file", "doc_no", "doc_id").distinct()
        spans = parse_coref(tokens, ["file", "doc_no"]).join(ids, ["file", "doc_no"])
        sides.append(spans.select("file", "doc_id", F.lit(ann).alias("ann"), F.lit(0).alias("seq"), F.col("first_tok").alias("m_start"), F.col("last_tok").alias("m_end"), "entity"))
    keys = ["file", "doc_id"]
    return all_scores(nest(sides[0].unionByName(sides[1]), None, keys), keys, other=1)


def to_lines(rows: DataFrame, key: str) -> DataFrame:
    """key and the document's lines from (key, tok_idx, word, coref)."""
    body = rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", F.concat_ws(" ", "word", "coref").alias("l")))), lambda x: x.l), "\n").alias("body"))
    return body.select(key, F.concat(F.lit("#begin document "), F.col(key).cast("string"), F.lit("\n"), "body", F.lit("\n#end document\n")).alias("value"))


def write(rows: DataFrame, key: str, path: str) -> None:
    to_lines(rows, key).select("value").write.text(path)
