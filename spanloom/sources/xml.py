"""Articles with inline marks: reading and writing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.codecs import decode_entities
from ..functions.text import normalize, runs, xml_escape
from ..operators.alignment import move_spans, shift_tables
from ..operators.markup import marked_text
from ..operators.sweep import zip_lists
from . import files


def read(spark: SparkSession, path: str, ann: int = 0) -> tuple[DataFrame, DataFrame]:
    """(articles, mentions) of files of inline-marked articles, in file and document order.

    Files are split between tasks at ends of articles. An article's number is the count of those in earlier blocks of its
    file, from a small table of blocks, and its place in the block, so no text is exchanged for it. An article that the
    file doesn't close goes to its end.
    """
    raw = spark.read.option("lineSep", "</article>").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    is_article = F.col("value").rlike("<article[\\s>]")
    blocks = raw.groupBy("file", "block").agg(F.min("n").alias("n0"), F.count_if(is_article).alias("k"), F.max(F.contains("value", F.lit("<article"))).alias("any"))
    order = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "n0", before.alias("before"), F.max("any").over(Window.partitionBy("file")).alias("any"))
    found = raw.join(blocks, ["file", "block"]).where(is_article | ~F.col("any"))
    xml = F.when(is_article, F.concat(F.regexp_extract("value", "(?s)<article[\\s>].*$", 0), F.lit("</article>"))).otherwise(F.concat(F.lit("<article>"), F.col("value"), F.lit("</article>")))
    return _parse(found.select("file", (F.col("before") + F.col("n") - F.col("n0")).cast("int").alias("doc_idx"), xml.alias("xml")), ann)


def scan(spark: SparkSession, path: str, ann: int = 0, split: int = files.SPLIT) -> tuple[DataFrame, DataFrame]:
    """(articles, mentions) like ``read``, by the data source of article files: splits of any size, of one huge file too, and no pass for
    numbers. An article's doc_idx is the byte at which it begins, which is in the order of its file. A file without articles has
    none."""
    return _parse(_scanned(spark, path, split), ann)


def scan_mentions(spark: SparkSession, path: str, ann: int = 0, split: int = files.SPLIT) -> DataFrame:
    """The mentions of ``scan`` with the doc_id of their article: files are read once, and nothing is joined."""
    art = _parsed(_scanned(spark, path, split), ann, text=False)
    return art.select("ann", "file", "doc_idx", "a.doc_id", F.explode("a.ms").alias("m")).select("ann", "file", "doc_idx", "doc_id", "m.*")


def _scanned(spark: SparkSession, path: str, split: int) -> DataFrame:
    return files.read(spark, "articles", path, split=split).select("file", F.col("at").alias("doc_idx"), "xml")


def parse_string(spark: SparkSession, text: str, ann: int = 0) -> tuple[DataFrame, DataFrame]:
    if "<article" not in text:
        text = f"<article>{text}</article>"
    return parse(spark.createDataFrame([("", text)], "file string, value string"), ann)


_PIECE = re.compile(r"<[^>]+>|[^<]+")
_MARK = re.compile(r"</?mark\b")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*(['\"])(.*?)\2", re.S)
_MAP = T.MapType(T.StringType(), T.StringType())
_MENTION = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("seq", "m_start", "m_end")), T.StructField("entity", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("min_start", "min_end")), T.StructField("info", _MAP)])
_ARTICLE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("info", _MAP), T.StructField("ms", T.ArrayType(_MENTION))])


def _attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag; of repeated names the last."""
    return {m[1]: decode_entities(m[3]) for m in _ATTRIBUTE.finditer(tag)}


def _mark(tag: str) -> tuple[str | None, str | None, list[tuple[str, str]]]:
    """Entity (or annotation), text of the minimal span and further attributes of an opening mark."""
    info = _attributes(tag)
    return info.get("entity") or info.get("annotation"), info.get("min"), [(k, v) for k, v in info.items() if k not in ("entity", "min")]


def _article(xml: str, marks: dict[str, tuple]) -> tuple[str, str, list[tuple[str, str]], list[tuple]]:
    """doc_id, text, info and mentions (m_start, m_end, entity, min_start, min_end, info) of one article element; ``marks`` has what
    ``_mark`` gave for tags met before, and gets those met here."""
    opened = re.match(r"<article[^>]*>", xml)
    head = _attributes(opened[0]) if opened else {}
    body = re.sub(r"</article>$", "", xml[opened.end() :] if opened else xml)
    out, n, stack, found = [], 0, [], []
    for piece in _PIECE.findall(body):
        if piece[0] != "<":
            t = decode_entities(piece) if "&" in piece else piece
            t = t.lstrip(" \t\n") if not n else t
            out.append(t)
            n += len(t)
        elif (mark := marks.get(piece)) is not None:
            stack.append((n, mark))
        elif piece == "</mark>" or _MARK.match(piece) and not piece.endswith("/>"):
            if not piece.startswith("</"):
                marks[piece] = mark = _mark(piece)
                stack.append((n, mark))
            elif stack:
                start, (entity, least, info) = stack.pop()
                if entity:
                    found.append((start, n, entity, least, info))
    text = "".join(out).rstrip()
    size, ms = len(text), []
    for start, end, entity, least, info in found:
        end = min(end, size)
        start = min(start, end)
        at = text.find(least, start, end) if least else -1
        ms.append((start, end, entity, at if at >= 0 else None, at + len(least) if at >= 0 else None, info))
    return head.get("id", ""), text, [(k, v) for k, v in head.items() if k != "id"], ms


def parse_article(xml: str) -> dict:
    """doc_id, text, info and mentions of one article element. A closing mark belongs to the last open one; marks without an
    entity (or annotation) are dropped, as are other tags, whose text stays, and marks that aren't closed."""
    doc_id, text, info, ms = _article(xml, {})
    return {"doc_id": doc_id, "text": text, "info": info, "ms": [{"seq": i + 1, **dict(zip(_MENTION.names[1:], m))} for i, m in enumerate(ms)]}


def _offsets(lists: list[list]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32))


def _maps(infos: list[list[tuple[str, str]]]) -> pa.Array:
    pairs = [x for info in infos for x in info]
    return pa.MapArray.from_arrays(_offsets(infos), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))


def parse_articles(xmls: list[str], text: bool = True) -> pa.Array:
    """``parse_article`` of each element, made by columns; without ``text`` only doc_id and ms."""
    marks: dict[str, tuple] = {}
    ids, texts, infos, listed = [], [], [], []
    for x in xmls:
        doc_id, t, info, ms = _article(x, marks)
        ids.append(doc_id)
        listed.append(ms)
        if text:
            texts.append(t)
            infos.append(info)
    start, end, entity, least, least_end, info = zip(*m) if (m := [x for ms in listed for x in ms]) else ((),) * 6
    offsets = _offsets(listed)
    seq = np.arange(1, len(start) + 1) - np.repeat(offsets.to_numpy()[:-1], np.diff(offsets.to_numpy()))
    places = [pa.array(c, pa.int32()) for c in (seq.astype(np.int32), start, end, least, least_end)]
    mentions = pa.StructArray.from_arrays([*places[:3], pa.array(entity, pa.string()), *places[3:], _maps(info)], fields=list(to_arrow_type(_MENTION)))
    columns = {"doc_id": pa.array(ids, pa.string()), "ms": pa.ListArray.from_arrays(offsets, mentions)}
    if text:
        columns |= {"text": pa.array(texts, pa.string()), "info": _maps(infos)}
    fields = [f for f in to_arrow_type(_ARTICLE) if f.name in columns]
    return pa.StructArray.from_arrays([columns[f.name] for f in fields], fields=fields)


def parse(raw: DataFrame, ann: int) -> tuple[DataFrame, DataFrame]:
    """(articles, mentions) of texts (file, value) that each hold a whole file; one without an article tag is one article."""
    found = F.regexp_extract_all("value", F.lit("(?s)<article[\\s>].*?</article>"), F.lit(0))
    whole = F.array(F.concat(F.lit("<article>"), F.col("value"), F.lit("</article>")))
    return _parse(raw.select("file", F.posexplode(F.when(F.col("value").contains("<article"), found).otherwise(whole)).alias("doc_idx", "xml")), ann)


def _parsed(art: DataFrame, ann: int, text: bool = True) -> DataFrame:
    """ann, file, doc_idx and ``a``, the article, of articles (file, doc_idx, xml), each read in one pass after its white space was
    normalised; without ``text`` only its doc_id and mentions."""
    src = art.select(F.lit(ann).alias("ann"), "file", "doc_idx", normalize("xml").alias("xml"))
    schema = T.StructType([*src.schema.fields[:3], T.StructField("a", _ARTICLE if text else T.StructType([_ARTICLE["doc_id"], _ARTICLE["ms"]]))])

    def run(batches):
        for b in batches:
            for a, z in runs(b.column(3)):
                yield pa.RecordBatch.from_arrays([*(c[a:z] for c in b.columns[:3]), parse_articles(b.column(3)[a:z].to_pylist(), text)], names=schema.names)

    return src.mapInArrow(run, schema)


def _parse(art: DataFrame, ann: int) -> tuple[DataFrame, DataFrame]:
    """Normalise the white space of articles (file, doc_idx, xml), cut tags from text and turn marks into character spans,
    each article in one pass. Spans are clamped to the trimmed text; seq is the closing order. info has the other
    attributes of articles (without id) and marks (without entity and min)."""
    art = _parsed(art, ann)
    articles = art.select("ann", "file", "doc_idx", "a.doc_id", "a.text", "a.info")
    return articles, art.select("ann", "file", "doc_idx", F.explode("a.ms").alias("m")).select("ann", "file", "doc_idx", "m.*")


def lines(articles: DataFrame, mentions: DataFrame, key: str = "doc_idx") -> DataFrame:
    """key and ``value``, each article as text with its marks (with their minimal spans and attributes) and its attributes."""
    marked = marked_text(articles, mentions, key).join(articles, key)
    more = F.lit("")
    if "info" in articles.columns:
        more = F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda x: F.concat(F.lit(" "), x.key, F.lit("='"), xml_escape(x.value), F.lit("'"))), ""), F.lit(""))
    return marked.select(key, F.concat(F.lit("<article id='"), xml_escape("doc_id"), F.lit("'"), more, F.lit(">"), "marked", F.lit("</article>")).alias("value"))


def write_files(articles: DataFrame, mentions: DataFrame, path: str, key: str = "doc_idx", mode: str = "append") -> None:
    """Article files, each complete, without any order among the articles (see ``files``)."""
    files.write(lines(articles, mentions, key), "articles", path, mode)


def write(articles: DataFrame, mentions: DataFrame, path: str, key: str = "doc_idx") -> None:
    """One article per line between the head and foot lines of the format."""
    body = lines(articles, mentions, key).select(F.col(key).cast("long").alias("o"), "value")
    spark = articles.sparkSession
    ends = spark.createDataFrame([(-1, "<?xml version='1.0' encoding='UTF-8' ?>\n<articles>"), (1 << 62, "</articles>")], "o long, value string")
    body.unionByName(ends).orderBy("o").select("value").write.text(path)


def rewrite(spark: SparkSession, source: str, target: str, path: str) -> None:
    """Write the target's texts with the source's mentions moved to where their text is there. Articles are paired by place
    as far as both files go; minimal spans are not moved, and mentions that have no place are left out."""
    (a, m), (b, _) = read(spark, source), read(spark, target)
    pairs = zip_lists(a, b, "doc_idx").select("doc_idx", F.col("l.text").alias("a"), F.col("r.text").alias("b"))
    moved = move_spans(m.join(shift_tables(pairs, "a", "b").select("doc_idx", "shifts"), "doc_idx"))
    moved = moved.select("doc_idx", "seq", F.col("a_start").alias("m_start"), F.col("a_end").alias("m_end"), "entity", "info")
    write(b.join(pairs.select("doc_idx"), "doc_idx"), moved, path)
