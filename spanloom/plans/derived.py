"""Annotations derived from the documents table by rule, for queries over tables that carry none.

Annotator 0: tokens of 6 or more characters, entity = their first two characters in lower case; and from every seventh
token a phrase to the token two further on, entity P0 to P4. Annotator 1 leaves out every eleventh token, shortens every
fourth entity and has every other phrase. Annotator 2 takes tokens of 5 or more characters and no phrases.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import tokenized, tokens
from ..operators.sweep import MENTION, Texts, flat

KEYS = ["doc_id"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Tables of at most this many bytes are dealt out; larger ones have row groups enough for all cores.
SMALL = 256 << 20


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text. A small table in fewer files than there are cores is dealt out to all of them, since all its rows may
    lie in one row group, which only one task can read."""
    docs = table(spark, d, "documents")
    cores = spark.sparkContext.defaultParallelism
    few = len(docs.inputFiles()) < cores and int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    docs = docs.select("doc_id", "text")
    return docs.repartition(2 * cores) if few else docs


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; only a local session without it gets one made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanloom-")
    return f"{base.rstrip('/')}/spanloom/{tag}-{uuid.uuid4().hex}"


def derived_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(documents(spark, d))


def _made(texts: pa.Array, annotators: int) -> tuple[pa.Array, pa.Array]:
    toks = tokenized(texts)
    return toks, _annotate(toks, annotators)


def _annotate(toks: pa.Array, annotators: int) -> pa.Array:
    """The mentions of the first annotators of each text, by its tokens in order."""
    count = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
    first = np.cumsum(count) - count
    start, end, word = toks.flatten().flatten()
    start, end = start.to_numpy(), end.to_numpy()
    i = np.arange(len(start)) - np.repeat(first, count)
    n = pc.utf8_length(word).to_numpy()
    far = i + 2 < np.repeat(count, count)
    phrase_end = np.where(far, end[np.minimum(np.arange(len(end)) + 2, len(end) - 1)] if len(end) else end, 0)
    picked = np.stack([n >= 6, (i % 7 == 0) & far, (n >= 6) & (i % 11 != 0), (i % 14 == 0) & far, n >= 5][: (0, 2, 4, 5)[annotators]], axis=1)
    at, kind = np.nonzero(picked)
    phrase = (kind == 1) | (kind == 3)
    lower = [pc.utf8_lower(pc.utf8_slice_codeunits(word, 0, k)) for k in (2, 1)]
    names = pa.concat_arrays([*lower, pa.array([f"P{x}" for x in range(5)])])
    which = np.where(phrase, 2 * len(word) + i[at] % 5, np.where((kind == 2) & (i[at] % 4 == 0), len(word) + at, at))
    columns = [np.array([0, 0, 1, 1, 2])[kind], i[at] + np.where(phrase, 1000000, 0), start[at], np.where(phrase, phrase_end[at], end[at])]
    mentions = pa.StructArray.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), names.take(pa.array(which))], list(MENTION))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.append(first, len(i))).astype(np.int32)), mentions)


def nested(spark: SparkSession, d: str, annotators: int = 3) -> Texts:
    """The texts with the tokens and mentions of the first annotators, made where they are used."""
    return Texts(documents(spark, d).where("text is not null"), partial(_made, annotators=annotators))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return flat(nested(spark, d), KEYS)


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TOK = f"""
pc AS (SELECT doc_id, regexp_extract_all(text, '^[A-Za-z0-9]+|[^A-Za-z0-9][A-Za-z0-9]*') AS ps FROM documents),
un AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM pc),
oo AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS off FROM un),
st AS (SELECT doc_id, i, off + length(piece) - length(ltrim(piece, {_WS})) AS tok_start, trim(piece, {_WS}) AS word FROM oo),
tok AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS tok_idx, CAST(tok_start AS INT) AS tok_start, CAST(tok_start + length(word) AS INT) AS tok_end, word FROM st WHERE word <> '')"""
MEN = """
tp AS (SELECT *, lead(tok_end, 2) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS p_end FROM tok),
men AS MATERIALIZED (
  SELECT doc_id, 0 AS ann, tok_idx AS seq, tok_start AS m_start, tok_end AS m_end, lower(left(word, 2)) AS entity FROM tp WHERE length(word) >= 6
  UNION ALL SELECT doc_id, 0, tok_idx + 1000000, tok_start, p_end, 'P' || (tok_idx % 5) FROM tp WHERE tok_idx % 7 = 0 AND p_end IS NOT NULL
  UNION ALL SELECT doc_id, 1, tok_idx, tok_start, tok_end, CASE WHEN tok_idx % 4 = 0 THEN lower(left(word, 1)) ELSE lower(left(word, 2)) END FROM tp WHERE length(word) >= 6 AND tok_idx % 11 <> 0
  UNION ALL SELECT doc_id, 1, tok_idx + 1000000, tok_start, p_end, 'P' || (tok_idx % 5) FROM tp WHERE tok_idx % 14 = 0 AND p_end IS NOT NULL
  UNION ALL SELECT doc_id, 2, tok_idx, tok_start, tok_end, lower(left(word, 2)) FROM tp WHERE length(word) >= 5)"""
SEG = """
bd AS (SELECT doc_id, m_start AS e FROM men UNION SELECT doc_id, m_end FROM men UNION SELECT doc_id, length(text) FROM documents WHERE text IS NOT NULL),
seg AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS seg_idx, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS s, e FROM bd)"""


def met(first: str) -> str:
    """The bucketed range join of segments and mentions as a table expression ``mt``."""
    return f"""
sb AS (SELECT *, e // 128 AS b FROM seg),
mb AS (SELECT *, unnest(range(m_start // 128, m_end // 128 + 1)) AS b FROM men),
mt AS MATERIALIZED (SELECT sb.doc_id, seg_idx, s, e, ann, seq, m_start, m_end, entity FROM sb JOIN mb ON sb.doc_id = mb.doc_id AND sb.b = mb.b AND m_start {first} e AND m_end >= e)"""


PRI = met("<") + """,
pri AS MATERIALIZED (SELECT doc_id, seg_idx, any_value(s) AS s, any_value(e) AS e, ann, arg_max(entity, m_start::HUGEINT * 100000000000000 + (10000000 - m_end)::HUGEINT * 10000000 + seq) AS entity FROM mt GROUP BY doc_id, seg_idx, ann),
wide AS MATERIALIZED (SELECT doc_id, seg_idx, max(entity) FILTER (ann = 0) AS p0, max(entity) FILTER (ann = 1) AS p1, max(entity) FILTER (ann = 2) AS p2 FROM pri GROUP BY ALL)"""
EVAL = "CASE WHEN {g} IS NULL AND {o} IS NULL THEN '' WHEN {o} IS NULL THEN 'missing' WHEN {g} IS NULL THEN 'toomuch' WHEN {g} = {o} THEN 'correct' ELSE 'wrong' END"
MRK = f"""
l1 AS MATERIALIZED (SELECT seg.*, p0, p1, p2, {EVAL.format(g='p0', o='p1')} AS e1, {EVAL.format(g='p0', o='p2')} AS e2 FROM seg LEFT JOIN wide USING (doc_id, seg_idx)),
mrk AS (SELECT doc_id, seg_idx, s, e, 1 AS ann, p0 AS gold_entity, p1 AS entity, e1 AS eval, e1 <> e2 AS split FROM l1 UNION ALL SELECT doc_id, seg_idx, s, e, 2, p0, p2, e2, e1 <> e2 FROM l1)"""


def sql(final: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + final
