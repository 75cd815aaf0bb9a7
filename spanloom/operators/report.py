"""The comparison of annotators as XML, and tables for people to read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import resources
from ..functions.text import xml_escape
from . import scores as sc
from . import sweep
from .markup import _ESCAPES, Escaped, joined


#: Further columns of the texts: (ann, entity, label, short) of each entity, and (ann, seq, info) of each mention with attributes.
_NAMES = "array<struct<ann:int,entity:string,label:string,short:string>>"
_INFO = "array<struct<ann:int,seq:int,info:map<string,string>>>"


def _escaped(s: str) -> str:
    return s.translate(_ESCAPES)


def _written(texts: pa.Array, x: sweep.Layout, known: np.ndarray, gold: int, hidden: tuple[str, ...], line_breaks: bool, names: list | None, info: list | None) -> pa.Array:
    """The contents of the texts of a layout, made by columns: a segment is its head, what it says and its foot. Without ``names``
    an entity, escaped, is its own label, and is its short name."""
    best, label, before, open_before, ends, listed = x.cells(known, gold, hidden)
    order = [*np.flatnonzero(known == gold), *np.flatnonzero(known != gold)]
    entity = x.entity.dictionary_encode()
    entities = entity.dictionary.to_pylist()
    longest = np.array([*map(len, entities), 0], np.int64)
    # the place at the end is that of no mention
    code = np.append(pc.fill_null(entity.indices, -1).to_numpy().astype(np.int64), -1)[best]
    marked = np.flatnonzero((code >= 0).any(axis=1))
    code, best, label, doc = code[marked], best[marked], label[marked], x.doc[marked]
    width = (x.e - x.s)[marked] + 5
    split = (label[:, order[1:]] != label[:, order[1:2]]).any(axis=1)
    named = None if names is None else [{(n["ann"], n["entity"]): (n["label"], n["short"]) for n in of or ()} for of in names]

    def shown(j: int, suffix: str) -> pa.Array:
        """Entity and short name, made once for all segments that show the same."""
        whose, cut = (np.zeros(len(code), np.int64), np.minimum(width, longest[code[:, j]])) if named is None else (doc, width)
        keys, back = _distinct(whose, code[:, j], cut)
        out = []
        for d, c, w in zip(*(k.tolist() for k in keys)):
            name, short = (None, None) if c < 0 else (_escaped(entities[c]), entities[c]) if named is None else named[d].get((known[j], entities[c]), (None, None))
            entity = "" if name is None else f" entity{suffix}='{_escaped(name)}'"
            # the short name, cut to five characters more than the segment has; [none] where there is no name
            short = "[none]" if short is None else _escaped(short[:w] + "…" if len(short) > w else short)
            out.append(f"{entity} short{suffix}='{short}'")
        return pa.array(out, pa.string()).take(pa.array(back))

    def chains(name: str, times: np.ndarray, some: np.ndarray, bracket: str) -> pa.Array:
        """An attribute of so many brackets, only where a mention of the annotator is open."""
        found, back = np.unique(np.where(some, times, -1)[marked], return_inverse=True)
        return pa.array(["" if n < 0 else f" {name}='{bracket * n}'" for n in found.tolist()], pa.string()).take(pa.array(back))

    heads = [pa.array(["<mark split='false'", "<mark split='true'"]).take(pa.array(split.astype(np.int8)))]
    further = None if info is None else _further(x, info)
    for j in order:
        is_gold = known[j] == gold
        suffix = str(gold) if is_gold else ""
        heads += ["" if is_gold else f"<annotator index='{known[j]}'", shown(j, suffix)]
        if not is_gold:
            heads.append(pa.array([f" eval='{v}'" for v in sweep.LABELS]).take(pa.array(label[:, j])))
            if further is not None:
                heads.append(further.take(pa.array(np.where(best[:, j] >= 0, best[:, j], len(further) - 1))))
        heads += [chains(f"chain-before{suffix}", before[:, j], open_before[:, j], "("), chains(f"chain-after{suffix}", ends[:, j], listed[:, j], ")"), ">" if is_gold else "/>\n"]
    head = pc.binary_join_element_wise(*heads, "")

    escaped = Escaped(texts)
    size = np.diff(escaped.first)
    alone = np.setdiff1d(np.arange(len(texts)), x.doc)  # texts without segments
    of = np.concatenate([x.doc, alone])
    by = np.argsort(of, kind="stable")
    of = of[by]
    places = np.stack([np.append(x.s, np.zeros(len(alone), np.int64)), np.append(x.e, size[alone])], axis=1)[by]
    places = (np.minimum(places, size[of][:, None]) + escaped.first[of][:, None]).ravel()
    said = escaped.between(np.append(places, places[-1:])).take(pa.array(np.arange(len(of)) * 2)) if len(of) else pa.array([], pa.string())
    if line_breaks:
        broken = said
        for feeds in ("\n\n\n", "\n\n", "\n"):
            broken = pc.replace_substring(broken, feeds, "<br/>")
        said = pc.if_else(pa.array(by < len(x.doc)), broken, said)  # line feeds stay in texts without segments
    which = np.full(len(x.doc) + len(alone), len(marked))
    which[marked] = np.arange(len(marked))
    which = which[by]
    head = pa.concat_arrays([head, pa.array([""])]).take(pa.array(which))
    foot = pa.array(["", "</mark>\n"]).take(pa.array((which < len(marked)).astype(np.int8)))
    return joined([head, said, foot], np.searchsorted(of, np.arange(len(texts) + 1)), pc.fill_null(texts, ""))


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns, and where each row is among them."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return [c[new] for c in columns], back


def _further(x: sweep.Layout, info: list) -> pa.Array:
    """The further attributes of each mention, and none at the end."""
    given = [{(n["ann"], n["seq"]): n["info"] for n in of or ()} for of in info]
    out = ["".join(f" {k}='{_escaped(v)}'" for k, v in sorted(given[d].get((a, s)) or ()) if v is not None) for d, a, s in zip(x.mention_doc.tolist(), x.ann.tolist(), x.seq.tolist())]
    return pa.array([*out, ""], pa.string())


def contents(docs: DataFrame | None, nested: DataFrame | sweep.Texts, names: DataFrame | None, annotators: list[int], keys: list[str], gold: int = 0, line_breaks: bool = False, info: DataFrame | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """keys and ``content``: the segments of a text in order, those with an entity as marks.

    ``docs`` has keys and text, ``nested`` the mentions (see ``sweep.nest``), ``names`` keys, ann, entity, label and short,
    ``info`` (if given) keys, ann, seq and a map of further attributes. A document without mentions gets its escaped text;
    a null text is empty. With ``line_breaks`` up to three line feeds become a break. Without ``names`` an entity, escaped, is its own
    label, and is its short name. Names, attributes and mentions are brought to their text, and it is written where they meet; segments
    are never rows. ``Texts`` need no docs and, without names and info, no exchange.
    """
    known = np.array(sorted({gold, *annotators}))
    more = {}
    if names is not None:
        more["names"] = names.groupBy(*keys).agg(F.collect_list(F.struct("ann", "entity", "label", "short")).cast(_NAMES).alias("names"))
    if info is not None:
        more["info"] = info.groupBy(*keys).agg(F.collect_list(F.struct("ann", "seq", "info")).cast(_INFO).alias("info"))
    if not isinstance(nested, sweep.Texts):
        nested = docs.select(*keys, "text").join(nested.select(*keys, "n_chars", "ms"), keys, "left")
        for x in more.values():
            nested = nested.join(x, keys, "left")
    elif more:
        raise ValueError("names and info are given with mentions as rows")
    src, cut = sweep.source(nested, keys, ("text", "n_chars", "ms", *more))
    schema = T.StructType([*(src.schema[x] for x in keys), T.StructField("content", T.StringType())])

    def run(batches):
        for b in batches:
            for own, x in cut(b):
                count = sweep.sizes(x["ms"])
                layout = sweep.Layout(pc.fill_null(x["n_chars"], -1).to_numpy().astype(np.int64), count, x["ms"].flatten().flatten())
                written = _written(x["text"], layout, known, gold, hidden, line_breaks, *(x[c].to_pylist() if c in x else None for c in ("names", "info")))
                yield pa.RecordBatch.from_arrays([*own, pc.binary_join_element_wise("<content>", written, "</content>", "")], names=schema.names)

    return src.mapInArrow(run, schema)


def entity_lists(names: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``entities``: the escaped entities of a document, by name."""
    one = F.transform(F.array_sort(F.collect_set("entity")), lambda x: F.concat(F.lit("<entry>"), xml_escape(x), F.lit("</entry>\n")))
    return names.groupBy(*keys).agg(F.concat(F.lit("<entity-list>\n"), F.array_join(one, ""), F.lit("</entity-list>\n")).alias("entities"))


def metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``metrics``: recall and precision of every metric by annotator, from (keys, ann, metric, fractions)."""
    line = F.concat(F.lit("    <metric name='"), xml_escape("metric"), F.lit("' recall='"), sc.value(F.col("r_nom"), F.col("r_den")).cast("float").cast("string"), F.lit("' precision='"), sc.value(F.col("p_nom"), F.col("p_den")).cast("float").cast("string"), F.lit("'/>\n"))

    def joined(c):
        return F.array_join(F.transform(F.array_sort(c), lambda x: x.line), "")

    by = scores.groupBy(*keys, "ann").agg(joined(F.collect_list(F.struct("metric", line.alias("line")))).alias("lines"))
    block = F.concat(F.lit("<annotator id='"), F.col("ann").cast("string"), F.lit("'>\n"), F.col("lines"), F.lit("</annotator>\n"))
    return by.groupBy(*keys).agg(F.concat(F.lit("<metrics>\n"), joined(F.collect_list(F.struct("ann", block.alias("line")))), F.lit("</metrics>\n")).alias("metrics"))


def annotators(names: list[str]) -> str:
    """The list of the compared files."""
    lines = "".join(f"\t<annotator id='{i}' file='{name.translate(_ESCAPES)}'/>\n" for i, name in enumerate(names))
    return f"<annotators>\n{lines}</annotators>\n"


#: The report around its articles.
TEMPLATE = resources.read("report.xml")


def fill(template: str, article: Column) -> Column:
    """The template with the article in the place of its article tag."""
    return F.replace(F.lit(template), F.lit("<article/>"), article)


def format_table(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``order`` and ``line``: the columns, each as wide as its longest value and one blank more; nulls are empty."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    width = rows.agg(*[F.coalesce(F.max(F.length(x)), F.lit(0)).alias(f"__{c}") for c, x in text.items()])
    padded = [F.concat(x, F.repeat(F.lit(" "), F.col(f"__{c}") + 1 - F.length(x))) for c, x in text.items()]
    return rows.crossJoin(F.broadcast(width)).select(order, F.concat(*padded).alias("line"))
