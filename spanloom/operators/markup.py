"""Tag matching, marked text, and token tables with chain brackets."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import in_runs, runs, xml_escape
from .sweep import MENTION, Texts, sizes, source


def pair_tags(tags: DataFrame, keys: list[str]) -> DataFrame:
    """Opening and closing tags (keys, n, is_open and any more columns) with ``partner``, the n of the other tag of the pair, and
    ``depth``, how many tags are open from the opening to the closing one, itself and those that are never closed included.

    A closing tag belongs to the last tag open before it, as on a stack. One that meets no open tag is stray: it has neither partner nor depth,
    and later tags are matched as if it weren't there. A tag that is never closed has no partner. The height of the
    stack is the running sum of +1 and -1 above its running minimum (or 0); within one depth, tags without the stray ones then take turns
    between opening and closing, so a tag's neighbour there is its partner. Both passes sort within the keys, and nothing is joined.
    """
    w = Window.partitionBy(*keys).orderBy("n")
    level = F.sum(F.when(F.col("is_open"), 1).otherwise(-1)).over(w)
    t = tags.withColumn("level", level).withColumn("floor", F.least(F.lit(0), F.min("level").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    after = F.col("level") - F.col("floor")  # the height, below 0 at a stray tag
    t = t.withColumn("depth", F.when(F.col("is_open"), after).when(after >= 0, after + 1))
    beside = Window.partitionBy(*keys, "depth").orderBy("n")
    partner = F.when(F.col("is_open"), F.lead("n").over(beside)).otherwise(F.lag("n").over(beside))
    return t.withColumn("partner", F.when(F.col("depth").isNotNull(), partner)).drop("level", "floor")


def match_tags(tags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, depth, open_n, close_n of the pairs of ``pair_tags``."""
    return pair_tags(tags, keys).where("not is_open and partner is not null").select(*keys, "depth", F.col("partner").alias("open_n"), F.col("n").alias("close_n"))


_ESCAPES = {**{n: None for n in (*range(9), 11, 12, *range(14, 32))}, **{ord(k): v for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\"", "&quot;"), ("'", "&apos;"))}}
_DROPPED = bytes(k for k, v in _ESCAPES.items() if v is None)
_WIDTH = np.array([len(_ESCAPES[k] or "") if k in _ESCAPES else 1 for k in range(256)], np.int64)


class Escaped:
    """The texts of a run, escaped as one string of bytes that is cut at places in characters; null ones are empty. Places are counted
    over all texts: text d begins at ``first[d]``."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
        first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2].to_pybytes()[first[0] : first[-1]] if first[-1] > first[0] else b""
        raw = np.frombuffer(data, np.uint8)
        begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        self.first = np.searchsorted(begins, first - first[0])
        self._at = np.concatenate([[0], np.cumsum(_WIDTH[raw])])[begins]
        data = data.translate(None, _DROPPED)
        for k, v in _ESCAPES.items():  # the ampersand before those that the others bring
            if v is not None:
                data = data.replace(bytes([k]), v.encode())
        self._data = data

    def between(self, places: np.ndarray) -> pa.Array:
        """What stands between each two of ascending places."""
        at = self._at[places]
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(self._data)])


def joined(columns: list[pa.Array], first: np.ndarray, texts: pa.Array) -> pa.Array:
    """The rows of columns of strings one after the other as one string from each place of ``first`` to the next; null where a text is."""
    k, n = len(columns), len(columns[0])
    parts = pa.concat_arrays([c.cast(pa.large_string()) for c in columns]).take(pa.array((np.arange(n)[:, None] + np.arange(k) * n).ravel()))
    offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset + k * first] if n else np.zeros(len(first), np.int64)
    out = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets), parts.buffers()[2] or pa.py_buffer(b"")]).cast(pa.string())
    return pc.if_else(texts.is_valid(), out, None) if texts.null_count else out


_MARK = pa.list_(pa.struct([("seq", pa.int32()), ("m_start", pa.int32()), ("m_end", pa.int32()), ("tag", pa.string())]))


@F.arrow_udf(T.StringType())
def _insert_marks(texts: pa.Array, marks: pa.Array) -> pa.Array:
    return in_runs(lambda t, m: _marked(t, sizes(m), *m.flatten().flatten()), texts, marks.cast(_MARK))


def _marked(texts: pa.Array, count: np.ndarray, *columns: pa.Array) -> pa.Array:
    """The escaped texts with each mark's tag at its start and a closing tag at its end, in span order; marks that reach out
    of a text are left out. Columns: seq, m_start, m_end and tag of the marks of all texts, of which each has ``count``."""
    *places, tags = columns
    seq, start, end = (x.to_numpy().astype(np.int64) for x in places)
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    kept = np.flatnonzero((start >= 0) & (start <= end) & (end <= length[doc]))
    doc, seq, start, end = doc[kept], seq[kept], start[kept], end[kept]
    n = len(doc)
    pos, kind = np.concatenate([end, start]), np.repeat([0, 1], n)
    order = np.lexsort((np.concatenate([-seq, seq]), np.concatenate([end, -end]), np.concatenate([-start, start]), kind, pos, np.concatenate([doc, doc])))
    # a text is what stands before each tag and the tag, in turn, and what stands after the last one
    escaped = Escaped(texts)
    of = np.concatenate([doc, doc])[order]
    last = np.searchsorted(of, np.arange(len(count)), "right")
    said = escaped.between(np.append(0, np.insert(escaped.first[of] + pos[order], last, escaped.first[1:])))
    which = np.concatenate([np.full(n, len(tags)), kept])[order]
    tag = pa.concat_arrays([tags, pa.array(["</mark>", ""])]).take(pa.array(np.insert(which, last, len(tags) + 1)))
    return joined([said, tag], np.append(0, last + np.arange(1, len(count) + 1)), texts)


def mark_tag(entity: Column, minimal: Column | None = None, info: Column | None = None) -> Column:
    """The opening tag of a mark: entity (without angle brackets around it), the minimal span's text where there is one, and
    further attributes by name."""
    out = F.concat(F.lit("<mark entity='"), xml_escape(F.regexp_replace(entity, "^<(.*)>$", "$1")), F.lit("'"))
    if minimal is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit(" min='"), xml_escape(minimal), F.lit("'")), F.lit("")))
    if info is not None:
        pairs = F.transform(F.array_sort(F.map_entries(info)), lambda x: F.concat(F.lit(" "), x.key, F.lit("='"), xml_escape(x.value), F.lit("'")))
        out = F.concat(out, F.coalesce(F.array_join(pairs, ""), F.lit("")))
    return F.concat(out, F.lit(">"))


#: As in ``mark_tag``: no line may end between the brackets, but one may after them.
_BRACKETED = re.compile("^<([^\\n\\r\\x85\\u2028\\u2029]*)>(?=(?:\\r\\n|[\\n\\r\\x85\\u2028\\u2029])?\\Z)")


def mark_nested(nested: DataFrame | Texts, key: str) -> DataFrame:
    """key and ``marked``, the text with a mark element around every mention of ``ms`` (see ``marked_text``)."""
    src, cut = source(nested, [key], ("text", "ms"))
    schema = T.StructType([src.schema[key], T.StructField("marked", T.StringType())])

    def run(batches):
        for b in batches:
            for own, x in cut(b):
                _, *places, entity = x["ms"].flatten().flatten()
                names = entity.dictionary_encode()
                tags = pa.array([f"<mark entity='{_BRACKETED.sub(lambda m: m[1], e).translate(_ESCAPES)}'>" for e in names.dictionary.to_pylist()], pa.string()).take(names.indices)
                yield pa.RecordBatch.from_arrays([*own, _marked(x["text"], sizes(x["ms"]), *places, tags)], names=schema.names).filter(x["text"].is_valid())

    return src.mapInArrow(run, schema)


def marked_text(docs: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """key and the text with a mark element around every mention, in span order; text pieces are escaped. Minimal spans
    (min_start, min_end) and attributes (info, a map) of mentions are written if they have such columns. The mentions are brought
    to their text, not the text to each of them."""
    more = [c for c in ("min_start", "min_end", "info") if c in mentions.columns]
    listed = mentions.select(key, F.struct("seq", "m_start", "m_end", "entity", *more).alias("m")).groupBy(key).agg(F.collect_list("m").alias("ms"))

    def mark(m):
        minimal = F.when(m.min_start.isNotNull(), F.substring("text", m.min_start + 1, m.min_end - m.min_start)) if "min_start" in more and "min_end" in more else None
        return F.struct(m.seq.alias("seq"), m.m_start.alias("m_start"), m.m_end.alias("m_end"), mark_tag(m.entity, minimal, m["info"] if "info" in more else None).alias("tag"))

    text = docs.select(key, "text").where("text is not null").join(listed, key, "left")
    return text.select(key, _insert_marks(F.col("text"), F.coalesce(F.transform("ms", mark), F.array())).alias("marked"))


def _bounds(ends: np.ndarray, ends_first: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token that ends after the start, and first that ends at or after the end, by places in ``ends`` (tokens of all
    texts); a text's number of tokens where there is none."""
    token_doc = np.repeat(np.arange(len(ends_first) - 1), np.diff(ends_first))
    width = int(max(ends.max(initial=0), start.max(initial=0), end.max(initial=0))) + 2
    key = token_doc * width + ends
    first = np.minimum(np.searchsorted(key, doc * width + start, "right"), ends_first[doc + 1])
    last = np.minimum(np.searchsorted(key, doc * width + end, "left"), ends_first[doc + 1])
    return first, last


@F.arrow_udf(T.ArrayType(T.StringType()))
def slices(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """What stands between places of a text (arrays); each text is decoded once."""

    def cut(*columns):
        return pa.array([[None if text is None else text[i:k] for i, k in zip(a or (), z or ())] for text, a, z in zip(*(c.to_pylist() for c in columns))], pa.list_(pa.string()))

    return in_runs(cut, texts, starts, ends)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def place_within(texts: pa.Array, starts: pa.Array, ends: pa.Array, parts: pa.Array) -> pa.Array:
    """For each span (starts and ends, arrays) of a text the place where its part (array of strings) first occurs in it; null for
    parts that are null or don't. Each text is decoded once, however many spans it has."""

    def find(*columns):
        out = []
        for text, a, z, part in zip(*(c.to_pylist() for c in columns)):
            at = [None if text is None or p is None else text.find(p, i, k) for i, k, p in zip(a or (), z or (), part or ())]
            out.append([None if x == -1 else x for x in at])
        return pa.array(out, pa.list_(pa.int32()))

    return in_runs(find, texts, starts, ends, parts)


def first_of_part(nested: DataFrame | Texts, keys: list[str], skip: int, length: int) -> DataFrame:
    """keys, ann, seq, m_start, m_end of the mentions, and ``at``, where the ``length`` characters ``skip`` after a mention's start first
    occur in it; null where they don't."""
    src, cut = source(nested, keys, ("text", "ms"))
    names = ("ann", "seq", "m_start", "m_end", "at")
    schema = T.StructType([*(src.schema[x] for x in keys), *(T.StructField(n, T.IntegerType()) for n in names)])

    def run(batches):
        for b in batches:
            for own, x in cut(b):
                ms, count = x["ms"].flatten().flatten()[:4], sizes(x["ms"])
                start, end = ms[2].to_pylist(), ms[3].to_pylist()
                at, m = [], 0
                for text, n in zip(x["text"].to_pylist(), count.tolist()):
                    for i, k in zip(start[m : m + n], end[m : m + n]):
                        at.append(-1 if text is None else text.find(text[i + skip : i + skip + length], i, k))
                    m += n
                at = np.array(at, np.int32)
                take = pa.array(np.repeat(np.arange(len(count)), count))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in own), *ms, pa.array(at, mask=at < 0)], names=schema.names)

    return src.mapInArrow(run, schema)


def token_boundaries(nested: DataFrame, keys: list[str]) -> DataFrame:
    """The mentions of ``ms`` with first_tok (first token that ends after the start) and last_tok (first token that ends at or
    after the end), if the text has such tokens; ``ends`` has the ends of its tokens in order."""
    src, cut = source(nested, keys, ("ends", "ms"))
    columns = {**{c: T.IntegerType() for c in MENTION[:4]}, "entity": T.StringType(), "first_tok": T.IntegerType(), "last_tok": T.IntegerType()}
    schema = T.StructType([*(src.schema[x] for x in keys), *(T.StructField(n, t) for n, t in columns.items())])

    def run(batches):
        for b in batches:
            for own, x in cut(b):
                ends_first = np.concatenate([[0], np.cumsum(sizes(x["ends"]))])
                doc = np.repeat(np.arange(len(x["ms"])), sizes(x["ms"]))
                ms = x["ms"].flatten().flatten()
                first, last = _bounds(x["ends"].flatten().to_numpy().astype(np.int64), ends_first, doc, ms[2].to_numpy().astype(np.int64), ms[3].to_numpy().astype(np.int64))
                ok = pa.array((first < ends_first[doc + 1]) & (last < ends_first[doc + 1]))
                take = pa.array(doc)
                found = [*(c.take(take) for c in own), *ms, *(pa.array((t - ends_first[doc]).astype(np.int32)) for t in (first, last))]
                yield pa.RecordBatch.from_arrays(found, names=schema.names).filter(ok)

    return src.mapInArrow(run, schema)


def nest_tokens(nested: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``nested`` (see ``sweep.nest``) with ``toks``, the tokens of each text in order, and ``ends``, where they end."""
    listed = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tok_idx", "tok_start", "tok_end", "word"))).alias("toks"))
    return nested.join(listed, keys, "left").withColumn("ends", F.transform("toks", lambda t: t.tok_end))


def _coref(toks: pa.Array, mentions: pa.Array) -> pa.Array:
    """The chain brackets of the tokens of all texts."""
    first_of = np.concatenate([[0], np.cumsum(sizes(toks))])
    ms = mentions.flatten().flatten()
    seq, start, end = (ms[i].to_numpy().astype(np.int64) for i in (1, 2, 3))
    doc = np.repeat(np.arange(len(mentions)), sizes(mentions))
    first, last = _bounds(toks.flatten().flatten()[1].to_numpy().astype(np.int64), first_of, doc, start, end)
    ok = (first < first_of[doc + 1]) & (last < first_of[doc + 1])
    order = np.lexsort((seq, -end, start, first))
    order = order[ok[order]]
    if not len(order):
        return pa.array(["-"]).take(pa.array(np.zeros(first_of[-1], np.int64)))
    entity = pc.fill_null(ms[4].dictionary_encode().indices, -1).to_numpy().astype(np.int64) + 1
    doc, first, last, chain = doc[order], first[order], last[order], (doc * (entity.max() + 1) + entity)[order]
    _, met, chain = np.unique(chain, return_index=True, return_inverse=True)  # chains by text and entity, and where each is first met
    number = np.empty(len(met), np.int64)
    number[np.argsort(met)] = np.arange(len(met))
    n = number[chain]  # of all texts' chains by first appearance; a text's own begin with 1
    n = n - np.minimum.reduceat(n, first_in := np.flatnonzero(np.diff(doc, prepend=-1)))[np.searchsorted(first_in, np.arange(len(n)), "right") - 1] + 1
    width = int(n.max()) + 1
    at, ends = np.unique(last * width + n, return_counts=True)
    opened, of, starts = np.unique(first * width + n, return_inverse=True, return_counts=True)
    by = np.argsort(of, kind="stable")
    nth = np.empty(len(of), np.int64)
    nth[by] = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)  # earlier starts of the chain at the token

    def count(where, known, times):
        i = np.minimum(np.searchsorted(known, where), len(known) - 1)
        return np.where(known[i] == where, times[i], 0)

    closed = nth < count(first * width + n, at, ends)
    alone = np.repeat(at, np.maximum(ends - count(at, opened, starts), 0))  # ends that no start has closed, by token and chain
    token = np.concatenate([first, alone // width])
    digits = pa.array(np.concatenate([n, alone % width])).cast(pa.string())
    before = pa.array(["(", ""]).take(pa.array(np.repeat([0, 1], [len(n), len(alone)])))
    after = pa.array([")", ""]).take(pa.array(np.concatenate([np.where(closed, 0, 1), np.zeros(len(alone), np.int64)])))
    place = np.argsort(token, kind="stable")
    items = pc.binary_join_element_wise(before, digits, after, "").take(pa.array(place))
    offsets = np.searchsorted(token[place], np.arange(first_of[-1] + 1)).astype(np.int32)
    cells = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), items), "|")
    return pc.if_else(pa.array(np.diff(offsets) > 0), cells, "-")


def _words(toks: pa.Array) -> pa.Array:
    """The tokens' words as they stand in a table."""
    words = toks.flatten().flatten()[2]
    for a, b in (("(", "-LBR-"), (")", "-RBR-"), ("\n", " ↵ ")):
        words = pc.replace_substring(words, a, b)
    return words


def conll_rows(nested: DataFrame | Texts, keys: list[str]) -> DataFrame:
    """keys, tok_idx, word, coref of the tokens in ``toks``: chain brackets '(n', '(n)', 'n)' joined by '|', '-' without any.
    Chains are numbered by first appearance. Starts come first in span order; a start is closed at once while ends of its
    entity remain there."""
    src, cut = source(nested, keys, ("toks", "ms"))
    schema = T.StructType([*(src.schema[x] for x in keys), T.StructField("tok_idx", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("coref", T.StringType())])

    def run(batches):
        for b in batches:
            for own, x in cut(b):
                size = sizes(x["toks"])
                take = pa.array(np.repeat(np.arange(len(size)), size))
                place = pa.array((np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in own), place, _words(x["toks"]), _coref(x["toks"], x["ms"])], names=schema.names)

    return src.mapInArrow(run, schema)


def conll_texts(nested: DataFrame | Texts, key: str) -> DataFrame:
    """key and ``value``, the whole document as lines, of every text with tokens; like ``sources.conll.to_lines`` of ``conll_rows``, but
    written where the text is."""
    src, cut = source(nested, [key], ("toks", "ms"))
    schema = T.StructType([src.schema[key], T.StructField("value", T.StringType())])

    def run(batches):
        for b in batches:
            for own, x in cut(b):
                lines = pc.binary_join_element_wise(_words(x["toks"]), _coref(x["toks"], x["ms"]), " ")
                first = np.concatenate([[0], np.cumsum(sizes(x["toks"]))])
                body = pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), lines), "\n").to_pylist()
                value = [f"#begin document {k}\n{v}\n#end document\n" if n else None for k, v, n in zip(own[0].to_pylist(), body, np.diff(first).tolist())]
                value = pa.array(value, pa.string())
                yield pa.RecordBatch.from_arrays([*own, value], names=schema.names).filter(value.is_valid())

    return src.mapInArrow(run, schema)


#: Bracket pairs that leave a worker at once.
PAIRS = 20_000


def _listed(c: pa.Array) -> list:
    """``to_pylist``, but by way of numpy where that gives the same."""
    plain = not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_string(c.type))
    return c.to_numpy(zero_copy_only=False).tolist() if plain else c.to_pylist()


def _stacked(rows: DataFrame, keys: list[str], ordered: bool) -> DataFrame:
    """keys, entity, depth, open_tok, open_i, close_tok and close_i of the bracket pairs of coref cells (see ``bracket_pairs``); a bracket
    without a partner has nulls for it, and a stray one no depth.

    Cells pass by document by document. Of what went before only the brackets still open are kept, on a stack for each entity, so a task's
    memory doesn't grow with its rows. ``ordered`` rows already lie so: each document's together in one partition, by tok_idx,
    as ``conll_rows`` writes them. Others are brought to their document and sorted.
    """
    cells = rows.where(F.col("coref").rlike("[()]")).select(*keys, "tok_idx", "coref")
    if not ordered:
        cells = cells.repartition(*keys).sortWithinPartitions(*keys, "tok_idx")
    k, tok = len(keys), cells.schema["tok_idx"].dataType
    columns = {"entity": T.StringType(), "depth": T.LongType(), "open_tok": tok, "open_i": T.IntegerType(), "close_tok": tok, "close_i": T.IntegerType()}
    schema = T.StructType([*(cells.schema[x] for x in keys), *(T.StructField(n, t) for n, t in columns.items())])

    def run(batches):
        doc, open_, out, types = None, {}, [], []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)

        def left():
            return [(*doc, e, j + 1, *at, None, None) for e, stack in open_.items() for j, at in enumerate(stack)]

        for b in batches:
            place = b.schema.field(k).type
            types = [*(b.schema.field(i).type for i in range(k)), pa.string(), pa.int64(), place, pa.int32(), place, pa.int32()]
            for first, end in runs(b.column(k + 1)):
                *own, toks, corefs = (_listed(c[first:end]) for c in b.columns)
                for key, t, cell in zip(zip(*own), toks, corefs):
                    if key != doc:
                        out += left()
                        doc, open_ = key, {}
                    closing = []
                    for i, x in enumerate(cell.split("|")):
                        opens, closes = x[:1] == "(", x[-1:] == ")"
                        if opens or closes:
                            e = x.replace("(", "").replace(")", "")
                            if opens:
                                open_.setdefault(e, []).append((t, i))
                            if closes:
                                closing.append((e, i))
                    for e, i in closing:
                        stack = open_.get(e)
                        if stack:
                            out.append((*key, e, len(stack), *stack.pop(), t, i))
                            if not stack:
                                del open_[e]
                        else:
                            out.append((*key, e, None, None, None, t, i))
                    if len(out) >= PAIRS:
                        yield table()
                        out.clear()
        out += left()
        if out:
            yield table()

    return cells.mapInArrow(run, schema)


def _bracket(end: str, side: int) -> Column:
    """The place of a pair's bracket; null where it has none."""
    return F.when(F.col(f"{end}_i").isNotNull(), F.struct(F.col(f"{end}_tok").alias("tok_idx"), F.lit(side).alias("side"), F.col(f"{end}_i").alias("i")))


def bracket_pairs(rows: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """The chain brackets of coref cells (keys, tok_idx, coref): keys, entity, n (struct of tok_idx, side and place in the cell),
    is_open, and partner and depth as ``pair_tags`` gives them within an entity.

    A cell is a list joined by '|' of '(e' (opens e), 'e)' (closes e) or '(e)' (both); e is any name without brackets. All
    opening brackets of a cell come before its closing ones. Null cells and other items have no bracket. For ``ordered`` see ``_stacked``.
    """
    a, z = _bracket("open", 0), _bracket("close", 1)
    both = F.array(F.struct(a.alias("n"), F.lit(True).alias("is_open"), z.alias("partner")), F.struct(z.alias("n"), F.lit(False).alias("is_open"), a.alias("partner")))
    found = _stacked(rows, keys, ordered).select(*keys, "entity", "depth", F.explode(F.filter(both, lambda x: x.n.isNotNull())).alias("x"))
    return found.select(*keys, "entity", "x.n", "x.is_open", "depth", "x.partner")


def parse_coref(rows: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """keys, entity, first_tok, last_tok and ``place`` (of the closing bracket, whose order is that of mentions) of every bracket pair
    in coref cells; brackets without a partner are left out, and pairs around them are found all the same."""
    pairs = _stacked(rows, keys, ordered).where("open_i is not null and close_i is not null")
    return pairs.select(*keys, "entity", F.col("open_tok").alias("first_tok"), F.col("close_tok").alias("last_tok"), _bracket("close", 1).alias("place"))


def unclosed(rows: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """keys, entity, tok_idx, is_open of every bracket in coref cells that has no partner."""
    alone = _stacked(rows, keys, ordered).where("open_i is null or close_i is null")
    return alone.select(*keys, "entity", F.coalesce("open_tok", "close_tok").alias("tok_idx"), F.col("open_i").isNotNull().alias("is_open"))
