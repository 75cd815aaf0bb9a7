"""The N-way interval sweep: elementary segments, the mentions open in them, and the principal ones.

Mentions: key columns, ann, seq, m_start, m_end, entity. A mention is listed in the segment that ends at e iff
m_start <= e <= m_end; it is a candidate for the principal one iff m_start < e <= m_end.

All of it works on nested texts: a row per text with its keys, n_chars and ``ms``, the array of its mentions. A pass over
these needs no exchange, since boundaries, segments and open mentions of a text are found where the text is, for many
texts at once. ``Texts`` are made in that pass; ``nest`` brings mentions that come as rows to their texts by one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import runs

#: Mentions that are swept at once; a text with more is swept alone.
RUN = 200_000
MENTION = ("ann", "seq", "m_start", "m_end", "entity")
LABELS = ("", "correct", "wrong", "missing", "toomuch")


def rank(prefix: str = "") -> Column:
    """The span order: start, outer before inner, then closing order."""
    return F.struct(F.col(f"{prefix}m_start"), -F.col(f"{prefix}m_end"), F.col(f"{prefix}seq"))


def nest(mentions: DataFrame, lengths: DataFrame | None, keys: list[str]) -> DataFrame:
    """keys, n_chars, ms of every text of ``lengths`` (keys, n_chars), if given, and of every one that has mentions."""
    listed = mentions.groupBy(*keys).agg(F.collect_list(F.struct(*MENTION)).alias("ms"))
    if lengths is None:
        return listed.select(*keys, F.lit(None).cast("int").alias("n_chars"), "ms")
    return lengths.select(*keys, F.col("n_chars").cast("int").alias("n_chars")).join(listed, keys, "full").select(*keys, "n_chars", "ms")


@dataclass(frozen=True)
class Texts:
    """Nested texts whose tokens and mentions are made in the pass that uses them, so many bytes of text at a time: neither Spark's
    rows nor a task ever hold those of a whole batch. ``rows`` has the keys and ``text``; ``make`` gives (tokens, mentions) of an array
    of texts, lists of (tok_start, tok_end, word) and of ``MENTION``."""

    rows: DataFrame
    make: Callable[[pa.Array], tuple[pa.Array, pa.Array]]


_CASTS = {
    "n_chars": lambda: F.col("n_chars").cast("int"), "text": lambda: F.col("text").cast("string"), "ends": lambda: F.col("ends").cast("array<int>"),
    "ms": lambda: F.transform("ms", lambda m: F.struct(*[m[c].cast("string" if c == "entity" else "int").alias(c) for c in MENTION])),
    "toks": lambda: F.transform("toks", lambda t: F.struct(t.tok_start.cast("int").alias("tok_start"), t.tok_end.cast("int").alias("tok_end"), t.word.cast("string").alias("word"))),
}


def source(nested: DataFrame | Texts, keys: list[str], columns: tuple[str, ...]):
    """(a table, and a function that cuts its batches into runs of bounded size: pairs of the keys' columns and the columns wanted, by
    name, which are n_chars, text, ms, toks and ends)."""
    k = len(keys)
    if isinstance(nested, Texts):
        make = nested.make

        def made(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], dict[str, pa.Array]]]:
            for a, z in runs(batch.column(k)):
                text = batch.column(k)[a:z]
                toks, ms = make(text)
                found = {"text": text, "toks": toks, "ms": ms}
                if "n_chars" in columns:
                    found["n_chars"] = pc.utf8_length(text)
                if "ends" in columns:
                    found["ends"] = pa.ListArray.from_arrays(toks.offsets, toks.values.field(1))
                yield [batch.column(i)[a:z] for i in range(k)], found

        return nested.rows.select(*keys, F.col("text").cast("string").alias("text")), made

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], dict[str, pa.Array]]]:
        found = dict(zip(columns, (batch.column(k + i) for i in range(len(columns)))))
        weight = np.zeros(batch.num_rows, np.int64)
        for name, x in found.items():
            if name == "text":
                weight += pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            elif name != "n_chars":
                weight += pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(weight)])
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(first, first[a] + RUN, "right")) - 1)
            yield [batch.column(i)[a:z] for i in range(k)], {name: x[a:z] for name, x in found.items()}
            a = z

    return nested.select(*keys, *[_CASTS[c]().alias(c) if c in _CASTS else F.col(c) for c in columns]), cut


def sizes(lists: pa.Array) -> np.ndarray:
    """How many items each list has; null ones have none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Layout:
    """Texts of a run laid one after the other, their boundaries, and mentions in span order with their first and last one."""

    def __init__(self, n_chars: np.ndarray, count: np.ndarray, columns: list[pa.Array]):
        self.ann, self.seq, self.start, self.end = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:4])
        self.entity = columns[4]
        doc = np.repeat(np.arange(len(count)), count)
        reach = np.maximum(n_chars, -1)
        np.maximum.at(reach, doc, self.end)
        base = np.cumsum(reach + 2) - (reach + 2)
        known = np.flatnonzero(n_chars >= 0)
        self.bound = np.unique(np.concatenate([base[doc] + self.start, base[doc] + self.end, base[known] + n_chars[known]]))
        self.doc = np.searchsorted(base, self.bound, "right") - 1
        first = np.searchsorted(self.doc, np.arange(len(count)))
        self.seg_idx = np.arange(len(self.bound)) - first[self.doc]
        self.e = self.bound - base[self.doc]
        self.s = np.where(self.seg_idx > 0, np.concatenate([[0], self.e[:-1]]), 0)
        self.mention_doc = doc
        self.order = np.lexsort((self.seq, -self.end, self.start, doc))
        self.lo = np.searchsorted(self.bound, (base[doc] + self.start)[self.order])
        self.hi = np.searchsorted(self.bound, (base[doc] + self.end)[self.order])

    def pairs(self, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """(mention, segment) in span order of the mentions, from each one's segment ``skip`` after its start on."""
        n = np.maximum(self.hi - self.lo + 1 - skip, 0)
        ends = np.cumsum(n)
        return np.repeat(self.order, n), np.repeat(self.lo + skip - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)

    def best(self, annotators: np.ndarray, hidden: tuple[str, ...] = ()) -> np.ndarray:
        """The principal mention of each segment and annotator, -1 without one: the last candidate in span order. One with a
        hidden entity counts as none, and no other takes its place.

        A mention stands in a run of segments, and the last one over each segment is wanted. Every run is covered by two stretches
        with a power of two of segments; the last mention of a stretch is handed down to its halves, from the longest
        stretches on, so the work grows with mentions and segments, however long and nested the mentions are.
        """
        out = np.full((len(self.bound), len(annotators)), -1, np.int64)
        ann = self.ann[self.order]
        for j, a in enumerate(annotators):
            on = np.flatnonzero((ann == a) & (self.hi > self.lo))
            if not len(on):
                continue
            lo, hi = self.lo[on] + 1, self.hi[on]
            level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
            last = np.full(len(self.bound), -1, np.int64)
            for k in range(int(level.max()), -1, -1):
                half = 1 << k
                last[half:] = np.maximum(last[half:], last[:-half])  # stretches of twice the length
                here = level == k
                np.maximum.at(last, lo[here], on[here])
                np.maximum.at(last, hi[here] - half + 1, on[here])
            out[:, j] = np.where(last >= 0, self.order[last], -1)
        if hidden:
            out[np.append(pc.fill_null(pc.is_in(self.entity, value_set=pa.array(hidden)), False).to_numpy(zero_copy_only=False), False)[out]] = -1
        return out


    def cells(self, known: np.ndarray, gold: int, hidden: tuple[str, ...] = ()) -> tuple[np.ndarray, ...]:
        """By segment and annotator (of ``known``, ascending): the principal mention (-1 without one), its label against gold, and how
        many mentions start and end here, each followed by whether any mention is listed."""
        n = len(known)
        at_gold = int(np.searchsorted(known, gold))
        best = self.best(known, hidden)
        codes = self.entity.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        code = np.where(best >= 0, codes[best], -1) if len(codes) else np.full(best.shape, -1)
        g = code[:, [at_gold]]
        label = np.where(code < 0, np.where(g < 0, 0, 3), np.where(g < 0, 4, np.where(code == g, 1, 2)))
        label[:, at_gold] = 0
        place = np.minimum(np.searchsorted(known, self.ann), n - 1)
        ours = known[place] == self.ann

        def counted(bound, mention):
            ok = ours[mention]
            return np.bincount(bound[ok] * n + place[mention[ok]], minlength=n * len(self.bound)).reshape(-1, n)

        mention, seg = self.pairs(0)
        listed = counted(seg, mention) > 0
        starts = counted(self.lo, self.order)
        ends = counted(self.hi[self.hi > self.lo], self.order[self.hi > self.lo])
        before = np.concatenate([np.zeros((1, n), np.int64), starts])[: len(self.bound)]
        open_before = np.concatenate([np.zeros((1, n), bool), listed])[: len(self.bound)] & (self.seg_idx != 0)[:, None]
        return best, label, before, open_before, ends, listed


_Layout = Layout  # its earlier name


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _pass(nested: DataFrame | Texts, keys: list[str], ddl: dict[str, T.DataType], make) -> DataFrame:
    """A flat table: the keys, and the columns that ``make`` finds in a layout, as (text of each row, columns)."""
    src, cut = source(nested, keys, ("n_chars", "ms"))
    schema = T.StructType([*(src.schema[k] for k in keys), *(T.StructField(n, t) for n, t in ddl.items())])

    def run(batches):
        for b in batches:
            for own, x in cut(b):
                doc, found = make(Layout(pc.fill_null(x["n_chars"], -1).to_numpy().astype(np.int64), sizes(x["ms"]), x["ms"].flatten().flatten()))
                if len(doc):
                    take = pa.array(doc)
                    out = pa.RecordBatch.from_arrays([*(c.take(take) for c in own), *found], names=schema.names)
                    # JVM and worker hold an output batch whole, and open mentions may be many times the input
                    for i in range(0, out.num_rows, RUN):
                        yield out.slice(i, RUN)

    return src.mapInArrow(run, schema)


_INT, _STRING = T.IntegerType(), T.StringType()
_SEGMENT = {"seg_idx": _INT, "s": _INT, "e": _INT}


def flat(nested: DataFrame | Texts, keys: list[str]) -> DataFrame:
    """keys and ``MENTION``, a row for each mention."""
    return _pass(nested, keys, {**{c: _INT for c in MENTION[:4]}, "entity": _STRING}, lambda x: (x.mention_doc, [*(_int(v) for v in (x.ann, x.seq, x.start, x.end)), x.entity]))


def followed(nested: DataFrame | Texts, keys: list[str]) -> DataFrame:
    """keys, ann, seq, m_start, m_end of the mentions that another one of their annotator follows in span order, and where that one
    starts and ends (s2, e2)."""

    def make(x: Layout):
        at = x.order[np.lexsort((x.ann[x.order], x.mention_doc[x.order]))]  # stable, so within an annotator in span order
        a, b = at[:-1], at[1:]
        same = (x.mention_doc[a] == x.mention_doc[b]) & (x.ann[a] == x.ann[b])
        a, b = a[same], b[same]
        return x.mention_doc[a], [_int(v) for v in (x.ann[a], x.seq[a], x.start[a], x.end[a], x.start[b], x.end[b])]

    return _pass(nested, keys, {c: _INT for c in ("ann", "seq", "m_start", "m_end", "s2", "e2")}, make)


def segments(nested: DataFrame | Texts, keys: list[str]) -> DataFrame:
    """keys, seg_idx, s, e for every distinct boundary of a text: all starts and ends, and the text's length."""
    return _pass(nested, keys, _SEGMENT, lambda x: (x.doc, [_int(x.seg_idx), _int(x.s), _int(x.e)]))


def open_mentions(nested: DataFrame | Texts, keys: list[str]) -> DataFrame:
    """Every mention listed in every segment, with ord (span order in the segment) and pos_type."""

    def make(x: Layout):
        mention, seg = x.pairs(0)
        order = np.lexsort((np.arange(len(seg)), x.ann[mention], seg))
        mention, seg = mention[order], seg[order]
        ann = x.ann[mention]
        new = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (ann[1:] != ann[:-1])])) if len(seg) else seg
        place = np.arange(len(seg)) - np.repeat(new, np.diff(np.append(new, len(seg))))
        kind = np.where(x.e[seg] == x.start[mention], 0, np.where(x.e[seg] == x.end[mention], 1, 2))
        names = pa.DictionaryArray.from_arrays(_int(kind), pa.array(["START", "END", "INTERMEDIATE"])).cast(pa.string())
        return x.doc[seg], [*(_int(v[seg]) for v in (x.seg_idx, x.s, x.e)), _int(ann), *(_int(v[mention]) for v in (x.seq, x.start, x.end)), x.entity.take(pa.array(mention)), names, _int(place)]

    return _pass(nested, keys, {**_SEGMENT, "ann": _INT, "seq": _INT, "m_start": _INT, "m_end": _INT, "entity": _STRING, "pos_type": _STRING, "ord": _INT}, make)


def principals(nested: DataFrame | Texts, keys: list[str]) -> DataFrame:
    """keys, seg_idx, s, e, ann and the innermost open mention (entity, m_start, m_end) where there is one."""

    def make(x: Layout):
        known = np.unique(x.ann)
        best = x.best(known)
        seg, place = np.nonzero(best >= 0)
        mention = best[seg, place]
        return x.doc[seg], [*(_int(v[seg]) for v in (x.seg_idx, x.s, x.e)), _int(known[place]), x.entity.take(pa.array(mention)), _int(x.start[mention]), _int(x.end[mention])]

    return _pass(nested, keys, {**_SEGMENT, "ann": _INT, "entity": _STRING, "m_start": _INT, "m_end": _INT}, make)


def wide(nested: DataFrame | Texts, annotators: list[int], keys: list[str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """keys, seg_idx, s, e and p<annotator>, the entity of each annotator's principal mention (null for a hidden entity), of
    every segment."""
    known = np.array(sorted(annotators))

    def make(x: Layout):
        best = x.best(known, hidden)
        return x.doc, [*(_int(v) for v in (x.seg_idx, x.s, x.e)), *(x.entity.take(pa.array(best[:, i], mask=best[:, i] < 0)) for i in range(len(known)))]

    return _pass(nested, keys, {**_SEGMENT, **{f"p{a}": _STRING for a in known.tolist()}}, make)


def evaluation(gold: Column, other: Column) -> Column:
    """correct, wrong, missing, toomuch, or the empty string where neither has an entity."""
    return F.when(gold.isNull() & other.isNull(), "").when(other.isNull(), "missing").when(gold.isNull(), "toomuch").when(gold == other, "correct").otherwise("wrong")


def marks(nested: DataFrame | Texts, annotators: list[int], keys: list[str], gold: int = 0, hidden: tuple[str, ...] = ()) -> DataFrame:
    """A row per segment and other annotator: gold_entity, entity, eval, and split (the annotators' labels differ)."""
    rows = wide(nested, [gold, *annotators], keys, hidden)
    labels = F.array(*[F.struct(F.lit(a).alias("ann"), F.col(f"p{a}").alias("entity"), evaluation(F.col(f"p{gold}"), F.col(f"p{a}")).alias("eval")) for a in annotators])
    split = F.lit(False)
    for a in annotators[1:]:
        split = split | (evaluation(F.col(f"p{gold}"), F.col(f"p{a}")) != evaluation(F.col(f"p{gold}"), F.col(f"p{annotators[0]}")))
    return rows.select(*keys, "seg_idx", "s", "e", F.col(f"p{gold}").alias("gold_entity"), split.alias("split"), F.explode(labels).alias("l")).select(*keys, "seg_idx", "s", "e", "l.ann", "gold_entity", "l.entity", "l.eval", "split")


def chain_marks(nested: DataFrame | Texts, keys: list[str]) -> DataFrame:
    """keys, ann, e, chain_before ('(' per mention that starts at e) and chain_after (')' per mention that ends there) for
    every end of a segment at which a mention of the annotator is listed."""

    def make(x: Layout):
        known, place = np.unique(x.ann, return_inverse=True)
        n = max(1, len(known))
        mention, seg = x.pairs(0)
        at = np.unique(seg * n + place[mention])
        rows = place[x.order]
        starts = np.bincount(x.lo * n + rows, minlength=n * len(x.bound))
        ends = np.bincount((x.hi * n + rows)[x.hi > x.lo], minlength=n * len(x.bound))
        return x.doc[at // n], [_int(known[at % n]), _int(x.e[at // n]), _int(starts[at]), _int(ends[at])]

    out = _pass(nested, keys, {"ann": _INT, "e": _INT, "before": _INT, "after": _INT}, make)
    return out.select(*keys, "ann", "e", F.repeat(F.lit("("), F.col("before")).alias("chain_before"), F.repeat(F.lit(")"), F.col("after")).alias("chain_after"))


def cells(nested: DataFrame | Texts, annotators: list[int], keys: list[str], gold: int = 0, hidden: tuple[str, ...] = ()) -> DataFrame:
    """A row per segment and annotator, the gold one included: seg_idx, s, e, ann, entity and seq of the principal mention,
    eval against gold (the empty string for gold), and how many mentions start where the segment starts (``before``) and end
    where it ends (``after``); these are null where no mention of the annotator is listed, and in the first segment
    ``before`` is."""
    known = np.array(sorted({gold, *annotators}))
    n = len(known)

    def make(x: Layout):
        best, label, before, open_before, ends, listed = x.cells(known, gold, hidden)
        seg = np.repeat(np.arange(len(x.bound)), n)
        flat = best.ravel()
        take = pa.array(flat, mask=flat < 0)
        names = pa.DictionaryArray.from_arrays(_int(label.ravel()), pa.array(LABELS)).cast(pa.string())

        def some(values, mask):
            return pa.array(values.ravel().astype(np.int32), mask=~mask.ravel())

        return x.doc[seg], [*(_int(v[seg]) for v in (x.seg_idx, x.s, x.e)), _int(np.tile(known, len(x.bound))), x.entity.take(take), _int(x.seq).take(take), names, some(before, open_before), some(ends, listed)]

    return _pass(nested, keys, {**_SEGMENT, "ann": _INT, "entity": _STRING, "seq": _INT, "eval": _STRING, "before": _INT, "after": _INT}, make)


def zip_prefix(left: DataFrame, right: DataFrame, idx: str, columns: list[str]) -> DataFrame:
    """Positions of two article streams up to the first at which id or text differ or a stream ends."""
    both = left.select(idx, *columns).join(right.select(idx, *[F.col(c).alias(f"{c}_r") for c in columns]), idx, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    both = both.select(idx, same.alias("same"))
    stop = both.where(~F.col("same")).agg(F.min(idx).alias("stop"))
    return both.crossJoin(F.broadcast(stop)).where(F.col("same") & (F.col("stop").isNull() | (F.col(idx) < F.col("stop")))).select(idx)


def zip_lists(left: DataFrame, right: DataFrame, idx: str) -> DataFrame:
    """Rows of two streams side by side as ``l`` and ``r``, as far as the shorter one goes."""
    a = left.select(F.col(idx), F.struct(*left.columns).alias("l"))
    return a.join(right.select(F.col(idx), F.struct(*right.columns).alias("r")), idx)


def ordered_merge(frames: list[DataFrame], by: list[str]) -> DataFrame:
    """All rows of several frames in one global order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(*by)
