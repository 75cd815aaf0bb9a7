"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, text_array, tidy
from .words import U, Words, mix, parts, split, word_hashes

#: Fixed masks over word positions; a 0 is a position whose word is ignored.
MASKS = ("110100111", "111010011", "1011100011")
#: The filter of test seeds that goes to every executor has this many bits a seed, and at most MAX_FILTER in all.
FILTER_BITS, MAX_FILTER, FILTER_HASHES = 32, 1 << 30, 4
#: Bytes of text whose seeds are made at a time; a longer text is read in parts.
RUN_BYTES = 1 << 20
_WIDEST = max(map(len, MASKS))
_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def masks_of(n: int, max_substitutions: float) -> list[str]:
    """The masks for items of ``n`` words. Those shorter than the widest of MASKS are looked for whole, with every choice of
    the one word that may differ in them if the share allows one."""
    if n >= _WIDEST:
        return list(MASKS)
    return ["1" * i + "0" + "1" * (n - i - 1) for i in range(n)] if n > 1 and int(max_substitutions * n) >= 1 else ["1" * n]


def needed(n: int, min_overlap: int, max_substitutions: float) -> int:
    """Equal words that an overlap with an item of ``n`` words must have."""
    return min(min_overlap, n - int(max_substitutions * n))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the words that the mask keeps, at every place where it fits (its whole width)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int("1" + mask, 2), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += h[j : j + n] * _STEPS[j]
    return mix(out)


class Filter:
    """Bits for test seeds: what it lets pass is joined with them, what it doesn't occurs in no test item."""

    def __init__(self, n: int):
        self.bits = max(20, int(min(MAX_FILTER, max(1, n) * FILTER_BITS) - 1).bit_length())
        self.data = np.zeros(1 << (self.bits - 3), np.uint8)

    def _place(self, s: np.ndarray, k: int):
        at = (s * _STEPS[k + 32]) >> U(64 - self.bits)
        return (at >> U(3)).astype(np.int64), (U(1) << (at & U(7))).astype(np.uint8)

    def add(self, s: np.ndarray) -> None:
        for k in range(FILTER_HASHES):
            byte, bit = self._place(s, k)
            np.bitwise_or.at(self.data, byte, bit)

    def passing(self, s: np.ndarray) -> np.ndarray:
        """Places of the seeds that may be test seeds."""
        at = np.arange(len(s))
        for k in range(FILTER_HASHES):
            byte, bit = self._place(s[at], k)
            at = at[(self.data[byte] & bit) != 0]
        return at


def best_stretch(equal: np.ndarray, max_substitutions: float) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch of an alignment with the most equal words of all those in which at most the
    share ``max_substitutions`` is substituted; it begins and ends with equal words. Of equal ones the first.

    A stretch is within the share if the sum over its words, +share for an equal and share - 1 for a substituted one, isn't negative. So for each
    end the best start is the first whose sum of all words before isn't above the end's, and it is among the new minima.
    """
    share = Fraction(max_substitutions).limit_denominator(1_000_000)
    total = np.concatenate([[0], np.cumsum(np.where(equal, share.numerator, share.numerator - share.denominator))])
    same = np.concatenate([[0], np.cumsum(equal)])
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    n = same - same[start]
    end = int(n.argmax())
    on = start[end] + np.flatnonzero(equal[start[end] : end])
    return (int(on[0]), int(on[-1]) + 1, len(on)) if len(on) else (0, 0, 0)


def verify(h: np.ndarray, x: np.ndarray, shift: int, min_overlap: int, max_substitutions: float):
    """(first word and end in the text, first word and end in the item, equal words) of the largest overlap within the share of
    substitutions that the alignment of item word j with text word ``shift`` + j shows, if it is long enough."""
    a, b = max(0, -shift), min(len(x), len(h) - shift)
    if b <= a:
        return None
    start, stop, same = best_stretch(h[shift + a : shift + b] == x[a:b], max_substitutions)
    if same < max(1, needed(len(x), min_overlap, max_substitutions)):
        return None
    return shift + a + start, shift + a + stop, a + start, a + stop, same


class _Test:
    """The test set: materialised items with their word hashes, their seeds as a table, and the filter of these."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, max_substitutions: float):
        src = benchmark.select(F.col(item_col).alias("item_key"), F.col(text_col).cast("string").alias("text")).where("text is not null")
        key = src.schema["item_key"]

        def hashes(batches):
            for b in batches:
                w = split(text_array(b.column(1)), lower=True)
                h, n = word_hashes(w), np.diff(w.first)
                raw = [h[a:z].tobytes() for a, z in zip(w.first, w.first[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(raw, pa.binary())], names=["item_key", "n", "words"])

        items = src.mapInArrow(tidy(hashes), T.StructType([key, *T.StructType.fromDDL("n long, words binary").fields])).where("n > 0")
        self.items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "test-items")

        def made(batches):
            for b in batches:
                for item, raw in zip(b.column(0).to_numpy().tolist(), b.column(1)):
                    h = np.frombuffer(raw.as_py(), np.uint64)
                    s = [seeds(h, m) for m in masks_of(len(h), max_substitutions)]
                    at = np.concatenate([np.arange(len(x)) for x in s])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64)), pa.array(np.full(len(at), item)), pa.array(at.astype(np.int32))], names=["seed", "item", "at"])

        placed = self.items.select("item", "words").mapInArrow(tidy(made), "seed long, item long, at int")
        self.seeds = materialize(placed.groupBy("seed", "item").agg(F.collect_list("at").alias("places")), "test-seeds")
        self.filter = Filter(self.seeds.count())
        distinct = self.seeds.select("seed").distinct().toLocalIterator()  # the filter alone stays
        while some := [r[0] for _, r in zip(range(100_000), distinct)]:
            self.filter.add(np.array(some, np.int64).view(np.uint64))
        sizes = {r["n"] for r in self.items.select(F.least("n", F.lit(_WIDEST)).alias("n")).distinct().collect()}
        self.masks = list(dict.fromkeys(m for n in sorted(sizes) for m in masks_of(n, max_substitutions)))


def _found(texts: pa.Array, masks: list[str], held: Filter):
    """(text, word hashes, places of seeds, seeds) of the texts that have a seed which the filter lets pass."""
    overlap = max(map(len, masks), default=1) - 1

    def hits(w: Words, h: np.ndarray):
        doc = w.doc
        places, found = [], []
        for m in masks:
            s = seeds(h, m)
            at = held.passing(s)
            at = at[doc[at] == doc[at + len(m) - 1]]
            places.append(at)
            found.append(s[at])
        at, s = np.concatenate([np.zeros(0, int), *places]), np.concatenate([np.zeros(0, np.uint64), *found])
        return doc[at] if len(doc) else at, at, s

    for first, part in chunks(texts, RUN_BYTES):
        if len(part) > 1 or part.nbytes <= 2 * RUN_BYTES:
            w = split(part, lower=True)
            h = word_hashes(w)
            doc, at, s = hits(w, h)
            order = np.argsort(doc, kind="stable")
            doc, at, s = doc[order], at[order], s[order]
            new = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, z in zip(new, np.append(new[1:], len(doc))):
                d = int(doc[a])
                yield first + d, h[w.first[d] : w.first[d + 1]], at[a:z] - w.first[d], s[a:z]
            continue
        hs, places, found, base = [], [], [], 0
        for raw, more in parts(part[0].as_py().encode("utf-8", "surrogatepass"), RUN_BYTES, overlap):
            w = split(pa.array([raw]), lower=True)
            h = word_hashes(w)
            _, at, s = hits(w, h)
            own = len(h) - more
            found.append(s[at < own])
            places.append(at[at < own] + base)
            hs.append(h[:own])
            base += own
        if sum(map(len, found)):
            yield first, np.concatenate(hs), np.concatenate(places), np.concatenate(found)


def _candidates(docs: DataFrame, test: _Test, text_at: int, carry: list[str]) -> DataFrame:
    """row (unique), the named columns, words (hashes) and seeds (array of seed and places) of the documents with a seed that
    the filter lets pass, written to the shared folder."""
    held = docs.sparkSession.sparkContext.broadcast((test.masks, test.filter))
    seed_type = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.list_(pa.int32()))]))

    def run(batches):
        masks, keep = held.value
        for b in batches:
            rows, words, lists = [], [], []
            for i, h, at, s in _found(text_array(b.column(text_at).cast(pa.string())), masks, keep):
                order = np.argsort(s, kind="stable")
                at, s = at[order].astype(np.int32), s[order]
                new = np.flatnonzero(np.diff(s, prepend=~s[:1]))
                rows.append(i)
                words.append(h.tobytes())
                lists.append([{"seed": int(k), "at": x} for k, x in zip(s[new].view(np.int64).tolist(), np.split(at, new[1:]))])
            if rows:
                some = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(some.column(b.schema.get_field_index(c)) for c in carry), pa.array(words, pa.binary()), pa.array(lists, seed_type)], names=[*carry, "__words", "__seeds"])

    schema = T.StructType([*(docs.schema[c] for c in carry), *T.StructType.fromDDL("__words binary, __seeds array<struct<seed:long,at:array<int>>>").fields])
    return materialize(docs.mapInArrow(tidy(run), schema).withColumn("__row", F.monotonically_increasing_id()), "contamination-candidates")


def _overlaps(cand: DataFrame, test: _Test, min_overlap: int, max_substitutions: float) -> DataFrame:
    """__row, item_key and the verified ranges: the candidates' seeds joined with the test seeds, the hits of each document
    and item gathered and turned into alignments, and each of these verified."""
    hit = cand.select("__row", F.explode("__seeds").alias("s")).select("__row", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    pairs = hit.join(test.seeds, "seed").groupBy("__row", "item").agg(F.collect_list(F.struct("at", "places")).alias("hits"))
    pairs = pairs.join(cand.select("__row", "__words"), "__row").join(test.items.select("item", "item_key", "words"), "item").select("__row", "item_key", "hits", "__words", "words")
    schema = T.StructType([T.StructField("__row", T.LongType()), test.items.schema["item_key"], *T.StructType.fromDDL("doc_start int, doc_end int, item_start int, item_end int, n_equal int").fields])

    def run(batches):
        for b in batches:
            rows, found = [], []
            for i in range(b.num_rows):
                h, x = (np.frombuffer(b.column(k)[i].as_py(), np.uint64) for k in (3, 4))
                seen = np.zeros(len(h) + len(x), bool)
                for pair in b.column(2)[i]:
                    at, places = pair["at"].values.to_numpy(), pair["places"].values.to_numpy()
                    short, long = sorted((at + len(x), -places), key=len)
                    for k in short.tolist():
                        seen[k + long] = True
                best = None
                for shift in (np.flatnonzero(seen) - len(x)).tolist():
                    v = verify(h, x, shift, min_overlap, max_substitutions)
                    if v and (best is None or v[-1] > best[-1]):
                        best = v
                if best:
                    rows.append(i)
                    found.append(best)
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, pa.int32()) for c in zip(*found))], names=schema.names)

    return pairs.mapInArrow(tidy(run), schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, max_substitutions: float = 0.2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and test item that overlap: ids, word ranges in both texts, equal words.

    Words are compared lower-cased (A-Z), by 64-bit hashes. Seeds ignore some positions, so a hit survives substituted words
    there; at each hit the two texts are aligned. They overlap if any stretch of the alignment has ``min_overlap`` equal words
    and at most the share ``max_substitutions`` of substituted ones; the one with most equal words is returned. Of an item too short for that, all words but that share
    must be equal (see ``needed``, ``masks_of``). Of several alignments the one with most equal words counts, of equal ones
    the first. Null or empty texts and items overlap with nothing; repeated documents and items give repeated rows; null
    ids are carried; empty tables give no rows; other columns are not read.

    Seeds of the test set are a table. Documents make theirs where they are scanned, a filter of the test seeds (its size is
    bounded) keeps those that may match, and Spark joins the two by hash. Very long texts are read in parts.
    """
    src = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    test = _Test(benchmark, item_col, item_text_col, max_substitutions)
    cand = _candidates(src, test, 1, ["doc_key"])
    out = _overlaps(cand, test, min_overlap, max_substitutions).join(cand.select("__row", "doc_key"), "__row")
    return out.select(F.col("doc_key").alias(id_col), F.col("item_key").alias(item_col), "doc_start", "doc_end", "item_start", "item_end", "n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, max_substitutions: float = 0.2, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, that overlap with no test item (see ``find_overlaps``); repeated rows and rows with null
    texts stay or go each for itself, an empty table stays empty. Column names starting with two underscores are taken.

    Documents without a seed that the filter lets pass are handed on where they are scanned; only the others take part in
    the joins.
    """
    test = _Test(benchmark, item_col, item_text_col, max_substitutions)
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast((test.masks, test.filter))

    def clear(batches):
        masks, keep = held.value
        for b in batches:
            stay = np.ones(b.num_rows, bool)
            stay[[i for i, *_ in _found(text_array(b.column(at).cast(pa.string())), masks, keep)]] = False
            yield b.filter(pa.array(stay))

    cand = _candidates(docs, test, at, docs.columns)
    bad = _overlaps(cand, test, min_overlap, max_substitutions).select("__row").distinct()
    return docs.mapInArrow(tidy(clear), docs.schema).unionAll(cand.join(bad, "__row", "left_anti").select(*docs.columns))
