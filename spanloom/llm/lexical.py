"""Ranked lexical search: a join seeded with thresholds from each term's stored kth impact."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, text_array, tidy
from .words import parts, split, word_hashes

#: Distinct (item, term) pairs that are searched for in one pass over the documents, about; more items make more passes.
BLOCK_TERMS = 200_000
#: A text of more bytes is counted in parts.
LONG = 1 << 22
#: (document, item) pairs that are looked at together.
PAIRS = 1 << 19
#: Bytes that belong to no term: ASCII without digits and letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
for _a, _z in ((48, 58), (65, 91), (97, 123)):
    _BETWEEN[_a:_z] = False


def _hashed(texts: pa.Array):
    """(text, hash, second hash) of every term, and the number of terms of each text."""
    w = split(texts, lower=True, separators=_BETWEEN)
    return w.doc, word_hashes(w, 0), word_hashes(w, 1), np.diff(w.first)


def _batches_of(texts: pa.Array):
    """(rows, texts) of bounded size; the parts of a long text follow each other."""
    for first, some in chunks(texts):
        if len(some) == 1 and len(raw := some[0].as_buffer()) > LONG:
            for part, _ in parts(raw.to_pybytes(), LONG, 0):
                yield np.array([first]), pa.array([part], pa.binary()).cast(pa.string(), safe=False)
        else:
            yield np.arange(first, first + len(some)), some


class _Block:
    """The terms of a block of items: a vocabulary (sorted by hash) and for each item its terms with their repeats."""

    def __init__(self, items: DataFrame):
        rows = items.select("item", "h", "g", "repeats").toArrow()
        h, g = (rows.column(c).to_numpy().view(np.uint64) for c in ("h", "g"))
        order = np.lexsort((g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        term = np.empty(len(h), np.int64)
        term[order] = np.cumsum(new) - 1
        self.h, self.g = h[order][new], g[order][new]
        self.keys, item = np.unique(rows.column("item").to_numpy(), return_inverse=True)
        by_item = np.lexsort((term, item))
        self.item, self.term, self.repeats = item[by_item], term[by_item], rows.column("repeats").to_numpy()[by_item]

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are in the vocabulary, and their terms."""
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        hit = np.flatnonzero(self.h[at] == h)
        term = at[hit]
        while (off := self.g[term] != g[hit]).any():  # equal first hashes stand side by side
            term = term + off
            ok = (term < len(self.h)) & (self.h[np.minimum(term, len(self.h) - 1)] == h[hit])
            hit, term = hit[ok], term[ok]
        return hit, term


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_key), and (item, h, g, repeats) of every item. Rows with one key are one item, of their distinct texts."""
    src = items.select(F.col(item_col).alias("item_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).distinct()
    keys = materialize(src.select("item_key").distinct().select(F.monotonically_increasing_id().alias("item"), "item_key"), "items")
    src = src.withColumnRenamed("item_key", "k").join(keys, F.col("k").eqNullSafe(F.col("item_key"))).select("item", "t")

    def run(batches):
        for b in batches:
            item = b.column(0).to_numpy()
            for row, texts in _batches_of(text_array(b.column(1))):
                doc, h, g, _ = _hashed(texts)
                yield pa.RecordBatch.from_arrays([pa.array(item[row[doc]]), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["item", "h", "g"])

    terms = src.mapInArrow(tidy(run), "item long, h long, g long").groupBy("item", "h", "g").agg(F.count(F.lit(1)).alias("repeats"))
    return keys, materialize(terms, "item-terms")


def _vectors(docs: DataFrame, block: _Block) -> DataFrame:
    """(doc, n, terms, tfs) of every document with at least one term: its terms' number, and those of the block, ascending."""
    size = len(block.h)

    def run(batches):
        for b in batches:
            texts = text_array(b.column(1))
            n, found = np.zeros(b.num_rows, np.int64), []
            for row, some in _batches_of(texts):
                doc, h, g, count = _hashed(some)
                n[row] += count
                at, term = block.find(h, g)
                found.append(np.stack(np.unique(row[doc[at]] * size + term, return_counts=True)))
            key, tf = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            key, back = np.unique(key, return_inverse=True)
            tf = np.bincount(back, weights=tf, minlength=len(key)).astype(np.int64)
            edges = np.searchsorted(key, np.arange(b.num_rows + 1) * size).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(edges), pa.array((key % size).astype(np.int32)))
            tfs = pa.ListArray.from_arrays(pa.array(edges), pa.array(tf))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), terms, tfs], names=["doc", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.mapInArrow(tidy(run), "doc long, n long, terms array<int>, tfs array<long>")


def _postings(b: pa.RecordBatch, n_docs: int, n_terms: int):
    """(row, term, impact without the term's weight) of a batch of vectors."""
    length = np.diff(np.asarray(b.column(2).offsets))
    row, n = np.repeat(np.arange(b.num_rows), length), b.column(1).to_numpy()
    term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
    m = 25 + 75 * n * n_docs // n_terms
    return row, term.astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 8 * m[row])


def _first_k(group: np.ndarray, k: int) -> np.ndarray:
    """Whether each row of sorted groups is among its group's first k."""
    start = np.zeros(len(group), np.int64)
    new = np.flatnonzero(group[1:] != group[:-1]) + 1
    start[new] = new
    return np.arange(len(group)) - np.maximum.accumulate(start) < k


def _top_impacts(vectors: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, top, kth): the largest and the kth largest impact of each term; kth is 0 where fewer documents hold it."""

    def run(batches):
        held = np.zeros((2, 0), np.int64)
        for b in batches:
            _, term, impact = _postings(b, n_docs, n_terms)
            held = np.concatenate([held, np.stack([term, impact])], axis=1)
            held = held[:, np.lexsort((-held[1], held[0]))]
            held = held[:, _first_k(held[0], k)]
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1])], names=["term", "impact"])

    best = vectors.mapInArrow(tidy(run), "term int, impact long")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("place") <= k)
    return best.groupBy("term").agg(F.max("impact").alias("top"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))


class _Plan:
    """For each item a threshold that its kth score reaches at least, and the terms that alone can lead to that."""

    def __init__(self, block: _Block, weight: np.ndarray, top: np.ndarray, kth: np.ndarray):
        n = len(block.keys)
        self.n_terms = len(block.h)
        factor = block.repeats * weight[block.term]
        self.first = np.searchsorted(block.item, np.arange(n + 1))
        self.item_term, self.item_factor = block.term, factor
        self.least = np.ones(n, np.int64)  # scores of 0 aren't returned
        np.maximum.at(self.least, block.item, factor * kth[block.term])
        most = factor * top[block.term]
        order = np.lexsort((-most, block.item))
        self.rest = np.zeros(n, np.int64)
        needed = np.zeros(len(most), bool)
        for i in range(n):
            own = order[self.first[i] : self.first[i + 1]]
            suffix = np.cumsum(most[own][::-1])[::-1]  # what this term and those after it can give at most
            cut = int((suffix >= self.least[i]).sum())
            needed[own[:cut]] = True
            self.rest[i] = suffix[cut] if cut < len(own) else 0
        at = np.flatnonzero(needed)
        at = at[np.argsort(block.term[at], kind="stable")]
        self.seed_item, self.seed_factor = block.item[at], factor[at]
        self.seed_first = np.searchsorted(block.term[at], np.arange(self.n_terms + 1))


def _expand(first: np.ndarray, last: np.ndarray):
    """(which, place) of every place of the ranges first..last."""
    count = last - first
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def _score(row, term, impact, plan: _Plan, least: np.ndarray):
    """(row, item, score) of all pairs whose score reaches the item's threshold."""
    which, seed = _expand(plan.seed_first[term], plan.seed_first[term + 1])
    if not len(seed):
        return (np.zeros(0, np.int64),) * 3
    pair = row[which] * len(least) + plan.seed_item[seed]
    pair, back = np.unique(pair, return_inverse=True)
    part = np.zeros(len(pair), np.int64)
    np.add.at(part, back, plan.seed_factor[seed] * impact[which])
    item = pair % len(least)
    pair = pair[part + plan.rest[item] >= least[item]]  # the candidates
    row_of, item = pair // len(least), pair % len(least)
    key = row * plan.n_terms + term  # ascending
    score = np.zeros(len(pair), np.int64)
    work = np.concatenate([[0], np.cumsum(plan.first[item + 1] - plan.first[item])])
    a = 0
    while a < len(pair):  # so many candidates at a time that their items' terms are bounded
        z = max(a + 1, int(np.searchsorted(work, work[a] + PAIRS, side="right")) - 1)
        cand, place = _expand(plan.first[item[a:z]], plan.first[item[a:z] + 1])
        wanted = row_of[a:z][cand] * plan.n_terms + plan.item_term[place]
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        hit = key[at] == wanted
        np.add.at(score, a + cand[hit], plan.item_factor[place[hit]] * impact[at[hit]])
        a = z
    good = score >= least[item]
    return row_of[good], item[good], score[good]


def _search(vectors: DataFrame, block: _Block, plan: _Plan, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score) of each task's k best documents of every item, of those that reach the item's threshold."""
    seeds = np.diff(plan.seed_first)

    def run(batches):
        least = plan.least.copy()
        held = [np.zeros(0, np.int64)] * 4  # item, score, id is null, id
        for b in batches:
            row, term, impact = _postings(b, n_docs, n_terms)
            null = np.asarray(b.column(0).is_null()).astype(np.int64)
            doc = b.column(0).fill_null(0).to_numpy()
            work = np.concatenate([[0], np.cumsum(np.bincount(row, weights=seeds[term], minlength=b.num_rows))])
            a = 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(work, work[a] + PAIRS, side="right")) - 1)
                i, j = np.searchsorted(row, [a, z])
                r, item, score = _score(row[i:j], term[i:j], impact[i:j], plan, least)
                a = z
                if len(r):
                    held = [np.concatenate(x) for x in zip(held, (item, score, null[r], doc[r]))]
                    order = np.lexsort((held[3], held[2], -held[1], held[0]))
                    held = [x[order] for x in held]
                    keep = _first_k(held[0], k)
                    held = [x[keep] for x in held]
                    full = np.flatnonzero(held[0][k - 1 :] == held[0][: len(held[0]) - k + 1]) if len(held[0]) >= k else []
                    for at in full:
                        least[held[0][at]] = max(least[held[0][at]], held[1][at + k - 1])
        item, score, null, doc = held
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[item]), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["item", "doc", "score"])

    return vectors.mapInArrow(tidy(run), "item long, doc long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_col, rank (int, from 1), id_col (long) and score (long): the k documents with the highest scores for every item.

    Terms are the longest runs of characters other than ASCII blanks, signs and controls, with A-Z in lower case; a null text has
    none. N documents hold a term, L terms in all with repeats, n a document, df documents hold a term, tf times a document.
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + 75 n N div L, and a score sums w * (10^9 tf div (1000 tf + 8 m)) over
    the item's terms, repeats included. Only scores above 0 are returned; equal ones by ascending id, null ids last.
    Repeated rows of documents are documents each. Rows of items with one key (null too) are one item, of all their distinct
    texts. Empty tables, and items without terms that a document holds, give no rows; other columns are not read.

    Documents are counted once for each block of items with about ``block_terms`` terms, by which alone what is sent to the tasks
    grows. From the terms' kth largest impacts, which are stored, follows a score that every item's kth document reaches.
    An item's terms are ordered by what they can give at most; those at the end that together stay below the threshold find no
    candidates. Documents whose found terms, with the most that the rest can give, reach the threshold are scored
    exactly; a task keeps the k best of each item and raises its threshold by them.
    """
    spark = docs.sparkSession
    keys, terms = _item_terms(items, item_col, item_text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    blocks = max(1, math.ceil(terms.count() / block_terms))
    found = spark.createDataFrame([], "item long, doc long, score long")
    for i in range(blocks):
        block = _Block(terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i))
        if not len(block.h):
            continue
        vectors = materialize(_vectors(src, block), "term-vectors")
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
        if not n_docs:
            continue
        held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        stored = materialize(_top_impacts(vectors, n_docs, n_terms, k).join(held, "term"), "term-impacts").toArrow()
        df, top, kth = (np.zeros(len(block.h), np.int64) for _ in range(3))
        for name, into in (("df", df), ("top", top), ("kth", kth)):
            into[stored.column("term").to_numpy()] = stored.column(name).to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
        found = found.unionAll(_search(vectors, block, _Plan(block, weight, top, kth), n_docs, n_terms, k))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    out = found.withColumn("rank", place).where(F.col("rank") <= k).join(keys, "item")
    return out.select(F.col("item_key").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def op12_sql() -> str:
    """The same over ``documents`` and ``benchmark``, for DuckDB."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    terms = rf"regexp_extract_all(translate(text, {letters}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark) GROUP BY ALL),
v AS (SELECT doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(ts) AS n, ts, row_number() OVER () AS r FROM v WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, nn),
s AS (
  SELECT item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN d USING (r), g GROUP BY item_id, doc_id, r
),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
