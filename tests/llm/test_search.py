"""Ranked lexical search and hard-negative mining against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import lexical, negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _rank(docs, items, k=10):
    counted = [(d, collections.Counter(t), len(t)) for d, x in docs if (t := _terms(x))]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    texts = collections.defaultdict(set)
    for key, x in items:
        texts[key].add(x or "")
    out = []
    for key, xs in texts.items():
        asked = collections.Counter(t for x in xs for t in _terms(x))
        scores = []
        for d, c, n in counted:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(key, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return collections.Counter(out)


def _library(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["ñandú", "Ünder", "x-ray", "A1", "naïve word", "日本", "\u0080"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randrange(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [docs[3], (None, docs[4][1]), (None, None), (2000, ""), (2001, "!! ?? ..."), (2002, "w1 W1, w1;" * 3000), (2003, "ñandú" * 5000)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 25)))) for i in range(25)] + [(100, docs[7][1]), (101, None), (102, ""), (103, "nowhere at all"), (None, "w5 w6"), (104, "w1 w1 w1"), (105, "w2"), (105, "w2"), (105, "w3 w9")]
    return docs, items


@pytest.mark.parametrize("block_terms,long", [(200_000, None), (40, 1 << 12)])
def test_rank_against_brute_force(spark, monkeypatch, block_terms, long):
    if long:
        monkeypatch.setattr(lexical, "LONG", long)
        monkeypatch.setattr(lexical, "PAIRS", 64)
    docs, items = _library()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = lexical.rank(d, q, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(tuple(x) for x in got.collect()) == _rank(docs, items)


def test_rank_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).collect() == [] and lexical.rank(docs, items.limit(0)).collect() == []
    assert lexical.rank(docs.withColumn("text", F.lit(None).cast("string")), items).collect() == []
    assert [tuple(x) for x in lexical.rank(docs, items).collect()] == [(1, 1, 1, int(math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100))))]


def test_thresholds_prune_and_keep():
    class Block:
        keys, item, term, repeats, h = np.array([7]), np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([1, 1, 2]), np.arange(3)

    plan = lexical._Plan(Block, np.array([10, 5, 1]), np.array([9, 8, 3]), np.array([8, 0, 3]))
    assert plan.least.tolist() == [80] and plan.rest.tolist() == [46]  # 90, 40 and 6 at most: the last two stay below 80
    assert plan.seed_item.tolist() == [0] and plan.seed_first.tolist() == [0, 1, 1, 1]


def _mine(rows, anchors, n_positives=5, n_negatives=3):
    whole = [(i, label, [math.floor(256.0 * float(x)) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []

    def order(x):
        return -x[0], x[1] is None, x[1] or 0

    for a, (anchor, label, v) in enumerate(whole):
        if not (anchor is not None and anchors(anchor)):
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w)))), i, other) for b, (i, other, w) in enumerate(whole) if b != a and len(w) == len(v)]
        for ps, p, _ in sorted((x for x in scored if x[2] == label), key=order)[:n_positives]:
            fit = sorted((x for x in scored if x[2] != label and 50 * ps <= 100 * x[0] <= 95 * ps), key=order)[:n_negatives]
            out += [(anchor, p, k + 1, n, ps, s) for k, (s, n, _) in enumerate(fit)]
    return collections.Counter(out)


def _vectors(n=700, dim=6, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dim)) * 2
    rows = [(i, int(r.integers(0, 4)), (centres[r.integers(0, 9)] + r.normal(size=dim) * 0.4).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, 1, rows[50][2]) for i in range(120)] + [(n + 200 + i, 2, rows[50][2]) for i in range(40)]
    rows += [rows[0], (50, 3, rows[50][2]), (None, 1, rows[50][2]), (5000, None, rows[1][2]), (5001, 1, None), (5002, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5003, 1, [float("inf")] * dim), (5004, 1, [float("nan")] * dim)]
    return rows + [(6000 + 50 * i, i % 2, [float(x) for x in r.integers(-2, 3, size=2)]) for i in range(30)] + [(7000 + i, i % 3, []) for i in range(0, 100, 25)] + [(8000, 1, [0.0] * dim)]


def _found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, label, v in rows], "vec_id long, embedding array<float>, label int, list int, uid string").repartition(3)
    return collections.Counter(tuple(x) for x in negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("block,anchors", [(2048, 8192), (20, 5)])
def test_mining_against_brute_force(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = _vectors()
    assert _found(spark, rows) == _mine(rows, lambda i: i % 50 == 0)


def test_mining_skips_lists():
    x = np.concatenate([np.random.default_rng(0).normal(size=(50, 8)) + 40 * np.eye(8)[i] for i in range(8)])
    c = negatives.fit_centroids(x, 8)

    class Lists:
        centroids = c
        bounds = negatives.Lists.bounds

    near = negatives._squares(x, c).argmin(axis=1)
    radii = np.array([np.sqrt(((x[near == k] - c[k]) ** 2).sum(axis=1)).max() if (near == k).any() else 0 for k in range(len(c))])
    least, most = Lists().bounds(x[:5], radii)
    score = x[:5] @ x.T
    assert (score <= most[:, near]).all() and (score >= least[:, near]).all()
    assert (most < np.sort(score, axis=1)[:, -3:-2]).mean() > 0.5  # most lists are below the third score


def test_mining_whole_numbers_and_empty(spark):
    a = np.array([[3e9, 1.0], [2.0**40, -(2.0**40)]])
    assert negatives.products(a, a).tolist() == [[9 * 10**18 + 1, int(3e9) * 2**40 - 2**40 if int(3e9) * 2**40 - 2**40 < 2**63 else 2**63 - 1], [2**63 - 1, 2**63 - 1]]
    assert negatives.products(np.array([[2.0**53, 1.0]]), np.array([[1.0, 1.0]])).tolist() == [[2**53 + 1]]
    assert _found(spark, []) == collections.Counter()
    big = [(0, 1, [1e30, 0.0]), (1, 1, [1e30, 0.0]), (2, 2, [1e10, 0.0]), (3, 2, [1.0, 5.0]), (50, 1, [2.0**20, 1.0]), (4, 2, [2.0**19 * 1.8, 0.0])]
    assert _found(spark, big) == _mine([(i, label, [float(np.float32(x)) for x in v]) for i, label, v in big], lambda i: i % 50 == 0)
