"""Quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, materialize, text_array, tidy, with_fields
from .words import Words, parts, split, word_hashes

#: Labelled rows whose pairs are compared with one another, and how many of either kind are among them at least on average.
BUCKET, LEAST = 32, 8

FEATURES = ("log_words", "mean_length", "upper", "digits", "symbols", "punctuation", "symbol_words", "bare_words", "repeats", "distinct", "long_words", "stops", "upper_words", "lines", "high_bytes")
#: Bytes of text whose features are found at once.
RUN_BYTES = 1 << 20
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#$%&*|!<>{}[]\\^~=+_@"]] = 1
_PUNCT = np.zeros(256, np.uint8)
_PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_ALPHA = np.zeros(256, np.uint8)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_HIGH = np.zeros(256, np.uint8)
_HIGH[128:] = 1


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _sums(w: Words, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text what adds up over its words (those of ``core``): a row of sums, and the hash of each word."""
    first, doc = w.first, w.doc
    length = (w.ends - w.starts).astype(float)

    def words(t):
        c = np.concatenate([[0], np.cumsum(t[w.data], dtype=np.int64)])
        return (c[w.ends] - c[w.starts]).astype(float)

    upper, alpha, digit, symbol, punct, high = (words(t) for t in (_UPPER, _ALPHA, _DIGIT, _SYMBOL, _PUNCT, _HIGH))
    h = word_hashes(w)
    next_ = np.zeros(len(h), bool)
    next_[:-1] = doc[1:] == doc[:-1]
    same, gap = np.zeros(len(h)), np.zeros(len(h))
    same[:-1] = (h[1:] == h[:-1]) & next_[:-1]
    newline = np.concatenate([[0], np.cumsum(w.data == 10, dtype=np.int64)])
    gap[:-1] = (newline[w.starts[1:]] > newline[w.ends[:-1]]) & next_[:-1]
    last = w.data[w.ends - 1]
    columns = [np.ones(len(h)), length, upper, alpha, digit, symbol, punct, high, symbol > 0, alpha == 0, same, length > 14, np.isin(last, (46, 33, 63)), (upper >= 2) & (upper >= 0.6 * alpha), gap]
    return np.stack([np.bincount(doc, np.where(core, c, 0), minlength=len(first) - 1) for c in columns], axis=1), h


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, all from the whole text; zeros for one without words. A long text is read in parts."""
    sums, distinct = np.zeros((len(texts), 15)), np.zeros(len(texts))
    for at, part in chunks(texts, RUN_BYTES):
        if len(part) == 1 and part.nbytes > 2 * RUN_BYTES:
            seen = np.zeros(0, np.uint64)
            for raw, more in parts(part[0].as_py().encode("utf-8", "surrogatepass"), RUN_BYTES, 1):
                w = split(pa.array([raw]), lower=False)
                if len(w.starts):
                    s, h = _sums(w, np.arange(len(w.starts)) < len(w.starts) - more)
                    sums[at] += s[0]
                    seen = np.union1d(seen, h)
            distinct[at] = len(seen)
            continue
        w = split(part, lower=False)
        if len(w.starts):
            sums[at : at + len(part)], h = _sums(w, np.ones(len(w.starts), bool))
            for i in np.flatnonzero(np.diff(w.first)).tolist():
                distinct[at + i] = len(np.unique(h[w.first[i] : w.first[i + 1]]))
    n, chars, upper, letters, digit, symbol, punct, high, symbol_words, bare, same, long, stops, upper_words, lines = sums.T
    out = np.stack([
        np.log1p(n), _ratio(chars, n), _ratio(upper, letters), _ratio(digit, chars), _ratio(symbol, chars), _ratio(punct, chars), _ratio(symbol_words, n), _ratio(bare, n), _ratio(same, n),
        _ratio(distinct, np.sqrt(np.maximum(n, 1) * 40)), _ratio(long, n), _ratio(stops, n), _ratio(upper_words, n), _ratio(lines, n), _ratio(high, chars),
    ], axis=1)
    return np.where(n[:, None] > 0, out, 0.0)


def _summed(df: DataFrame, part) -> np.ndarray:
    """The sum of ``part`` (a vector of the columns of a batch) over a table: each task gives one row, the driver adds these."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                v = np.concatenate([np.atleast_1d(x).ravel() for x in part(b)])
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    return np.sum([r.v for r in df.mapInArrow(run, "v array<double>").collect()], axis=0)


def _vectors(lists: pa.Array) -> np.ndarray:
    """A row of features and their squares for each list."""
    x = lists.flatten().to_numpy().reshape(-1, len(FEATURES))
    return np.concatenate([x, x**2], axis=1)


def _pairs(b: pa.RecordBatch, mean: np.ndarray, sd: np.ndarray, centres: np.ndarray):
    """The feature differences of all pairs of a row of label 1 and one of label 0 in each bucket (ys, xs) of a batch. A bucket
    without one kind compares its rows with that kind's mean."""
    y, z = b.column(0).flatten().to_numpy(), (_vectors(b.column(1).flatten()) - mean) / sd
    ends = np.cumsum(pc.list_value_length(b.column(0)).to_numpy())
    for i, k in zip((ends - pc.list_value_length(b.column(0)).to_numpy()).tolist(), ends.tolist()):
        bad, good = (z[i:k][y[i:k] == c] if (y[i:k] == c).any() else centres[[c]] for c in (0, 1))
        yield (good[:, None] - bad[None]).reshape(-1, z.shape[1])


def fit(rows: DataFrame, l2: float = 1e-3, rounds: int = 40) -> dict:
    """Weights from preference pairs (a row of label 1 over a row of label 0) by logistic loss on feature differences, from all
    ``rows`` (doc_key, x, y).

    Rows are dealt into buckets of about BUCKET by hashes of their ids, the rarer kind into as many as give each bucket about
    LEAST of it, and all pairs of a bucket are compared; so pairs grow with the rows, and no group does. Newton steps on standardised
    features with their squares, each one pass. The threshold is the quantile of all scores at the share of label 0; the scale makes
    the logistic of (score - threshold) fit all labels.
    """
    n = 2 * len(FEATURES)

    def moments(b):
        v, y = _vectors(b.column(0)), b.column(1).to_numpy()
        return (len(y), y.sum(), v.sum(axis=0), (v**2).sum(axis=0), v[y == 1].sum(axis=0))

    got = _summed(rows.select("x", "y"), moments)
    if not np.ndim(got):  # no rows
        return {"mean": np.zeros(n), "sd": np.ones(n), "w": np.zeros(n), "threshold": 1.0, "scale": 1.0}
    count, n1, total, squares, good = int(got[0]), int(got[1]), *got[2:].reshape(3, n)
    n0, mean = count - n1, total / count
    sd = np.sqrt(np.maximum(squares / count - mean**2, 0)) + 1e-9
    if not n0 or not n1:
        return {"mean": mean, "sd": sd, "w": np.zeros(n), "threshold": -1.0 if n1 else 1.0, "scale": 1.0}
    centres = (np.stack([(total - good) / n0, good / n1]) - mean) / sd
    buckets = -(-count // BUCKET)
    copies = [min(buckets, max(1, -(-LEAST * buckets // k))) for k in (n0, n1)]
    place = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 1, copies[1] - 1).otherwise(copies[0] - 1)))
    dealt = rows.select("x", "y", F.xxhash64("doc_key").alias("h"), place.alias("j")).groupBy(F.pmod(F.col("h") + F.col("j"), F.lit(buckets)).alias("bucket"))
    dealt = materialize(dealt.agg(F.collect_list("y").alias("ys"), F.collect_list("x").alias("xs")).select("ys", "xs"), "quality-pairs")
    weights = np.zeros(n)
    for _ in range(rounds):

        def step(b, w=weights.copy()):
            pairs, grad, hess = 0, np.zeros(n), np.zeros((n, n))
            for diff in _pairs(b, mean, sd, centres):
                p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
                pairs, grad, hess = pairs + len(diff), grad + diff.T @ (1 - p), hess + (diff * (p * (1 - p))[:, None]).T @ diff
            return pairs, grad, hess

        got = _summed(dealt, step)
        move = np.linalg.solve(got[n + 1 :].reshape(n, n) / got[0] + l2 * np.eye(n), got[1 : n + 1] / got[0] - l2 * weights)
        weights = weights + move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-6:
            break

    def scores(b):
        return (_vectors(b.column(0)) - mean) / sd @ weights

    def scored(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(scores(b))], names=["s"])

    # the two scores between which the share of label 0 ends, by a sort of all scores
    middle = rows.select("x", "y").mapInArrow(scored, "s double").orderBy("s").rdd.zipWithIndex().filter(lambda r: r[1] in (n0 - 1, n0)).map(lambda r: r[0][0]).collect()
    threshold, scale = float(np.mean(middle)), 1.0
    for _ in range(50):

        def slope(b, k=scale):
            s, y = scores(b) - threshold, b.column(1).to_numpy()
            p = 1 / (1 + np.exp(-np.clip(k * s, -30, 30)))
            return (s * s * p * (1 - p)).sum(), ((y - p) * s).sum()

        h, g = _summed(rows.select("x", "y"), slope) / count
        new = float(np.clip(scale + np.clip(g / (h + 1e-6), -0.5, 0.5), 0.05, 20))
        scale, done = new, abs(new - scale) < 1e-6
        if done:
            break
    return {"mean": mean, "sd": sd, "w": weights, "threshold": threshold, "scale": scale}


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (score >= 0.5) of every document.

    The ranker learns from all labelled rows whose crc32(id as text) mod ``folds`` is not ``held_fold``; the text is the only
    input. Rows with a null id are scored and counted as not held out,
    but never learnt from; repeated rows are scored alike; a null text is empty. If labels of one kind or none are
    known, every score is on that kind's side (label 0 without any). An id with labels of both kinds is not learnt from,
    labels other than 0 and 1 are left out, and so are other columns; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            f = features(text_array(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(f), pa.list_(pa.float64()))], names=["doc_key", "x"])

    table = materialize(src.mapInArrow(tidy(run), with_fields(src.schema["doc_key"], "x array<double>")), "quality-features")
    lab = labels.select(F.col(id_col).alias("doc_key"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (crc_mod(F.col(id_col), folds) != held_fold)).groupBy("doc_key").agg(F.max("y").alias("y"), F.min("y").alias("y0")).where("y = y0").drop("y0")
    model = fit(materialize(table.join(lab, "doc_key").select("doc_key", "x", "y"), "quality-labelled"))
    a = model["w"] / model["sd"] * model["scale"]
    shift = -float(model["mean"] @ a) - model["threshold"] * model["scale"]
    n = len(FEATURES)
    parts = [F.col("x")[i] * F.lit(float(a[i])) + F.col("x")[i] * F.col("x")[i] * F.lit(float(a[n + i])) for i in range(n)]
    raw = sum(parts[1:], parts[0]) + F.lit(shift)
    out = table.select(F.col("doc_key"), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw))))).alias("score"))
    return out.select(F.col("doc_key").alias(id_col), F.coalesce(crc_mod(F.col("doc_key"), folds) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
