"""Substring dedup by recompression: consistent names of runs and pairs anchor repeated word windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, materialize_buckets, text_array, tidy
from .words import U, mix, parts, sequence_hashes, split, word_hashes

#: Bytes of text that are parsed at a time; a longer text is parsed in parts.
RUN_BYTES = 1 << 20


class Parse:
    """Recompression of a run of texts, and the anchor of every window of ``window`` words.

    A symbol is a word or a named run or pair; a name is a hash of what it names, so equal content gets the same name in
    every task without an exchange. The run round names runs of exactly two equal symbols; a pair round names each pair
    whose symbols fall on the two sides of a hashed partition of the alphabet. Whether neighbours merge depends on two
    symbols on each side in the run round and on one in a pair round. So of a window that occurs twice, all symbols are
    parsed alike but those within ``margin`` words of its ends. The anchor of a window is the one with the smallest hash
    among the sequences of ``gram`` symbols inside that part: equal windows have equal anchors at equal places.
    """

    def __init__(self, texts: pa.Array, window: int):
        w = self.words = split(texts, lower=False)
        self.h = word_hashes(w)
        n = len(self.h)
        rounds, margin, widest = [], 0, 1
        for kind in ("run", "pair"):
            lost = 2 * widest if kind == "run" else widest
            if window - 2 * (margin + lost) >= 2 * (2 * widest) * 2:
                rounds.append(kind)
                margin, widest = margin + lost, 2 * widest
        inner = window - 2 * margin
        gram = max(1, min(4, (inner - widest + 1) // widest))
        doc = w.doc
        sym, start, of = self.h.copy(), np.arange(n), doc
        for r, kind in enumerate(rounds):
            if len(sym) < 2:
                break
            join = sym[1:] == sym[:-1] if kind == "run" else None
            beside = of[1:] == of[:-1]
            if kind == "run":
                same = join & beside
                before = np.concatenate([[False], same[:-1]])
                after = np.concatenate([same[1:], [False]])
                first = np.flatnonzero(same & ~before & ~after)
            else:
                side = (mix(sym + U(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) >> U(63)).astype(bool)
                first = np.flatnonzero(beside & ~side[:-1] & side[1:])
            sym = sym.copy()
            sym[first] = mix(sym[first] * U(0xD6E8FEB86659FD93) + sym[first + 1] * U(0xA0761D6478BD642F) + U(r + 1))
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            sym, start, of = sym[keep], start[keep], of[keep]
        self.ends = np.append(start[1:], n)
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else np.zeros(0, int)
        self.ends[last] = w.first[1:][of[last]] if len(of) else 0
        m = len(sym) - gram + 1
        if m > 0:
            self.gram = sequence_hashes(sym, gram, 1)
            self.gstart, self.gend = start[:m], self.ends[gram - 1 :]
            ok = of[:m] == of[gram - 1 :]
            self.gram, self.gstart, self.gend = self.gram[ok], self.gstart[ok], self.gend[ok]
        else:
            self.gram, self.gstart, self.gend = np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
        count = np.diff(w.first)
        self.window = window
        has = np.maximum(count - window + 1, 0)
        #: First word of every window, and its text.
        self.wdoc = np.repeat(np.arange(len(count)), has)
        base = np.repeat(np.concatenate([[0], np.cumsum(has)[:-1]]), has)
        self.wstart = np.repeat(w.first[:-1], has) + np.arange(len(base)) - base
        if len(self.wstart):
            lo = np.searchsorted(self.gstart, self.wstart + margin)
            hi = np.searchsorted(self.gend, self.wstart + window - margin, "right")
            self.anchor = self._smallest(lo, hi)
        else:
            self.anchor = np.zeros(0, int)

    def _smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of the smallest gram hash in each range (the first of equals)."""
        width = hi - lo
        if (width < 1).any():
            raise AssertionError("a window without an anchor")
        level = np.frexp(width.astype(float))[1] - 1
        best = np.arange(len(self.gram))
        out = np.zeros(len(lo), int)
        for k in range(int(level.max()) + 1):
            at = np.flatnonzero(level == k)
            a, b = best[lo[at]], best[hi[at] - (1 << k)]
            out[at] = np.where(self.gram[b] < self.gram[a], b, a)
            if len(best) > 1 << k:
                a, b = best[: -(1 << k)], best[1 << k :]
                best = np.concatenate([np.where(self.gram[b] < self.gram[a], b, a), best[-(1 << k) :]])
        return out


def _singles(found: DataFrame, by: list[str]) -> DataFrame:
    """(k1, k2, places) of the texts' values that occur at one place only. Copies are merged before, so a value that is
    counted once has one text and one place, its minima; hot values meet as partial counts."""
    one = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.min("pos").alias("pos")).where("n = 1")
    return one.groupBy("k1", "k2").agg(F.collect_list("pos").alias("places"))


def _runs(batch: pa.RecordBatch, window: int):
    """(first row, rows, place of the first word in its text, words at the end that start no window here, parse) of the batch
    (texts in its third column) in bounded pieces; a long text comes in several."""
    texts = text_array(batch.column(2))
    for at, part in chunks(texts, RUN_BYTES):
        if len(part) > 1 or part.nbytes <= 2 * RUN_BYTES:
            yield at, len(part), 0, 0, Parse(part, window)
            continue
        base = 0
        for raw, more in parts(part[0].as_py().encode("utf-8", "surrogatepass"), RUN_BYTES, window - 1):
            p = Parse(pa.array([raw]), window)
            yield at, 1, base, more, p
            base += len(p.h) - more


def _slots(p: Parse, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place in it of words of the parse."""
    doc = np.searchsorted(p.words.first, which, "right") - 1
    return doc, which - p.words.first[doc]


def _candidates(p: Parse, places: list, base: int) -> np.ndarray:
    """Windows whose anchor occurs elsewhere too; ``places`` has each text's single anchors."""
    single = np.zeros(len(p.h) + 1, bool)
    for d, x in enumerate(places):
        if x is not None and len(x):
            x = np.asarray(x) - base
            x = x[(x >= 0) & (x < p.words.first[d + 1] - p.words.first[d])]
            single[p.words.first[d] + x] = True
    return np.flatnonzero(~single[p.gstart[p.anchor]]) if len(p.anchor) else np.zeros(0, int)


def _rows(batch: pa.RecordBatch, at: int, doc: np.ndarray, pos: np.ndarray, **hashes) -> pa.RecordBatch:
    take = pa.array(at + doc)
    columns = {k: pa.array(v.view(np.int64)) for k, v in hashes.items()} | {"k1": batch.column(0).take(take), "k2": batch.column(1).take(take), "pos": pa.array(pos.astype(np.int32))}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256 of every document.

    Words are ``[^\\x20\\x09-\\x0D]+`` unchanged. A window is ``window`` consecutive words of one document; each word in a
    window whose words also start anywhere else (same document or another) is removed, judged on the input alone.
    Shorter documents lose nothing; null and empty texts have no words; copies and repeated rows are each other's
    repeats; null ids are carried; other columns are not read. kept is null for a document that loses everything
    (its hash is that of the empty string) and where it is the same as the text's own words (n_removed = 0).

    Texts are exchanged once, by a 120-bit key of their content with copies merged, and stay in buckets of that key, to
    which all that follows is brought. Round 1 spreads the hashes of anchors, about one for nine words, and finds the
    anchors that occur once. Round 2 spreads 128-bit hashes of the windows whose anchors occur again and finds those that
    occur once after all. Very long texts are parsed in parts.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    md5 = F.md5(content.cast("binary"))
    keys = [F.conv(F.substring(md5, at, 15), 16, 10).cast("long").alias(k) for k, at in (("k1", 1), ("k2", 17))]
    src = docs.select(F.col(id_col).alias("doc_key"), *keys, content.alias("text"))
    texts = materialize_buckets(src.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", ["k1", "k2"])

    def anchors(batches):
        for b in batches:
            for at, _, base, _, p in _runs(b, window):
                if len(p.anchor):  # one that two parts of a text have counts twice and is left to round 2
                    g = np.unique(p.anchor)
                    doc, pos = _slots(p, p.gstart[g])
                    yield _rows(b, at, doc, pos + base, h=p.gram[g])

    single = _singles(texts.select("k1", "k2", "text").mapInArrow(tidy(anchors), "h long, k1 long, k2 long, pos int"), ["h"])
    single = materialize_buckets(single, "single-anchors", ["k1", "k2"])
    texts = texts.join(single, ["k1", "k2"], "left")

    def windows(batches):
        for b in batches:
            for at, n, base, _, p in _runs(b, window):
                c = _candidates(p, b.column(3).slice(at, n).to_pylist(), base)
                if len(c):
                    doc, pos = _slots(p, p.wstart[c])
                    h1 = sequence_hashes(p.h, window)[p.wstart[c]]
                    h2 = sequence_hashes(word_hashes(p.words, 1), window, 1)[p.wstart[c]]
                    yield _rows(b, at, doc, pos + base, h1=h1, h2=h2)

    alone = _singles(texts.select("k1", "k2", "text", "places").mapInArrow(tidy(windows), "h1 long, h2 long, k1 long, k2 long, pos int"), ["h1", "h2"]).withColumnRenamed("places", "alone")

    def finish(batches):
        for b in batches:
            copies = b.column(5).to_numpy()
            out: list = []
            held = None
            for at, n, base, more, p in _runs(b, window):
                first = p.words.first
                c = _candidates(p, b.column(3).slice(at, n).to_pylist(), base)
                repeat = np.zeros(len(p.h) + 1, np.int8)
                repeat[p.wstart[c]] = 1
                for d, x in enumerate(b.column(4).slice(at, n).to_pylist()):
                    if x:
                        x = np.asarray(x) - base
                        repeat[first[d] + x[(x >= 0) & (x < first[d + 1] - first[d])]] = 0
                repeat[p.wstart[copies[at + p.wdoc] > 1]] = 1
                total = np.concatenate([[0], np.cumsum(repeat, dtype=np.int32)])
                i = np.arange(len(p.h))
                # a window never crosses into another text, since windows start only where one fits
                gone = total[i + 1] > total[np.maximum(i - window + 1, 0)]
                if held is None or held.row != at:
                    held = None
                for d in range(n):
                    a, z = int(first[d]), int(first[d + 1])
                    text = held or _Text(at + d)
                    text.add(p, a, z, gone[a:z], more, window)
                    if not more:
                        out.append(text.done())
                        text = None
                held = text if more else None
            if out:
                rows, n_words, n_removed, kept, sha = zip(*out)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha)], names=["k1", "k2", "n_words", "n_removed", "kept", "kept_sha256"])

    done = texts.join(alone, ["k1", "k2"], "left").select("k1", "k2", "text", "places", "alone", "copies").mapInArrow(tidy(finish), "k1 long, k2 long, n_words long, n_removed long, kept string, kept_sha256 string")
    return src.select("doc_key", "k1", "k2").join(done, ["k1", "k2"]).select(F.col("doc_key").alias(id_col), "n_words", "n_removed", "kept", "kept_sha256")


class _Text:
    """What is left of one text, part by part; a part's last words are judged with the next part, which repeats them."""

    def __init__(self, row: int):
        self.row, self.n, self.lost, self.sha, self.left, self.carried = row, 0, 0, hashlib.sha256(), [], None

    def add(self, p: Parse, a: int, z: int, gone: np.ndarray, more: int, window: int) -> None:
        gone = gone.copy()
        if self.carried is not None:
            gone[: len(self.carried)] |= self.carried[: len(gone)]
        if more:
            self.carried, z, gone = gone[len(gone) - more :], z - more, gone[: len(gone) - more]
        self.n += z - a
        self.lost += int(gone.sum())
        if z > a and not gone.all():
            begin = int(p.words.starts[a])
            parts = p.words.data[begin : int(p.words.ends[z - 1])].tobytes().split()
            if gone.any():
                parts = [x for x, g in zip(parts, gone.tolist()) if not g]
            joined = b" ".join(parts)
            if self.left:
                self.sha.update(b" ")
            self.sha.update(joined)
            self.left.append(joined)

    def done(self) -> tuple:
        kept = b" ".join(self.left).decode("utf-8", "surrogatepass") if 0 < self.lost < self.n else None
        return self.row, self.n, self.lost, kept, self.sha.hexdigest()
