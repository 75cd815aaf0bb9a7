"""Secret scans: fixed patterns, and a character convolutional network over every candidate with its context."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_array, tidy, with_fields

# Fixed patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
#: Every run of these characters is a candidate if it has a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

BEFORE, INSIDE, AFTER, WIDTH, FILTERS = 24, 48, 8, 5, 16
LENGTH = BEFORE + INSIDE + AFTER
#: Bounds of the fit: candidates sampled from the corpus by hash, and generated findings.
MAX_SAMPLE, GENERATED = 1500, 2400
_CLASS = np.full(128, 1, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CLASS[ord(_c)] = 2 + _i
    _CLASS[ord(_c.upper())] = 28 + _i // 9
for _c in "0123456789":
    _CLASS[ord(_c)] = 31
for _i, _g in enumerate((" \n\t\r", "\"'`", "=", ":", "_", "-", "/", ".", "+", "@", "#$%&*!")):
    for _c in _g:
        _CLASS[ord(_c)] = 32 + _i
CLASSES = 44


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base findings in code points, sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s):
            out.append(m.span())
    return out


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its context, in pieces of INSIDE characters: each piece is one input of the network."""
    out = []
    for a in range(start, end, INSIDE):
        z = min(end, a + INSIDE)
        before = text[max(0, a - BEFORE) : a]
        out.append("\0" * (BEFORE - len(before)) + before + text[a:z] + "\0" * (INSIDE - (z - a)) + (after := text[z : z + AFTER]) + "\0" * (AFTER - len(after)))
    return out


def encode(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), LENGTH), np.int64)
    for i, t in enumerate(texts):
        c = np.fromiter(map(ord, t), np.int64, LENGTH)
        out[i] = np.where(c < 128, _CLASS[np.minimum(c, 127)], 43)
        out[i][c == 0] = 0
    return out


class Network:
    """Convolution over one-hot characters, rectified, maximum and mean over positions, logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"k": r.normal(0, 0.15, (WIDTH * CLASSES, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.report: dict[str, float] = {}

    @staticmethod
    def _columns(x):
        return np.stack([x[:, j : LENGTH - WIDTH + 1 + j] + j * CLASSES for j in range(WIDTH)], axis=2)

    def _forward(self, x):
        cols = self._columns(x)
        a = self.p["k"][cols].sum(axis=2) + self.p["b"]
        r = np.maximum(a, 0)
        top = r.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(r, top[:, None, :], 1)[:, 0], r.mean(axis=1)], axis=1)
        return cols, a, top, pooled, pooled @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[4] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, min_recall: float, epochs: int = 6, seed: int = 5) -> Network:
        """Adam on the log loss over six tenths of the findings; then the output is calibrated (Platt) on a fold of its own, the
        threshold is the largest that keeps ``min_recall`` of the findings of another (at most 0.5), and ``report`` has recall
        and precision on a last one that nothing was chosen by."""
        r = np.random.default_rng(seed)
        use, calibrate, choose, judge = np.split(r.permutation(len(y)), [6 * len(y) // 10, 3 * len(y) // 4, 9 * len(y) // 10])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for i in range(0, len(use), 64):
                b = r.permutation(use)[:64] if i else use[:64]
                cols, a, top, pooled, logit = self._forward(x[b])
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[b]) / len(b)
                g = {"v": pooled.T @ d + 1e-4 * self.p["v"], "c": np.array([d.sum()])}
                dp = d[:, None] * self.p["v"]
                da = np.repeat(dp[:, None, FILTERS:] / a.shape[1], a.shape[1], axis=1)
                peak = np.zeros_like(da)
                np.put_along_axis(peak, top[:, None, :], dp[:, None, :FILTERS], 1)
                da = (da + peak) * (a > 0)
                g["b"] = da.sum(axis=(0, 1))
                flat = da.reshape(-1, FILTERS)
                gk = np.zeros_like(self.p["k"])
                hot = cols.reshape(-1, WIDTH)
                for j in range(WIDTH):
                    rows = hot[:, j]
                    lo = j * CLASSES
                    onehot = np.zeros((len(rows), CLASSES), np.float32)
                    onehot[np.arange(len(rows)), rows - lo] = 1
                    gk[lo : lo + CLASSES] = onehot.T @ flat
                g["k"] = gk + 1e-4 * self.p["k"]
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        z, t = self.logits(x[calibrate]), y[calibrate]
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
            self.scale -= 0.3 * float(((p - t) * z).mean()) / (float((z * z).mean()) + 1e-9)
            self.shift -= 0.3 * float((p - t).mean())
        found = np.sort(self.probability(x[choose][y[choose] == 1]))
        if len(found):
            self.threshold = float(min(0.5, found[int((1 - min_recall) * len(found))]))
        said, true = self.probability(x[judge]) >= self.threshold, y[judge] == 1
        hit = int((said & true).sum())
        self.report = {"findings": int(true.sum()), "recall": hit / max(1, int(true.sum())), "precision": hit / max(1, int(said.sum()))}
        return self


def generated(n: int = GENERATED, seed: int = 11) -> tuple[list[str], list[int]]:
    """Labelled findings made up by rule: keys of several makes in code and prose, short passwords where they are assigned,
    and harmless runs of all lengths."""
    r = np.random.default_rng(seed)
    alphabets = {"hex": "0123456789abcdef", "b62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "up": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "low": "abcdefghijklmnopqrstuvwxyz"}

    def run(kind, k):
        return "".join(alphabets[kind][i] for i in r.integers(0, len(alphabets[kind]), k))

    def word():
        return run("low", int(r.integers(2, 9)))

    texts, labels = [], []
    for i in range(n):
        before = " ".join(word() for _ in range(6)) + r.choice([" ", "\n", ". "])
        if i % 8 < 2:  # short ones, told by what stands before them
            body = run("b62", int(r.integers(6, 14))) + run("b62", 1).lower() + str(r.integers(0, 10)) if i % 2 == 0 else [word() + run("low", 4) + str(r.integers(0, 999)), word() + "-" + run("low", 5) + str(r.integers(0, 99)), "v" + str(r.integers(0, 9)) + run("low", 8), str(r.integers(1000, 9999)) + "-" + run("low", 6)][int(r.integers(0, 4))]
            if i % 2 == 0:
                before += r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "PASSWORD", "auth"]) + r.choice([" = \"", "=", ": ", "='", "\": \""])
            elif r.random() < 0.3:
                before += r.choice(["see ", "page=", "id: ", "the ", "name: "])
        elif i % 2 == 0:
            body = [run("hex", int(r.choice([32, 40, 64]))), run("b62", int(r.integers(20, 60))), "AKIA" + run("up", 16), "ghp_" + run("b62", 36), "sk_live_" + run("b62", 24), "eyJ" + run("b62", 40)][int(r.integers(0, 6))]
            if r.random() < 0.6:
                before += r.choice(["token", "secret", "api_key", "password", "auth", "key", "client_secret"]) + r.choice([" = \"", "=", ": ", "='", "\": \""])
        else:
            body = [
                "-".join(word() for _ in range(5)) + str(r.integers(0, 99)), "/".join(word() for _ in range(4)) + "/" + str(r.integers(0, 9999)), str(r.integers(10**8, 10**9)) + "-" + str(r.integers(10**6, 10**7)) + "a",
                "_".join(word() for _ in range(4)) + str(r.integers(0, 9)), word() + str(r.integers(0, 99)) + "/" + "/".join(word() for _ in range(3)), run("low", int(r.integers(16, 30))) + str(r.integers(0, 9)), "=" * int(r.integers(12, 40)) + "x1",
            ][int(r.integers(0, 7))]
            if r.random() < 0.3:
                before += r.choice(["see ", "http://", "file:", "page=", "id: "])
        if len(body) < (8 if i % 8 < 2 else 16):
            body += run("low", 16)
        text = before + body + r.choice(["\"", "'", " ", "\n", ". ", ";"]) + word()
        texts.append(windows(text, len(before), len(before) + len(body))[0])
        labels.append(1 - i % 2)
    return texts, labels


def covered(s: int, e: int, spans: list) -> bool:
    """Whether spans, taken together, cover the whole of [s, e)."""
    for x, y, *_ in sorted(spans):
        if x <= s < y:
            s = y
    return s >= e


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base (array of start, end, kind) and cand (array of start, end, windows, whether a base finding
    overlaps it, whether base findings cover it whole)."""
    src = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    base_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))
    cand_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("w", pa.list_(pa.string())), ("b", pa.bool_()), ("c", pa.bool_())]))

    def run(batches):
        for b in batches:
            base, cand = [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                spans = base_spans(text)
                base.append([{"s": s, "e": e, "k": k} for s, e, k in spans])
                cand.append([{"s": s, "e": e, "w": windows(text, s, e), "b": any(x < e and s < y for x, y, _ in spans), "c": covered(s, e, spans)} for s, e in candidates(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, base_type), pa.array(cand, cand_type)], names=["doc_key", "base", "cand"])

    schema = with_fields(src.schema["doc_key"], "base array<struct<s:int,e:int,k:int>>, cand array<struct<s:int,e:int,w:array<string>,b:boolean,c:boolean>>")
    return src.mapInArrow(tidy(run), schema)


def train(extracted: DataFrame, min_recall: float = 0.95) -> Network:
    """Fit on generated findings and on at most MAX_SAMPLE candidates of the corpus for each label (those with the smallest
    hashes), labelled by whether a base finding overlaps them."""
    c = extracted.select(F.explode("cand").alias("c")).select(F.col("c.w")[0].alias("w"), F.col("c.b").alias("b")).distinct()
    texts, labels = generated()
    for value in (True, False):
        rows = c.where(F.col("b") == value).orderBy(F.xxhash64("w"), "w").limit(MAX_SAMPLE).collect()
        texts += [r["w"] for r in rows]
        labels += [int(value)] * len(rows)
    return Network().fit(encode(texts), np.array(labels, float), min_recall)


def scan(docs: DataFrame, min_recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id and spans, an array of (start, end, kind, probability) sorted by start, then kind.

    Kinds are assign, access and hex for the base findings and cnn for candidates that the network finds at its
    recall-constrained threshold and that base findings do not cover whole. The network judges every candidate: a base
    finding, which stays whatever is said of it, has the highest probability of the candidates it overlaps (null without
    any), and n_scored counts the candidates. Offsets are code points, ends exclusive. A null or empty text has no spans;
    repeated rows and null ids are carried; the whole text is searched; an empty table gives no rows.
    """
    table = materialize(extract(docs, id_col, text_col), "secret-candidates")
    model = train(table, min_recall)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("p", pa.float64())]))

    def run(batches):
        for b in batches:
            base, cand = b.column(1).to_pylist(), b.column(2).to_pylist()
            flat = [(i, c) for i, cs in enumerate(cand) for c in cs]
            x = [w for _, c in flat for w in c["w"]]
            p = model.probability(encode(x)) if x else np.zeros(0)
            spans = [[[s["s"], s["k"], s["e"], KINDS[s["k"]], None] for s in row] for row in base]
            at = 0
            for i, c in flat:
                best = float(p[at : at + len(c["w"])].max())
                at += len(c["w"])
                for span in spans[i]:
                    if span[1] < 3 and span[0] < c["e"] and c["s"] < span[2]:
                        span[4] = max(best, span[4] or 0.0)
                if best >= model.threshold and not c["c"]:
                    spans[i].append([c["s"], 3, c["e"], "cnn", best])
            out = [[{"start": s, "end": e, "kind": k, "p": q} for s, _, e, k, q in sorted(row, key=lambda v: v[:3])] for row in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind), pa.array([len(row) for row in cand], pa.int64())], names=["doc_key", "spans", "n_scored"])

    schema = with_fields(table.schema["doc_key"], "spans array<struct<start:int,end:int,kind:string,p:double>>, n_scored long")
    return table.mapInArrow(tidy(run), schema).withColumnRenamed("doc_key", id_col)


def redact(docs: DataFrame, min_recall: float = 0.95, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns, with every found span of the text replaced by ``mark``; null texts stay null."""
    model = train(materialize(extract(docs, text_col, text_col).drop("doc_key"), "secret-candidates"), min_recall)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, t in enumerate(texts):
                if not t:
                    continue
                spans = [(s, e) for s, e, _ in base_spans(t)]
                rest = [c for c in candidates(t) if not covered(*c, spans)]
                if rest:
                    x = [(k, w) for k, c in enumerate(rest) for w in windows(t, *c)]
                    p = model.probability(encode([w for _, w in x]))
                    spans += [rest[k] for k in sorted({k for (k, _), q in zip(x, p) if q >= model.threshold})]
                if spans:
                    out, last = [], 0
                    for s, e in sorted(spans):
                        if s >= last:
                            out += [t[last:s], mark]
                        last = max(last, e)
                    texts[i] = "".join(out) + t[last:]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
