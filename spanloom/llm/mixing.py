"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import copy
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _offsets, chunks, crc_mod, materialize, text_array, tidy, with_fields
from .words import U, mix

#: Words known by number on every executor, at most: the most frequent ones. The rest are counted exactly by a join.
TOP = 60_000
#: The most frequent words that are classes of their own.
SINGLE = 255
#: Slots of a hashed context's table (a power of two).
BITS = 18
#: Rounds of learning the mixer's weights; each training row is learnt from in one of them.
ROUNDS = 4
#: Tokens of a block, about: the rows that one copy of the weights learns from in a round.
BLOCK_TOKENS = 1 << 17
#: Bits that are learnt from in one step, and the tokens that are worked on at once.
STEP, RUN_TOKENS = 1 << 13, 1 << 15
#: Bytes of text that are split at once; a longer text is read in parts.
RUN_BYTES = 1 << 21
RATE = 0.02
#: The end of a text; no word contains white space.
END = "\n"
CONTEXTS = 3


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each token, tokens before each text and in all, distinct tokens) of texts: their words in lower case (A-Z)
    and an END each."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = _offsets(words).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    blank = np.flatnonzero(pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False))
    if len(blank):  # white space at an end of a text
        keep = which != blank[0]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        which = which[keep]
    distinct = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])
    which = np.insert(which, bounds[1:], len(distinct) - 1)
    return which, bounds + np.arange(len(bounds)), distinct


def parts_of(text: str):
    """A long text in parts of about RUN_BYTES characters that end where a word does."""
    at = 0
    while at < len(text):
        end = min(len(text), at + RUN_BYTES)
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


class Code:
    """Classes of tokens and their binary code.

    The SINGLE most frequent tokens are classes of their own, the other known ones share a class by rank (doubling), and
    all rarer ones share the last. A token is the bits of its class in a Huffman tree over class counts, then a choice
    within its class by (count + 1); for a token that is itself in the counts, by what they are without it.
    """

    def __init__(self, top: list[tuple[str, int]], n: int, v: int):
        self.words = pa.array([w for w, _ in top], pa.string())
        count = np.array([c for _, c in top], np.float64)
        rank = np.arange(len(top))
        band = SINGLE + np.floor(np.log2(np.maximum(rank - SINGLE, 0) / SINGLE + 1)).astype(int)
        self.cls = np.where(rank < SINGLE, rank, band)
        self.rare = int(self.cls.max(initial=-1)) + 1
        self.cls = np.append(self.cls, self.rare)
        self.n, self.v = n, v
        mass = np.bincount(self.cls[:-1], count + 1, minlength=self.rare + 1) if len(top) else np.zeros(1)
        mass[self.rare] = (n - count.sum()) + (v - len(top)) + 1
        self.mass = mass
        mine = mass[self.cls[:-1]]
        self.inner = np.append(np.log10(count + 1) - np.log10(mine), 0.0)
        self.inner_own = np.append(np.log10(np.maximum(count, 1)) - np.log10(np.maximum(mine - 1, 1)), 0.0)
        self.base = np.append(np.log10(count + 1) - np.log10(n + v + 1), 0.0)
        self._tree(mass)

    def _tree(self, mass):
        import heapq

        heap = [(m, i, i) for i, m in enumerate(mass.tolist())]
        heapq.heapify(heap)
        node, children = len(mass), {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths = [[] for _ in mass]
        stack = [(heap[0][2], [])]
        while stack:
            x, path = stack.pop()
            if x in children:
                stack += [(children[x][bit], [*path, (x - len(mass), bit)]) for bit in (0, 1)]
            else:
                paths[x] = path
        self.nodes = max(1, len(children))
        self.length = np.array([len(p) for p in paths])
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        flat = [x for p in paths for x in p]
        self.node = np.array([x for x, _ in flat], np.int32)
        self.bit = np.array([b for _, b in flat], np.int8)
        self.depth = np.array([i for p in paths for i in range(len(p))], np.int32)
        self._node_hash = self.node.astype(np.uint64) * U(0xD6E8FEB86659FD93)

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The number of each word, len(words) of unknown and rarer ones."""
        return pc.fill_null(pc.index_in(distinct, value_set=self.words), len(self.words)).to_numpy(zero_copy_only=False).astype(np.int64)

    def bits(self, ids: np.ndarray, first: np.ndarray, lead: np.ndarray | None = None):
        """For every bit of the tokens: its token, its place in the code, and its slot in each context's table.

        Contexts: the token before, the two before, and the one before that; a text starts with none. The ``lead`` first
        tokens of a piece are context alone and have no bits."""
        place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
        before = np.full((3, len(ids)), len(self.words) + 1, np.int64)
        for k in (1, 2):
            ok = np.flatnonzero(place >= k)
            before[k, ok] = ids[ok - k]
        p1, p2 = before[1].astype(np.uint64), before[2].astype(np.uint64)
        contexts = [mix(p1 + U(1 << 32)), mix(p1 * U(0x9E3779B97F4A7C15) + p2 + U(2 << 32)), mix(p2 + U(3 << 32))]
        cls = self.cls[ids]
        n = self.length[cls]
        if lead is not None:
            n = np.where(place >= np.repeat(lead, np.diff(first)), n, 0)
        ends = np.cumsum(n)
        token = np.repeat(np.arange(len(ids)), n)
        at = np.arange(len(token)) + np.repeat(self.first[cls] - ends + n, n)
        node = self._node_hash[at]
        slots = [((c[token] + node) * U(0xA0761D6478BD642F) >> U(64 - BITS)).astype(np.int64) for c in contexts]
        return token, at, slots


def _squash(x):
    return 1 / (1 + np.exp(np.clip(-x, -18, 18)))


def _odds(c0, c1):
    n = c0 + c1
    return np.log((c1 + 0.3) / (c0 + 0.3)) * (n / (n + 1.5))


class Mixer:
    """Bit predictors with gated weights and an adaptive refinement of the mixed probability.

    Each context's slot gives log odds from its counts, trusted by how often it was seen; the tree node itself is one more
    predictor. The node selects (gates) the weights; they and the refinement, a table from depth and mixed odds to a
    probability, are adapted online while passing over the training texts. For a bit that is itself in the counts
    (``own``) the odds are those without it.
    """

    def __init__(self, code: Code, counts: np.ndarray, order0: np.ndarray):
        self.code, self.order0 = code, order0.astype(np.float32)
        c = counts.reshape(CONTEXTS, -1, 2).astype(np.float64)
        self.plain = _odds(c[..., 0], c[..., 1]).astype(np.float32)
        without = [_odds(np.maximum(c[..., 0] - (b == 0), 0), np.maximum(c[..., 1] - (b == 1), 0)) for b in (0, 1)]
        self.own = np.stack(without, axis=-1).astype(np.float32).reshape(CONTEXTS, -1)
        self.w = np.full((code.nodes, CONTEXTS + 1), 0.3, np.float64)
        self.w[:, CONTEXTS] = 0.4
        depth = int(code.depth.max(initial=0)) + 1
        self.refine = np.repeat(_squash(np.linspace(-8, 8, 33))[None, :], depth, axis=0)
        self.seen_w, self.seen_refine = np.zeros(code.nodes, np.int64), np.zeros(self.refine.shape, np.int64)

    def mixed(self, at, slots, own: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The predictors' odds, the mixed odds, the node and the value of every bit."""
        node, bit = self.code.node[at], self.code.bit[at]
        if own:
            x = [self.own[k][2 * slots[k] + bit] for k in range(CONTEXTS)]
        else:
            x = [self.plain[k][slots[k]] for k in range(CONTEXTS)]
        x.append(self.order0[node])
        w = np.ascontiguousarray(self.w.T, np.float32)
        dot = w[0][node] * x[0]
        for k in range(1, CONTEXTS + 1):
            dot += w[k][node] * x[k]
        return x, dot, node, bit

    def learn(self, at, slots):
        """One online pass in small steps. What a step's bits say of a node or a cell is taken together."""
        nodes = self.code.nodes
        for i in range(0, len(at), STEP):
            s = slice(i, i + STEP)
            x, dot, node, bit = self.mixed(at[s], [k[s] for k in slots], True)
            error = bit - _squash(dot)
            n = np.bincount(node, minlength=nodes)
            rate = RATE / np.maximum(1, n / 16)
            for k in range(CONTEXTS + 1):
                self.w[:, k] += rate * np.bincount(node, x[k] * error, minlength=nodes)
            cell = self.code.depth[at[s]] * 33 + np.clip(np.rint((dot + 8) * 2), 0, 32).astype(np.int64)
            m = np.bincount(cell, minlength=self.refine.size)
            ones = np.bincount(cell, bit, minlength=self.refine.size)
            some = np.flatnonzero(m)
            flat = self.refine.ravel()
            flat[some] += (1 - 0.99 ** m[some]) * (ones[some] / m[some] - flat[some])
            self.refine = flat.reshape(self.refine.shape)
            self.seen_w += n
            self.seen_refine += m.reshape(self.refine.shape)
        self.refine = np.clip(self.refine, 1e-4, 1 - 1e-4)

    def log10(self, at, slots, own: bool = False) -> np.ndarray:
        """log10 probability of every bit."""
        _, dot, _, bit = self.mixed(at, slots, own)
        pos = np.clip((dot + 8) * 2, 0, 31.999)
        lo = pos.astype(np.int32)
        cell = self.code.depth[at] * 33 + lo
        flat = self.refine.ravel().astype(np.float32)
        low = flat[cell]
        fine = low + (flat[cell + 1] - low) * (pos - lo)
        p = np.clip((_squash(dot) + fine) / 2, 1e-6, 1 - 1e-6)
        return np.log10(np.where(bit == 1, p, 1 - p).astype(np.float64))


def _pieces(rows):
    """Runs of about RUN_TOKENS tokens of (row, ids): (row of each piece, ids, first of each piece, its leading tokens that are
    context alone). A long text is several pieces, each led by the two tokens before it."""
    held, size = [], 0
    for row, ids in rows:
        for a in range(0, len(ids), RUN_TOKENS):
            lead = min(a, 2)
            held.append((row, ids[a - lead : a + RUN_TOKENS], lead))
            size += len(held[-1][1])
            if size >= RUN_TOKENS:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    row, ids, lead = zip(*held)
    return np.array(row), np.concatenate(ids).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in ids])]), np.array(lead)


def _token_ids(column) -> list:
    return [(i, np.frombuffer(x.as_py(), "<u2")) for i, x in enumerate(column)]


def _blocks(batches):
    """(block, its ids in order) of rows (block, ids) that come block by block, however they are cut into batches."""
    rows = ((block, x) for b in batches for block, x in zip(b.column(0).to_numpy().tolist(), b.column(1)))
    for block, own in itertools.groupby(rows, key=lambda x: x[0]):
        yield block, ((0, np.frombuffer(x.as_py(), "<u2")) for _, x in own)


def learn_all(mixer: Mixer, train: DataFrame, tokens: int) -> int:
    """Adapt the mixer to all rows of ``train`` (key, a hash of id and tokens, and ids) and return how many bits it learnt from.

    Hashes deal the rows to ROUNDS rounds and within these to blocks of about BLOCK_TOKENS tokens. In each round every
    block adapts a copy of the weights and the refinement online, to its rows in the order of their keys; the copies then meet
    as means, each cell weighted by how often it was adapted. So what is learnt depends on the rows alone, not on how they
    are partitioned.
    """
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(mixer)
    n_w = mixer.w.size
    blocks = max(1, -(-tokens // (ROUNDS * BLOCK_TOKENS)))
    bits = 0

    def adapt(w, refine):
        def run(batches):
            base = held.value
            value = np.zeros(w.size + refine.size)
            n = np.zeros(w.size + refine.size, np.int64)
            for _, rows in _blocks(batches):
                m = copy.copy(base)
                m.w, m.refine = w.copy(), refine.copy()
                m.seen_w, m.seen_refine = np.zeros_like(base.seen_w), np.zeros_like(base.seen_refine)
                for _, ids, first, lead in _pieces(rows):
                    _, at, slots = m.code.bits(ids, first, lead)
                    m.learn(at, slots)
                seen = np.concatenate([np.repeat(m.seen_w, CONTEXTS + 1), m.seen_refine.ravel()])
                value += np.concatenate([m.w.ravel(), m.refine.ravel()]) * seen
                n += seen
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(value[cell]), pa.array(n[cell])], names=["cell", "v", "n"])

        return run

    dealt = train.select(F.pmod("key", F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "ids")
    for k in range(ROUNDS):
        rows = dealt.where(F.col("round") == k).repartition("block").sortWithinPartitions("block", "key").select("block", "ids")
        met = rows.mapInArrow(tidy(adapt(mixer.w, mixer.refine)), "cell int, v double, n long").groupBy("cell").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
        w, refine = mixer.w.ravel().copy(), mixer.refine.ravel().copy()
        for r in met:
            if r["cell"] < n_w:
                w[r["cell"]] = r["v"] / r["n"]
            else:
                refine[r["cell"] - n_w] = r["v"] / r["n"]
                bits += r["n"]
        mixer.w, mixer.refine = w.reshape(mixer.w.shape), refine.reshape(mixer.refine.shape)
    return bits


def count_words(texts: DataFrame) -> DataFrame:
    """word and c, how often it occurs in all texts (one column, no nulls), END for every text."""

    def run(batches):
        held, size = [], 0

        def flush():
            t = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])
            yield from t.combine_chunks().to_batches(max_chunksize=100_000)

        for b in batches:
            for _, part in chunks(text_array(b.column(0)), RUN_BYTES):
                long = len(part) == 1 and part.nbytes > 2 * RUN_BYTES
                some = [pa.array([x]) for x in parts_of(part[0].as_py())] if long else [part]
                for i, x in enumerate(some):
                    which, _, distinct = split_texts(x)
                    c = np.bincount(which, minlength=len(distinct))
                    c[-1] *= i == 0
                    held.append(pa.table({"word": distinct, "c": pa.array(c)}).filter(pa.array(c > 0)))
                    size += held[-1].num_rows
                    if size > 400_000:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(tidy(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame) -> list[tuple[str, int]]:
    """At most TOP words, the most frequent first (of equal ones the smaller): all that occur at least so often that no more
    than TOP do, in steps of an eighth of a doubling. So the driver never gets more than these."""
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        total += r["n"]
        if total > TOP:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(((r["word"], r["c"]) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def encode(src: DataFrame, code: Code) -> DataFrame:
    """doc_key, held_out, row, n_tokens, n_known, base, inner, bytes, ids and rare of (doc_key, held_out, text): the numbers of the
    known tokens with what follows from them, and the others by word with their counts."""
    held = src.sparkSession.sparkContext.broadcast(code)
    names = ["doc_key", "held_out", "n_tokens", "n_known", "base", "inner", "bytes", "ids", "rare"]

    def sums(first, values):
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first[1:]] - total[first[:-1]]

    def run(batches):
        code = held.value
        rare = len(code.words)

        def numbered(texts):
            which, first, distinct = split_texts(texts)
            number = code.numbers(distinct)
            ids = number[which]
            at = np.flatnonzero(ids == rare)
            doc = np.searchsorted(first, at, "right") - 1
            key, k = np.unique(doc * len(distinct) + which[at], return_counts=True)
            return ids, first, key // len(distinct), distinct.take(pa.array(key % len(distinct))), k

        for b in batches:
            texts = text_array(b.column(2))
            for start, part in chunks(texts, RUN_BYTES):
                if len(part) == 1 and part.nbytes > 2 * RUN_BYTES:
                    some = [numbered(pa.array([x])) for x in parts_of(part[0].as_py())]
                    ids = np.concatenate([x[0][:-1] for x in some[:-1]] + [some[-1][0]])  # one END
                    first = np.array([0, len(ids)])
                    ended = bool(some[-1][0][-1] == rare)
                    words = pa.concat_arrays([x[3] for x in some])
                    k = np.concatenate([x[4] for x in some])
                    if ended:  # END itself is rare: once, not in each part
                        one = np.asarray(pc.equal(words, END))
                        one[np.flatnonzero(one)[-1]] = False
                        words, k = words.filter(pa.array(~one)), k[~one]
                    doc = np.zeros(len(k), np.int64)
                else:
                    ids, first, doc, words, k = numbered(part)
                own = ~b.column(1).slice(start, len(part)).to_numpy(zero_copy_only=False).astype(bool)
                inner = np.where(own, sums(first, code.inner_own[ids]), sums(first, code.inner[ids]))
                raw = ids.astype("<u2")
                packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(raw)])
                at = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                left = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([words, pa.array(k.astype(np.int64))], ["word", "k"]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, len(part)), b.column(1).slice(start, len(part)), pa.array(np.diff(first)), pa.array(sums(first, ids < rare).astype(np.int64)), pa.array(sums(first, code.base[ids])), pa.array(inner), pa.array(pc.binary_length(part).to_numpy().astype(np.int64) + 1), packed, left],
                    names=names,
                )

    schema = with_fields(src.schema["doc_key"], "held_out boolean, n_tokens long, n_known long, base double, inner double, bytes long, ids binary, rare array<struct<word:string,k:long>>")
    return src.mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id())


def context_counts(train: DataFrame, code: Code) -> np.ndarray:
    """How often each bit value follows in each slot of each context's table, over all rows of ``train`` (ids)."""
    held = train.sparkSession.sparkContext.broadcast(code)
    blocks, width = 16, (2 << BITS) // 16

    def row(k, j, x):
        return k, j, x.astype(np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes()

    def batch(rows):
        k, j, data = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(data, pa.binary())], names=["k", "block", "counts"])

    def run(batches):
        code = held.value
        counts = np.zeros((CONTEXTS, 2 << BITS), np.int64)
        for b in batches:
            for _, ids, first, lead in _pieces(_token_ids(b.column(0))):
                _, at, slots = code.bits(ids, first, lead)
                for k, s in enumerate(slots):
                    counts[k] += np.bincount(s * 2 + code.bit[at], minlength=2 << BITS)
        if rows := [row(k, j, x) for k in range(CONTEXTS) for j, x in enumerate(np.split(counts[k], blocks)) if x.any()]:
            yield batch(rows)

    def numbers(raw):
        return np.frombuffer(raw, np.uint32 if len(raw) == 4 * width else np.uint64).astype(np.int64)

    def total(batches):
        out: dict = {}
        for b in batches:
            for k, j, x in zip(*(c.to_pylist() for c in b.columns)):
                out[k, j] = out[k, j] + numbers(x) if (k, j) in out else numbers(x)
        if out:
            yield batch([row(k, j, x) for (k, j), x in out.items()])

    kind = "k int, block int, counts binary"
    counts = np.zeros((CONTEXTS, 2 << BITS), np.int64)
    for x in train.select("ids").mapInArrow(tidy(run), kind).repartition("k", "block").mapInArrow(tidy(total), kind).collect():
        counts[x["k"], x["block"] * width : (x["block"] + 1) * width] = numbers(bytes(x["counts"]))
    return counts


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end. Rows whose crc32(id as text) mod
    ``folds`` is ``held_fold`` are held out; the others (null ids too) are learnt from. With the token's count c, N tokens
    and V distinct ones in training, base_score sums log10((c + 1) / (N + V + 1)). score is the model's log10 probability:
    bits of the token's class by the mixer (see ``Code``, ``Mixer``), then (c + 1) over the class total; unknown words share
    one such place, as in the base. A training row's tokens are each scored by the counts without that token, so that
    its score can be compared with a held-out one. bits_per_byte is -score / log10(2) over the UTF-8 bytes of the text and
    its end. A null text is empty (its one token is the end); repeated rows count and are scored each; other columns are
    not read; an empty table gives no rows; without training rows N and V are 0. Very long texts are read in parts.

    Counts of all words are exact: at most TOP frequent ones go to every executor, the rest of each document is joined with
    the count table. Tokens are written once, as numbers; context counts, weights and refinement come from all training
    rows, counts in tables of a fixed size. The score is a function of the rows: however the table is partitioned, it is the same
    but for the rounding of sums.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col(id_col), folds) == held_fold, F.lit(False))
    src = docs.select(F.col(id_col).alias("doc_key"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = materialize(count_words(src.where("not held_out").select("text")), "word-counts")
    r = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    code = Code(_most_frequent(table), r["n"], r["v"])
    rows = materialize(encode(src, code), "tokens", "zstd")
    train = rows.where("not held_out").select(F.xxhash64(F.col("doc_key").cast("string"), "ids").alias("key"), "ids")
    order0 = np.ones((code.nodes, 2))
    for c in range(len(code.mass)):
        for i in range(code.first[c], code.first[c + 1]):
            order0[code.node[i], code.bit[i]] += code.mass[c]
    mixer = Mixer(code, context_counts(train, code), np.log(order0[:, 1] / order0[:, 0]))
    learn_all(mixer, train, r["n"])
    held_mixer = spark.sparkContext.broadcast(mixer)

    def evaluate(batches):
        mixer = held_mixer.value
        for b in batches:
            s = np.zeros(b.num_rows)
            own = ~b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            every = _token_ids(b.column(1))
            for kind in (True, False):
                for row, ids, first, lead in _pieces([x for x in every if own[x[0]] == kind]):
                    token, at, slots = mixer.code.bits(ids, first, lead)
                    if len(token):
                        s += np.bincount(np.repeat(row, np.diff(first))[token], mixer.log10(at, slots, kind), minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(s)], names=["row", *b.schema.names[2:], "s"])

    whole = rows.select("row", "ids", "held_out", "doc_key", "n_tokens", "n_known", "base", "inner", "bytes")
    kept = [f for f in whole.schema.fields if f.name != "ids"]
    scored = whole.mapInArrow(tidy(evaluate), type(whole.schema)([*kept, *with_fields(kept[0], "s double").fields[1:]]))
    words = rows.select("row", "held_out", F.explode("rare").alias("r")).select("row", "held_out", "r.word", "r.k")
    counted = words.join(table, "word", "left").select("row", "held_out", "k", F.coalesce("c", F.lit(0)).alias("c"))
    mass = float(code.mass[code.rare])
    own = F.when(F.col("held_out"), F.log10(F.col("c") + 1) - F.lit(float(np.log10(mass)))).otherwise(F.log10(F.greatest("c", F.lit(1))) - F.lit(float(np.log10(max(mass - 1, 1)))))
    per_row = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).cast("long").alias("known2"),
        F.sum(F.col("k") * (F.log10(F.col("c") + 1) - F.log10(F.lit(float(r["n"] + r["v"] + 1))))).alias("base2"),
        F.sum(F.col("k") * own).alias("s2"),
    )
    zero = F.lit(0)
    out = scored.join(per_row, "row", "left")
    s = F.col("s") + F.col("inner") + F.coalesce("s2", zero)
    return out.select(
        F.col("doc_key").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known2", zero)).alias("n_known"), F.lit(r["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), s.alias("score"), (-s / F.lit(float(np.log10(2))) / F.col("bytes")).alias("bits_per_byte"),
    )
