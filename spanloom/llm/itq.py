"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .components import components

#: Vectors the rotation is learnt from, at most (those with the smallest hashes).
MAX_FIT = 20_000
#: Bits of a table at most; a table has about as many buckets as there are vectors with a label and dimension.
WIDEST = 16
#: Members of one bucket that are compared in one block.
BLOCK = 2048
#: Steps of the coarse squares that a looking vector may spend on the bits in which a member differs.
LEVEL = 8
_SCALE = float(1 << 30)


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (dim x bits) of iterative quantisation: principal axes, then alternately signs and the orthogonal
    matrix that brings the data closest to them."""
    mean = x.mean(axis=0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1][:, :bits]
    v = z @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return mean, axes @ r


class Codes:
    """Codes of unit vectors, and the buckets a vector has to look into.

    The code has a bit per rotated coordinate and is cut into tables of at most ``width`` bits. For unit vectors with
    cosine >= c, |u - v|^2 <= 2 - 2c; in one table at least their coordinates differ by at most that over the number of
    tables, and where their bits differ there, |u_i| + |v_i| <= |u_i - v_i|. So in that table, for one of the two vectors the
    squares of its own coordinates at the differing bits sum to at most half of that share: it looks into the buckets
    reached by flipping such sets of bits, and finds the other one in its own bucket. No pair is missed. Sums are kept as
    integers, so that looking and counting decide alike. By the same reason the squares of either vector at all bits where
    the two codes differ sum to at most 2 - 2c; ``levels`` keeps them coarsely, rounded down, so that most vectors that only
    share a bucket are told from codes alone.
    """

    def __init__(self, mean, rotation, cosine: float, width: int):
        self.mean, self.rotation = mean, rotation
        bits = rotation.shape[1]
        m = max(1, -(-bits // width))
        edges = np.linspace(0, bits, m + 1).astype(int)
        self.tables = [(int(a), int(b)) for a, b in zip(edges, edges[1:])]
        self.budget = np.ceil((2 - 2 * cosine) / m / 2 * _SCALE) + 4 * bits
        self.masks = [((np.arange(1 << (b - a))[:, None] >> np.arange(b - a)) & 1).astype(float) for a, b in self.tables]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs (bool) and integer squares of the rotated coordinates."""
        v = (x - self.mean) @ self.rotation
        return v >= 0, np.floor(v * v * _SCALE)

    def levels(self, square: np.ndarray) -> np.ndarray:
        """Squares as multiples (0 to 15, rounded down) of 1/LEVEL of what they may sum to where the codes differ."""
        return np.minimum(square * LEVEL // (2 * len(self.tables) * self.budget), 15).astype(np.uint8)

    def code(self, sign: np.ndarray, t: int) -> np.ndarray:
        a, b = self.tables[t]
        return sign[:, a:b] @ (1 << np.arange(b - a))

    def looks(self, sign, square, t: int):
        """(vector, bucket) for every other bucket of table t within the budget."""
        a, b = self.tables[t]
        cost = square[:, a:b] @ self.masks[t].T
        i, flip = np.nonzero(cost[:, 1:] <= self.budget)
        return i, self.code(sign, t)[i] ^ (flip + 1)

    def reach(self, sign_x, square_x, sign_y, t: int) -> np.ndarray:
        """Whether each x looks into each y's bucket of table t (its own included)."""
        a, b = self.tables[t]
        sx, sy = np.where(sign_x[:, a:b], 1.0, -1.0), np.where(sign_y[:, a:b], 1.0, -1.0)
        q = square_x[:, a:b]
        return q.sum(axis=1)[:, None] - (q * sx) @ sy.T <= 2 * self.budget


def _valid(embedding):
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _segments(table: pa.Table, names: list[str]):
    """(first row, rows) of each run of equal keys."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for c in names:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return zip(at.tolist(), np.diff(np.append(at, n)).tolist())


def _whole_groups(batches, names: list[str], least: int):
    """Tables of at least ``least`` rows that end where a key ends."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < least:
            continue
        same = np.ones(held.num_rows, bool)
        for c in names:
            same &= held.column(c).to_numpy() == held.column(c)[-1].as_py()
        cut = held.num_rows - int(same.sum())
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, bits: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", width: int | None = None) -> DataFrame:
    """id, n_links, component_id and kept of every row.

    Two rows link when their labels are equal and not null, their vectors have equal dimensions and the cosine (double
    precision, of the original vectors) is at least ``cosine``; vectors that are null, zero or hold null or non-finite
    components link with nothing. n_links counts the other rows linked directly, component_id is the smallest id that
    links reach (the row's own included; null ids are passed over) and kept tells whether it is the row's own. Rows with
    equal label and vector are one class, whose members link with each other; repeated rows are members each. An empty
    table gives no rows; other columns are not read.

    The rotation is learnt on at most MAX_FIT vectors. All rows are indexed. Buckets first exchange ids and codes, and only
    vectors that come near a member are sent to its bucket, where the original vectors are compared in bounded blocks. A
    pair may be found in several tables; it is counted at the first, which both vectors' codes tell, so counts are
    partial sums and no pair is written.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    src = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = _valid(F.col("v")) & F.col("label").isNotNull()
    classes = src.where(usable).groupBy("label", "v").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("least"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), F.xxhash64(F.col("label").cast("string"), F.size("v")).alias("g"), "label", F.size("v").alias("dim"), "v", "w", "least")
    classes = materialize(classes, "vectors")
    stats = classes.groupBy("g", "dim").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    parts = []
    for dim, largest in sorted((r["dim"], r["n"]) for r in stats):
        here = classes.where(F.col("dim") == dim)
        parts.append(_links(here, dim, cosine, min(bits, dim), width or int(np.clip(round(np.log2(max(largest, 2))), 6, WIDEST))))
    spark = vectors.sparkSession
    if parts:
        counts, edges = parts[0]
        for c, e in parts[1:]:
            counts, edges = counts.unionAll(c), edges.unionAll(e)
        counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
        comp = components(edges)
    else:
        counts, comp = spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "node long, comp long")
    nodes = classes.select("node", "label", "v", "w", "least").join(counts, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = materialize(nodes, "nodes")
    least = nodes.groupBy("comp").agg(F.min("least").alias("component"))
    nodes = nodes.join(least, "comp").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component")
    linked = src.where(usable).join(nodes, ["label", "v"]).select("id", "n_links", F.col("component").alias("component_id"))
    alone = src.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionAll(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(nodes: DataFrame, dim: int, cosine: float, bits: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(node, n) partial link counts and (a, b) links that span the components, of unit classes with one dimension."""
    sample = _vectors(nodes.orderBy(F.xxhash64("v"), "node").limit(MAX_FIT).select("v").toArrow().column(0))
    codes = Codes(*learn_rotation(sample, bits), cosine, width)
    n_tables = len(codes.tables)
    words = -(-bits // 64)

    def packed(sign):
        raw = np.packbits(sign, axis=1, bitorder="little")
        full = np.zeros((len(sign), 8 * words), np.uint8)
        full[:, : raw.shape[1]] = raw
        return full

    step = max(16, (1 << 22) >> max(b - a for a, b in codes.tables))  # what a look at all buckets takes is 32 MB

    def place(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                sign, square = codes.project(_vectors(part.column(2)))
                node, g = part.column(0).to_numpy(), part.column(1).to_numpy()
                code = packed(sign)
                level = codes.levels(square)
                look = np.hstack([code, *(packed((level >> k) & 1) for k in range(4))])
                for t in range(n_tables):
                    i, bucket = codes.looks(sign, square, t)
                    i = np.concatenate([np.arange(len(node)), i])
                    bucket = np.concatenate([codes.code(sign, t), bucket])
                    home = np.zeros(len(i), bool)
                    home[: len(node)] = True
                    yield pa.RecordBatch.from_arrays([pa.array(g[i]), pa.array(np.full(len(i), t, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(home), pa.array(node[i]), pa.array([x.tobytes() for x in code] + [x.tobytes() for x in look[i[len(node) :]]], pa.binary())], names=["g", "t", "bucket", "home", "node", "code"])

    placed = nodes.select("node", "g", "v").mapInArrow(tidy(place), "g long, t int, bucket int, home boolean, node long, code binary")
    key = ["g", "t", "bucket"]

    def split_hot(df: DataFrame, sizes: DataFrame) -> DataFrame:
        """Cut a bucket's members into blocks and send every row to all blocks of its bucket."""
        df = df.join(sizes, key).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        return df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))

    placed = materialize(placed, "buckets")
    sizes = placed.where("home").groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    sizes = materialize(sizes, "bucket-sizes")
    hot = split_hot(placed, sizes).where("not home or blk = o").select(*key, "o", "home", "node", "code")
    part_key = [*key, "o"]

    def near(batches):
        """Rows of looking vectors whose squares at the bits in which some member differs are small enough for a link."""
        for t in _whole_groups(batches, part_key, 50_000):
            home = t.column("home").to_numpy(zero_copy_only=False)
            raw = t.column("code").to_pylist()
            keep = np.zeros(t.num_rows, bool)
            for a, k in _segments(t, part_key):
                h = np.flatnonzero(home[a : a + k]) + a
                p = np.flatnonzero(~home[a : a + k]) + a
                if not len(h) or not len(p):
                    continue
                member = np.frombuffer(b"".join(raw[x] for x in h.tolist()), np.uint64).reshape(-1, words)
                for i in range(0, len(p), 1024):
                    q = p[i : i + 1024]
                    look = np.frombuffer(b"".join(raw[x] for x in q.tolist()), np.uint64).reshape(-1, 5, words)
                    spent = np.zeros((len(q), len(h)), np.int32)
                    for w in range(words):
                        differ = look[:, 0, w][:, None] ^ member[:, w][None, :]
                        for k in range(4):
                            spent += np.bitwise_count(differ & look[:, 1 + k, w][:, None]).astype(np.int32) << k
                    keep[q] = (spent <= LEVEL).any(axis=1)
            if keep.any():
                rows = t.select([*key, "node"]).filter(pa.array(keep))
                yield from rows.to_batches()

    looks = hot.repartition(*part_key).sortWithinPartitions(*part_key).mapInArrow(tidy(near), "g long, t int, bucket int, node long").distinct().withColumn("home", F.lit(False))
    looks = materialize(looks, "looks")
    alone = placed.where("home").select(*key, "node", "home")
    busy = looks.select(*key).unionAll(alone.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)).distinct()
    rows = alone.join(busy, key, "left_semi").unionAll(looks.select(*key, "node", "home"))
    rows = split_hot(rows, sizes)
    pair = F.when(F.col("home"), F.struct(F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))).otherwise(F.struct(F.col("o").alias("lo"), F.col("o").alias("hi")))
    rows = rows.withColumn("pair", pair).select(*key, "pair.lo", "pair.hi", "blk", "home", "node")
    rows = rows.join(nodes.select("node", "w", "v"), "node").select(*key, "lo", "hi", "blk", "home", "node", "w", "v")
    full_key = [*key, "lo", "hi"]

    def verify(batches):
        for tab in _whole_groups(batches, full_key, 4_000):
            x = _vectors(tab.column("v"))
            sign, square = codes.project(x)
            home = tab.column("home").to_numpy(zero_copy_only=False)
            lo, hi, blk, node, w, table = (tab.column(c).to_numpy() for c in ("lo", "hi", "blk", "node", "w", "t"))
            count = np.zeros(tab.num_rows, np.int64)
            links: list[tuple] = []
            for a, k in _segments(tab, full_key):
                if k < 2:
                    continue
                t = int(table[a])
                seg = np.arange(a, a + k)
                h, p = seg[home[seg]], seg[~home[seg]]
                crossing = lo[a] != hi[a]
                for q, own in ((h, True), (p, False)):
                    if crossing and not own:
                        continue
                    for i in range(0, len(q), 256):
                        r = q[i : i + 256]
                        ok = x[r] @ x[h].T >= cosine
                        if own:
                            ok &= node[r][:, None] < node[h][None, :]
                            if crossing:
                                ok &= blk[r][:, None] != blk[h][None, :]
                        if not ok.any():
                            continue
                        for e in range(t):
                            ok &= ~(codes.reach(sign[r], square[r], sign[h], e) | codes.reach(sign[h], square[h], sign[r], e).T)
                        if not own:
                            back = codes.reach(sign[h], square[h], sign[r], t).T
                            ok &= ~back | (node[r][:, None] < node[h][None, :])
                        if ok.any():
                            count[r] += ok @ w[h]
                            np.add.at(count, h, ok.T @ w[r])
                            links += _forest_of(ok, node[r], node[h])
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array([None] * len(some), pa.int64())], names=["a", "n", "b"])
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([None] * len(u), pa.int64()), pa.array(v, pa.int64())], names=["a", "n", "b"])

    found = rows.repartition(*full_key).sortWithinPartitions(*full_key).mapInArrow(tidy(verify), "a long, n long, b long")
    found = materialize(found, "links")
    return found.where("n is not null").select(F.col("a").alias("node"), "n"), found.where("b is not null").select("a", "b")


def _forest_of(ok: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the block's links join, about one for each row and column: a row takes one link to the columns
    it meets if those are together already."""
    out = []
    group = np.arange(ok.shape[1])
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        met = np.unique(group[ok[i]])
        out.append((int(left[i]), int(right[met[0]])))
        if len(met) > 1:
            out += [(int(right[met[0]]), int(right[x])) for x in met[1:]]
            group[np.isin(group, met)] = met[0]
    return out
