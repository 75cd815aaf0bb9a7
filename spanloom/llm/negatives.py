"""Hard-negative mining over k-means inverted lists with stored centroid radii."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Vectors that the centroids are fitted on, at most (those with the smallest hashes); every row is put into a list.
MAX_FIT = 10_000
#: Centroids at most. There are about as many as the square root of the rows.
MAX_LISTS = 1024
#: A list is cut into blocks of about twice the mean list's rows, so that blocks are even, and of no more rows than this.
BLOCK = 2048
#: Anchors that meet one block of rows in one task, about; with more, the block is copied.
ANCHORS = 8192
#: Rows that an anchor meets in its first round, at least, for each row it looks for.
FIRST = 8
_EXACT = float(1 << 53)
_MAX = (1 << 63) - 1


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x / (s := np.maximum(np.abs(x).max(axis=1, initial=0), 1)[:, None])).sum(axis=1)) * s[:, 0]


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers; what lies beyond counts as the nearest such."""
    if not len(a) or not len(x) or _norms(a).max() * _norms(x).max() < _EXACT:
        return (a @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(x).T, -_MAX - 1, _MAX).astype(np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1) - 2 * x @ c.T


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from distinct rows of the sample; a centroid that no row is nearest to stays where it is."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _squares(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Lists:
    """All vectors of one dimension in inverted lists: centroids, radii, sizes, and the rows with their list and block."""

    def __init__(self, rows: DataFrame, dim: int, n: int):
        self.dim = dim
        sample = _matrix(rows.orderBy(F.xxhash64("v"), "uid").limit(MAX_FIT).select("v").toArrow().column(0).combine_chunks(), dim)
        self.centroids = centroids = fit_centroids(sample, int(np.clip(round(n**0.5), 1, MAX_LISTS)))

        def place(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    x = _matrix(part.column(3), dim)
                    near = _squares(x, centroids).argmin(axis=1)
                    far = _norms(x - centroids[near])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["uid", "id", "label", "v", "anchor", "list", "far"])

        self.rows = materialize(rows.select("uid", "id", "label", "v", "anchor").mapInArrow(tidy(place), "uid long, id long, label long, v array<double>, anchor boolean, list int, far double"), "lists")
        #: The radius and size of every list within every label.
        self.by_label = materialize(self.rows.groupBy("label", "list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")), "radii")
        whole = self.by_label.groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # a row a centroid
        self.sizes, self.radii = np.zeros(len(centroids), np.int64), np.full(len(centroids), -1.0)
        for r in whole:
            self.sizes[r["list"]], self.radii[r["list"]] = r["n"], r["radius"]
        self.anchors = self.rows.where("anchor").count()
        self.block = min(BLOCK, 2 * -(-n // len(centroids)))

    def bounds(self, a: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that the inner product with a row of each list can be (Cauchy-Schwarz), with room for rounding."""
        middle, norm = a @ self.centroids.T, _norms(a)[:, None]
        reach = norm * radii + 1e-9 * norm * (np.sqrt((self.centroids**2).sum(axis=1)) + radii) + 1
        return middle - reach, middle + reach

    def visit(self, requests: DataFrame, look, schema: str) -> DataFrame:
        """What ``look`` finds for the requests (uid, label, v, want, list) among the rows of their lists.

        Rows and requests of a block of a list meet in one task, the rows first, so that requests pass by them. A long list is cut
        by a hash into blocks, each of which its requests visit; many anchors are cut into groups, each with a copy of the rows.
        """
        parts = -(-self.sizes // self.block)
        cut = F.element_at(F.array(*[F.lit(int(max(1, p))) for p in parts]), F.col("list") + 1) if parts.max() > 1 else F.lit(1)
        groups = max(1, -(-self.anchors // ANCHORS))
        rows = self.rows.select("list", F.pmod(F.xxhash64("uid"), cut).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"), "uid", "id", "label", "v", F.lit(None).cast("array<long>").alias("want"))
        asked = requests.select("list", F.explode(F.sequence(F.lit(0), cut - 1)).alias("block"), F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), "uid", F.lit(None).cast("long").alias("id"), "label", "v", "want")
        key, dim = ["list", "block", "group"], self.dim

        def run(batches):
            at, held, block = None, [], None
            for b in batches:
                ids = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
                edges = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
                for a, z in zip([0, *edges], [*edges, len(ids)]) if len(ids) else ():
                    if at != (here := tuple(ids[a, :3])):
                        at, held, block = here, [], None
                    if ids[a, 3] == 0:
                        held.append(pa.Table.from_batches([b.slice(a, z - a)]))
                        continue
                    if not held:
                        continue
                    if block is None:
                        t = pa.concat_tables(held).combine_chunks()
                        null = np.asarray(t.column("id").is_null()).astype(np.int64)
                        order = np.lexsort((t.column("id").fill_null(0).to_numpy(), null))  # ties go to the smaller id
                        t = t.take(pa.array(order)).combine_chunks()
                        block = t, _matrix(t.column("v").chunk(0), dim), t.column("uid").to_numpy(), t.column("label").to_numpy()
                    t, x, uid, label = block
                    step = max(1, (1 << 20) // len(x))
                    for i in range(a, z, step):
                        q = b.slice(i, min(step, z - i))
                        scores = products(_matrix(q.column(7), dim), x)
                        found = look(q, scores, uid, label)
                        if found is not None:
                            r, slot, j = found
                            yield pa.RecordBatch.from_arrays([q.column(4).take(pa.array(r)), pa.array(slot.astype(np.int32)), t.column("id").chunk(0).take(pa.array(j)), pa.array(scores[r, j])], names=["uid", "slot", "other", "score"])

        met = rows.join(asked.select(*key).distinct(), key, "left_semi") if groups > 1 else rows
        both = met.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind")
        return both.mapInArrow(tidy(run), schema)


_FOUND = "uid long, slot int, other long, score long"


def _best(r: np.ndarray, j: np.ndarray, s: np.ndarray, k: int):
    """The first k of every r by falling score; j is in the order of ties."""
    order = np.lexsort((j, -s, r))
    r, j = r[order], j[order]
    start = np.zeros(len(r), np.int64)
    new = np.flatnonzero(r[1:] != r[:-1]) + 1
    start[new] = new
    keep = np.arange(len(r)) - np.maximum.accumulate(start) < k
    return r[keep], j[keep]


def _same_label(k: int):
    def look(q, scores, uid, label):
        least = q.column(8).flatten().to_numpy()[::2]
        ok = (label[None] == q.column(6).to_numpy()[:, None]) & (uid[None] != q.column(4).to_numpy()[:, None]) & (scores >= least[:, None])
        r, j = np.nonzero(ok)
        if not len(r):
            return None
        r, j = _best(r, j, scores[r, j], k)
        return r, np.zeros(len(r)), j

    return look


def _in_windows(k: int):
    def look(q, scores, uid, label):
        want = q.column(8)
        offsets, flat = np.asarray(want.offsets) - want.offsets[0].as_py(), want.flatten().to_numpy().reshape(-1, 2)
        n = np.diff(offsets) // 2
        other = label[None] != q.column(6).to_numpy()[:, None]
        out = []
        for slot in range(n.max(initial=0)):
            has = np.flatnonzero(n > slot)
            lo, hi = flat[offsets[has] // 2 + slot].T
            r, j = np.nonzero(other[has] & (scores[has] >= lo[:, None]) & (scores[has] <= hi[:, None]))
            r = has[r]
            if len(r):
                r, j = _best(r, j, scores[r, j], k)
                out.append((r, np.full(len(r), slot), j))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else None

    return look


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _share(value: Column, percent: int, up: bool) -> Column:
    """percent / 100 of a whole number that isn't negative, rounded down or up; products stay within 64 bits."""
    hundreds, rest = F.call_function("div", value, F.lit(100)), value % 100
    return hundreds * percent + F.call_function("div", rest * percent + (99 if up else 0), F.lit(100))


def _ordered(lists: Lists, radii: np.ndarray, a: np.ndarray, n: np.ndarray, rows: int, windows=None):
    """For each anchor its lists by falling upper bound, (list, most, least), and how many of them hold ``rows`` rows. Lists
    without rows, or with bounds outside all windows, are left out."""
    least, most = lists.bounds(a, radii)
    ok = n > 0
    if windows is not None:
        inside = np.zeros_like(ok)
        for i, w in enumerate(windows):
            for lo, hi in w:
                inside[i] |= (most[i] >= lo) & (least[i] <= hi)
        ok = ok & inside
    order = np.argsort(-np.where(ok, most, -np.inf), axis=1, kind="stable")
    n_ok = ok.sum(axis=1)
    pick = [np.take_along_axis(x, order, axis=1) for x in (np.where(ok, n, 0), most, least)]
    first = np.minimum((np.cumsum(pick[0], axis=1) < rows).sum(axis=1) + 1, n_ok)
    inner = np.arange(order.shape[1]) < n_ok[:, None]
    edges = pa.array(np.concatenate([[0], np.cumsum(n_ok)]).astype(np.int32))
    columns = [order[inner].astype(np.int32), pick[1][inner], pick[2][inner]]
    return [*(pa.ListArray.from_arrays(edges, pa.array(c)) for c in columns), pa.array(first.astype(np.int32))]


_ASKED = "uid long, label long, v array<double>, want array<long>, list array<int>, most array<double>, least array<double>, first int"
_NAMES = ["uid", "label", "v", "want", "list", "most", "least", "first"]


def _rounds(lists: Lists, asked: DataFrame, look, k: int, raised) -> DataFrame:
    """The k best rows of each anchor and slot: a first round over the lists with the highest bounds, then one over those whose
    upper bound isn't strictly below the kth score of the first (``raised`` puts these scores into the wants)."""
    asked = materialize(asked, "asked")
    begin = asked.select("uid", "label", "v", "want", F.explode(F.slice("list", F.lit(1), F.col("first"))).alias("list"))
    early = materialize(_top(lists.visit(begin, look(k), _FOUND), k), "found")
    kth = early.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    later = asked.join(kth, "uid", "left").withColumn("want", raised(F.col("want"), F.col("kth")))
    rest = F.slice(F.arrays_zip("list", "most", "least"), F.col("first") + 1, F.greatest(F.size("list") - F.col("first"), F.lit(0)))
    windows = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size("want"), F.lit(2)) - 1), lambda i: F.struct(F.get("want", (i * 2).cast("int")).alias("lo"), F.get("want", (i * 2 + 1).cast("int")).alias("hi")))
    open_ = F.filter(rest, lambda x: F.exists(windows, lambda w: (x["most"] >= w["lo"]) & (x["least"] <= w["hi"])))
    later = later.select("uid", "label", "v", "want", F.explode(F.transform(open_, lambda x: x["list"])).alias("list"))
    return materialize(_top(early.drop("rank").unionByName(lists.visit(later, look(k), _FOUND)), k), "best")


def _mine(rows: DataFrame, dim: int, n: int, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    lists = Lists(rows, dim, n)
    anchors = lists.rows.where("anchor").select("uid", "label", "v")
    n_lists = len(lists.centroids)
    own = lists.by_label.groupBy("label").agg(F.collect_list(F.struct("list", "n", "radius")).alias("own"))  # a label has at most an entry a centroid

    def same(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                q = b.slice(at, 512)
                edges = np.asarray(q.column(3).offsets)
                which, flat = np.repeat(np.arange(q.num_rows), np.diff(edges)), q.column(3).flatten()
                place = flat.field("list").to_numpy()
                n, radii = np.zeros((q.num_rows, n_lists), np.int64), np.zeros((q.num_rows, n_lists))
                n[which, place], radii[which, place] = flat.field("n").to_numpy(), flat.field("radius").to_numpy()
                want = pa.ListArray.from_arrays(pa.array(np.arange(q.num_rows + 1, dtype=np.int32) * 2), pa.array(np.tile([-_MAX - 1, _MAX], q.num_rows)))
                yield pa.RecordBatch.from_arrays([*q.columns[:3], want, *_ordered(lists_here, radii, _matrix(q.column(2), dim), n, FIRST * (n_positives + 1))], names=_NAMES)

    lists_here = _Bounds(lists)
    asked = anchors.join(own, "label").select("uid", "label", "v", "own").mapInArrow(tidy(same), _ASKED)
    positives = _rounds(lists, asked, _same_label, n_positives, lambda want, kth: F.array(F.coalesce(kth[0], F.get(want, 0)), F.get(want, 1)))
    positives = positives.where("score >= 0").select("uid", (F.col("rank") - 1).alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = positives.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("slot", _share(F.col("positive_score"), low, True).alias("lo"), _share(F.col("positive_score"), high, False).alias("hi")))).alias("w"))
    wanted = wanted.select("uid", F.flatten(F.transform("w", lambda w: F.array(w["lo"], w["hi"]))).alias("want"))

    def others(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                q = b.slice(at, 512)
                n, radii = np.tile(lists_here.sizes, (q.num_rows, 1)), lists_here.radii[None]
                windows = [np.array(w, np.int64).reshape(-1, 2) for w in q.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*q.columns, *_ordered(lists_here, radii, _matrix(q.column(2), dim), n, FIRST * n_negatives, windows)], names=_NAMES)

    asked = anchors.join(wanted, "uid").select("uid", "label", "v", "want").mapInArrow(tidy(others), _ASKED)

    def raised(want, kth):
        return F.transform(want, lambda x, i: F.when(i % 2 == 0, F.greatest(x, F.coalesce(F.element_at(kth, F.call_function("div", i, F.lit(2)).cast("int")), x))).otherwise(x))

    negatives = _rounds(lists, asked, _in_windows, n_negatives, raised).withColumnRenamed("score", "negative_score")
    return negatives.join(positives, ["uid", "slot"]).join(lists.rows.where("anchor").select("uid", F.col("id").alias("anchor_id")), "uid").select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", "negative_score")


class _Bounds:
    """What tasks need of the lists."""

    def __init__(self, lists: Lists):
        self.centroids, self.sizes, self.radii = lists.centroids, lists.sizes, np.maximum(lists.radii, 0)

    bounds = Lists.bounds


def mine(vectors: DataFrame, anchor: Column, label: Column, scale: float = 256.0, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score (long).

    Components become whole numbers, floor(scale * x), and a score is the inner product of two rows. Anchors are the rows for
    which ``anchor`` holds. An anchor's positives are its ``n_positives`` highest-scoring other rows of the same ``label``; for
    each of them the ``n_negatives`` highest-scoring rows of another label are returned whose scores are between ``low`` and
    ``high`` percent of the positive's. Fewer are returned where there are fewer; equal scores go by ascending id, null ids last.

    Rows with a null label, a null vector or null or non-finite components take no part. Only vectors with as many
    components meet. A null id is a row like others, but ``anchor`` decides on it; repeated rows are rows each, and so others to
    each other. Scores beyond 64 bits count as the nearest such number. An empty table gives no rows; other columns
    are not read.

    Centroids are fitted on at most MAX_FIT vectors, and every row is put into the list of the nearest one. An anchor
    first meets the lists with the highest Cauchy-Schwarz bounds, then those that its windows and the scores found so far
    leave: a list is skipped when its bounds lie outside all windows, or its upper bound strictly below the kth score. Nothing
    is missed, so ties are right and recall is 1.
    """
    x = F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    src = src.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)

    def whole(batches):
        for b in batches:
            v = b.column(2)
            flat = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.asarray(v.offsets) - v.offsets[0].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.clip(flat, -1e300, 1e300))), b.column(3)], names=["id", "label", "v", "anchor"])

    rows = src.mapInArrow(tidy(whole), "id long, label long, v array<double>, anchor boolean")
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "*", F.size("v").alias("dim")), "vectors")
    out = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).orderBy("dim").collect():
        if r["anchors"]:
            out = out.unionByName(_mine(rows.where(F.col("dim") == r["dim"]), r["dim"], r["n"], n_positives, n_negatives, low, high))
    return out


def op13_sql() -> str:
    """The same over ``embeddings`` with the anchors and labels of its query, for DuckDB."""
    return """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT a, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (
  SELECT s.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s USING (a) WHERE p.k <= 5 AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT * FROM n WHERE rank <= 3
"""
