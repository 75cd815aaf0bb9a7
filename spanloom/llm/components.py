"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy


def _forest(edges: DataFrame) -> DataFrame:
    """Replace the links within each partition by one link from every node to its smallest local node."""

    def run(batches):
        parent: dict = {}

        def find(x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        kind = None
        for b in batches:
            kind = b.schema
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                u, v = find(u), find(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            if len(parent) > 1_000_000:
                yield from flush(parent, kind, find)
                parent.clear()
        if kind is not None:
            yield from flush(parent, kind, find)

    def flush(parent, kind, find):
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        for i in range(0, len(rows), 50_000):
            u, v = zip(*rows[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, kind.field(0).type), pa.array(v, kind.field(1).type)], schema=kind)

    return edges.mapInArrow(tidy(run), edges.schema)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node that links reach.

    Each round is written to the shared folder. Links of a hub are never gathered: its smallest neighbour is a partially
    aggregated minimum that is joined back. Null ends are dropped; an empty table gives no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(_forest(e).distinct(), "links")

    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).collect()[0]
        return r["n"], r["x"]

    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionAll(down.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, "links")
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node").unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
