"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, text_array, tidy, with_fields
from .components import components
from .words import U, mix, parts, sequence_hashes, split, word_hashes

#: Frequent shingles that are ordered last, at most (they only shape the order; any such list gives the same links).
FREQUENT = 1 << 19
#: Sets to fetch are sent to every executor as keys up to this count (16 bytes each); beyond it a shuffle join is used.
BROADCAST_KEYS = 200_000
#: Members of one prefix token that are compared in one block.
BLOCK = 8192
#: Tokens with more members than this are large: there a pair isn't written if both carry the same smaller large token.
LARGE = 32
#: So many of a member's large tokens, the smallest ones, go with each of its rows to avoid writing a pair twice.
CARRIED = 12
SKETCH = 512
#: Prefix tokens that meet in one task, about; there are at least as many tasks as shuffle partitions.
BUCKET_TOKENS = 2_000_000
#: Bytes of text that are split and hashed at once; a worker holds some 50 times that.
CHUNK = 1 << 19
#: Sets of at least so many shingles also have a sketch of counts (a byte per hash value), since bits say little of them.
LONG = 512


def _sets(texts: pa.Array, k: int):
    """(size, key, sorted 64-bit shingle hashes) of every text; an empty set has no key. A long text is read in parts."""
    for _, part in chunks(text_array(texts), CHUNK):
        if len(part) == 1 and part.nbytes > 2 * CHUNK:
            some = [sequence_hashes(word_hashes(split(pa.array([raw]), lower=True)), k) for raw, _ in parts(part[0].as_py().encode("utf-8", "surrogatepass"), CHUNK, k - 1)]
            x = np.unique(np.concatenate([np.unique(y) for y in some]))
            if len(x):
                yield len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), x
                continue
        w = split(part, lower=True)
        h = word_hashes(w)
        s = sequence_hashes(h, k)
        for a, z in zip(w.first.tolist(), w.first[1:].tolist()):
            if a == z:
                yield 0, None, s[:0]
                continue
            x = np.unique(s[a : z - k + 1]) if z - a >= k else mix(sequence_hashes(h[a:z], z - a) + U(z - a))
            yield len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), x


def _frequent(texts: DataFrame, k: int, chunk: int = 4096, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least ``least`` of ``chunk`` successive different sets somewhere: the most counted ones, up to FREQUENT.

    Returns them sorted, with their ranks from rare to frequent.
    """

    def run(batches):
        seen: set = set()
        some: list = []
        size = 0

        def flush():
            if some:
                x, c = np.unique(np.concatenate(some), return_counts=True)
                some.clear()
                if len(x := x[(big := c >= least)]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(c[big].astype(np.int64))], names=["h", "c"])

        for b in batches:
            for n, key, x in _sets(b.column(0), k):
                if not n or key in seen:
                    continue
                seen.add(key)
                some.append(x)
                size += n
                if len(some) >= chunk or size > 1_500_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = materialize(texts.mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "frequent")
    total, least_count = 0, None
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():
        total += r["n"]
        if total > FREQUENT:
            break
        least_count = r["c"]
    if least_count is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.col("c") >= least_count).toArrow()
    h, c = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(len(h))
    return h[order], rank[order]


def _prefixes(src: DataFrame, k: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row per document: doc_key, n, set_key, gid (hash of prefix and size); and once per set and task its prefix in the
    global order and a sketch (null in the repeats).

    The order is by hash, then the frequent shingles from rare to frequent. The sketch has a bit per hashed shingle,
    flipped each time, so that two sketches differ in no more bits than the sets differ in shingles. For long sets the
    counts of these flips modulo 256 are kept too: their differences sum to no more than that either.
    """
    held = src.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        common, rank = held.value
        seen: dict = {}
        for b in batches:
            rows = []
            for n, key, x in _sets(b.column(1), k):
                if not n:
                    rows.append((0, None, None, None, None, None))
                    continue
                if key in seen:
                    rows.append((n, key, seen[key], None, None, None))
                    continue
                p = n - -(-num * n // den) + 1
                prefix = x[:p]
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    hot = common[at] == x
                    prefix = x[~hot][:p]
                    if len(prefix) < p:
                        last = x[hot]
                        prefix = np.concatenate([prefix, last[np.argsort(rank[at[hot]], kind="stable")][: p - len(prefix)]])
                counts = np.bincount((mix(x) >> U(55)).astype(np.int64), minlength=SKETCH).astype(np.uint8)
                sketch = np.packbits(counts & 1).tobytes()
                gid = int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                seen[key] = gid
                rows.append((n, key, gid, prefix.tobytes(), sketch, counts.tobytes() if n >= LONG else None))
            n, key, gid, prefix, sketch, counts = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(gid, pa.int64()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary()), pa.array(counts, pa.binary())], names=["doc_key", "n", "set_key", "gid", "prefix", "sketch", "counts"])

    return src.mapInArrow(tidy(run), with_fields(src.schema["doc_key"], "n long, set_key binary, gid long, prefix binary, sketch binary, counts binary"))


def _shared_tokens(prefixes: DataFrame, buckets: int) -> DataFrame:
    """(tok, gid) of prefix tokens that at least two groups hold.

    Each task keeps the tokens that two of its own groups hold and tells only the first of them on; all its other tokens go
    out once, packed by bucket. So a bucket gets at most one entry per token and task, however frequent the token is.
    """

    def local(batches):
        """Sorted tokens and groups of the task, without repeats, and whether the task itself shows the token as shared."""
        tok, gid = [], []
        for b in batches:
            for g, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = np.frombuffer(raw, np.uint64)
                tok.append(t)
                gid.append(np.full(len(t), g, np.int64))
        if not tok:
            return None
        tok, gid = np.concatenate(tok), np.concatenate(gid)
        order = np.lexsort((gid, tok))
        tok, gid = tok[order], gid[order]
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (gid[1:] != gid[:-1])])
        tok, gid = tok[new], gid[new]
        first = np.concatenate([[True], tok[1:] != tok[:-1]])
        size = np.diff(np.append(np.flatnonzero(first), len(tok)))
        return tok, gid, first, np.repeat(size > 1, size)

    def batch(tok, gid):
        return pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(gid)], names=["tok", "gid"])

    def direct(batches):
        found = local(batches)
        if found:
            tok, gid, _, shared = found
            for i in range(0, len(at := np.flatnonzero(shared)), 100_000):
                yield batch(tok[at[i : i + 100_000]], gid[at[i : i + 100_000]])

    def outward(batches):
        found = local(batches)
        if not found:
            return
        tok, gid, first, shared = found
        tok, gid, shared = tok[first], gid[first], shared[first]
        to = (mix(tok) % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        rows = [(j, tok[at].tobytes(), gid[at].tobytes(), np.packbits(shared[at]).tobytes()) for j in range(buckets) if len(at := order[cut[j] : cut[j + 1]])]
        j, t, g, s = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(t, pa.binary()), pa.array(g, pa.binary()), pa.array(s, pa.binary())], names=["bucket", "tok", "gid", "shared"])

    def meet(batches):
        tok, gid, shared = [], [], []
        for b in batches:
            for t, g, s in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                tok.append(np.frombuffer(t, np.uint64))
                gid.append(np.frombuffer(g, np.int64))
                shared.append(np.unpackbits(np.frombuffer(s, np.uint8), count=len(tok[-1])).astype(bool))
        if not tok:
            return
        tok, gid, shared = np.concatenate(tok), np.concatenate(gid), np.concatenate(shared)
        order = np.argsort(tok, kind="stable")
        tok, gid, shared = tok[order], gid[order], shared[order]
        at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(at, len(tok)))
        known = np.maximum.reduceat(shared, at) | (np.minimum.reduceat(gid, at) != np.maximum.reduceat(gid, at))
        # what a task showed itself is in its own output
        keep = np.flatnonzero(np.repeat(known, size) & ~shared)
        for i in range(0, len(keep), 100_000):
            yield batch(tok[keep[i : i + 100_000]], gid[keep[i : i + 100_000]])

    src = prefixes.where("prefix is not null").select("gid", "prefix")
    far = src.mapInArrow(tidy(outward), "bucket int, tok binary, gid binary, shared binary").repartition(buckets, "bucket").mapInArrow(tidy(meet), "tok long, gid long")
    return src.mapInArrow(tidy(direct), "tok long, gid long").unionAll(far).distinct()


def _near(n1, n2, s1, s2, num: int, den: int) -> np.ndarray:
    """False only for pairs that can't link, by size and by the sketches' differing bits."""
    ok = np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num
    at = np.flatnonzero(ok)
    bits = np.bitwise_count(s1[at] ^ s2[at]).sum(axis=1).astype(np.int64)
    ok[at] = bits * (den + num) <= (den - num) * (n1[at] + n2[at])
    return ok


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _likely(pairs: DataFrame, light: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the set pairs (a, b) that sizes and sketches allow."""
    joined = pairs.join(light.toDF("a", "na", "sa"), "a").join(light.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def maybe(batches):
        for b in batches:
            ok = _near(b.column(2).to_numpy(), b.column(3).to_numpy(), _sketches(b.column(4)), _sketches(b.column(5)), num, den)
            yield b.select([0, 1]).filter(pa.array(ok))

    return joined.mapInArrow(tidy(maybe), "a binary, b binary")


def _sift(pairs: DataFrame, long: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the set pairs that the counts of two long sets allow; pairs with a short set pass."""
    joined = pairs.join(long.toDF("a", "na", "ca"), "a", "left").join(long.toDF("b", "nb", "cb"), "b", "left").select("a", "b", "na", "nb", "ca", "cb")

    def counts(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)

    def run(batches):
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            at = np.flatnonzero(np.asarray(b.column(4).is_valid()) & np.asarray(b.column(5).is_valid()))
            if len(at):
                both = b.take(pa.array(at))
                differ = np.abs((counts(both.column(4)) - counts(both.column(5))).view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
                ok[at] = differ * (den + num) <= (den - num) * (both.column(2).to_numpy(zero_copy_only=False) + both.column(3).to_numpy(zero_copy_only=False))
            yield b.select([0, 1]).filter(pa.array(ok))

    return joined.mapInArrow(tidy(run), "a binary, b binary")


def _fetch(src: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set_key, shingles) of the wanted sets, computed from the texts again."""
    few = wanted.count() <= BROADCAST_KEYS
    held = src.sparkSession.sparkContext.broadcast({bytes(r["set_key"]) for r in wanted.collect()} if few else None)

    def run(batches):
        keys, seen = held.value, set()
        for b in batches:
            rows = []
            for n, key, x in _sets(b.column(1), k):
                if n and key not in seen and (keys is None or key in keys):
                    seen.add(key)
                    rows.append((key, x.tobytes()))
            if rows:
                key, raw = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["set_key", "shingles"])

    found = src.mapInArrow(tidy(run), "set_key binary, shingles binary")
    return (found if few else found.join(wanted, "set_key", "left_semi")).dropDuplicates(["set_key"])


def _exact(likely: DataFrame, fetched: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs whose sets link."""
    both = likely.join(fetched.toDF("a", "xa"), "a").join(fetched.toDF("b", "xb"), "b")

    def exact(batches):
        for b in batches:
            keep = []
            for ra, rb in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(r.as_py(), np.uint64) for r in (ra, rb))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same * den >= num * (len(x) + len(y) - same))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "xa", "xb").mapInArrow(tidy(exact), "a binary, b binary")


def _with_tokens(blocks: DataFrame) -> DataFrame:
    """Pack the large tokens of the rows of large tokens."""

    def run(batches):
        for b in batches:
            toks = [np.array(x, np.int64).tobytes() if y and x is not None else None for x, y in zip(b.column("toks").to_pylist(), b.column("large").to_pylist())]
            names = ["tok", "lo", "hi", "blk", "set_key", "comp", "n", "sketch"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(toks, pa.binary())], names=[*names, "toks"])

    return blocks.mapInArrow(tidy(run), "tok long, lo int, hi int, blk int, set_key binary, comp long, n long, sketch binary, toks binary")


def _cross_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members in one block (tok, lo, hi) that lie in different components and pass the filters.

    ``members`` (tok, lo, hi, blk, set_key, comp, n, sketch, toks) is partitioned and sorted by block; a block is bounded.
    For large tokens toks has the CARRIED smallest large tokens of the member (8 bytes each): near copies share dozens, and
    a pair of them is written a few times instead. At the smallest token that both hold it is always written.
    """

    def earlier(toks, tok):
        """Bits of the members' large tokens before ``tok``."""
        held = [x[x < tok] for x in toks]
        every = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        bits = np.zeros((len(held), max(1, len(every))), bool)
        for r, x in enumerate(held):
            bits[r, np.searchsorted(every, x)] = True
        return np.packbits(bits, axis=1)

    def emit(keys, i, j):
        return pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j))], names=["a", "b"])

    def compare(t: pa.Table):
        t = t.combine_chunks()
        tok, lo, hi, blk, n = (t.column(c).to_numpy() for c in ("tok", "lo", "hi", "blk", "n"))
        keys = t.column("set_key").combine_chunks()
        comp = t.column("comp").to_numpy()
        sketch = _sketches(t.column("sketch"))
        new = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        size = np.diff(np.append(new, len(tok)))
        group = np.repeat(np.arange(len(new)), size)
        small = np.repeat(size <= 64, size)
        for d in range(1, int(size[size <= 64].max(initial=1))):
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
            i = i[(comp[i] != comp[i + d]) & ((lo[i] == hi[i]) | (blk[i] != blk[i + d]))]
            if len(i):
                i = i[_near(n[i], n[i + d], sketch[i], sketch[i + d], num, den)]
                if len(i):
                    yield emit(keys, i, i + d)
        toks = t.column("toks").to_pylist()
        for s, k in zip(new[size > 64].tolist(), size[size > 64].tolist()):
            rows = np.arange(s, s + k)
            known = earlier([np.frombuffer(x, np.int64) for x in toks[s : s + k]], tok[s]) if all(x is not None for x in toks[s : s + k]) else None
            step = max(1, 100_000 // k)
            for r in range(0, k, step):
                i = np.repeat(rows[r : r + step], k)
                j = np.tile(rows, len(rows[r : r + step]))
                ok = (i < j) & (comp[i] != comp[j])
                if lo[s] != hi[s]:
                    ok &= blk[i] != blk[j]
                i, j = i[ok], j[ok]
                ok = _near(n[i], n[j], sketch[i], sketch[j], num, den)
                i, j = i[ok], j[ok]
                if known is not None and len(i):
                    ok = ~(known[i - s] & known[j - s]).any(axis=1)
                    i, j = i[ok], j[ok]
                if len(i):
                    yield emit(keys, i, j)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 20_000:
                continue
            last = [held.column(c)[-1].as_py() for c in ("tok", "lo", "hi")]
            same = np.ones(held.num_rows, bool)
            for c, v in zip(("tok", "lo", "hi"), last):
                same &= held.column(c).to_numpy() == v
            cut = held.num_rows - int(same.sum())
            if cut:
                yield from compare(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from compare(held)

    return members.mapInArrow(tidy(run), "a binary, b binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_key")).unionAll(pairs.select(F.col("b").alias("set_key"))).distinct()


def components_of_sets(src: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, comp) of the sets; ``rows`` are the documents' prefixes.

    1. Sets with the same prefix and size form a group. Prefix tokens held by one group only are dropped.
    2. Each group's members are compared with its first, and each group with one of a similar size per token: a linear
       number of pairs, which joins most of a large family of near copies.
    3. Within each token (and each group), all members in different components are compared, in bounded blocks: no link
       is lost, and families that are one component already cost nothing. Of the pairs between the same two components
       one is verified first, and then all between components that this has not joined.
    """
    spark = src.sparkSession
    members = rows.where("prefix is not null").select("set_key", "gid", "n", "sketch", "counts").dropDuplicates(["set_key"])
    members = materialize(members, "members")
    tokens = rows.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)).alias("n")).collect()[0]["n"] // 8
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    shared = materialize(_shared_tokens(rows, buckets), "shared")
    groups = materialize(members.groupBy("gid").agg(F.min("set_key").alias("leader"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m")), "groups")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int").alias("band")
    banded = shared.join(groups.select("gid", band), "gid").select("tok", "band", "gid")
    pivots = banded.groupBy("tok", "band").agg(F.min("gid").alias("pivot"))
    star = banded.join(pivots, ["tok", "band"]).where("gid <> pivot").select("gid", "pivot").distinct()
    leaders = groups.select("gid", "leader")
    star = star.join(leaders.toDF("gid", "a"), "gid").join(leaders.toDF("pivot", "b"), "pivot").select("a", "b")
    inner = members.select("gid", "set_key").join(leaders, "gid").where("set_key <> leader").select(F.col("set_key").alias("a"), F.col("leader").alias("b"))
    light, long = members.select("set_key", "n", "sketch"), members.where("counts is not null").select("set_key", "n", "counts")
    likely = materialize(_likely(star.unionAll(inner), light, num, den), "pairs")  # written, so that no task runs two workers
    likely = materialize(_sift(likely, long, num, den), "pairs")
    wanted = materialize(_ends(likely), "wanted")
    fetched = materialize(_fetch(src, wanted, k), "fetched", "none")
    first = materialize(_exact(likely, fetched, num, den), "links")
    comp = materialize(components(first), "components")
    own = members.select("gid", "set_key").join(comp.withColumnRenamed("node", "set_key"), "set_key", "left").select("gid", "set_key", F.coalesce("comp", "set_key").alias("comp"))
    own = materialize(own, "own")
    spread = own.groupBy("gid").agg(F.min(F.xxhash64("comp")).alias("c0"), F.max(F.xxhash64("comp")).alias("c1"), F.count(F.lit(1)).alias("m"))
    tokens = shared.unionAll(groups.where("m > 1").select(F.col("gid").alias("tok"), "gid"))
    open_tokens = tokens.join(spread, "gid").groupBy("tok").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("m").alias("c")).where("c0 <> c1").select("tok", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"), (F.col("c") > LARGE).alias("large"))
    open_tokens = materialize(open_tokens, "open-tokens")
    large = tokens.join(open_tokens.where("large"), "tok").join(own, "gid").groupBy("set_key").agg(F.slice(F.sort_array(F.collect_set("tok")), 1, CARRIED).alias("toks"))
    blocks = tokens.join(open_tokens, "tok").join(own, "gid").withColumn("blk", F.pmod(F.xxhash64("set_key"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    blocks = blocks.select("tok", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "set_key", F.xxhash64("comp").alias("comp"), "large").join(light, "set_key").join(large, "set_key", "left")
    blocks = _with_tokens(blocks)
    cross = _cross_pairs(blocks.repartition("tok", "lo", "hi").sortWithinPartitions("tok", "lo", "hi"), num, den).distinct()
    cross = materialize(_sift(cross, long, num, den), "pairs")
    more = materialize(_ends(cross).join(wanted, "set_key", "left_anti"), "wanted")
    if more.count():
        fetched = fetched.unionAll(materialize(_fetch(src, more, k), "fetched", "none"))
    node = own.select("set_key", "comp")
    met = cross.join(node.toDF("a", "ca"), "a").join(node.toDF("b", "cb"), "b").select("a", "b", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
    met = materialize(met, "pairs")
    one = materialize(met.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("x", "y", "p.a", "p.b"), "pairs")
    joined = materialize(one.join(_exact(one.select("a", "b"), fetched, num, den), ["a", "b"], "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    wider = materialize(components(joined), "components")  # of components
    still = one.select("x", "y").join(wider.toDF("x", "cx"), "x", "left").join(wider.toDF("y", "cy"), "y", "left")
    still = still.where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y")
    rest = materialize(met.join(still, ["x", "y"], "left_semi").join(one.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if rest.count():
        more = rest.join(_exact(rest.select("a", "b"), fetched, num, den), ["a", "b"], "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        wider = materialize(components(joined.unionAll(materialize(more, "links"))), "components")
    return node.join(wider.toDF("comp", "wider"), "comp", "left").select(F.col("set_key").alias("node"), F.coalesce("wider", "comp").alias("comp"))


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every document.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct ``k``-word shingles (the
    whole sequence if it is shorter, nothing without words or text). Two documents link when
    den * |intersection| >= num * |union|; an empty set links with nothing. component_id is the smallest id that links
    reach (null ids are passed over; it is null if the class has no other). Copies are one set; repeated rows are each
    returned; other columns are not read; an empty table gives no rows. Sets are not stored: the texts are read again for
    those that have to be compared.
    """
    src = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(_prefixes(src, k, num, den, _frequent(src.select("text"), k)), "prefixes", "none")
    comp = components_of_sets(src, rows, k, num, den)
    rows = rows.select("doc_key", "n", "set_key").join(comp.withColumnRenamed("node", "set_key"), "set_key", "left").select("doc_key", "n", F.coalesce("comp", "set_key").alias("comp"))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_key").alias("least"))
    return rows.join(least, "comp", "left").select(F.col("doc_key").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_key")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that are not the smallest id of their class (see ``jaccard_classes``).

    Rows that repeat the smallest id are all kept if their text is the same; rows with null ids are kept. An empty table stays
    empty, and other columns may have any name.
    """
    classes = jaccard_classes(docs, k, num, den, id_col, text_col)
    gone = classes.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)  # by name, so that no column's name is taken
