"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _offsets, text_array, tidy

BUCKETS = 1 << 15
#: Bytes of text looked up at a time, at most (fewer with many languages).
BLOCK = 1 << 19
#: Units that log likelihoods are counted in.
UNITS = 1 << 16
#: Languages whose counts a Python worker holds at once (256 KB each); with more it hands over what it has and goes on.
HELD_LANGUAGES = 256
#: Hosts whose evidence is sent to every executor, at most (about 300 bytes, or 25 counts, each); beyond it a shuffle join
#: is used.
BROADCAST_HOSTS = 50_000
#: Overlapping character trigrams repeat each other's evidence; their log likelihoods count by this factor.
TEMPER = 0.3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _grams(texts: pa.Array, block: int):
    """(trigram buckets, text of each) in turn, for ``block`` bytes of the texts at a time; a trigram lies in one text."""
    offsets = _offsets(texts).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    for lo in range(0, len(data) - 2, block):
        x = _FOLD[data[lo : lo + block + 2]]
        space = x == 32
        twice = space[:-1] & space[1:]
        good = ~(twice[:-1] | twice[1:])
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, lo + len(good) + 2, "left")] - lo
        for back in (1, 2):
            at = inner - back
            good[at[(at >= 0) & (at < len(good))]] = False
        at = np.flatnonzero(good)
        x = x.astype(np.uint32)
        v = (x[at] << 16) | (x[at + 1] << 8) | x[at + 2]
        yield ((v * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32), np.searchsorted(offsets, at + lo, "right") - 1


def count_grams(docs: DataFrame, text_col: str, lang_col: str, languages: list[str]) -> np.ndarray:
    """Counts of trigram buckets per declared language over all documents (languages x BUCKETS)."""
    place = {x: i for i, x in enumerate(languages)}
    names = ["lang", "bucket", "counts"]

    def row(i: int, counts: np.ndarray):
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts[at].tobytes()], pa.binary())], names=names)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            lang = np.array([place.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            known, dense = np.unique(lang, return_inverse=True)  # -1, if there, is the first
            dense = dense - int(len(known) > 0 and known[0] < 0)
            known = known[known >= 0]
            for key, doc in _grams(text_array(b.column(0)), BLOCK):
                of = dense[doc]
                if dense.min(initial=0) < 0:
                    key, of = key[of >= 0], of[of >= 0]
                for first in range(0, len(known), HELD_LANGUAGES):
                    some = known[first : first + HELD_LANGUAGES]
                    here = slice(None) if len(some) == len(known) else (of >= first) & (of < first + len(some))
                    counts = np.bincount((of[here] - first) * BUCKETS + key[here], minlength=len(some) * BUCKETS).reshape(-1, BUCKETS)
                    for i, c in zip(some.tolist(), counts):
                        held[i] = held[i] + c if i in held else c.copy()
                    if len(held) > HELD_LANGUAGES:
                        yield from (row(i, c) for i, c in held.items())
                        held = {}
        yield from (row(i, c) for i, c in held.items())

    def total(batches):
        last, out = None, np.zeros(0, np.int64)
        for b in batches:
            for i, at, x in zip(*(c.to_pylist() for c in b.columns)):
                if i != last:
                    if last is not None:
                        yield row(last, out)
                    last, out = i, np.zeros(BUCKETS, np.int64)
                out[np.frombuffer(at, np.uint16)] += np.frombuffer(x, np.int64)
        if last is not None:
            yield row(last, out)

    schema = "lang int, bucket binary, counts binary"
    src = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    for r in src.mapInArrow(tidy(run), schema).repartition("lang").sortWithinPartitions("lang").mapInArrow(tidy(total), schema).toLocalIterator():
        counts[r["lang"], np.frombuffer(bytes(r["bucket"]), np.uint16)] = np.frombuffer(bytes(r["counts"]), np.int64)
    return counts


def suffix_of(host: Column) -> Column:
    """The last label of a host name."""
    return F.lower(F.element_at(F.split(host, "\\."), -1))


def identify(docs: DataFrame, text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", suffix: Column | None = None, min_posterior: float = 0.5, prior_weight: float = 20.0) -> DataFrame:
    """All columns of ``docs`` with lang_id, lang_posterior and lang_kept (as named; clashing columns are replaced).

    Evidence, combined as log probabilities: (1) the text under character-trigram models counted over all documents by
    declared language; (2) the declared language, by a table of how often each is declared given what texts say; (3) a
    prior per host, smoothed towards its address suffix and that towards the whole corpus with ``prior_weight`` pseudo
    documents, from counts of what texts say. lang_kept is false for texts without letters and where the best posterior
    is under ``min_posterior``. Null or empty texts and texts without a language known have no text evidence; a null
    declaration or host adds none. Ties go to the more frequently declared language. Without any declared language all
    rows get a null lang_id and lang_kept false. Repeated rows are judged alike. All declared languages are known; each
    takes 128 KB of model in every Python worker.
    """
    names = docs.columns
    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).cast("string").alias("__text"), declared.alias("__declared"), host.alias("__host"), (F.coalesce(suffix, F.lit("")) if suffix is not None else suffix_of(host)).alias("__suffix"))
    top = work.where("__declared is not null").groupBy("__declared").count().orderBy(F.desc("count"), "__declared").collect()
    languages = [r["__declared"] for r in top]
    keep = [c for c in names if c not in ("lang_id", "lang_posterior", "lang_kept")]
    if not languages:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("lang_posterior"), F.lit(False).alias("lang_kept"))
    counts = count_grams(work, "__text", "__declared", languages)
    model = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    # relative to the mean language, in whole units: sums don't depend on where a block ends
    model = np.ascontiguousarray(np.rint((model - model.mean(axis=0)).T * UNITS).astype(np.int32))
    columns = np.ascontiguousarray(model.T, np.int64) if len(languages) <= 8 else None  # the same sums, faster one by one
    block = max(1 << 12, min(BLOCK, (1 << 21) // len(languages)))

    def scores(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, letters = np.zeros((len(texts), model.shape[1]), np.int64), np.zeros(len(texts), bool)
        for key, doc in _grams(texts, block):
            if len(key):
                edge = np.flatnonzero(np.diff(doc, prepend=-1))
                if columns is None:
                    out[doc[edge]] += np.add.reduceat(model[key], edge, axis=0, dtype=np.int64)
                else:
                    for i, x in enumerate(columns):
                        out[doc[edge], i] += np.add.reduceat(x[key], edge)
                letters[doc[edge]] = True
        for i in np.flatnonzero(~letters).tolist():
            letters[i] = any(c.isalpha() for c in texts[i].as_py())
        return TEMPER / UNITS * out, letters

    def score(batches):
        for b in batches:
            s, letters = scores(text_array(b.column("__text")))
            arrays = [b.column(n) for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(s), pa.list_(pa.float64())), pa.array(letters)], names=[n for n in b.schema.names if n != "__text"] + ["__s", "__letters"])

    def scored(df: DataFrame) -> DataFrame:
        schema = T.StructType([*(f for f in df.schema.fields if f.name != "__text"), *T.StructType.fromDDL("__s array<double>, __letters boolean").fields])
        return df.mapInArrow(tidy(score), schema)

    n = len(languages)
    said = F.when(F.col("__letters"), F.array_position("__s", F.array_max("__s")).cast("int") - 1)
    seen = scored(work.drop("row")).withColumn("__said", said).where("__said is not null").groupBy("__suffix", "__host", "__declared", "__said").agg(F.count(F.lit(1)).alias("k"))
    from .common import materialize

    seen = materialize(seen, "language-evidence")

    def spoken(*by: str) -> DataFrame:
        """Counts of what texts say, as an array of (language, count)."""
        return seen.groupBy(*by, "__said").agg(F.sum("k").alias("k")).groupBy(*by).agg(F.collect_list(F.struct("__said", "k")).alias("c"))

    whole = np.ones(n)
    for r in seen.groupBy("__said").agg(F.sum("k").alias("k")).collect():
        whole[r["__said"]] += r["k"]
    whole /= whole.sum()
    place = {x: i for i, x in enumerate(languages)}
    table = np.full((n + 1, n), 0.5)
    for r in seen.where("__declared is not null").groupBy("__declared", "__said").agg(F.sum("k").alias("k")).collect():
        table[place[r["__declared"]], r["__said"]] += r["k"]
    table[n] = 1.0
    table[:n] /= table[:n].sum(axis=0)
    declare = np.log(table)

    hosts = spoken("__suffix", "__host").withColumnRenamed("c", "__hc").join(spoken("__suffix").withColumnRenamed("c", "__sc"), "__suffix")
    hosts = materialize(hosts, "language-hosts")
    weight = hosts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("__hc") + F.size("__sc")).alias("c")).collect()[0]
    if max(weight["n"], (weight["c"] or 0) / 25) <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)

    def smoothed(counts: list | None, prior: np.ndarray) -> np.ndarray:
        if not counts:
            return prior
        c = np.zeros(n)
        c[[x["__said"] for x in counts]] = [x["k"] for x in counts]
        return (c + prior_weight * prior) / (c.sum() + prior_weight)

    def decide(batches):
        for b in batches:
            s, letters = scores(text_array(b.column("row").field(names.index(text_col)).cast(pa.string())))
            which = [place.get(x, n) for x in b.column("__declared").to_pylist()]
            priors: dict = {}
            best, sure = [], []
            suffixes, hosts = b.column("__suffix").to_pylist(), b.column("__host").to_pylist()
            hc, sc = b.column("__hc"), b.column("__sc")
            for i, at in enumerate(zip(suffixes, hosts)):
                if at not in priors:
                    priors[at] = np.log(smoothed(hc[i].as_py(), smoothed(sc[i].as_py(), whole)))
                post = s[i] + declare[which[i]] + priors[at]
                top = int(post.argmax())
                best.append(languages[top])
                sure.append(1.0 / float(np.exp(post - post[top]).sum()))
            kept = letters & (np.array(sure) >= min_posterior)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(best, pa.string()), pa.array(sure, pa.float64()), pa.array(kept)], names=["row", "lang_id", "lang_posterior", "lang_kept"])

    ready = work.drop("__text").join(hosts, ["__suffix", "__host"], "left")
    schema = T.StructType([work.schema["row"], *T.StructType.fromDDL("lang_id string, lang_posterior double, lang_kept boolean").fields])
    out = ready.mapInArrow(tidy(decide), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "lang_id", "lang_posterior", "lang_kept")


def page_language(pages: DataFrame, url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """``identify`` for web pages: text without markup, declared language from the html element, host and suffix from the
    address. All columns of ``pages`` stay, whatever their names (lang_id, lang_posterior and lang_kept are replaced);
    null pages have no text and aren't kept, null addresses no host; repeated rows and ties are as in ``identify``, and an
    empty table gives no rows."""
    keep = [c for c in pages.columns if c not in ("lang_id", "lang_posterior", "lang_kept")]
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    text = F.regexp_replace(html, "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<[^>]*>|&\\w+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, "(?is)<html[^>]*\\blang\\s*=\\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), "^[a-z]+://([^/:?#]+)", 1))
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), text.alias("text"), declared.alias("declared"), host.alias("host"))
    out = identify(df, "text", "declared", "host", **options)
    return out.select(*[F.col("page").getField(c).alias(c) for c in keep], "lang_id", "lang_posterior", "lang_kept")
