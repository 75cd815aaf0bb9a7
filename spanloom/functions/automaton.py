"""Dictionaries as automata: all words that stand in texts, found in one pass over each text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

#: Characters of words that one automaton is built from, about; larger dictionaries are dealt to several by a hash of the word.
MAX_CHARS = 2_000_000
#: Characters that one run of a pass reads, besides those before it that a word may begin with.
RUN = 1024
#: Characters of texts that are read together.
TOGETHER = 1 << 22


class Automaton:
    """States are the prefixes of the words, the root is 0. Arrays hold the way down (by state and character), the state of the
    longest proper suffix that is a prefix too (``fail``), the length of the word that ends in a state (``length``, 0 for none),
    and the longest proper suffix that is a word (``word``)."""

    def __init__(self, words: list[str]):
        words = sorted({w for w in words if w})
        size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(codes)
        self.width = len(self.alphabet) + 1  # class 0: characters of no word
        self.longest = int(size.max(initial=0))
        kind = np.searchsorted(self.alphabet, codes) + 1
        first, state = np.cumsum(size) - size, np.zeros(len(words), np.int64)
        ways, parents, states = [], [], 1
        self.levels = []
        for d in range(self.longest):
            on = np.flatnonzero(size > d)
            way, back = np.unique(state[on] * self.width + kind[first[on] + d], return_inverse=True)
            state[on] = states + back
            ways.append(way)
            self.levels.append((states, states + len(way)))
            states += len(way)
        #: Ascending, since a level's states follow those of the level before.
        self.ways = np.concatenate(ways) if ways else np.zeros(0, np.int64)
        self.length = np.zeros(states, np.int64)
        self.length[state] = size
        self.fail, self.word = np.zeros(states, np.int64), np.zeros(states, np.int64)
        for a, z in self.levels[1:]:
            way = self.ways[a - 1 : z - 1]
            self.fail[a:z] = self.step(self.fail[way // self.width], way % self.width)
        for a, z in self.levels:
            f = self.fail[a:z]
            self.word[a:z] = np.where(self.length[f] > 0, f, self.word[f])

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = np.zeros(len(state), np.int64)
        on, at = np.flatnonzero(kind > 0), state[kind > 0]
        while len(on):
            way = at * self.width + kind[on]
            place = np.minimum(np.searchsorted(self.ways, way), len(self.ways) - 1)
            hit = self.ways[place] == way
            out[on[hit]] = place[hit] + 1
            on, at = on[~hit & (at > 0)], self.fail[at[~hit & (at > 0)]]
        return out

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of every word in one sequence of code points, overlapping ones included. The sequence is read in runs
        side by side; each begins as far before its own part as a word can reach."""
        n, before = len(codes), max(self.longest - 1, 0)
        run = max(RUN, 4 * before)
        kind = np.searchsorted(self.alphabet, codes)
        kind[kind == len(self.alphabet)] = 0
        kind = np.where(self.alphabet[kind] == codes, kind + 1, 0) if len(self.alphabet) else np.zeros(n, np.int64)
        runs = -(-n // run)
        padded = np.zeros(before + runs * run, np.int64)
        padded[before : before + n] = kind
        own = np.arange(runs) * run
        state, ends, found = np.zeros(runs, np.int64), [], []
        for i in range(before + run):
            state = self.step(state, padded[own + i])
            if i >= before:
                on = np.flatnonzero((self.length[state] > 0) | (self.word[state] > 0))
                at = state[on]
                at = np.where(self.length[at] > 0, at, self.word[at])
                while len(on):
                    ends.append(own[on] + i - before + 1)
                    found.append(self.length[at])
                    on, at = on[self.word[at] > 0], self.word[at[self.word[at] > 0]]
        end, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, found))
        return end - length, length


def _together(texts: list[str]):
    """(first, last) of runs of texts with about TOGETHER characters."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > TOGETHER:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def matches(texts: DataFrame, words: DataFrame, keys: list[str], text: str, word: str, which: str = "all") -> DataFrame:
    """keys, start (from 0) and len (int) of the words of a dictionary that stand in the texts: ``all`` of them, or at each place
    where one starts the ``shortest`` or the ``longest``.

    Empty and null words are left out; a null text has none; repeated words count once, repeated rows of texts are rows each. The
    time is that of the texts and of what is found, whatever the dictionary. It is built into one automaton, which the tasks get,
    if its words have at most MAX_CHARS characters; else into several of about that, one pass over the texts for each, and only
    then are the finds exchanged, to choose between words of different automata.
    """
    spark = texts.sparkSession
    src = texts.select(*keys, col(text).cast("string").alias("__text")).where("__text is not null")
    dictionary = words.select(F.col(word).cast("string").alias("word")).where("word <> ''").distinct()
    chars = dictionary.agg(F.sum(F.length("word"))).collect()[0][0] or 0
    blocks = max(1, -(-chars // MAX_CHARS))
    schema = T.StructType([*src.schema.fields[: len(keys)], T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType())])
    many = blocks > 1 and which != "all"
    if many:
        src = src.withColumn("__row", F.monotonically_increasing_id())
    out = None
    for i in range(blocks):
        part = dictionary.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i) if blocks > 1 else dictionary
        found = _pass(spark, src, part.toArrow().column(0).to_pylist(), schema, which, len(keys), many)
        out = found if out is None else out.unionByName(found)
    if many:
        best = F.min("len") if which == "shortest" else F.max("len")
        firsts = [F.first(F.col(f"`{k}`")).alias(k) for k in keys]
        out = out.groupBy("__row", "start").agg(*firsts, best.alias("len")).select(*keys, "start", "len")
    return out


def _pass(spark, src: DataFrame, words: list[str], schema: T.StructType, which: str, k: int, numbered: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(Automaton(words))
    if numbered:
        schema = T.StructType([*schema.fields, T.StructField("__row", T.LongType())])

    def run(batches):
        a = shared.value
        for b in batches:
            texts = b.column(k).to_pylist()
            for lo, hi in _together(texts):
                size = np.array([len(t) + 1 for t in texts[lo:hi]], np.int64)
                first = np.cumsum(size) - size
                codes = np.frombuffer(("\0".join(texts[lo:hi]) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
                codes[first + size - 1] = 0xFFFFFFFF  # no word goes from text to text
                start, length = a.find(codes)
                order = np.lexsort((-length if which == "longest" else length, start))
                start, length = start[order], length[order]
                if which != "all":
                    keep = np.ones(len(start), bool)
                    keep[1:] = start[1:] != start[:-1]
                    start, length = start[keep], length[keep]
                row = np.searchsorted(first, start, "right") - 1
                take = pa.array(row + lo)
                columns = [*(b.column(i).take(take) for i in range(k)), pa.array((start - first[row]).astype(np.int32)), pa.array(length.astype(np.int32))]
                columns += [b.column(k + 1).take(take)] if numbered else []
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return src.mapInArrow(run, schema)


def in_order(words: DataFrame, word: str) -> DataFrame:
    """word and ``place`` (long, from 0) of the different words in the order in which a prefix tree is walked from its last branch: a
    word before those that it begins, and of words that part, the one with the larger character first. Null and empty words
    are left out. Places are counted within first characters, before which the words of larger ones are counted, so that no
    task gets all words."""
    w = words.select(F.col(word).cast("string").alias("word")).where("word <> ''").distinct()
    w = w.withColumn("head", -F.ascii("word")).withColumn("walk", F.transform(F.split("word", ""), lambda c: -F.ascii(c)))
    sizes = w.groupBy("head").agg(F.count(F.lit(1)).alias("n"))  # a row for each first character
    before = sizes.select("head", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("head").orderBy("walk")) - 1
    return w.withColumn("within", within).join(F.broadcast(before), "head").select("word", (F.col("before") + F.col("within")).alias("place"))
