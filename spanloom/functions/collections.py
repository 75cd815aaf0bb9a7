"""Dictionaries, position tracking, constant maps and sets, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton
from .text import col


def dictionary_match(texts: DataFrame, words: DataFrame, keys: list[str], text: str, word: str, longest: bool = False) -> DataFrame:
    """keys, start (from 0), len of the shortest (or longest) dictionary word at every place of the texts where one starts (see
    ``automaton.matches``)."""
    return automaton.matches(texts, words, keys, text, word, "longest" if longest else "shortest")


def contains_word(words: Column | str, c: Column | str, ignore_case: bool = False) -> Column:
    """Whether the text is one of the words of an array."""
    words = col(words)
    return F.exists(words, lambda w: F.lower(w) == F.lower(col(c))) if ignore_case else F.array_contains(words, col(c))


def contained_length(words: Column | str, c: Column | str, start: Column | int = 0) -> Column:
    """Length of the shortest of the words that stands in the text at ``start``, -1 without one."""
    at = start if isinstance(start, Column) else F.lit(start)
    here = F.filter(col(words), lambda w: (F.length(w) > 0) & (col(c).substr(at + 1, F.length(w)) == w))
    return F.coalesce(F.array_min(F.transform(here, F.length)), F.lit(-1))


def longest_prefix(c: Column | str, search: Column | str) -> Column:
    """The longest prefix of ``search`` that occurs in the text: a longer one occurs only if a shorter one does, so by halving."""
    c, search = col(c), col(search)

    def step(n, i):
        more = n + F.pow(F.lit(2.0), i).cast("int")
        return F.when((more <= F.length(search)) & F.contains(c, F.substring(search, F.lit(1), more)), more).otherwise(n)

    return F.left(search, F.aggregate(F.sequence(F.lit(30), F.lit(0)), F.lit(0), step))


def translate(pos: Column | str, changes: Column | str) -> Column:
    """A place of a changed text in the original one: ``changes`` are (pos, delta) with pos in the changed text."""
    pos = col(pos)
    return pos + F.aggregate(F.filter(col(changes), lambda e: e.pos <= pos), F.lit(0), lambda acc, e: acc + e.delta)


def _forward(changes: Column) -> Column:
    """The changes with ``at``, where each ends in the original text, and ``cut``, where the lost part starts."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<struct<at:int,cut:int,delta:int>>").alias("all"))

    def add(acc, e):
        end = (e.pos + acc["sum"] + e.delta).cast("int")
        one = F.struct(end.alias("at"), (end - F.greatest(e.delta, F.lit(0))).cast("int").alias("cut"), e.delta.cast("int").alias("delta"))
        return F.struct((acc["sum"] + e.delta).cast("int").alias("sum"), F.concat(acc["all"], F.array(one)).alias("all"))

    return F.aggregate(F.array_sort(changes), zero, add)["all"]


def translate_forward(pos: Column | str, changes: Column | str) -> Column:
    """A place of the original text in the changed one, by the same changes; null where it was cut away."""
    pos = col(pos)
    return F.when(~cut_away(pos, changes), pos - F.aggregate(F.filter(_forward(col(changes)), lambda e: e.at <= pos), F.lit(0), lambda acc, e: acc + e.delta))


def translate_exactly(pos: Column | str, changes: Column | str) -> Column:
    """Like ``translate_forward``; a place that was cut away becomes the place after the cut."""
    pos = col(pos)
    moved = F.aggregate(F.filter(_forward(col(changes)), lambda e: e.at <= pos), F.lit(0), lambda acc, e: acc + e.delta)
    inside = F.filter(_forward(col(changes)), lambda e: (e.cut <= pos) & (pos < e.at))
    return F.when(F.size(inside) > 0, inside[0].at - moved - inside[0].delta).otherwise(pos - moved)


def cut_away(pos: Column | str, changes: Column | str) -> Column:
    """Whether a place of the original text lies in a part that was lost."""
    return F.exists(_forward(col(changes)), lambda e: (e.cut <= col(pos)) & (col(pos) < e.at))


def constant_map(**pairs) -> Column:
    """A map of constants in key order; keys can't repeat."""
    return F.create_map(*[F.lit(x) for k in sorted(pairs) for x in (k, pairs[k])])


def constant_set(*values) -> Column:
    """A sorted array of different constants."""
    return F.array(*[F.lit(x) for x in sorted(set(values))])


def index_of(values: Column | str, x: Column | str | int | float) -> Column:
    """Place (from 0) of a value in an array, -1 without it."""
    return F.array_position(col(values), x if isinstance(x, Column) else F.lit(x)).cast("int") - 1


def set_union(a: Column | str, b: Column | str) -> Column:
    return F.array_union(col(a), col(b))


def set_intersection(a: Column | str, b: Column | str) -> Column:
    return F.array_intersect(col(a), col(b))


def sets_meet(a: Column | str, b: Column | str) -> Column:
    return F.arrays_overlap(col(a), col(b))


def intersection_size(a: Column | str, b: Column | str) -> Column:
    """Elements, repeats counted, of the shorter array (the first of equals) that the longer one has."""
    a, b = col(a), col(b)

    def hits(small, large):
        return F.size(F.filter(small, lambda x: F.array_contains(large, x)))

    return F.when(F.size(a) <= F.size(b), hits(a, b)).otherwise(hits(b, a))


def counts(df: DataFrame, keys: list[str], value: Column | None = None) -> DataFrame:
    """keys and cnt: how often each occurs, or the sum of a value."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias("cnt"))


def greatest_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def multimap(df: DataFrame, keys: list[str], value: str, distinct: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg((F.collect_set if distinct else F.collect_list)(value).alias("values"))


def keys_by_count(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``counts``, the most frequent first and of equal ones the smaller key."""
    return counted.orderBy(F.desc("cnt"), *keys)


def value_or(pairs: Column | str, key, default) -> Column:
    """The value of a key, the default where the map lacks it or has null."""
    return F.coalesce(F.try_element_at(col(pairs), key if isinstance(key, Column) else F.lit(key)), F.lit(default))


def greatest_value(pairs: Column | str) -> Column:
    return F.array_max(F.map_values(col(pairs)))


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1; nulls are equal to each other and come before everything else."""
    a, b = col(a), col(b)
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def compare_tuples(pairs: list[tuple]) -> Column:
    """``compare`` of the first of several pairs of values that aren't equal."""
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(compare(a, b) != 0, compare(a, b)).otherwise(out)
    return out


def element(values: Column | str, i: int) -> Column:
    """The element at a place from 0, from the end if negative, null where there is none."""
    return F.get(col(values), F.lit(i)) if i >= 0 else F.try_element_at(col(values), F.lit(i))
