"""Reading up to delimiters, as column expressions over whole texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Fixed value: white space as the format's readers see it.
SPACE = "\\s"


def _cut(c: Column, most: int | None) -> Column:
    return c if most is None else F.left(c, F.lit(most))


def _class(characters: str) -> str:
    return "[" + "".join("\\" + x if x in "\\]^-[&" else x for x in characters) + "]"


def read_to(c: Column | str, characters: str, most: int | None = None) -> Column:
    """The text before the first of the characters, all of it without one, at most ``most`` characters."""
    return _cut(F.regexp_extract(col(c), f"(?s)^(.*?)(?:{_class(characters)}|\\z)", 1), most)


def read_to_space(c: Column | str, most: int | None = None) -> Column:
    return _cut(F.regexp_extract(col(c), f"(?s)^(.*?)(?:{SPACE}|\\z)", 1), most)


def first_after_space(c: Column | str) -> Column:
    """The first character that is no white space, null without one."""
    return F.nullif(F.regexp_extract(col(c), "(\\S)", 1), F.lit(""))


def read_through(c: Column | str, limit: str, most: int | None = None) -> Column:
    """The text up to and with the first ``limit``, all of it without one."""
    at = F.locate(limit, col(c))
    return _cut(F.when(at > 0, F.left(col(c), at + len(limit) - 1)).otherwise(col(c)), most)


def read_to_boundary(c: Column | str, limit: str, most: int | None = None) -> Column:
    """The text before the first ``limit``; null without one, or if that is beyond ``most`` characters."""
    at = F.locate(limit, col(c))
    found = at > 0 if most is None else (at > 0) & (at + len(limit) - 1 <= most)
    return F.when(found, F.left(col(c), at - 1))


def scroll_past(c: Column | str, limit: str) -> Column:
    """The text after the first ``limit``, null without one."""
    at = F.locate(limit, col(c))
    return F.when(at > 0, F.substring(col(c), at + len(limit), F.length(col(c))))


def scroll_past_any(c: Column | str, characters: str) -> Column:
    """The text after the first of the characters, null without one."""
    return F.when(col(c).rlike(_class(characters)), F.regexp_replace(col(c), f"(?s)^.*?{_class(characters)}(.*)$", "$1"))


def read_between(c: Column | str, start: str, end: str) -> Column:
    """The text between the first ``start`` and the first ``end`` after it, null without both."""
    return read_to_boundary(scroll_past(c, start), end)


def find(c: Column | str, needles: list[str], ignore_case: bool = False) -> Column:
    """Number (from 0) of the needle that ends first in the text, of those ending together the first; -1 without any."""
    text = F.upper(col(c)) if ignore_case else col(c)
    places = [F.locate(x.upper() if ignore_case else x, text) for x in needles]
    ends = F.array(*[F.when(p > 0, F.struct((p + len(x)).alias("end"), F.lit(i).alias("i"))) for i, (p, x) in enumerate(zip(places, needles))])
    return F.when(text.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(F.array_min(ends)["i"], F.lit(-1)))


def before_any(c: Column | str, needles: list[str]) -> Column:
    """The text before the needle that ``find`` finds, all of it without one."""
    any_of = "|".join(re.escape(x) for x in needles)
    hit = find(c, needles)
    out = col(c)
    for i, x in enumerate(needles):
        out = F.when(hit == i, F.left(col(c), F.locate(x, col(c)) - 1)).otherwise(out)
    return F.when(col(c).rlike(any_of), out).otherwise(col(c))
