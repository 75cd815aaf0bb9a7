"""Text differences and what follows from them: edit scripts, deltas, and spans moved to another text."""

from __future__ import annotations

import re
import urllib.parse
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Script = list[tuple[str, str]]
DIFF_TYPE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))


#: Texts that are both longer than this are compared by tokens first, and what differs then by characters.
LONG = 2000
#: Differences that a search looks for from each end; where there are more, the stretch is cut where it has come furthest.
MOST_STEPS = 500
_TOKEN = re.compile(r"\w+|\W")


def diff(a: str, b: str) -> Script:
    """A script of EQUAL, DELETE and INSERT pieces from ``a`` to ``b`` (Myers' greedy algorithm in linear space): a shortest one,
    but for long texts (by tokens first) and for stretches with more than MOST_STEPS differences from each end."""
    if a is None or b is None:
        raise ValueError("a text is null")
    if min(len(a), len(b)) <= LONG:
        return merge(_diff(a, b))
    number: dict[str, str] = {}

    def coded(text):
        """A character for each different token."""
        return "".join(number.setdefault(t, chr(len(number) + (0x800 if len(number) >= 0xD800 else 0))) for t in _TOKEN.findall(text))

    x, y = coded(a), coded(b)
    token = {c: t for t, c in number.items()}
    script = merge(_diff(x, y))
    out: Script = []
    gone = ""
    for op, t in [*script, ("EQUAL", "")]:
        t = "".join(token[c] for c in t)
        if op == "DELETE":
            gone = t
        elif op == "INSERT" and gone:
            out += _diff(gone, t) if max(len(gone), len(t)) <= LONG else [("DELETE", gone), ("INSERT", t)]
            gone = ""
        else:
            out += [("DELETE", gone)] * bool(gone) + [(op, t)] * bool(t)
            gone = ""
    return merge(out)


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _diff(a: str, b: str) -> Script:
    out, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if isinstance(a, int):
            out.append(("EQUAL", b))
            continue
        if a == b:
            out += [("EQUAL", a)] if a else []
            continue
        n = _shared(a, b)
        if n:
            out.append(("EQUAL", a[:n]))
            a, b = a[n:], b[n:]
        m = _shared(a[::-1], b[::-1])
        if m:
            todo.append((0, a[len(a) - m :]))
            a, b = a[: len(a) - m], b[: len(b) - m]
        if not a or not b:
            out += ([("DELETE", a)] if a else []) + ([("INSERT", b)] if b else [])
            continue
        x, y = _middle(a, b)
        if (x, y) in ((0, 0), (len(a), len(b))):
            out += [("DELETE", a), ("INSERT", b)]
            continue
        todo += [(a[x:], b[y:]), (a[:x], b[:y])]
    return out


def _middle(a: str, b: str) -> tuple[int, int]:
    """A point on a shortest path, where searches from both ends meet."""
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        if d > MOST_STEPS:
            x, k = max((x, k) for k, x in ahead.items() if 0 <= x <= n and 0 <= x - k <= m and 2 * x - k == max(2 * z - j for j, z in ahead.items() if 0 <= z <= n and 0 <= z - j <= m))
            return x, x - k
        for k in range(-d, d + 1, 2):
            x = ahead.get(k + 1, -1) if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead.get(k - 1, -1) + 1
            y = x - k
            while x < n and 0 <= y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and abs(delta - k) < d and x <= n and 0 <= y <= m and x + back.get(delta - k, -n - 1) >= n:
                return x, y
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back.get(k - 1, -1) + 1
            y = x - k
            while x < n and 0 <= y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and abs(delta - k) <= d and x <= n and 0 <= y <= m and x + ahead.get(delta - k, -n - 1) >= n:
                return n - x, m - y
    return 0, 0


def merge(script: Script) -> Script:
    """One deletion and one insertion between equal pieces, with shared ends moved into the equal pieces."""
    out: Script = []
    gone, new = "", ""

    def equal(t):
        if not t:
            return
        if out and out[-1][0] == "EQUAL":
            out[-1] = ("EQUAL", out[-1][1] + t)
        else:
            out.append(("EQUAL", t))

    def close():
        nonlocal gone, new
        n = _shared(gone, new)
        equal(gone[:n])
        gone, new = gone[n:], new[n:]
        m = _shared(gone[::-1], new[::-1])
        tail = gone[len(gone) - m :]
        gone, new = gone[: len(gone) - m], new[: len(new) - m]
        if gone:
            out.append(("DELETE", gone))
        if new:
            out.append(("INSERT", new))
        equal(tail)
        gone, new = "", ""

    for op, t in [*script, ("EQUAL", "")]:
        if op == "DELETE":
            gone += t
        elif op == "INSERT":
            new += t
        else:
            if gone or new:
                close()
            equal(t)
    return out


def to_delta(script: Script) -> str:
    keep = "-_.!~*'();/?:@&=+$,# "
    return "\t".join({"EQUAL": f"={len(t)}", "DELETE": f"-{len(t)}"}.get(op) or "+" + urllib.parse.quote(t, safe=keep) for op, t in script)


def from_delta(text: str, delta: str) -> Script:
    out, at = [], 0
    for token in delta.split("\t") if delta else []:
        if token[:1] == "+":
            out.append(("INSERT", urllib.parse.unquote(token[1:])))
        elif token[:1] in "=-" and token[1:].isdigit():
            n = int(token[1:])
            if at + n > len(text):
                raise ValueError("the delta is longer than the text")
            out.append(("EQUAL" if token[0] == "=" else "DELETE", text[at : at + n]))
            at += n
        else:
            raise ValueError(f"no delta operation: {token!r}")
    if at != len(text):
        raise ValueError("the delta is shorter than the text")
    return out


@F.pandas_udf(DIFF_TYPE)
def diff_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [{"op": o, "text": t} for o, t in diff(x, y)] for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def delta_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else to_delta(diff(x, y)) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def apply_delta_udf(a: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or d is None else "".join(t for o, t in from_delta(x, d) if o != "DELETE") for x, d in zip(a, delta)])


def source_text(d: Column) -> Column:
    return F.array_join(F.transform(F.filter(d, lambda x: x.op != "INSERT"), lambda x: x.text), "")


def target_text(d: Column) -> Column:
    return F.array_join(F.transform(F.filter(d, lambda x: x.op != "DELETE"), lambda x: x.text), "")


def script_distance(d: Column) -> Column:
    """Sum over the gaps between equal pieces of the longer of what is deleted and inserted there."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("ins"), F.lit(0).alias("dele"))

    def step(acc, x):
        n = F.length(x.text)
        equal = x.op == "EQUAL"
        return F.struct(
            F.when(equal, acc.total + F.greatest(acc.ins, acc.dele)).otherwise(acc.total).alias("total"),
            F.when(equal, 0).otherwise(acc.ins + F.when(x.op == "INSERT", n).otherwise(0)).alias("ins"),
            F.when(equal, 0).otherwise(acc.dele + F.when(x.op == "DELETE", n).otherwise(0)).alias("dele"),
        )

    return F.aggregate(d, zero, step, lambda acc: acc.total + F.greatest(acc.ins, acc.dele))


def place_after(d: Column, place: Column) -> Column:
    """Where a place of the source text lies in the target text; one in a deleted part becomes the place where that was."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(None).cast("int").alias("found"))

    def step(acc, x):
        n = F.length(x.text)
        here = (x.op != "INSERT") & (place < acc.p + n) & acc.found.isNull()
        return F.struct(
            (acc.p + F.when(x.op == "INSERT", 0).otherwise(n)).alias("p"),
            (acc.q + F.when(x.op == "DELETE", 0).otherwise(n)).alias("q"),
            F.when(here, F.when(x.op == "DELETE", acc.q).otherwise(acc.q + place - acc.p)).otherwise(acc.found).cast("int").alias("found"),
        )

    return F.aggregate(d, start, step, lambda acc: F.coalesce(acc.found, acc.q + place - acc.p))


def pretty_html(d: Column) -> Column:
    def piece(x):
        t = F.replace(F.replace(F.replace(F.replace(x.text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("&para;<br>"))
        return F.when(x.op == "INSERT", F.concat(F.lit('<ins style="background:#e6ffe6;">'), t, F.lit("</ins>"))).when(x.op == "DELETE", F.concat(F.lit('<del style="background:#ffe6e6;">'), t, F.lit("</del>"))).otherwise(F.concat(F.lit("<span>"), t, F.lit("</span>")))

    return F.array_join(F.transform(d, piece), "")


def shifts(d: Column) -> Column:
    """Source positions with the shift that holds from there on, in order; a first negative shift also holds from 0."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("shift"), F.array().cast("array<struct<pos:int,shift:int>>").alias("out"))

    def step(acc, x):
        n = F.length(x.text)
        pos = acc.pos + F.when(x.op == "INSERT", 0).otherwise(n)
        shift = acc["shift"] + F.when(x.op == "INSERT", n).when(x.op == "DELETE", -n).otherwise(0)
        same = F.filter(acc.out, lambda o: o.pos != pos)
        return F.struct(pos.alias("pos"), shift.alias("shift"), F.concat(same, F.array(F.struct(pos.alias("pos"), shift.alias("shift")))).alias("out"))

    found = F.aggregate(d, start, step, lambda acc: acc.out)
    first = F.try_element_at(found, F.lit(1))["shift"]
    return F.when(first < 0, F.concat(F.array(F.struct(F.lit(0).alias("pos"), first.alias("shift"))), found)).otherwise(found)


def floor_shift(table: Column, pos: Column) -> Column:
    """The shift of the greatest position not above ``pos`` (0 where there is none)."""
    return F.coalesce(F.try_element_at(F.filter(table, lambda x: x.pos <= pos), F.lit(-1))["shift"], F.lit(0))


def shift_tables(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``pairs`` with the column ``shifts`` (see there) from the source text to the target text."""
    return pairs.withColumn("shifts", shifts(diff_udf(F.col(source), F.col(target))))


def move_spans(spans: DataFrame) -> DataFrame:
    """Rows with ``shifts`` and their m_start and m_end moved as a_start and a_end; spans that become negative are dropped."""
    df = spans.withColumn("a_start", F.col("m_start") + floor_shift(F.col("shifts"), F.col("m_start"))).withColumn("a_end", F.col("m_end") + floor_shift(F.col("shifts"), F.col("m_end") - 1))
    return df.where("a_start >= 0 and a_end >= 0").drop("shifts")


def align_spans(spans: DataFrame, source: str, target: str) -> DataFrame:
    """``move_spans`` for rows that carry both texts; with many spans a text, join them with ``shift_tables`` instead."""
    return move_spans(shift_tables(spans, source, target))


def word_spans(text: str | None, words: list[str | None] | None) -> list[tuple[int, int] | None] | None:
    """Where each word of a text is in it, words being those of the text in order but perhaps written differently: they are
    joined by blanks, compared with the text and moved to it. A null word has no place."""
    if text is None or words is None:
        return None
    joined = "".join(w + " " for w in words if w is not None)
    at, shift, pos = [], [], 0
    total = 0
    for op, t in diff(joined, text):
        pos += 0 if op == "INSERT" else len(t)
        total += len(t) if op == "INSERT" else -len(t) if op == "DELETE" else 0
        if at and at[-1] == pos:
            shift[-1] = total
        else:
            at.append(pos)
            shift.append(total)
    if shift and shift[0] < 0:
        at, shift = [0, *at], [shift[0], *shift]

    def moved(p, look):
        i = bisect_right(at, look) - 1
        return p + (shift[i] if i >= 0 else 0)

    out, n = [], 0
    for w in words:
        if w is None:
            out.append(None)
            continue
        out.append((moved(n, n), moved(n + len(w), n + len(w) - 1)))
        n += len(w) + 1
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("m_start", T.IntegerType()), T.StructField("m_end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def word_spans_udf(texts: pd.Series, words: pd.Series) -> pd.Series:
    """array<struct<m_start, m_end>> of ``word_spans``."""
    found = (word_spans(t, None if w is None else list(w)) for t, w in zip(texts, words))
    return pd.Series([x if x is None else [y and {"m_start": y[0], "m_end": y[1]} for y in x] for x in found])
