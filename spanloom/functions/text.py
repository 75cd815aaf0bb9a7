"""Text functions as column expressions. Offsets count code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "[ \\t\\x0B\\f\\r]"
#: Entity names that stand for "no entity".
NO_ENTITY = ("--", "--OOKBE--", "--NME--")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str, trim_lines: bool = True, join_lines: bool = True, paragraphs: bool = True, blanks: bool = True) -> Column:
    """Trim lines, join single line breaks, reduce blank lines to one and runs of blanks to one space, in this order."""
    c = col(c)
    if trim_lines:
        c = F.regexp_replace(c, f"{BLANK}*\\n{BLANK}*", "\n")
    if join_lines:
        c = F.regexp_replace(c, "([^\\n])\\n([^\\n])", "$1 $2")
    if paragraphs:
        c = F.regexp_replace(c, "\\n\\n+", "\n\n")
    return F.regexp_replace(c, f"{BLANK}+", " ") if blanks else c


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_TOKEN = T.StructType([T.StructField("tok_start", T.IntegerType()), T.StructField("tok_end", T.IntegerType()), T.StructField("word", T.StringType())])
#: Bytes of text that are worked on at once, however many texts a batch has; a longer text is worked on alone.
RUN_BYTES = 1 << 20


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, z
        a = z


def in_runs(make: Callable[..., pa.Array], texts: pa.Array, *more: pa.Array) -> pa.Array:
    """``make`` of a batch, run by run, so that what it needs besides its result doesn't grow with the batch."""
    parts = [make(texts[a:z], *(x[a:z] for x in more)) for a, z in runs(texts)]
    return pa.concat_arrays(parts) if parts else make(texts, *more)


@F.arrow_udf(T.ArrayType(_TOKEN))
def token_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The tokens of each text in order: tok_start, tok_end, word. They leave the worker run by run, so that it never has those of a
    whole batch."""
    for texts in batches:
        for a, z in runs(texts):
            yield tokenized(texts[a:z])


def tokenized(texts: pa.Array) -> pa.Array:
    """``token_arrays`` of an Arrow array; for a whole table see ``tokens``."""
    null = texts.is_null()
    texts = texts.cast(pa.string()).fill_null("")
    if len(texts) == 0:
        return pa.array([], pa.list_(pa.struct([("tok_start", pa.int32()), ("tok_end", pa.int32()), ("word", pa.string())])))
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inner = (data & 0xC0) == 0x80
    begin = ~_ALNUM[data] & ~inner
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(data))
    blank = _WHITE[data[start]]
    before = np.concatenate([[0], np.cumsum(~inner)])  # characters before each byte
    doc = np.searchsorted(offsets, start, "right") - 1
    word = start + blank
    some = end > word
    kept = np.ones(len(data), bool)
    kept[start[blank]] = False
    word, end, doc = word[some], end[some], doc[some]
    bounds = np.concatenate([[0], np.cumsum(end - word)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(word), [None, pa.py_buffer(bounds), pa.py_buffer(data[kept])])
    first = before[offsets[doc]]
    tokens = pa.StructArray.from_arrays([pa.array((before[word] - first).astype(np.int32)), pa.array((before[end] - first).astype(np.int32)), words], ["tok_start", "tok_end", "word"])
    at = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), tokens, mask=null)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tok_idx, tok_start, tok_end, word: split before every character that is no ASCII letter or digit, with white
    space stripped and empty words dropped. Null texts have no tokens. Nothing is exchanged, and tokens leave a task run by run."""
    rows = docs.select(key, F.posexplode(token_arrays(F.col(text).cast("string"))).alias("tok_idx", "t"))
    return rows.select(key, "tok_idx", "t.tok_start", "t.tok_end", "t.word")


def xml_escape(c: Column | str) -> Column:
    c = F.regexp_replace(col(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\"", "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescape(c: Column | str) -> Column:
    c = col(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def initials(c: Column | str) -> Column:
    """First letter of every run of ASCII letters and whole runs of digits; up to two more letters if that is one character."""
    c = F.coalesce(col(c), F.lit(""))
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    short = F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), x).otherwise(F.left(x, F.lit(1)))), "")
    last = F.try_element_at(runs, F.lit(-1))
    return F.when((F.length(short) < 2) & last.rlike("^[A-Za-z]"), F.concat(short, F.substring(last, 2, 2))).otherwise(short)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix, by halving: equal prefixes are tested at log2 places."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))

    def step(acc, i):
        more = acc + F.pow(F.lit(2.0), i).cast("int")
        return F.when((more <= n) & (F.substring(a, F.lit(1), more) == F.substring(b, F.lit(1), more)), more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(30), F.lit(0)), F.lit(0), step)


def common_suffix(a: Column | str, b: Column | str) -> Column:
    return common_prefix(F.reverse(col(a)), F.reverse(col(b)))


def overlap_length(a: str, b: str) -> int:
    """Length of the longest suffix of ``a`` that is a prefix of ``b``, in time linear in the shorter text."""
    n = min(len(a), len(b))
    a, b = a[len(a) - n :], b[:n]
    border, k = [0] * n, 0  # the longest proper prefix of b that ends at each place too
    for i in range(1, n):
        while k and b[k] != b[i]:
            k = border[k - 1]
        k += b[k] == b[i]
        border[i] = k
    k = 0
    for x in a:
        while k and (k == n or b[k] != x):
            k = border[k - 1]
        k += k < n and b[k] == x
    return k


@F.arrow_udf(T.IntegerType())
def _overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else overlap_length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def common_overlap(a: Column | str, b: Column | str) -> Column:
    """Length of the longest suffix of ``a`` that is a prefix of ``b``."""
    return _overlaps(col(a).cast("string"), col(b).cast("string"))


def capitalize(c: Column | str) -> Column:
    """Letters after anything but a letter or digit in upper case, all others in lower case."""
    parts = F.regexp_extract_all(col(c), F.lit("[\\p{L}\\p{Nd}]+|[^\\p{L}\\p{Nd}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def truncate(c: Column | str, n: int) -> Column:
    return F.rpad(col(c), n, " ")


def ellipsis(c: Column | str, n: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def line_breaks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "\\n{1,3}", "<br/>")


def span_string(text: Column | str, start: Column | str, end: Column | str) -> Column:
    text, start, end = col(text), col(start), col(end)
    bad = (start < 0) | (end < start) | (end > F.length(text))
    return F.when(text.isNull(), "").when(bad, F.format_string("(%d-%d, invalid)", start, end)).otherwise(F.substring(text, start + 1, end - start))


def same_span(s1, e1, s2, e2) -> Column:
    return (col(s1) == col(s2)) & (col(e1) == col(e2))


def overlapping(s1, e1, s2, e2) -> Column:
    return F.least(col(e1), col(e2)) > F.greatest(col(s1), col(s2))


def contains(s1, e1, s2, e2) -> Column:
    return (col(s1) <= col(s2)) & (col(e1) >= col(e2))


def format_ms(ms: Column | str) -> Column:
    """Milliseconds in words: ms, s, min and s, or h and min."""
    ms = col(ms)
    minutes, hours = F.floor(ms / 60000), F.floor(ms / 3600000)

    def rounded(x, n):
        # bround takes the shortest decimal for the number, and rounds doubles just below or above a half as if they were one
        return F.rint(x * F.lit(10.0**n)) / F.lit(10.0**n)

    def two(x):
        return F.format_string("%.2f", rounded(x, 2))

    def one(x):
        return F.format_string("%.1f", rounded(x, 1))

    return (
        F.when(ms < 100, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 60000, F.concat(two(ms / 1000.0), F.lit(" s")))
        .when(ms < 3600000, F.concat(minutes.cast("string"), F.lit(" min, "), one((ms / 1000.0) % 60.0), F.lit(" s")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" h, "), one((ms / 60000.0) % 60.0), F.lit(" min")))
    )


def number_pattern(c: Column | str, pattern: str) -> Column:
    """A number by a pattern: ``+`` shows the sign of positive ones, ``#`` a least digit each, one other character among
    them separates groups of three, digits after a point are fractions (rounded half to even), a blank begins a suffix.

    Groups are counted from the point or the end, also without fractions. NaN and infinities give NaN and INF; null stays null.
    """
    body, blank, suffix = pattern.partition(" ")
    sign = body[: len(body) - len(body.lstrip("[]+-/"))]
    whole, point, fractions = body[len(sign) :].partition(".")
    separator = next((x for x in whole if x not in "#0123456789"), "")
    least, n = len(whole) - whole.count(separator) * bool(separator), len(fractions)
    if not whole:
        raise ValueError(f"no number pattern: {pattern!r}")
    d = col(c).cast("double")
    digits = F.format_string("%.0f", F.rint(F.abs(d) * F.lit(10.0**n)))
    digits = F.when(F.length(digits) < least + n, F.lpad(digits, least + n, "0")).otherwise(digits)
    head, tail = F.left(digits, F.length(digits) - n), F.right(digits, F.lit(n))
    if separator:
        head = F.regexp_replace(head, "(?<=\\d)(?=(?:\\d{3})+$)", separator.replace("\\", "\\\\").replace("$", "\\$"))
    shown = F.concat(head, F.lit("."), tail) if point else head
    mark = F.when(d < 0, "-").otherwise("+" if "+" in sign else "")
    finite = F.concat(mark, shown, F.lit(blank + suffix))
    return F.when(d.isNull(), F.lit(None).cast("string")).when(F.isnan(d), "NaN").when(F.abs(d) == float("inf"), F.concat(mark, F.lit("INF"))).otherwise(finite)


def last(c: Column | str) -> Column:
    """The last character, the empty string without one."""
    return F.right(col(c), F.lit(1))


def cut_last(c: Column | str) -> Column:
    c = col(c)
    return F.left(c, F.greatest(F.length(c) - 1, F.lit(0)))


def upper_first(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def lower_first(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def shown_span(text: Column | str, start: Column | str, end: Column | str, info: Column | str | None = None) -> Column:
    """A span for people to read: line breaks as an arrow, then its attributes as JSON."""
    out = F.replace(span_string(text, start, end), F.lit("\n"), F.lit(" ↵ "))
    return out if info is None else F.concat(out, F.coalesce(F.concat(F.lit(" "), F.to_json(col(info))), F.lit("")))


def iso_date(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def iso_time(ts: Column | str) -> Column:
    """Date and time with the milliseconds in four digits."""
    return F.concat(F.date_format(col(ts), "yyyy-MM-dd 'T' HH:mm:ss.'0'SSS"))


def iso_week_time(ts: Column | str) -> Column:
    """Year, week and day of the week (Sunday is 0) and time; a week starts on Sunday and week 1 has the first of January, so
    the last days of a year may be in week 1."""
    ts = col(ts)
    day = F.dayofweek(ts) - 1
    saturday = F.date_add(ts.cast("date"), 6 - day)
    week = F.when(F.year(saturday) > F.year(ts), F.lit(1)).otherwise(F.floor((F.dayofyear(saturday) + 6) / 7))
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-w"), F.lpad(week.cast("string"), 2, "0"), F.lit("-"), day.cast("string"), F.date_format(ts, " 'T' HH:mm:ss.'0'SSS"))


def time_stamp(c: Column | str) -> Column:
    """The digits of an ISO time before the fractions."""
    return F.regexp_replace(F.substring_index(col(c), ".", 1), "\\D", "")
