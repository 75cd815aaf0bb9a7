"""Encoders and decoders. Column expressions where Spark has the parts, Arrow UDFs for the rest."""

from __future__ import annotations

import html.entities
import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, in_runs


def _decoder(mark: str, change):
    """An Arrow function from text to text: only texts with a match of ``mark`` (without which ``change`` changes nothing) are taken
    out of their Arrow array, repeated ones once."""

    def decoded(texts: pa.Array) -> pa.Array:
        on = pc.fill_null(pc.match_substring_regex(texts, mark), False)
        some = texts.filter(on).dictionary_encode()
        changed = pa.array([change(t) for t in some.dictionary.to_pylist()], pa.string()).take(some.indices)
        return pc.replace_with_mask(texts, on, changed)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return in_runs(decoded, texts)

    return run


def percent_encode(c: Column | str) -> Column:
    """UTF-8 bytes other than ASCII letters and digits as %XX (blank is %20)."""
    c = F.url_encode(col(c))
    for a, b in (("+", "%20"), ("-", "%2D"), ("_", "%5F"), (".", "%2E"), ("*", "%2A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def uri_path_encode(c: Column | str, xml: bool = False) -> Column:
    """Percent encoding that keeps the characters of a URI path segment; with ``xml`` ampersands and quotes are encoded too."""
    c = percent_encode(c)
    for x in PATH_SIGNS:
        if not (xml and x == "&"):
            c = F.replace(c, F.lit(f"%{ord(x):02X}"), F.lit(x))
    return c


def _whole(text: str) -> str:
    """Pairs of surrogates as the characters they stand for, single ones as the replacement character."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if any("\ud800" <= x <= "\udfff" for x in text) else text


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _utf8(codes: list[int]) -> str:
    """Bytes as UTF-8; a byte that starts no whole sequence is the character of its number."""
    out, i = [], 0
    while i < len(codes):
        c = codes[i]
        n = 1 if c < 0x80 else 2 if c >> 5 == 6 else 3 if c >> 4 == 14 else 4 if c >> 3 == 30 else 0
        more = codes[i + 1 : i + n]
        if n > 1 and len(more) == n - 1 and all(x >> 6 == 2 for x in more):
            value = c & (0xFF >> (n + 1))
            for x in more:
                value = value << 6 | x & 0x3F
            if value < 0x110000:
                out.append(chr(value))
                i += n
                continue
        out.append(chr(c))
        i += 1
    return "".join(out)


def decode_percents(text: str) -> str:
    """Every %XX as a byte, bytes in a row as UTF-8; what is malformed stays, and so does a plus sign."""
    return _whole(_PERCENT.sub(lambda m: _utf8([int(x, 16) for x in m[0].split("%")[1:]]), text))


percent_decode = _decoder("%", decode_percents)


#: A name or number ended by a semicolon, which belongs to it, or by a space or the end.
_ENTITY = re.compile(r"&(?:#([0-9]+)|#x([0-9A-Fa-f]+)|([A-Za-z][A-Za-z0-9]*))(?:;|(?=[ \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])|\Z)")
_NAMES = {**html.entities.name2codepoint, "apos": 39}


def _entity(m: re.Match, hexadecimal: bool = True) -> str:
    if m[1] or m[2]:
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if n < 0x110000 and (m[1] or hexadecimal) else m[0]
    n = _NAMES.get(m[3], _NAMES.get(m[3].lower()))
    return m[0] if n is None else chr(n)


def decode_entities(text: str, hexadecimal: bool = True) -> str:
    """Named, decimal and hexadecimal entities ended by a semicolon, a space (which stays) or the end; unknown ones stay."""
    return _whole(_ENTITY.sub(lambda m: _entity(m, hexadecimal), text))


def decode_entities_tracked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The decoded text, and for each replaced entity the place after it in the decoded text and how much was lost there."""
    out, changes, at, n = [], [], 0, 0
    for m in _ENTITY.finditer(text):
        x = _entity(m)
        out += [text[at : m.start()], x]
        n += m.start() - at + len(x)
        at = m.end()
        if x != m[0]:
            changes.append((n, len(m[0]) - len(x)))
    return "".join(out) + text[at:], changes


_CHANGE = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("delta", T.IntegerType())])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("changes", T.ArrayType(_CHANGE))]))
def ampersand_decode_tracked(s: pd.Series) -> pd.DataFrame:
    """text, and changes for ``collections.translate``, which leads from places in it to those of the encoded text."""
    rows = [(None, None) if x is None else decode_entities_tracked(x) for x in s]
    return pd.DataFrame({"text": [t for t, _ in rows], "changes": [c and [{"pos": p, "delta": d} for p, d in c] if c is not None else None for _, c in rows]})


#: Without hexadecimal entities, which stay.
ampersand_decode_decimal = _decoder("&", lambda x: decode_entities(x, False))
ampersand_decode = _decoder("&", decode_entities)


def _by_character(c: Column | str, keep: str, other) -> Column:
    """The characters that match ``keep`` as they are, and ``other`` of the rest."""
    return F.array_join(F.transform(F.split(col(c), ""), lambda x: F.when((x == "") | x.rlike(keep), x).otherwise(other(x))), "")


def _decimal(x: Column) -> Column:
    return F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))


def ampersand_encode(c: Column | str) -> Column:
    """The five XML names, and decimal references for controls and non-ASCII characters."""
    names = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\"": "&quot;", "'": "&apos;"}

    def other(x):
        out = _decimal(x)
        for k, v in names.items():
            out = F.when(x == k, v).otherwise(out)
        return out

    return _by_character(c, "^[ !#$%(-;=?-\\x7F]$", other)


def ampersand_encode_all(c: Column | str) -> Column:
    """Everything but ASCII letters, digits and the underscore as decimal references."""
    return _by_character(c, "^[A-Za-z0-9_]$", _decimal)


def to_html(c: Column | str) -> Column:
    """``ampersand_encode`` with a break for each line feed."""
    return F.replace(ampersand_encode(c), F.lit("&#10;"), F.lit("<BR>"))


_BACKSLASH = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|([0-8]+)|([btnfr\\\"']))")
_SHORT = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", "\\": "\\", "\"": "\"", "'": "'"}


def _backslash(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    if m[2]:
        return m[0] if "8" in m[2] or int(m[2], 8) > 0xFFFF else chr(int(m[2], 8))
    return _SHORT[m[3]]


def decode_backslashes(text: str) -> str:
    """\\uXXXX, octal numbers and the usual short escapes; others stay."""
    return _whole(_BACKSLASH.sub(_backslash, text))


backslash_decode = _decoder(r"\\", decode_backslashes)


def backslash_encode(c: Column | str, keep: str = "^[A-Za-z0-9 ]$", short: bool = False) -> Column:
    """Characters that don't match ``keep`` as \\uXXXX, those above U+FFFF as two; with ``short`` backslashes and line feeds
    as \\\\ and \\n."""

    def four(n):
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def other(x):
        n = F.ascii(x)
        out = F.when(n < 0x10000, four(n)).otherwise(F.concat(four(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), four(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF))))
        return F.when(x == "\\", "\\\\").when(x == "\n", "\\n").otherwise(out) if short else out

    return _by_character(c, keep, other)


def backslash_encode_names(c: Column | str) -> Column:
    """Everything but ASCII letters, digits and the underscore."""
    return backslash_encode(c, "^[A-Za-z0-9_]$")


def backslash_encode_ascii(c: Column | str) -> Column:
    """Everything but printable ASCII, and the backslash and the quote."""
    return backslash_encode(c, "^[ !#-\\[\\]-\\x7F]$")


_ANY = re.compile(f"(?P<percent>{_PERCENT.pattern})|(?P<entity>{_ENTITY.pattern})|(?P<backslash>{_BACKSLASH.pattern})|(?P<utf8>[\xc0-\xf7][\x80-\xbf]+)")


def decode_any(text: str) -> str:
    """At every place the first that fits of: percent code, entity, backslash code, UTF-8 bytes as characters, the character."""

    def one(m):
        if m["percent"]:
            return decode_percents(m[0])
        if m["entity"]:
            return decode_entities(m[0])
        if m["backslash"]:
            return _BACKSLASH.sub(_backslash, m[0])
        return _utf8([ord(x) for x in m[0]])

    return _whole(_ANY.sub(one, text))


decode = _decoder("[%&\\\\\u00c0-\u00f7]", decode_any)


def hex_all(c: Column | str) -> Column:
    """The number of every character in upper-case hexadecimal, each followed by a blank."""
    return F.array_join(F.transform(F.split(col(c), ""), lambda x: F.when(x == "", "").otherwise(F.concat(F.hex(F.ascii(x)), F.lit(" ")))), "")


def encode_hex(c: Column | str) -> Column:
    """Everything but ASCII letters and digits as upper-case hexadecimal numbers."""
    return _by_character(c, "^[A-Za-z0-9]$", lambda x: F.hex(F.ascii(x)))


# Character classes of URIs.
ALPHANUMERIC = "A-Za-z0-9"
UNRESERVED = "-._~"
SUB_DELIMITERS = "!$&'()*+,="
GEN_DELIMITERS = ":/?#[]@"
PATH_SIGNS = UNRESERVED + SUB_DELIMITERS + "@"


def _one_of(c: Column | str, signs: str, letters: bool) -> Column:
    return col(c).rlike(f"^[{ALPHANUMERIC if letters else ''}{re.escape(signs)}]$")


def is_alphanumeric(c: Column | str) -> Column:
    return _one_of(c, "", True)


def is_unreserved(c: Column | str) -> Column:
    return _one_of(c, UNRESERVED, True)


def is_sub_delimiter(c: Column | str) -> Column:
    return _one_of(c, SUB_DELIMITERS, False)


def is_gen_delimiter(c: Column | str) -> Column:
    return _one_of(c, GEN_DELIMITERS, False)


def is_reserved(c: Column | str) -> Column:
    return _one_of(c, SUB_DELIMITERS + GEN_DELIMITERS, False)


def is_path_character(c: Column | str) -> Column:
    return _one_of(c, PATH_SIGNS, True)


def is_escaped(c: Column | str) -> Column:
    return col(c).rlike("^%[0-9A-Fa-f]{2}$")


#: Letters written with two letters, and signs.
PAIRS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("–", "-"), ("—", "-"), ("‘", "'"), ("’", "'"), ("“", "\""), ("”", "\""), ("…", "..."), (" ", " "))
_MARKED = "".join(chr(n) for n in range(0xC0, 0x180) if unicodedata.decomposition(chr(n)) and chr(n) not in "".join(a for a, _ in PAIRS) and ord(unicodedata.normalize("NFD", chr(n))[0]) < 128)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def ascii_normalize(c: Column | str) -> Column:
    """Latin letters without marks, two-letter forms, plain dashes and quotes; any other non-ASCII character is [?]."""
    c = col(c)
    for a, b in PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), "[^\\x00-\\x7F]", "[?]")


def utf8_as_chars(c: Column | str) -> Column:
    """Each UTF-8 byte as one character."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def chars_as_utf8(c: Column | str) -> Column:
    return F.decode(F.encode(col(c), "ISO-8859-1"), "UTF-8")


def decode_and_normalize(c: Column | str) -> Column:
    return ascii_normalize(decode(col(c)))
