"""Codecs, delimiter readers, dictionaries, position tracking, times and line sources."""

import datetime
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from spanloom.functions import codecs, collections, delimited
from spanloom.functions import text as tx
from spanloom.sources import lines


def _each(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], f"i int, v {kind}")
    got = dict(df.select("i", f(F.col("v"))).collect())
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_percent(spark):
    _each(spark, codecs.percent_decode, {"%41%ZZ%42": "A%ZZB", "a+b%20%C3%BC": "a+b ü", "%E9x%": "éx%", "%F0%9F%98%80": "😀", "": "", "%c3": "Ã", "%C3%41": "ÃA", None: None})
    _each(spark, codecs.percent_encode, {"a b-ü~*": "a%20b%2D%C3%BC%7E%2A", "😀": "%F0%9F%98%80"})
    _each(spark, codecs.uri_path_encode, {"a b/c:d@e-f_g~h%2D&\"": "a%20b%2Fc%3Ad@e-f_g~h%252D&%22"})
    _each(spark, lambda c: codecs.uri_path_encode(c, xml=True), {"a&b\"c,d": "a%26b%22c,d"})
    r = random.Random(1)
    texts = ["".join(r.choice("aZ0 %&+-._~/é€😀\n") for _ in range(12)) for _ in range(50)]
    _each(spark, lambda c: codecs.percent_decode(codecs.percent_encode(c)), {t: t for t in texts})
    _each(spark, codecs.percent_encode, {t: "".join(x if x.isascii() and x.isalnum() else "".join(f"%{b:02X}" for b in x.encode()) for x in t) for t in texts})
    _each(spark, codecs.percent_decode, {urllib.parse.quote(t): t for t in texts if "+" not in t})


def test_entities(spark):
    _each(spark, codecs.ampersand_decode, {"&eacute;&#65;&#x42;&nope; &amp": "éAB&nope; &", "a &amp b&lt;": "a & b<", "&AMP;&#xZ;&;": "&&#xZ;&;", "&amp\n": "&amp\n", "&#55357;": "�", None: None})
    _each(spark, codecs.ampersand_decode_decimal, {"&#65;&#x42;&lt;": "A&#x42;<"})
    _each(spark, codecs.ampersand_encode, {"<a & \"b'>\té😀~": "&lt;a &amp; &quot;b&apos;&gt;&#9;&#233;&#128512;~", "": ""})
    _each(spark, codecs.ampersand_encode_all, {"a_1 é": "a_1&#32;&#233;"})
    _each(spark, codecs.to_html, {"a<b\nc": "a&lt;b<BR>c"})
    printable = "".join(chr(n) for n in range(32, 128))
    _each(spark, lambda c: codecs.ampersand_decode(codecs.ampersand_encode(c)), {printable: printable, "ü\t😀": "ü\t😀"})


def test_entities_with_places(spark):
    text = "x &amp;y &lt; z &nope; &#65;"
    row = spark.createDataFrame([(text,), (None,)], "v string").select(codecs.ampersand_decode_tracked("v").alias("d")).collect()
    assert row[0].d.text == "x &y < z &nope; A" and row[1].d.text is None
    plain = row[0].d.text
    places = spark.createDataFrame([(p, [tuple(c) for c in row[0].d.changes]) for p in range(len(plain) + 1)], "p int, c array<struct<pos:int,delta:int>>")
    back = dict(places.select("p", collections.translate("p", "c")).collect())
    assert all(text[back[p]] == plain[p] or text[back[p]] == "&" for p in range(len(plain))) and back[len(plain)] == len(text)
    forth = spark.createDataFrame([(p, [tuple(c) for c in row[0].d.changes]) for p in range(len(text) + 1)], "p int, c array<struct<pos:int,delta:int>>")
    for p, f, cut, exact in forth.select("p", collections.translate_forward("p", "c"), collections.cut_away("p", "c"), collections.translate_exactly("p", "c")).collect():
        assert cut == (f is None) and (f is None or text[p:] == "" or plain[f] == text[p] or text[p] == "&")
        assert exact == (f if f is not None else min(q for q in range(len(plain) + 1) if back[q] > p))


def test_backslashes(spark):
    _each(spark, codecs.backslash_encode, {"aB 1_é😀": "aB 1\\u005f\\u00e9\\ud83d\\ude00", "": ""})
    _each(spark, codecs.backslash_encode_names, {"a b_é": "a\\u0020b_\\u00e9"})
    _each(spark, codecs.backslash_encode_ascii, {"a \"b\\ü~\n": "a \\u0022b\\u005c\\u00fc~\\u000a"})
    _each(spark, lambda c: codecs.backslash_encode(c, short=True), {"a\\b\n,": "a\\\\b\\n\\u002c"})
    _each(spark, codecs.backslash_decode, {r"A\n\101\t\8x\q": "A\nA\t\\8x\\q", r"\ud83d\ude00": "😀", r"\1234": "\u029c", None: None})
    both = {t: t for t in ("aé\\😀\n\"'", "", "x")}
    for f in (codecs.backslash_encode, codecs.backslash_encode_names, codecs.backslash_encode_ascii):
        _each(spark, lambda c, f=f: codecs.backslash_decode(f(c)), both)


def test_decode_any_and_hex(spark):
    _each(spark, codecs.decode, {"%41&amp;\\u0042Ã©&nope;": "A&Bé&nope;", "plain": "plain"})
    _each(spark, codecs.decode_and_normalize, {"F%C3%BC&szlig;e": "Fuesse"})
    _each(spark, codecs.hex_all, {"aé ": "61 E9 20 ", "": ""})
    _each(spark, codecs.encode_hex, {"a-é1": "a2DE91"})
    _each(spark, lambda c: codecs.chars_as_utf8(codecs.utf8_as_chars(c)), {"aé€": "aé€"})


def test_character_classes(spark):
    chars = [chr(n) for n in range(33, 127)] + ["é", "ab", ""]
    for f, want in ((codecs.is_alphanumeric, lambda c: c.isascii() and c.isalnum()), (codecs.is_unreserved, lambda c: c.isascii() and (c.isalnum() or c in "-._~")), (codecs.is_sub_delimiter, lambda c: c in "!$&'()*+,="), (codecs.is_gen_delimiter, lambda c: c in ":/?#[]@"), (codecs.is_reserved, lambda c: c in "!$&'()*+,=:/?#[]@"), (codecs.is_path_character, lambda c: c.isascii() and (c.isalnum() or c in "-._~!$&'()*+,=@"))):
        _each(spark, f, {c: len(c) == 1 and bool(want(c)) for c in chars})
    _each(spark, codecs.is_escaped, {"%2f": True, "%2": False, "%2fx": False})


def test_small_text_functions(spark):
    _each(spark, tx.last, {"abc": "c", "": "", None: None})
    _each(spark, tx.cut_last, {"abc": "ab", "": "", "a": ""})
    _each(spark, tx.upper_first, {"aBC": "ABC", "éa": "Éa", "": ""})
    _each(spark, tx.lower_first, {"ABC": "aBC"})
    df = spark.createDataFrame([("a\nb c", 0, 3, {"k": "v"}), ("abc", 2, 9, None)], "t string, s int, e int, info map<string,string>")
    assert [r[0] for r in df.select(tx.shown_span("t", "s", "e", "info")).collect()] == ['a ↵ b {"k":"v"}', "(2-9, invalid)"]


def test_times(spark):
    def week(d):
        """The week that has the day, counting weeks from Sunday; the one with the first of January is the first."""
        saturday = d + datetime.timedelta(days=6 - (d.weekday() + 1) % 7)
        return 1 if saturday.year > d.year else (saturday.timetuple().tm_yday + 6) // 7

    days = [datetime.datetime(2000, 1, 1, 3, 4, 5, 67000) + datetime.timedelta(days=37 * i) for i in range(250)] + [datetime.datetime(y, 12, 31) for y in range(2000, 2012)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    for ts, iso, date, w, stamp in df.select("ts", tx.iso_time("ts"), tx.iso_date("ts"), tx.iso_week_time("ts"), tx.time_stamp(tx.iso_time("ts"))).collect():
        time = f"{ts:%H:%M:%S}.0{ts.microsecond // 1000:03}"
        assert (iso, date, stamp) == (f"{ts:%Y-%m-%d} T {time}", f"{ts:%Y-%m-%d}", f"{ts:%Y%m%d%H%M%S}")
        assert w == f"{ts.year}-w{week(ts):02}-{(ts.weekday() + 1) % 7} T {time}"


def test_delimiters(spark):
    _each(spark, lambda c: delimited.read_to(c, ";]"), {"ab;c": "ab", "a]b;": "a", "abc": "abc", "": "", "a\nb;": "a\nb"})
    _each(spark, lambda c: delimited.read_to(c, ";", most=2), {"abcd;e": "ab"})
    _each(spark, delimited.read_to_space, {"ab c": "ab", "ab\tc": "ab", " a": ""})
    _each(spark, delimited.first_after_space, {" \n x": "x", "  ": None})
    _each(spark, lambda c: delimited.read_through(c, "</a>"), {"x</a>y": "x</a>", "xy": "xy", "<<</a>": "<<</a>"})
    _each(spark, lambda c: delimited.read_to_boundary(c, "--"), {"x--y": "x", "xy": None, "--": ""})
    _each(spark, lambda c: delimited.read_to_boundary(c, "--", most=3), {"x--y": "x", "xx--y": None})
    _each(spark, lambda c: delimited.scroll_past(c, "<a"), {"<<a>x": ">x", "b": None})
    _each(spark, lambda c: delimited.scroll_past_any(c, ",;"), {"a;b,c": "b,c", "a": None, "a\n,b": "b"})
    _each(spark, lambda c: delimited.read_between(c, "[", "]"), {"a[b]c]": "b", "a]b[c": None, "[]": ""})
    _each(spark, lambda c: delimited.find(c, ["xyz", "b"]), {"axyzb": 0, "ab xyz": 1, "a": -1, "": -1})
    _each(spark, lambda c: delimited.find(c, ["XYZ", "b"], ignore_case=True), {"axyz": 0, "aB": 1})
    _each(spark, lambda c: delimited.before_any(c, ["xyz", "b"]), {"axyzb": "a", "ab xyz": "a", "a": "a"})


@pytest.mark.parametrize("longest", [False, True])
def test_dictionary(spark, longest):
    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))) for _ in range(9)}
    texts = {i: "".join(r.choice("abc") for _ in range(r.randrange(0, 30))) for i in range(40)}
    df = spark.createDataFrame([*texts.items(), (99, None)], "id int, t string")
    got = {(x.id, x.start): x.len for x in collections.dictionary_match(df, spark.createDataFrame([(w,) for w in [*words, "", None]], "w string"), ["id"], "t", "w", longest).collect()}
    want = {}
    for i, t in texts.items():
        for at in range(len(t)):
            if here := [len(w) for w in words if t.startswith(w, at)]:
                want[i, at] = (max if longest else min)(here)
    assert got == want
    array = F.array(*[F.lit(w) for w in sorted(words)])
    if not longest:
        _each(spark, lambda c: collections.contained_length(array, c), {t: want.get((i, 0), -1) for i, t in texts.items()})
    _each(spark, lambda c: collections.contains_word(array, c), {t: t in words for t in [*texts.values(), *words]})
    _each(spark, lambda c: collections.longest_prefix(c, F.lit("abcab")), {t: max(("abcab"[:n] for n in range(6) if "abcab"[:n] in t), key=len) for t in texts.values()})
    assert collections.dictionary_match(df, df.where("id < 0").select("t"), ["id"], "t", "t").count() == 0


def test_sets_and_counters(spark):
    df = spark.createDataFrame([([1, 2, 2], [2, 3, 4, 2]), ([], [1]), ([5, 1], [9, 8])], "a array<int>, b array<int>")
    assert [tuple(r) for r in df.select(collections.intersection_size("a", "b"), collections.sets_meet("a", "b"), F.size(collections.set_union("a", "b")), collections.index_of("b", 2)).collect()] == [(2, True, 4, 0), (0, False, 1, -1), (0, False, 4, -1)]
    row = spark.range(1).select(collections.constant_map(b=2, a=1), collections.constant_set("y", "x", "y")).collect()[0]
    assert list(row[0].items()) == [("a", 1), ("b", 2)] and row[1] == ["x", "y"]
    pairs = spark.createDataFrame([("a", 1), ("b", 5), ("a", 7)], "k string, v int")
    assert [tuple(r) for r in collections.keys_by_count(collections.counts(pairs, ["k"]), ["k"]).collect()] == [("a", 2), ("b", 1)]
    assert dict(collections.counts(pairs, ["k"], F.col("v")).collect()) == {"a": 8, "b": 5} and dict(collections.greatest_per_key(pairs, ["k"], "v").collect()) == {"a": 7, "b": 5}
    assert {k: sorted(v) for k, v in collections.multimap(pairs, ["k"], "v").collect()} == {"a": [1, 7], "b": [5]}


def test_comparisons_and_defaults(spark):
    df = spark.createDataFrame([(1, 2, "x", {"k": 1}, [4, 5]), (None, 2, "y", {"k": None}, []), (None, None, None, None, [7]), (3, 2, "z", {"j": 9}, None)], "a int, b int, s string, m map<string,int>, l array<int>")
    assert [r[0] for r in df.select(collections.compare("a", "b")).collect()] == [-1, -1, 0, 1]
    assert [r[0] for r in df.select(collections.compare_tuples([("b", "b"), ("a", "b"), (F.lit(2), F.lit(1))])).collect()] == [-1, -1, 1, 1]
    assert [tuple(r) for r in df.select(collections.value_or("m", "k", 0), collections.greatest_value("m"), collections.element("l", 0), collections.element("l", -1)).collect()] == [(1, 1, 4, 5), (0, None, None, None), (0, None, 7, 7), (0, 9, None, None)]


def test_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("x\ny\n", encoding="utf-8")
    (tmp_path / "d" / "b.txt").write_text("é\nz", encoding="utf-8")
    (tmp_path / "d" / "c.log").write_bytes("é\nz\n".encode("latin-1"))
    assert lines.count_lines(spark, str(tmp_path / "a.txt")) == 2
    assert {r.file.rsplit("/", 1)[1]: r.n for r in lines.count_all_lines(spark, str(tmp_path), ".txt").collect()} == {"a.txt": 2, "b.txt": 2}
    assert [r.value for r in lines.lines(spark, str(tmp_path / "d" / "b.txt")).collect()] == ["é", "z"]
    assert [r.value for r in lines.lines(spark, str(tmp_path / "d" / "c.log"), "ISO-8859-1").collect()] == ["é", "z"]
    lines.write(spark.createDataFrame([("a",), (None,), ("b",)], "v string").coalesce(1), "v", str(tmp_path / "out"))
    assert [r.value for r in lines.lines(spark, str(tmp_path / "out")).collect()] == ["a", "", "b"]
