"""Tokens, text functions, markup, sources, scores and differences."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import codecs
from spanloom.functions import text as tx
from spanloom.operators import alignment, chains, markup, scores, sweep
from spanloom.sources import conll, xml


def _one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v")).alias("x")).collect()[0].x


def test_tokens(spark):
    text = "foo,bar  don't für (x). Next"
    rows = tx.tokens(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("tok_idx").collect()
    assert [r.word for r in rows] == ["foo", ",bar", "don", "'t", "f", "ür", "(x", ")", ".", "Next"]
    assert all(text[r.tok_start : r.tok_end] == r.word for r in rows)


def test_normalize(spark):
    assert _one(spark, tx.normalize, "a \n b\n\n\n c\t\td") == "a b\n\nc d"


def test_initials(spark):
    cases = {"Bertrand_Russel": "BR", "missiles": "mis", "mi": "mi", "{John_Russel123,Katharine_Russel}": "JR123KR", "123": "123", "": ""}
    assert {k: _one(spark, tx.initials, k) for k in cases} == cases


def test_prefix_suffix_overlap(spark):
    df = spark.createDataFrame([("abcdef", "abcxef"), ("", "a"), ("abc", "abc")], "a string, b string")
    assert [tuple(r) for r in df.select(tx.common_prefix("a", "b"), tx.common_suffix("a", "b")).collect()] == [(3, 2), (0, 0), (3, 3)]
    assert spark.createDataFrame([("xxab", "abyy")], "a string, b string").select(tx.common_overlap("a", "b")).collect()[0][0] == 2


def test_codecs(spark):
    assert _one(spark, codecs.percent_encode, "a b-ü") == "a%20b%2D%C3%BC"
    assert _one(spark, codecs.percent_decode, "a+b%20%C3%BC") == "a+b ü"
    assert codecs.decode_entities("&eacute;&#65;&#x42;&nope; &amp") == "éAB&nope; &"
    assert codecs.decode_backslashes(r"A\n\101") == "A\nA"
    assert _one(spark, codecs.ascii_normalize, "Füße café Ω") == "Fuesse cafe [?]"
    assert _one(spark, tx.capitalize, "a-b cDE1f") == "A-B Cde1f"
    assert _one(spark, tx.xml_escape, "<a & 'b'>") == "&lt;a &amp; &apos;b&apos;&gt;"


def test_marked_text(spark):
    docs = spark.createDataFrame([(0, "abc def ghi jkl")], "doc_id int, text string")
    m = spark.createDataFrame([(0, 0, 0, 3, "1"), (0, 1, 0, 7, "2"), (0, 2, 4, 7, "3")], "doc_id int, seq int, m_start int, m_end int, entity string")
    assert markup.marked_text(docs, m, "doc_id").collect()[0].marked == "<mark entity='2'><mark entity='1'>abc</mark> <mark entity='3'>def</mark></mark> ghi jkl"


XML = """<?xml version='1.0' ?>
<articles>
  <article id='A'>
    The <mark entity='X' min='big'>big &amp; <mark entity="Y">red</mark> dog</mark> and
    <b>more</b> <mark annotation='Z'>text</mark>.
  </article>
  <article id="B">Plain.</article>
</articles>"""


def test_xml_read(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    articles, m = xml.read(spark, str(tmp_path / "a.xml"))
    texts = {r.doc_id: r.text for r in articles.collect()}
    assert texts == {"A": "The big & red dog and more text.", "B": "Plain."}
    got = sorted((texts["A"][r.m_start : r.m_end], r.entity, r.seq, r.min_start) for r in m.collect())
    assert got == [("big & red dog", "X", 2, 4), ("red", "Y", 1, None), ("text", "Z", 3, None)]
    marked = markup.marked_text(articles.where("doc_id = 'A'"), m, "doc_idx").collect()[0].marked
    again, m2 = xml.parse_string(spark, f"<article id='A'>{marked}</article>")
    assert again.collect()[0].text == texts["A"]
    assert sorted((r.m_start, r.m_end, r.entity) for r in m2.collect()) == sorted((r.m_start, r.m_end, r.entity) for r in m.collect())


def test_xml_without_articles_and_with_attributes(spark, tmp_path):
    (tmp_path / "plain.xml").write_text("<?xml version='1.0' ?> just <mark entity='a'>text</mark>\n")
    articles, m = xml.read(spark, str(tmp_path / "plain.xml"))
    assert [r.text for r in articles.collect()] == ["just text"] and [(r.m_start, r.m_end, r.entity) for r in m.collect()] == [(5, 9, "a")]
    (tmp_path / "b.xml").write_text("<articles>\n<article id='A' lang='e&amp;n'>a <mark entity='x' min='big' sure=\"yes &lt; no\">big dog</mark> <mark annotation='y'>cat</mark></article>\n</articles>")
    articles, m = xml.read(spark, str(tmp_path / "b.xml"))
    assert articles.collect()[0].info == {"lang": "e&n"}
    assert {r.entity: (r.min_start, r.min_end, r.info) for r in m.collect()} == {"x": (2, 5, {"sure": "yes < no"}), "y": (None, None, {"annotation": "y"})}
    xml.write(articles, m, str(tmp_path / "out"))
    again, m2 = xml.read(spark, str(tmp_path / "out"))
    columns = ["doc_idx", "doc_id", "text", "info"]
    assert again.select(columns).collect() == articles.select(columns).collect()
    columns = ["m_start", "m_end", "entity", "min_start", "min_end", "info"]
    assert sorted(map(str, m2.select(columns).collect())) == sorted(map(str, m.select(columns).collect()))


def test_large_xml_files_are_split(spark, tmp_path):
    """Articles keep their order where a file is read by several tasks."""
    for name, n in (("a.xml", 300), ("b.xml", 7)):
        (tmp_path / name).write_text("<articles>\n" + "\n".join(f"<article id='{name}{i}'>text {i} <mark entity='e{i}'>x</mark>{' y' * (i % 50)}</article>" for i in range(n)) + "\n</articles>\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        articles, m = xml.read(spark, str(tmp_path))
        assert articles.rdd.getNumPartitions() > 3
        got = sorted((r.file.rsplit("/", 1)[1], r.doc_idx, r.doc_id) for r in articles.collect())
        assert got == sorted((name, i, f"{name}{i}") for name, n in (("a.xml", 300), ("b.xml", 7)) for i in range(n))
        assert m.count() == 307
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_aligned_rewrite(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<articles><article id='1'>say the <mark entity='c'>cat</mark> sat</article><article id='2'>gone <mark entity='d'>x</mark></article></articles>")
    (tmp_path / "b.xml").write_text("<articles><article id='1'>say that the cat sat down</article></articles>")
    xml.rewrite(spark, str(tmp_path / "a.xml"), str(tmp_path / "b.xml"), str(tmp_path / "out"))
    articles, m = xml.read(spark, str(tmp_path / "out"))
    text = articles.collect()[0].text
    assert text == "say that the cat sat down" and [(text[r.m_start : r.m_end], r.entity) for r in m.collect()] == [("cat", "c")]


def test_word_spans(spark):
    text = "The  cat (big) sat."
    words = ["The", "cat", "-LBR-", "big", None, "sat", "."]
    spans = spark.createDataFrame([(text, words), (None, words)], "t string, w array<string>").select(alignment.word_spans_udf("t", "w").alias("s")).collect()
    got = [s and text[s.m_start : s.m_end] for s in spans[0].s]
    assert got[0] == "The" and got[1] == "cat" and got[3] == "big" and got[4] is None and got[5:] == ["sat", "."] and spans[1].s is None


def test_long_diff():
    import random

    r = random.Random(4)
    a = " ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(r.randrange(50)) for _ in range(3000))
    b = a.replace("alpha1 ", "ALPHA1 ").replace("beta2", "bet2")
    c = " ".join(str(r.randrange(10**6)) for _ in range(3000))
    for x, y in ((a, b), (a, c), (a, "")):
        d = alignment.diff(x, y)
        assert "".join(t for o, t in d if o != "INSERT") == x and "".join(t for o, t in d if o != "DELETE") == y
    assert sum(len(t) for o, t in alignment.diff(a, b) if o == "EQUAL") > 0.97 * len(a)


def test_conll_files(spark, tmp_path):
    for side, text in (("g", "#begin document d1\nA (1\nB 1)\nC -\n\nD (1)|(2\nE 2)\n#end document\n"), ("o", "#begin document d1\nA (5\nB 5)\nC (7\n\nD (5)\nE (6)\n#end document\n")):
        (tmp_path / side / "deep").mkdir(parents=True)
        (tmp_path / side / "deep" / "x.conll").write_text(text)
    (tmp_path / "o" / "lonely.conll").write_text("#begin document q\nA (1)\n#end document\n")
    docs = conll.documents(conll.lines(spark, str(tmp_path / "g"), "conll"))
    text = conll.text(docs, 0).collect()[0].text
    assert text == "A B C\nD E"
    assert sorted((text[r.m_start : r.m_end], r.entity) for r in conll.mentions(docs, 0).collect()) == [("A B", "1"), ("D", "1"), ("D E", "2")]
    other = conll.documents(conll.lines(spark, str(tmp_path / "o"), "conll"))
    assert [(r.entity, r.tok_idx, r.is_open) for r in conll.unclosed_brackets(other).collect()] == [("7", 2, True)]
    a, b, alone = conll.paired_folders(spark, str(tmp_path / "g"), str(tmp_path / "o"))
    assert {r.file for r in a.collect()} == {r.file for r in b.collect()} == {"x.conll"} and [r.file for r in alone.collect()] == ["lonely.conll"]
    got = {r.metric: (r.r_nom, r.r_den, r.p_nom, r.p_den) for r in conll.compare_folders(spark, str(tmp_path / "g"), str(tmp_path / "o")).collect()}
    assert got["muc"] == (1.0, 1.0, 1.0, 1.0) and got["ceafm"] == (2.0, 3.0, 2.0, 3.0)
    both = conll.concatenated(conll.lines(spark, str(tmp_path / "o"), "conll"))
    assert [r.doc_id for r in conll.documents(both).select("doc_id", "doc_no").distinct().orderBy("doc_no").collect()] == ["q", "d1"]
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "t.conll").write_text("#begin document d\nold -\n#end document\n#begin document d\nnew -\n#end document\n")
    assert [r.text for r in conll.text(conll.latest(conll.documents(conll.lines(spark, str(tmp_path / "twice")))), 0).collect()] == ["new"]


def test_doubtful_scores_and_info(spark):
    s = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 2.0), ("b", 1.0, 2.0, 1.0, 2.0), ("c", -1.0, 2.0, 0.0, 0.0)], "doc_id string, r_nom double, r_den double, p_nom double, p_den double")
    assert {r.doc_id for r in scores.doubtful(s).collect()} == {"a", "c"}
    rows = spark.createDataFrame([("d", 2, {"x": "2", "z": "9"}), ("d", 1, {"x": "1", "y": "1"}), ("e", 1, None)], "k string, o int, info map<string,string>")
    assert {r.k: r.info for r in scores.merge_info(rows, ["k"], "o").collect()} == {"d": {"x": "2", "y": "1", "z": "9"}, "e": {}}
    merged = sweep.ordered_merge([spark.createDataFrame([(3,), (1,)], "x int"), spark.createDataFrame([(2,)], "x int")], ["x"])
    assert [r.x for r in merged.collect()] == [1, 2, 3]


def test_conll(spark, tmp_path):
    (tmp_path / "x.conll").write_text("#begin document d1\nA (1\nB 1)|(2)\n\nC -\n#end document\njunk\n#begin document d2\nD (1)\n#end document\n")
    docs = conll.documents(conll.lines(spark, str(tmp_path)))
    assert {(r.doc_id, r.text) for r in conll.text(docs, 0).collect()} == {("d1", "A B\nC"), ("d2", "D")}
    rows = docs.where("size(cols) > 0").select("doc_no", F.col("row_idx").alias("tok_idx"), F.element_at("cols", -1).alias("coref"))
    assert sorted(tuple(r) for r in markup.parse_coref(rows, ["doc_no"]).drop("place").collect()) == [(1, "1", 0, 1), (1, "2", 1, 1), (2, "1", 0, 0)]


def test_macro_micro(spark):
    s = spark.createDataFrame([(d, "m", n, k, 0.0, 0.0, 1.0) for d, n, k in (("a", 1.0, 2.0), ("b", 3.0, 4.0), ("c", 0.0, 0.0))], "doc_id string, metric string, r_nom double, r_den double, p_nom double, p_den double, weight double")
    got = {r.doc_id: round(r.recall, 6) for r in scores.display(scores.combine(s)).collect()}
    assert got == {"macro": 0.416667, "micro": 0.666667}


def test_coreference_of_equal_annotations(spark):
    rows = [(0, a, i, 10 * i, 10 * i + 3, "xyz"[i % 3]) for a in (0, 1) for i in range(9)]
    m = sweep.nest(spark.createDataFrame(rows, "doc_id int, ann int, seq int, m_start int, m_end int, entity string"), None, ["doc_id"])
    for df in (chains.muc(m, ["doc_id"]), chains.b_cubed(m, ["doc_id"]), chains.ceaf(m, ["doc_id"], "m"), chains.ceaf(m, ["doc_id"], "e")):
        r = df.collect()[0]
        assert abs(r.r_nom - r.r_den) < 1e-9 and abs(r.p_nom - r.p_den) < 1e-9
    b = chains.blanc(m, ["doc_id"]).collect()[0]
    assert b.right_coref == b.key_coref == b.resp_coref == 9 and b.right_non == b.key_non == b.resp_non == 27


def test_assignment():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4)):
        v = r.random((n, m))
        small, big = (v, (n, m)) if n <= m else (v.T, (m, n))
        best = max(sum(small[i, p[i]] for i in range(big[0])) for p in itertools.permutations(range(big[1]), big[0]))
        assert abs(chains.assign(v) - best) < 1e-9


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12))
def test_overlap(a, b):
    assert tx.overlap_length(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=40))
def test_diff(a, b):
    d = alignment.diff(a, b)
    assert "".join(t for o, t in d if o != "INSERT") == a and "".join(t for o, t in d if o != "DELETE") == b
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
    assert sum(len(t) for o, t in d if o == "EQUAL") == lcs[-1][-1]
    assert alignment.from_delta(a, alignment.to_delta(d)) == d


def test_span_alignment(spark):
    df = spark.createDataFrame([("say the cat sat", "say that the cat sat", 8, 11)], "a string, b string, m_start int, m_end int")
    r = alignment.align_spans(df, "a", "b").collect()[0]
    assert r.b[r.a_start : r.a_end] == "cat"


def test_queries_have_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
