"""The report, results as JSON, number patterns, and the comparison of files."""

import json

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import report
from spanloom.plans.compare import compare
from spanloom.plans.queries import QUERIES
from spanloom.sources import results


def test_number_pattern(spark):
    cases = [(1234.5, "#,###.##", "1,234.50"), (5.0, "+##", "+05"), (0.125, "#.##", "0.12"), (-7.0, "#", "-7"), (1234567.0, "#,###", "1,234,567"), (2.0, "#.# s", "2.0 s"), (float("nan"), "#", "NaN"), (float("-inf"), "#", "-INF"), (None, "#", None)]
    for value, pattern, expected in cases:
        got = spark.createDataFrame([(value,)], "v double").select(tx.number_pattern("v", pattern)).collect()[0][0]
        assert got == expected, (value, pattern)


def test_number_pattern_of_all_orders(spark):
    """All orders are formatted, as Python formats them; the largest numbers have two separators or more."""
    d = "/root/testdata/sf0.1"
    keys = [r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").collect()]

    def brute(k):  # "#,###" is four digits at least, as in the fixed cases above
        whole = f"{k * 37:04d}"
        return "+" + ",".join([whole[: len(whole) % 3]] * (len(whole) % 3 > 0) + [whole[i : i + 3] for i in range(len(whole) % 3, len(whole), 3)]) + ".50 EUR"

    got = [tuple(r) for r in QUERIES["number_pattern"](spark, d).collect()]
    assert sorted(got) == sorted((k, brute(k)) for k in keys) and any(x.count(",") == 2 for _, x in got) and any(k * 37 < 1000 for k in keys)


def test_results(spark):
    rows = [("a", "muc", 1.0, 2.0, 3.0, 4.0, 1.0), ("a", "bcub", 0.0, 0.0, 0.0, 0.0, 1.0), ("b", "muc", 5.0, 6.0, 7.0, 8.0, 2.0)]
    scores = spark.createDataFrame(rows, results.SCHEMA)
    assert sorted(tuple(r) for r in results.parse(results.to_json(scores)).collect()) == sorted(rows)
    assert results.parse(results.to_json(scores.limit(0))).count() == 0
    tagged = {"docidToMetricToResult": ["java.util.TreeMap", {"a": ["java.util.TreeMap", {"muc": ["x.Y", {"recall": ["x.F", {"nom": 1, "denom": 2}], "precision": None}]}]}]}
    got = results.parse(spark.createDataFrame([(json.dumps(tagged, indent=2),), (None,), ("",)], "value string")).collect()
    assert [tuple(r) for r in got] == [("a", "muc", 1.0, 2.0, 0.0, 0.0, 1.0)]


def _files(tmp_path, *texts):
    out = []
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.xml").write_text(f"<articles>\n{t}\n</articles>", encoding="utf-8")
        out.append(str(tmp_path / f"f{i}.xml"))
    return out


def test_compare_files(spark, tmp_path):
    files = _files(tmp_path, "<article id='x'><mark entity='New_York'>NY</mark> &amp; me</article>", "<article id='x'><mark entity='York'>NY</mark> &amp; <mark entity='Me' sure='a&amp;b'>me</mark></article>")
    c = compare(spark, files)
    assert {(r.s, r.e, r.eval) for r in c.marks.collect() if r.e > r.s} == {(0, 2, "wrong"), (2, 5, ""), (5, 7, "toomuch")}
    xml = c.report().collect()[0].article
    assert "<content><mark split='false' entity0='New_York' short0='New_Yor…' chain-before0='(' chain-after0=')'><annotator index='1' entity='York' short='York' eval='wrong' chain-before='(' chain-after=')'/>\nNY</mark>\n &amp; <mark" in xml
    assert "<mark split='false' short0='[none]'><annotator index='1' entity='Me' short='Me' eval='toomuch' sure='a&amp;b' chain-before='(' chain-after=')'/>\nme</mark>\n</content>" in xml
    assert "<entity-list>\n<entry>Me</entry>\n<entry>New_York</entry>\n<entry>York</entry>\n</entity-list>" in xml and xml.startswith("  <article id='x'>\n") and xml.endswith("  </article>")
    assert "<annotator id='1'>\n    <metric name='bcub' recall='1.0' precision='0.5'/>" in xml
    head = c.head()
    assert head.startswith(f"<annotators>\n\t<annotator id='0' file='{files[0]}'/>\n") and "<metric name='bcub (macro)' recall='1.0' precision='0.5'/>" in head
    assert "entity0='NY; 1; New_York'" in c.report(human_readable=True).collect()[0].article and "short0='NY'" in c.report(short="initials").collect()[0].article


def test_minimal_spans_and_chain_numbers(spark, tmp_path):
    files = _files(
        tmp_path,
        "<article id='x'><mark entity='A' min='cat'>the cat there</mark> and <mark entity='B'>dog</mark> <mark entity='--NME--'>nil</mark></article>\n<article id='y'>same</article>\n<article id='z'>one</article>",
        "<article id='x'>the <mark entity='q'>cat</mark> there and <mark entity='p'>dog</mark> <mark entity='r'>nil</mark></article>\n<article id='y'>same</article>\n<article id='z'>two</article>",
    )
    c = compare(spark, files)
    assert [r.doc_id for r in c.articles.orderBy("doc_idx").collect()] == ["x", "y"]
    text = "the cat there and dog nil"
    assert {(text[r.s : r.e], r.eval) for r in c.marks.where("doc_idx = 0 and eval <> ''").collect()} == {("cat", "wrong"), ("dog", "wrong"), ("nil", "toomuch")}
    whole = compare(spark, files, min_only=False, drop_no_entity=False)
    assert {(text[r.s : r.e], r.eval) for r in whole.marks.where("doc_idx = 0 and eval <> ''").collect()} == {("the ", "missing"), ("cat", "wrong"), (" there", "missing"), ("dog", "wrong"), ("nil", "wrong")}
    # by whole mentions A meets q and B meets p
    assert {(r.ann, r.entity): r.chain_idx for r in c.chains.collect()} == {(0, "A"): 1, (0, "B"): 2, (1, "q"): 1, (1, "p"): 2, (1, "r"): 3}
    alone = compare(spark, files[:1])
    assert {r.eval for r in alone.marks.collect()} == {"", "correct"}
    muc = {(r.doc_id, r.metric): (r.r_nom, r.r_den) for r in alone.scores.collect()}
    assert muc["x", "ceafe"] == (2.0, 2.0) and muc["x", "bcub"] == (2.0, 2.0)


def test_command_line(spark, tmp_path, capsys):
    from spanloom.__main__ import main

    files = _files(tmp_path, "<article id='x'><mark entity='A'>NY</mark>\n\nme</article>", "<article id='x'><mark entity='A'>NY</mark>\n\nme</article>")
    main([*files, "--out", str(tmp_path / "out"), "--line-breaks"])
    shown = capsys.readouterr().out
    assert "1\tcorrect\t1\t2\n" in shown and "1\tbcub\tmacro\t100.00\t100.00\t100.00" in shown
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("<?xml") and text.index("<annotators>") < text.index("<metrics>") < text.index("<article id='x'>") and "<br/>me" in text and text.rstrip().endswith("</comparison>")
    main(files[:1])
    assert "1\tcorrect\t1\t2\n" in capsys.readouterr().out


def test_format_table(spark):
    rows = spark.createDataFrame([(0, "thank", None), (1, "Bill", "(4"), (2, "to", "4)")], "n int, w string, c string")
    assert [r.line for r in report.format_table(rows, "n", ["w", "c"]).orderBy("n").collect()] == ["thank    ", "Bill  (4 ", "to    4) "]


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "a<b")], "doc_id int, text string")
    nested = spark.createDataFrame([(1, None, [])], "doc_id int, n_chars int, ms array<struct<ann:int,seq:int,m_start:int,m_end:int,entity:string>>")
    names = spark.createDataFrame([], "doc_id int, ann int, entity string, label string, short string")
    got = {r.doc_id: r.content for r in report.contents(docs, nested, names, [1], ["doc_id"]).collect()}
    assert got == {1: "<content></content>", 2: "<content>a&lt;b</content>"}
    assert spark.range(1).select(report.fill("<x><article/></x>", F.lit("y"))).collect()[0][0] == "<x>y</x>"
