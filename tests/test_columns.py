"""Work that is done by columns, once and where the text is, against plain loops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.operators import report, sweep
from spanloom.plans import queries
from spanloom.sources import conll, files, xml


def test_article_files_are_read_once(spark):
    """Articles and their mentions come from one scan, and nothing is joined."""
    plan = queries.QUERIES["article_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan articles") == 1 and "Join" not in plan


def test_small_splits_are_dealt_out(tmp_path):
    """A task reads many small splits one after the other, each once and in order; a few splits are a task each."""
    (tmp_path / "a.xml").write_bytes(b"x" * 100_001)
    (tmp_path / "b.xml").write_bytes(b"x" * 7)
    parts = files._ArticleReader({"path": str(tmp_path), "split": "10"}).partitions()
    splits = [s for p in parts for s in p.splits]
    assert 200 <= len(parts) <= 300 and len(splits) == 10_002
    assert [(s.path[-5:], s.first, s.last) for s in splits] == [*(("a.xml", i, min(i + 10, 100_001)) for i in range(0, 100_001, 10)), ("b.xml", 0, 7)]
    assert [len(p.splits) for p in files._ArticleReader({"path": str(tmp_path / "a.xml"), "split": "10000"}).partitions()] == [1] * 11


def test_articles_parsed_by_columns():
    found = [
        "<article id='a' b='&lt;1'>one <mark entity='E' min='wo'>two <mark entity='F' x='1' y='2'>three</mark></mark>  </article>",
        "<article>a &amp; b <mark annotation='G'>c</mark> <mark>no entity</mark> <mark entity='H'>open <b>tag</b></article>", "no tag", "",
    ]
    want = [xml.parse_article(x) for x in found]
    assert [(m["m_start"], m["m_end"], m["entity"], m["min_start"], m["info"]) for m in want[0]["ms"]] == [(8, 13, "F", None, [("x", "1"), ("y", "2")]), (4, 13, "E", 5, [])]
    assert xml.parse_articles(found).to_pylist() == want
    assert xml.parse_articles(found, text=False).to_pylist() == [{"doc_id": x["doc_id"], "ms": x["ms"]} for x in want]


def test_conll_texts_are_parsed_where_they_are(spark):
    """The same documents as from lines, which were exchanged and sorted; the query exchanges its input at most."""
    texts = spark.createDataFrame([
        ("a", "junk\n#begin document x y\nw1 - (1\n\n# note\n lead  -\u00a0b \n#end document\nno\n#begin document z\nq\n#begin document z\nr\ts\n#end document\nt\n#end document\nu"),
        ("b", "#end document\n#begin document n\nlost\n#begin document m\nkept"), ("c", ""), ("d", None), ("e", "#begin document empty\n#end document"), (None, "#begin document 7\nx\n"),
    ], "file string, value string")
    rows = texts.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    key = lambda r: tuple(map(str, r))
    want = sorted(map(tuple, conll.documents(rows).collect()), key=key)
    found = conll.documents_of(texts)
    assert len(want) == 9 and sorted(map(tuple, found.select("file", "doc_no", "doc_id", F.explode("rows").alias("r")).select("file", "doc_no", "doc_id", "r.row_idx", "r.cols").collect()), key=key) == want
    listed = {}
    for file, no, doc_id, idx, cols in sorted(want, key=lambda r: r[3]):
        listed.setdefault((file, no, doc_id), []).extend(cols[:1])
    assert {(r.file, r.doc_no, r.doc_id): r.words for r in conll.words(found, 0).collect()} == {k: " ".join(v) for k, v in listed.items()}
    plan = queries.QUERIES["conll_column"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Aggregate", "Sort "))


def test_report_is_written_by_columns(monkeypatch):
    """What many segments show is made once, not for each of them."""
    made = []
    escape = report._escaped
    monkeypatch.setattr(report, "_escaped", lambda s: made.append(s) or escape(s))
    texts = pa.array(["é<\x01b cd " * 1000, None, "&"])
    at = np.arange(0, 8000, 8)
    columns = [pa.array(np.tile(c, 1000), pa.int32()) for c in ([0, 1], [0, 1])] + [pa.array(np.repeat(at + k, 2), pa.int32()) for k in (0, 4)] + [pa.array(["<e>", "longer"] * 1000)]
    layout = sweep.Layout(np.array([8000, 0, 1]), np.array([2000, 0, 0]), columns)
    got = report._written(texts, layout, np.array([0, 1]), 0, (), False, None, None).to_pylist()
    mark = "<mark split='false' entity0='&amp;lt;e&amp;gt;' short0='&lt;e&gt;' chain-before0='(' chain-after0=')'><annotator index='1' entity='longer' short='longer' eval='wrong' chain-before='(' chain-after=')'/>\né&lt;b</mark>\n"
    assert got == [f"{mark} cd " * 1000, "", "&amp;"] and len(made) <= 20
