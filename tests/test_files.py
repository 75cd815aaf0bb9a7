"""Article and CoNLL files as data sources, in many splits and with tasks that fail on the way."""

import os
import random

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from spanloom.sources import conll, files, xml


def _articles(n=60, seed=1):
    r = random.Random(seed)
    return [f"<article id='a{i}'>" + "\n".join("wörd <mark entity='E'>x</mark> " * r.randrange(0, 30) for _ in range(3)) + "</article>" for i in range(n)]


@pytest.mark.parametrize("split,block", [(1 << 20, 1 << 20), (700, 64), (37, 16)])
def test_articles_in_splits(spark, tmp_path, monkeypatch, split, block):
    monkeypatch.setattr(files, "BLOCK", block)
    made = _articles()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.xml").write_text("<articles>\n" + "\n".join(made[:40]) + "\n</articles>\n")
    (tmp_path / "in" / "a.xml").write_text("<?xml version='1.0'?><articles>" + "".join(made[40:]) + "<article id='open'>never closed")
    (tmp_path / "in" / "_hidden").write_text(made[0])
    got = files.read(spark, "articles", str(tmp_path / "in"), split=split).collect()
    by_file = {}
    for x in sorted(got, key=lambda x: (x.file, x.at)):
        by_file.setdefault(os.path.basename(x.file), []).append(x.xml)
    assert by_file == {"b.xml": made[:40], "a.xml": [*made[40:], "<article id='open'>never closed"]}
    for x in got:
        with open(x.file, "rb") as f:
            f.seek(x.at)
            assert f.read(8) == b"<article"


@pytest.mark.parametrize("split,block", [(1 << 20, 1 << 20), (50, 32), (7, 5)])
def test_conll_in_splits(spark, tmp_path, monkeypatch, split, block):
    monkeypatch.setattr(files, "BLOCK", block)
    r = random.Random(2)
    text = "junk before\n"
    for d in range(12):
        text += f"#begin document d{d}\n" + "".join(r.choice(["a b (1)\n", "\n", "#begin documents? no\n" if False else "# note\n", " lead x 2)\n", "é #begin document\n"]) for _ in range(r.randrange(0, 12)))
        text += r.choice(["#end document\n", "#end document\njunk between\n", ""])
    text += "#begin document last\nno end -"
    path = tmp_path / "x.conll"
    path.write_text(text)
    got = [(x.doc_id, x.row_idx, list(x.cols)) for x in files.read(spark, "conll", str(path), split=split).orderBy("at", "row_idx").collect()]
    want, doc, n = [], None, 0
    for line in text.split("\n"):
        if line.startswith("#begin document"):
            doc, n = line[16:], 0
        elif line.startswith("#end document"):
            doc = None
        elif doc is not None and not line.startswith("#"):
            want.append((doc, n, [] if line == "" else __import__("re").split(r"\s+", line)))
            n += 1
    assert got == want


def test_written_articles_are_read_again(spark, tmp_path):
    made = _articles(50)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "i int, value string").repartitionByRange(7, "i").sortWithinPartitions("i")
    files.write(rows, "articles", str(tmp_path / "out"))
    names = sorted(os.listdir(tmp_path / "out"))
    texts = [(tmp_path / "out" / n).read_text() for n in names]
    assert all(t.startswith(files.HEAD) and t.endswith(files.FOOT) for t in texts) and len(names) >= 5
    assert "".join(t[len(files.HEAD) : -len(files.FOOT)] for t in texts) == "\n".join(made) + "\n"
    assert sorted(x.xml for x in files.read(spark, "articles", str(tmp_path / "out"), split=200).collect()) == sorted(made)
    articles, mentions = xml.read(spark, str(tmp_path / "out"))
    assert articles.count() == 50 and mentions.count() == sum(x.count("<mark") for x in made)
    files.write(rows.limit(3), "articles", str(tmp_path / "out"), "overwrite")
    assert len(files.read(spark, "articles", str(tmp_path / "out")).collect()) == 3
    files.write(rows.limit(0), "articles", str(tmp_path / "none"))
    assert files.read(spark, "articles", str(tmp_path / "none")).collect() == [] and xml.read(spark, str(tmp_path / "none"))[0].count() == 0


def test_failed_attempts_leave_nothing(tmp_path, monkeypatch):
    """The writer's own protocol: attempts of the same partition, of which the commit takes one, and an abort."""
    made = [(f"row {i}",) for i in range(6)]
    w = files._Writer(str(tmp_path / "out"), "conll", "", "", False)

    class Context:
        def __init__(self, partition, attempt):
            self.partitionId, self.taskAttemptId = lambda: partition, lambda: attempt

    def attempt(partition, number, rows, fail=False):
        monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Context(partition, number)))

        def given():
            yield from rows
            if fail:
                raise RuntimeError("executor lost")

        return w.write(given())

    with pytest.raises(RuntimeError):
        attempt(0, 1, made[:2], fail=True)
    attempt(0, 2, made[:3])  # finished, but Spark took another attempt
    messages = [attempt(0, 3, made[:3]), attempt(1, 4, made[3:]), attempt(2, 5, [])]
    assert os.listdir(tmp_path / "out") and not [n for n in os.listdir(tmp_path / "out") if n.startswith("part-")]
    w.commit(messages)
    assert "".join((tmp_path / "out" / n).read_text() for n in sorted(os.listdir(tmp_path / "out"))) == "".join(f"{x}\n" for (x,) in made)
    w2 = files._Writer(str(tmp_path / "gone"), "conll", "", "", False)
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Context(0, 9)))
    w2.abort([w2.write(iter(made))])
    assert os.listdir(tmp_path / "gone") == []


def test_written_documents_are_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(d, t, f"w{d}.{t}", "-") for d in range(9) for t in range(5)], "doc_id int, tok_idx int, word string, coref string")
    files.write(conll.to_lines(rows, "doc_id"), "conll", str(tmp_path / "c"))
    got = files.read(spark, "conll", str(tmp_path / "c"), split=40).where(F.size("cols") > 0)
    assert sorted((int(x.doc_id), x.row_idx, x.cols[0]) for x in got.collect()) == [(d, t, f"w{d}.{t}") for d in range(9) for t in range(5)]
