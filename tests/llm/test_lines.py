"""Line dedup against a brute-force version."""

import collections
import random

import pytest

from spanloom.llm import lines


def _key(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def _brute(rows, least=10):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[_key(line)].add(doc)
    out = []
    for doc, text in rows:
        ls = (text or "").split("\n")

        def stays(line):
            key = _key(line)
            ids = holders[key]
            return len(key) < least or len(ids) < 2 or doc == min((d for d in ids if d is not None), default=None)

        kept = [x for x in ls if stays(x)]
        out.append((doc, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def _rows():
    r = random.Random(3)
    pool = [f"Línea número {i} ÄB" if i % 3 else f"a common line {i}" for i in range(40)] + ["short", "", "  ", "tencharsXX", "ninechars", "İstanbul line É"]
    rows = []
    for i in range(120):
        ls = [r.choice(pool) for _ in range(r.randrange(0, 9))]
        ls = [r.choice([x, x.upper().replace("É", "é"), f"\t{x} \x0b", x + "\r"]) for x in ls]
        if i % 3 == 0:
            ls.insert(r.randrange(len(ls) + 1), "The one line that a third of all texts have")
        rows.append((i * 7 % 120, "\n".join(ls)))
    rows += [rows[5], (rows[6][0], "another text of one id\na common line 3"), (None, "a common line 6\nonly without an id\n\n"), (None, "only without an id"), (200, None), (201, ""), (-4, "a common line 9\n" * 3), (300, "\n".join(f"a common line {i % 50}" for i in range(20_000)))]
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 3)])
def test_lines_against_brute_force(spark, batches, fanout):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, h string, batch int, lost string").repartition(3)
    got = collections.Counter(tuple(x) for x in lines.dedup_lines(docs, batches=batches, fanout=fanout).select("doc_id", "n_lines", "n_dropped", "kept").collect())
    assert got == _brute(rows)


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, "a line of nobody"), (1, "a line of nobody")], "doc_id long, text string")
    got = sorted((tuple(x) for x in lines.dedup_lines(nulls).collect()), key=str)
    assert got == sorted([(None, 1, 0, ""), (None, 1, 1, ""), (1, 1, 0, "a line of nobody")], key=str)


def test_runs_are_levelled(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for i in range(6):
        batch = spark.createDataFrame([(h, 0, 10 * i + d) for d, h in enumerate([1, 2 + i, 2 + i])], "h long, g int, doc long")
        found = sorted(tuple(x) for x in runs.add(batch).collect())
        assert found == sorted([(1, 0, 10 * i)] * (i > 0) + [(2 + i, 0, 10 * i + 2)] + [(2 + i, 0, 10 * i + 1)] * 0)
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    assert sorted(r.h for level in runs.levels for run in level for r in runs._hashes(run).collect()) == list(range(1, 8))
    runs.close()
