"""The interval sweep against worked cases."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.operators import sweep

BO, US, DE = "Barack_Obama", "United_States", "Determiner"
SCHEMA = "doc_id int, ann int, seq int, m_start int, m_end int, entity string"


def _run(spark, rows, n=53):
    m = spark.createDataFrame([(0, a, i, s, e, x) for i, (a, s, e, x) in enumerate(rows)], SCHEMA)
    return sweep.nest(m, spark.createDataFrame([(0, n)], "doc_id int, n_chars int"), ["doc_id"])


def _opened(spark, rows):
    nested = _run(spark, rows)
    out: dict = {(r.s, r.e): {} for r in sweep.segments(nested, ["doc_id"]).collect()}
    for r in sweep.open_mentions(nested, ["doc_id"]).orderBy("ord").collect():
        out[r.s, r.e].setdefault(r.ann, []).append((r.entity, r.pos_type[0]))
    return out


def test_two_annotators(spark):
    rows = [(0, 0, 34, BO), (0, 0, 4, DE), (0, 21, 34, US), (1, 4, 13, BO), (1, 21, 34, US)]
    assert _opened(spark, rows) == {
        (0, 0): {0: [(BO, "S"), (DE, "S")]}, (0, 4): {0: [(BO, "I"), (DE, "E")], 1: [(BO, "S")]}, (4, 13): {0: [(BO, "I")], 1: [(BO, "E")]},
        (13, 21): {0: [(BO, "I"), (US, "S")], 1: [(US, "S")]}, (21, 34): {0: [(BO, "E"), (US, "E")], 1: [(US, "E")]}, (34, 53): {},
    }
    got = {(r.s, r.ann): r.entity for r in sweep.principals(_run(spark, rows), ["doc_id"]).where("e > s").collect()}
    assert got == {(0, 0): DE, (4, 0): BO, (4, 1): BO, (13, 0): BO, (21, 0): US, (21, 1): US}


def test_four_annotators(spark):
    rows = [(0, 0, 34, BO), (0, 21, 34, US), (1, 4, 13, BO), (1, 21, 34, US), (2, 4, 34, BO), (3, 0, 13, BO), (3, 21, 34, US)]
    assert _opened(spark, rows) == {
        (0, 0): {0: [(BO, "S")], 3: [(BO, "S")]}, (0, 4): {0: [(BO, "I")], 1: [(BO, "S")], 2: [(BO, "S")], 3: [(BO, "I")]},
        (4, 13): {0: [(BO, "I")], 1: [(BO, "E")], 2: [(BO, "I")], 3: [(BO, "E")]}, (13, 21): {0: [(BO, "I"), (US, "S")], 1: [(US, "S")], 2: [(BO, "I")], 3: [(US, "S")]},
        (21, 34): {0: [(BO, "E"), (US, "E")], 1: [(US, "E")], 2: [(BO, "E")], 3: [(US, "E")]}, (34, 53): {},
    }


def test_empty_text_has_one_segment(spark):
    assert [(r.s, r.e) for r in sweep.segments(_run(spark, [], 0), ["doc_id"]).collect()] == [(0, 0)]


def test_labels(spark):
    rows = [("a", "a"), ("a", None), (None, "a"), ("a", "b"), (None, None)]
    df = spark.createDataFrame(rows, "g string, o string").select(sweep.evaluation(F.col("g"), F.col("o")).alias("x"))
    assert [r.x for r in df.collect()] == ["correct", "missing", "toomuch", "wrong", ""]


def test_hidden_entities_leave_a_gap(spark):
    nested = _run(spark, [(0, 0, 10, "x"), (0, 2, 5, "--OOKBE--"), (1, 0, 10, "x")], 10)
    got = {(r.s, r.e): r.eval for r in sweep.marks(nested, [1], ["doc_id"], hidden=("--OOKBE--",)).where("e > s").collect()}
    assert got == {(0, 2): "correct", (2, 5): "toomuch", (5, 10): "correct"}
    assert {(r.s, r.eval) for r in sweep.cells(nested, [1], ["doc_id"], hidden=("--OOKBE--",)).where("ann = 1 and e > s").collect()} == {(0, "correct"), (2, "toomuch"), (5, "correct")}


def test_gold_against_itself(spark):
    rows = [(a, 0, 10, "x") for a in (0, 1)] + [(a, 3, 6, "y") for a in (0, 1)]
    got = sweep.marks(_run(spark, rows, 20), [1], ["doc_id"])
    assert {r.eval for r in got.collect()} == {"correct", ""}


def test_sweep_against_brute_force(spark, monkeypatch):
    """Random mentions of several texts, in one run and in small ones: every output by checking every pair."""
    r = random.Random(7)
    texts = {d: r.randrange(0, 60) for d in range(12)}
    rows = []
    for d, n in texts.items():
        for i in range(r.randrange(0, 14)):
            s, e = sorted((r.randint(0, n), r.randint(0, n)))
            rows.append((d, r.randrange(3), i, s, e, r.choice("abc")))
    rows.append((99, 0, 0, 3, 5, "x"))  # a text without a length
    m = spark.createDataFrame(rows, SCHEMA)
    nested = sweep.nest(m, spark.createDataFrame(list(texts.items()), "doc_id int, n_chars int"), ["doc_id"]).repartition(2)
    segs, opened, best, signs = set(), set(), {}, {}
    for d in [*texts, 99]:
        mine = [x for x in rows if x[0] == d]
        ends = sorted({x[3] for x in mine} | {x[4] for x in mine} | ({texts[d]} if d in texts else set()))
        for i, e in enumerate(ends):
            segs.add((d, i, ends[i - 1] if i else 0, e))
            for a in range(3):
                here = sorted((x for x in mine if x[1] == a and x[3] <= e <= x[4]), key=lambda x: (x[3], -x[4], x[2]))
                for k, x in enumerate(here):
                    opened.add((d, i, a, k, x[2], "START" if e == x[3] else "END" if e == x[4] else "INTERMEDIATE"))
                if inside := [x for x in here if x[3] < e]:
                    best[d, i, a] = inside[-1][5]
                if here:
                    signs[d, a, e] = ("(" * sum(x[3] == e for x in here), ")" * sum(x[4] == e != x[3] for x in here))
    label = {(True, True): "", (False, True): "missing", (True, False): "toomuch"}
    for run in (200_000, 5):
        monkeypatch.setattr(sweep, "RUN", run)
        k = ["doc_id"]
        assert {(x.doc_id, x.seg_idx, x.s, x.e) for x in sweep.segments(nested, k).collect()} == segs
        got = [(x.doc_id, x.seg_idx, x.ann, x.ord, x.seq, x.pos_type) for x in sweep.open_mentions(nested, k).collect()]
        assert len(got) == len(opened) and set(got) == opened
        assert {(x.doc_id, x.seg_idx, x.ann): x.entity for x in sweep.principals(nested, k).collect()} == best
        assert {(x.doc_id, x.ann, x.e): (x.chain_before, x.chain_after) for x in sweep.chain_marks(nested, k).collect()} == signs
        for x in sweep.marks(nested, [1, 2], k).collect():
            p = [best.get((x.doc_id, x.seg_idx, a)) for a in range(3)]
            want = [label.get((p[0] is None, p[a] is None), "correct" if p[0] == p[a] else "wrong") for a in (1, 2)]
            assert (x.gold_entity, x.entity, x.eval, x.split) == (p[0], p[x.ann], want[x.ann - 1], want[0] != want[1])


def test_zip_prefix_stops_at_first_difference(spark):
    a = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "i int, text string")
    b = spark.createDataFrame([(i, "t9" if i == 3 else f"t{i}") for i in range(5)], "i int, text string")
    assert sorted(r.i for r in sweep.zip_prefix(a, b, "i", ["text"]).collect()) == [0, 1, 2]


def test_flagship_counts(spark):
    from spanloom.plans.queries import QUERIES

    got = {(r.ann, r.eval): (r.n_segments, r.n_chars) for r in QUERIES["eval_summary"](spark, "/root/testdata/sf0.001").collect()}
    assert got[1, "correct"] == (32216, 204410) and got[2, "missing"] == (20009, 90430) and got[2, "toomuch"] == (2306, 11530)


def test_principal_mentions_of_long_and_nested_spans():
    """The last mention over every segment, for random, deeply nested and very long mentions, against a look at all of them."""
    r = np.random.default_rng(5)
    for trial in range(30):
        texts, rows = 4, []
        for d in range(texts):
            n = int(r.integers(0, 60))
            start = r.integers(0, 80, n) if trial % 3 else np.arange(n)
            end = start + r.integers(0, 40, n) if trial % 3 else 200 - np.arange(n)
            rows += [(d, int(r.integers(0, 3)), i, int(a), int(z), f"e{i % 4}") for i, (a, z) in enumerate(zip(start, end))]
        count = np.bincount([x[0] for x in rows], minlength=texts)
        columns = [pa.array([x[k] for x in rows], pa.int32()) for k in (1, 2, 3, 4)] + [pa.array([x[5] for x in rows], pa.string())]
        layout = sweep._Layout(np.full(texts, 300), count, columns)
        best = layout.best(np.array([0, 1, 2]), hidden=("e3",))
        for seg in range(len(layout.bound)):
            d, e = layout.doc[seg], layout.e[seg]
            for a in range(3):
                over = [(x[3], -x[4], x[2], i) for i, x in enumerate(rows) if x[0] == d and x[1] == a and x[3] < e <= x[4]]
                want = max(over)[-1] if over else -1
                want = -1 if want >= 0 and rows[want][5] == "e3" else want
                assert best[seg, a] == want
