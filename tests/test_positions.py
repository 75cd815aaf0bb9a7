"""As-of joins and tracked places against replay and brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import positions
from spanloom.operators import asof


def _meet(left, right, direction, exact, tolerance):
    out = {}
    for i, k, t in left:
        best = None
        for j, q, u in right:
            if k is None or t is None or q != k or u is None or (not exact and u == t) or (tolerance is not None and abs(u - t) > tolerance):
                continue
            if (direction == "backward" and u > t) or (direction == "forward" and u < t):
                continue
            key = (-abs(u - t), u < t, j)
            if best is None or key > best[0]:
                best = key, j
        out[i] = best and best[1]
    return out


@pytest.mark.parametrize("direction,exact,tolerance,stretches", [("backward", True, None, 7), ("backward", False, 20, 1), ("forward", True, None, 50), ("forward", False, 15, 7), ("nearest", True, None, 7), ("nearest", False, 9, 3)])
def test_asof_against_trial(spark, direction, exact, tolerance, stretches):
    r = random.Random(stretches)
    left = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(-20, 140)])) for i in range(150)]
    right = [(j, r.choice([1, 1, 2, 4, None]), r.choice([None, *range(0, 120)])) for j in range(60)]
    a, b = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "j int, k int, t int")
    got = asof.asof_join(a, b, "t", ["k"], direction, exact, tolerance, stretches=stretches)
    assert got.columns == ["i", "k", "t", "j", "t_right"]
    assert {x.i: x.j for x in got.collect()} == _meet(left, right, direction, exact, tolerance)
    inner = asof.asof_join(a, b, "t", ["k"], direction, exact, tolerance, "inner", stretches)
    assert inner.count() == sum(x is not None for x in _meet(left, right, direction, exact, tolerance).values())


def test_asof_of_times_dates_and_empty_tables(spark):
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(10)]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t timestamp")
    b = spark.createDataFrame([(j, t[j]) for j in (2, 5)], "j int, t timestamp")
    want = [None, None, 2, 2, 2, 5, 5, 5, 5, 5]
    for kind in ("timestamp", "timestamp_ntz"):
        x, y = a.withColumn("t", F.col("t").cast(kind)), b.withColumn("t", F.col("t").cast(kind))
        assert [r.j for r in asof.asof_join(x, y, "t").orderBy("i").collect()] == want
        assert [r.j for r in asof.asof_join(x, y, "t", tolerance=3_600_000_000).orderBy("i").collect()] == [None, None, 2, 2, None, 5, 5, None, None, None]
    days = asof.asof_join(a.withColumn("t", F.col("t").cast("date")), b.withColumn("t", F.col("t").cast("date")), "t")
    assert {r.j for r in days.collect()} == {5}
    assert {r.j for r in asof.asof_join(a, b.limit(0), "t").collect()} == {None} and asof.asof_join(a.limit(0), b, "t").collect() == []
    with pytest.raises(ValueError):
        asof.asof_join(a, b.withColumn("i", F.lit(1)), "t")


def _edit(r, text):
    """A changed text, its changes, and for each of its characters the place where it was (None for new ones)."""
    out, changes, was, i = [], [], [], 0
    while i < len(text):
        x = r.random()
        if x < 0.1:
            new = "+" * r.randrange(1, 4)
            changes.append((i, len(new)))
            out.append(new)
            was += [None] * len(new)
        elif x < 0.2:
            n = min(r.randrange(1, 5), len(text) - i)
            i += n
            changes.append((i, -n))
            continue
        out.append(text[i])
        was.append(i)
        i += 1
    return "".join(out), changes, was


def test_rounds_against_replay(spark):
    r = random.Random(8)
    rows, texts = [], {}
    for k in range(40):
        text = first = "".join(r.choices("abcdefgh", k=r.randrange(0, 90)))
        place = list(range(len(text)))
        for n in range(r.randrange(0, 5)):
            text, changes, was = _edit(r, text)
            rows += [(k, n * 3, p, d) for p, d in changes]
            place = [None if w is None else place[w] for w in was]
        texts[k] = first, text, place
    rows += [(7, 1, None, 3), (7, 1, 3, 0)]
    r.shuffle(rows)
    changes = spark.createDataFrame(rows, "k int, round int, pos int, delta int")
    last = spark.createDataFrame([(k, p) for k, (_, text, _) in texts.items() for p in range(len(text))], "k int, p int")
    first = spark.createDataFrame([(k, p) for k, (text, _, _) in texts.items() for p in range(len(text))], "k int, p int")
    state = positions.track(changes, ["k"]).cache()
    parts = [positions.track(changes.where(c), ["k"]).select("k", F.col("breaks").alias(f"b{i}"), F.col("moves").alias(f"m{i}")) for i, c in enumerate(("round < 3", "round = 3", "round > 3"))]
    all_ = parts[0].join(parts[1], "k", "full").join(parts[2], "k", "full")
    left = positions.compose(positions.compose("b0", "m0", "b1", "m1")["breaks"], positions.compose("b0", "m0", "b1", "m1")["moves"], F.col("b2"), F.col("m2"))
    right = positions.compose(F.col("b0"), F.col("m0"), positions.compose("b1", "m1", "b2", "m2")["breaks"], positions.compose("b1", "m1", "b2", "m2")["moves"])
    together = {x.k: (x.breaks, x.moves) for x in state.collect()}
    for x in all_.select("k", left.alias("l"), right.alias("r")).collect():
        assert (x.l.breaks, x.l.moves) == (x.r.breaks, x.r.moves) == together.get(x.k, ([], []))
    kept = {(k, i): w for k, (_, _, place) in texts.items() for i, w in enumerate(place) if w is not None}
    back = {(x.k, x.p): x.q for x in last.join(state, "k", "left").select("k", "p", positions.traced("p", "breaks").alias("q")).collect()}
    forth = {(x.k, x.p): x.q for x in first.join(state, "k", "left").select("k", "p", positions.traced("p", "moves").alias("q")).collect()}
    assert len(kept) > 500
    assert sum(forth[k, w] != i for (k, i), w in kept.items()) == 0
    wrong = [(k, i) for (k, i), w in kept.items() if back[k, i] != w]
    assert not wrong, wrong[:5]


def test_places_of_replacements(spark):
    df = spark.createDataFrame([(1, "a&amp;b&amp;"), (2, "none"), (3, None), (4, "")], "k int, t string")
    got = sorted(tuple(x) for x in positions.replacements(df, ["k"], "t", "&amp;", "", 1).collect())
    assert got == [(1, 6, -4), (1, 12, -4)]


def test_shift_by_halving(spark):
    steps = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(s).alias("shift")) for p, s in ((0, 4), (3, 1), (10, -2))])
    got = spark.range(-2, 14).select(F.col("id").cast("int").alias("p")).select(positions.shift_at(steps, F.col("p")).alias("s"))
    assert [x.s for x in got.collect()] == [0, 0, 4, 4, 4, 1, 1, 1, 1, 1, 1, 1, -2, -2, -2, -2]
    assert np.array_equal(positions.Steps.summed(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([2, -1, 7])).shift, [1, 7])
