"""Clean-ups, fuzzy location and patches."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import alignment
from spanloom.operators import patching as pt

TEXT = st.text("ab c.\n", max_size=60)
E, D, I = "EQUAL", "DELETE", "INSERT"


def _ends(script):
    return "".join(t for op, t in script if op != I), "".join(t for op, t in script if op != D)


def test_semantic():
    assert pt.clean_semantic([(D, "a"), (E, "b"), (D, "c")]) == [(D, "abc"), (I, "b")]
    assert pt.clean_semantic([(D, "ab"), (I, "cd"), (E, "12"), (D, "e")]) == [(D, "ab"), (I, "cd"), (E, "12"), (D, "e")]
    assert pt.clean_semantic([(D, "abcxxx"), (I, "xxxdef")]) == [(D, "abc"), (E, "xxx"), (I, "def")]
    assert pt.clean_semantic([(D, "xxxabc"), (I, "defxxx")]) == [(I, "def"), (E, "xxx"), (D, "abc")]


def test_slide_and_efficiency():
    assert pt.slide([(E, "The c"), (I, "ow and the c"), (E, "at.")]) == [(E, "The "), (I, "cow and the "), (E, "cat.")]
    assert pt.clean_efficiency([(D, "ab"), (I, "12"), (E, "xyz"), (D, "cd"), (I, "34")]) == [(D, "abxyzcd"), (I, "12xyz34")]
    assert pt.clean_efficiency([(D, "ab"), (I, "12"), (E, "wxyz"), (D, "cd"), (I, "34")]) == [(D, "ab"), (I, "12"), (E, "wxyz"), (D, "cd"), (I, "34")]


def test_locate():
    assert pt.locate("abcdef", "de", 3) == 3
    assert pt.locate("abcdefghijk", "fgh", 5) == 5
    assert pt.locate("abcdefghijk", "efxhi", 0) == 4
    assert pt.locate("abcdefghijk", "bxy", 1) == -1
    assert pt.locate("", "abc", 0) == -1
    with pytest.raises(ValueError):
        pt.locate("a", "b" * 33, 0)


def test_patch_text():
    text = "@@ -21,18 +22,17 @@\n jump\n-s\n+ed\n  over \n-the\n+a\n  laz\n"
    assert pt.patch_to_text(pt.patch_from_text(text)) == text
    with pytest.raises(ValueError):
        pt.patch_from_text("Bad\nPatch\n")
    assert pt.patch_from_text("") == []


def test_apply_to_a_changed_text():
    hunks = pt.make_patch("The quick brown fox jumps over the lazy dog.", "That quick brown fox jumped over a lazy dog.")
    assert pt.apply_patch(hunks, "The quick red rabbit jumps over the tired tiger.") == ("That quick red rabbit jumped over a tired tiger.", [True, True])
    text, done = pt.apply_patch(hunks, "I am the very model of a modern major general.")
    assert (text, set(done)) == ("I am the very model of a modern major general.", {False})


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_round_trips(a, b):
    script = alignment.diff(a, b)
    for clean in (pt.clean_semantic, pt.clean_efficiency, pt.slide):
        assert _ends(clean(script)) == (a, b)
    hunks = pt.make_patch(a, b)
    assert pt.patch_from_text(pt.patch_to_text(hunks)) == hunks
    assert pt.apply_patch(hunks, a)[0] == b


def _best(text, pattern, near):
    def errors(at):
        row = list(range(len(pattern) + 1))
        best = row[-1]
        for c in text[at:]:
            new = [row[0] + 1]
            for j, p in enumerate(pattern, 1):
                new.append(min(row[j - 1] + (c != p), row[j] + 1, new[-1] + 1))
            row = new
            best = min(best, row[-1])
        return best

    scores = [(errors(at) / len(pattern) + abs(at - near) / 1000, at) for at in range(len(text))]
    score, at = min(scores)
    return at if score <= 0.5 else -1


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.text("abcd", min_size=1, max_size=8), st.integers(0, 30))
def test_locate_against_brute_force(text, pattern, near):
    near = min(near, len(text))
    if text.startswith(pattern, near) or text == pattern:
        return
    assert pt.locate(text, pattern, near) == _best(text, pattern, near)


def test_udfs(spark):
    df = spark.createDataFrame([("the cat", "a cat"), (None, "x"), ("", "")], "a string, b string")
    df = df.withColumn("p", pt.patch_udf("a", "b")).withColumn("r", pt.apply_patch_udf("p", "a")).select("a", "b", "r.text")
    assert [(r.a, r.text) for r in df.collect()] == [("the cat", "a cat"), (None, None), ("", "")]


def test_places_after_an_edit(spark):
    cases = [("the cat sat", "a cat, sat down"), ("abc", ""), ("", "abc"), ("same", "same"), ("abcdef", "xxabyyefzz")]
    df = spark.createDataFrame([(i, a, b, p) for i, (a, b) in enumerate(cases) for p in range(len(a) + 2)], "i int, a string, b string, p int")
    got = df.withColumn("d", alignment.diff_udf("a", "b")).select("i", "p", alignment.place_after(F.col("d"), F.col("p")).alias("q")).collect()
    assert {(x.i, x.p): x.q for x in got} == {(i, p): pt._index(alignment.diff(a, b), p) for i, (a, b) in enumerate(cases) for p in range(len(a) + 2)}
    assert [x.q for x in sorted(got, key=lambda x: x.p) if x.i == 3] == [0, 1, 2, 3, 4, 5]
