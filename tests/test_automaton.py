"""Dictionaries in texts against search by trial."""

import collections
import random
import time

import numpy as np
import pytest

from spanloom.functions import automaton


def _trial(text, words):
    words = {w for w in words if w}
    return [(i, n) for i in range(len(text)) for n in sorted({len(w) for w in words}) if text[i : i + n] in words and i + n <= len(text)]


def _tables(spark, texts, words):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, word string").repartition(3), spark.createDataFrame([(w,) for w in words], "w string")


@pytest.mark.parametrize("which", ["all", "shortest", "longest"])
@pytest.mark.parametrize("most", [2_000_000, 60])
def test_matches_against_trial(spark, monkeypatch, which, most):
    monkeypatch.setattr(automaton, "MAX_CHARS", most)
    monkeypatch.setattr(automaton, "RUN", 16)
    monkeypatch.setattr(automaton, "TOGETHER", 300)
    r = random.Random(6)
    words = ["a", "ab", "abc", "bc", "bcb", "cc", "ñ", "ñb", "😀", "b😀a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "", None, "ab"]
    words += ["".join(r.choices("abcñ", k=r.randrange(2, 7))) for _ in range(30)]
    texts = ["".join(r.choices("abcñ😀 ", k=r.randrange(0, 200))) for _ in range(60)] + [None, "", "a", "a" * 500 + "b" + "a" * 29 + "b", "\0ab\0", "ab\nab"]
    df, dictionary = _tables(spark, texts, words)
    got = collections.defaultdict(list)
    for x in automaton.matches(df, dictionary, ["id"], "text", "w", which).collect():
        got[x.id].append((x.start, x.len))
    for i, t in enumerate(texts):
        want = _trial(t or "", [w for w in words if w])
        if which != "all":
            best = {}
            for start, n in want:
                best[start] = n if start not in best else (min if which == "shortest" else max)(n, best[start])
            want = sorted(best.items())
        assert sorted(got[i]) == want, t


def test_empty_dictionary_and_texts(spark):
    df, none = _tables(spark, ["abc"], [])
    assert automaton.matches(df, none, ["id"], "text", "w").collect() == []
    assert automaton.matches(df.limit(0), _tables(spark, [], ["a"])[1], ["id"], "text", "w").collect() == []


def test_time_is_linear():
    a = automaton.Automaton(["a" * n for n in range(1, 200)] + ["b" * 40 + "c"])
    assert len(a.find(np.full(50, ord("a"), np.uint32))[0]) == 50 * 51 // 2
    seconds = []
    for n in (200_000, 800_000):
        began = time.process_time()
        start, length = a.find(np.full(n, ord("b"), np.uint32))
        seconds.append(time.process_time() - began)
        assert not len(start)
    assert seconds[1] < 8 * seconds[0] + 0.5


def test_links():
    a = automaton.Automaton(["he", "she", "his", "hers"])
    text = np.frombuffer("ushers".encode("utf-32-le"), np.uint32)
    assert sorted(zip(*(x.tolist() for x in a.find(text)))) == [(1, 3), (2, 2), (2, 4)]
    assert (a.fail[1:] < np.arange(1, len(a.fail))).all()


def _walk(words):
    """The words of a prefix tree from its last branch, a word before its extensions."""
    tree = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = w

    def go(at):
        if "" in at:
            yield at[""]
        for c in sorted((x for x in at if x), reverse=True):
            yield from go(at[c])

    return list(go(tree))


def test_order_of_a_walk(spark):
    words = ["b", "ba", "bab", "bb", "a", "ab", "é", "éa", "😀", "Z", "a", "", None]
    got = sorted(automaton.in_order(_tables(spark, [], words)[1], "w").collect(), key=lambda x: x.place)
    assert [x.word for x in got] == _walk({w for w in words if w}) and [x.place for x in got] == list(range(len(got)))
