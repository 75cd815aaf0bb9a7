"""Own tokenizers and normalisers in SQL, and counts observed while the work is done."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import extensions, text
from spanloom.operators import guard


def test_two_tokenizers_in_sql(spark):
    texts = ["A b, cc!", None, "", "für 😀 x", "a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    extensions.register_tokenizer(spark, "my_words", extensions.tokenizer(extensions.regex_spans(r"\S+")))
    extensions.register_tokenizer(spark, "alnum_tokens", text.token_arrays)
    extensions.register_normaliser(spark, "my_upper", str.upper)
    rows = spark.sql("SELECT d.i, w.* FROM {d} AS d, LATERAL my_words(d.t) AS w", d=df)
    want = [(i, k, *m.span(), m[0]) for i, t in enumerate(texts) for k, m in enumerate(re.finditer(r"\S+", t or ""))]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
    mine = spark.sql("SELECT d.i, w.* FROM {d} AS d, LATERAL alnum_tokens(d.t) AS w", d=df)
    built_in = text.tokens(df, "i", "t")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, built_in.collect()))
    plans = [re.findall(r"Exchange|Generate|ArrowEvalPython|Join", x._jdf.queryExecution().executedPlan().toString()) for x in (mine, built_in)]
    assert plans[0] == plans[1] == ["Generate", "ArrowEvalPython"]
    assert [r.u for r in spark.sql("SELECT my_upper(t) AS u FROM {d} ORDER BY i", d=df).collect()] == [t and t.upper() for t in texts]
    with pytest.raises(ValueError):
        extensions.register_tokenizer(spark, "no name", text.token_arrays)


def test_flat_map(spark):
    row = T.StructType([T.StructField("c", T.StringType()), T.StructField("n", T.LongType())])
    extensions.register_flat_map(spark, "letters", extensions.flat_map(lambda t: [(c, t.count(c)) for c in sorted(set(t))], row), row)
    df = spark.createDataFrame([(1, "banana"), (2, ""), (3, None)], "i int, t string")
    got = spark.sql("SELECT i, idx, c, n FROM {d}, LATERAL letters(t)", d=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", 3), (1, 1, "b", 1), (1, 2, "n", 2)]
    extensions.register_flat_map(spark, "letters", extensions.flat_map(lambda t: [(t, 1)], row), row)
    assert [tuple(r) for r in spark.sql("SELECT i, c FROM {d}, LATERAL letters(t)", d=df).collect()] == [(1, "banana"), (2, "")]


def test_guard_counts_without_a_second_scan(spark, tmp_path):
    a = [(0, "x", "same"), (1, "y", "abcdef"), (2, "z", None), (3, "w", "only here"), (5, "v", "ids"), (6, None, None)]
    b = [(0, "x", "same"), (1, "y", "abcXYZ"), (2, "z", ""), (4, "q", "only there"), (5, "u", "ids"), (6, None, None)]
    left, right = (spark.createDataFrame(x, "n int, id string, text string") for x in (a, b))
    rows, seen = guard.guarded(left, right, "n", "id", "text")
    rows.write.parquet(str(tmp_path / "d"))
    assert seen.get == {"n_rows": 7, "agree": 2, "other_id": 1, "other_text": 2, "other_missing": 2}
    got = {r.n: tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert got == {1: ("text", 3, "def", "XYZ", 6, 6), 2: ("text", 0, "", "", -1, 0), 3: ("missing", 0, "only here", "", 9, -1), 4: ("missing", 0, "", "only there", -1, 10), 5: ("id", 3, "", "", 3, 3)}
    assert guard.guarded(left.limit(0), right.limit(0), "n", "id", "text")[0].collect() == []


def test_brackets_and_scores_observed(spark):
    rows = spark.createDataFrame([(0, i, c) for i, c in enumerate(["(1)", "1)", "(1", "1)", "(2", "-"])], "d int, tok_idx int, coref string")
    pairs, seen = guard.brackets_observed(rows, ["d"])
    assert sorted((r.first_tok, r.last_tok) for r in pairs.collect()) == [(0, 0), (2, 3)]
    assert seen.get == {"n_rows": 6, "stray": 1, "never_closed": 1}
    s = spark.createDataFrame([(1.0, 2.0, 3.0, 2.0), (-1.0, 2.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0)], "r_nom double, r_den double, p_nom double, p_den double")
    out, seen = guard.doubtful_observed(s)
    assert len(out.collect()) == 3
    assert seen.get == {"n_rows": 3, "negative": 1, "above_one": 1, "undefined": 1}
