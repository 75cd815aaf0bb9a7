"""Passes work on so much text at a time, however much a batch has."""

from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.functions import extensions
from spanloom.functions import text as tx
from spanloom.operators import chains, markup, report, sweep
from spanloom.plans import derived, queries

KEYS = ["doc_id"]


def _texts(spark, annotators=3):
    """4 MB in one batch, and a text that is longer than a run."""

    def bounded(texts):
        if texts.nbytes > 2 * tx.RUN_BYTES and len(texts) > 1:
            raise MemoryError(f"{texts.nbytes} bytes at once")
        return derived._made(texts, annotators)

    line = F.expr("repeat(concat('Wonderful <b> people (gather) near fountains & ', id, ' quietly\n'), 40)")
    docs = spark.range(1000, numPartitions=1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.repeat(line, 400)).otherwise(line).alias("text"))
    return docs, sweep.Texts(docs, bounded)


def test_every_pass_is_bounded(spark):
    docs, texts = _texts(spark)
    total = tx.tokens(docs).count()
    assert markup.conll_rows(texts, KEYS).count() == total > 500_000
    assert sweep.flat(texts, KEYS).count() == markup.token_boundaries(texts, KEYS).count() == markup.first_of_part(texts, KEYS, 2, 2).count()
    for rows in (chains.muc(texts, KEYS), markup.mark_nested(texts, "doc_id"), markup.conll_texts(texts, "doc_id"), sweep.segments(texts, KEYS), chains.nested_chains(texts, KEYS)):
        assert rows.select("doc_id").distinct().count() == 1000


def test_runs_cover_a_batch():
    texts = pa.array(["a" * n for n in (5, 0, 30, 4, 4, 4)] + [None])
    assert list(tx.runs(texts, 10)) == [(0, 2), (2, 3), (3, 5), (5, 7)] and list(tx.runs(texts[:0], 10)) == []
    assert tx.in_runs(lambda t: t, texts).equals(texts)


def test_maps_where_the_text_is(spark):
    """The passes over nested texts give what the same steps give over rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    texts = sweep.Texts(docs, partial(derived._made, annotators=3))
    segs = sweep.wide(texts, [0, 1], KEYS)
    counts = chains.cooccurrence(segs, KEYS)

    def same(a, b):
        a, b = (sorted(map(tuple, x.select(*b.columns).collect())) for x in (a, b))
        assert a == b and a

    same(chains.nested_cooccurrence(texts, KEYS), counts)
    same(chains.nested_greedy_map(texts, KEYS), chains.greedy_map(counts, KEYS))
    same(chains.nested_last_map(texts, KEYS), chains.last_map(segs, KEYS))
    same(chains.nested_chains(texts, KEYS), chains.chains(sweep.flat(texts, KEYS), KEYS))


def test_report_exchanges_nothing(spark):
    """Segments and names of the report are no rows: it is written where the text is, and the same with mentions as rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    texts = sweep.Texts(docs, partial(derived._made, annotators=3))
    out = report.contents(None, texts, None, [1, 2], KEYS)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    ms = sweep.flat(texts, KEYS)
    names = ms.select("doc_id", "ann", "entity").distinct().withColumns({"label": tx.xml_escape("entity"), "short": F.col("entity")})
    nested = sweep.nest(ms, docs.select("doc_id", F.length("text").alias("n_chars")), KEYS)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, report.contents(docs, nested, names, [1, 2], KEYS).collect()))


def test_own_normalisers_and_tokenizers_are_bounded(spark):
    """A function of one's own never has more than a run's results waiting, whatever the batch."""
    held = {"now": 0, "most": 0}

    class Held(str):
        def __new__(cls, text):
            held["now"] += len(text)
            held["most"] = max(held["most"], held["now"])
            return super().__new__(cls, text)

        def __del__(self):
            held["now"] -= len(self)

    texts = pa.array([f"{n} " + "word " * 20_000 for n in range(100)] + [None])
    names = []
    register_udf, spark_udf = extensions.register_normaliser, type("S", (), {"udf": type("U", (), {"register": staticmethod(lambda name, f: names.append(f))})})
    register_udf(spark_udf, "held", lambda t: Held(t.upper()))
    assert names[0].func(texts).to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    assert held["most"] <= 2 * tx.RUN_BYTES
    tokens = extensions.tokenizer(extensions.regex_spans("[^ ]+")).func(pa.array(["a bc", None, "", "d"]))
    assert tokens.to_pylist() == [[{"tok_start": 0, "tok_end": 1, "word": "a"}, {"tok_start": 2, "tok_end": 4, "word": "bc"}], None, [], [{"tok_start": 0, "tok_end": 1, "word": "d"}]]


def test_words_are_sorted_in_their_natural_order(spark):
    """Not by a comparison that is interpreted for each two words."""
    plan = queries.QUERIES["conll_column"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "lambdafunction(if" not in plan and "array_sort" not in plan


def test_factors_of_maps_where_the_text_is(spark):
    """The same as from counted rows, with nothing exchanged, also for ranks of one block."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    texts = sweep.Texts(docs, partial(derived._made, annotators=2))
    found, want = chains.nested_map_factors(texts, KEYS), chains.map_factors(chains.nested_cooccurrence(texts, KEYS), KEYS)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.dtypes == want.dtypes
    a, b = ({r.doc_id: (r.n_maps, r["all"]) for r in x.collect()} for x in (found, want))
    assert a == b and any(len(n) > 3 for n, _ in a.values())
    for name in ("entity_map_range", "entity_maps_product"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Window", "Aggregate", "RepartitionByExpression"))
