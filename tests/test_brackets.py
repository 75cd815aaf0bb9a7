"""Tags and chain brackets against a stack."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import markup
from spanloom.sources import conll


def _stack(tags):
    """(n, partner, depth) of every tag by a plain stack."""
    out, open_ = {}, []
    for n, is_open in tags:
        if is_open:
            open_.append(n)
            out[n] = (None, len(open_))
        elif open_:
            depth = len(open_)
            m = open_.pop()
            out[m], out[n] = (n, depth), (m, depth)
        else:
            out[n] = (None, None)
    return out


def test_tags_against_a_stack(spark):
    r = random.Random(1)
    texts = {0: [], 1: [False], 2: [True], 3: [False, True, False, False, True], 4: [True] * 40 + [False] * 60 + [True, False]}
    texts |= {k: [r.random() < (0.3, 0.5, 0.7)[k % 3] for _ in range(r.randrange(1, 80))] for k in range(5, 60)}
    rows = [(k, 3 * i, o, "x") for k, v in texts.items() for i, o in enumerate(v)]
    r.shuffle(rows)
    got = markup.pair_tags(spark.createDataFrame(rows, "k int, n int, is_open boolean, level string"), ["k"]).collect()
    want = {(k, n): x for k, v in texts.items() for n, x in _stack([(3 * i, o) for i, o in enumerate(v)]).items()}
    assert {(x.k, x.n): (x.partner, x.depth) for x in got} == want
    empty = spark.createDataFrame([], "k int, n int, is_open boolean")
    assert markup.match_tags(empty, ["k"]).collect() == []


def _read(cells):
    """((entity, first, last) in closing order, (entity, token, is_open) without partner) of a column of cells."""
    open_, pairs, alone = {}, [], []
    for t, cell in enumerate(cells):
        items = cell.split("|")
        for x in items:
            if x.startswith("("):
                open_.setdefault(x.replace("(", "").replace(")", ""), []).append(t)
        for x in items:
            if x.endswith(")"):
                e = x.replace("(", "").replace(")", "")
                if open_.get(e):
                    pairs.append((e, open_[e].pop(), t))
                else:
                    alone.append((e, t, False))
    return pairs, sorted(alone + [(e, t, True) for e, ts in open_.items() for t in ts])


@pytest.mark.parametrize("cells,want", [(["(1)", "1)", "(1", "1)"], [("1", 0, 0), ("1", 2, 3)]), (["(1", "(1", "1)", "1)|1)"], [("1", 1, 2), ("1", 0, 3)]), (["(a|(b", "b)|a)|a)", "(a)"], [("b", 0, 1), ("a", 0, 1), ("a", 2, 2)])])
def test_reading_goes_on_after_a_stray_bracket(spark, tmp_path, cells, want):
    assert _read(cells)[0] == want
    lines = [f"w{i} {c}" for i, c in enumerate(cells)]
    (tmp_path / "x.conll").write_text("#begin document d\n" + "\n".join(lines) + "\n#end document\n")
    docs = conll.documents(conll.lines(spark, str(tmp_path)))
    text = conll.text(docs, 0).collect()[0].text
    found = [(m.entity, text[: m.m_start].count(" "), text[: m.m_end].count(" ")) for m in conll.mentions(docs, 0).orderBy("seq").collect()]
    assert found == want
    assert sorted((x.entity, x.tok_idx, x.is_open) for x in conll.unclosed_brackets(docs).collect()) == _read(cells)[1]


def test_cells_against_a_stack(spark):
    r = random.Random(4)
    docs = {}
    for k in range(40):
        docs[k] = ["|".join(r.choice(("({0}", "{0})", "({0})")).format(r.choice("ab7")) for _ in range(r.randrange(1, 4))) if r.random() < 0.6 else "-" for _ in range(30)]
    rows = spark.createDataFrame([(k, t, c) for k, v in docs.items() for t, c in enumerate(v)] + [(99, 0, None)], "k int, tok_idx int, coref string")
    got = markup.parse_coref(rows, ["k"]).orderBy("place").collect()
    lost = markup.unclosed(rows, ["k"]).collect()
    for k, v in docs.items():
        pairs, alone = _read(v)
        assert [(x.entity, x.first_tok, x.last_tok) for x in got if x.k == k] == pairs
        assert sorted((x.entity, x.tok_idx, x.is_open) for x in lost if x.k == k) == alone


def test_cells_need_only_their_document(spark):
    """Brackets are matched as rows pass by: ordered rows are neither exchanged nor sorted, others are by document alone, once."""
    r = random.Random(5)
    docs = {k: ["|".join(r.choice(("({0}", "{0})", "({0})", "{0}", "")).format(r.choice("ab7")) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(40))] for k in range(60)}
    rows = [(k, t, c) for k, v in docs.items() for t, c in enumerate(v)]
    want = [_read(v) for v in docs.values()]
    shuffled = r.sample(rows, len(rows))
    for listed, ordered in ((rows, True), (shuffled, False)):
        df = spark.createDataFrame(listed, "k int, tok_idx int, coref string").coalesce(1)
        pairs = markup.parse_coref(df, ["k"], ordered)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and (plan.count("Exchange"), plan.count("Sort ")) == ((0, 0) if ordered else (1, 1))
        found, alone = pairs.orderBy("place").collect(), markup.unclosed(df, ["k"], ordered).collect()
        for k, (p, a) in enumerate(want):
            assert [(x.entity, x.first_tok, x.last_tok) for x in found if x.k == k] == p
            assert sorted((x.entity, x.tok_idx, x.is_open) for x in alone if x.k == k) == a


def test_brackets_as_tags(spark):
    """Places, partners and depths are those of the windows over tags."""
    r = random.Random(6)
    cells = [(f"k{k}" if k else None, t, "|".join(r.choice(("({0}", "{0})", "({0})")).format(r.choice("ab")) for _ in range(r.randrange(1, 4)))) for k in range(12) for t in range(r.randrange(30))]
    tags = [(k, x.replace("(", "").replace(")", ""), (t, side, i), side == 0) for k, t, c in cells for i, x in enumerate(c.split("|")) for side in (0, 1) if (x[0] == "(", x[-1] == ")")[side]]
    want = markup.pair_tags(spark.createDataFrame(tags, "k string, entity string, n struct<tok_idx:bigint,side:int,i:int>, is_open boolean"), ["k", "entity"])
    got = markup.bracket_pairs(spark.createDataFrame(r.sample(cells, len(cells)), "k string, tok_idx bigint, coref string"), ["k"])
    assert got.dtypes == want.dtypes
    flat = [F.to_json(F.struct(*want.columns)).alias("j")]
    assert sorted(x.j for x in got.select(flat).collect()) == sorted(x.j for x in want.select(flat).collect())


def _written(ends, mentions):
    """Cells of one text's tokens, mention by mention."""
    order = []
    for _, seq, start, end, entity in mentions:
        first = next((i for i, e in enumerate(ends) if e > start), None)
        last = next((i for i, e in enumerate(ends) if e >= end), None)
        if first is not None and last is not None:
            order.append((first, start, -end, seq, last, entity))
    order.sort(key=lambda x: x[:4])
    number, left, cells = {}, {}, {t: [] for t in range(len(ends))}
    for *_, last, entity in order:
        at = last, number.setdefault(entity, len(number) + 1)
        left[at] = left.get(at, 0) + 1
    for first, *_, entity in order:
        n = number[entity]
        closed = left.get((first, n), 0) > 0
        left[first, n] = left.get((first, n), 0) - closed
        cells[first].append(f"({n})" if closed else f"({n}")
    for (t, n), times in sorted(left.items()):
        cells[t] += [f"{n})"] * times
    return ["|".join(c) or "-" for c in cells.values()]


def test_cells_are_written_as_mention_by_mention():
    r = random.Random(7)
    toks, ms = [], []
    for k in range(300):
        ends = [4 * i + 3 for i in range(r.choice((0, 1, 5, 14)))]
        toks.append([{"tok_start": e - 3, "tok_end": e, "word": "abc"} for e in ends])
        spans = [(a := r.randrange(60), a + r.randrange(1, 30)) for _ in range(r.choice((0, 1, 12)))] if k % 3 else []
        ms.append([{"ann": 0, "seq": i, "m_start": a, "m_end": z, "entity": r.choice(("a", "b", "c", "", None))} for i, (a, z) in enumerate(spans)])
    token = pa.struct([("tok_start", pa.int32()), ("tok_end", pa.int32()), ("word", pa.string())])
    mention = pa.struct([("ann", pa.int32()), ("seq", pa.int32()), ("m_start", pa.int32()), ("m_end", pa.int32()), ("entity", pa.string())])
    for a, z in ((0, 300), (7, 200), (0, 1), (0, 0)):
        got = markup._coref(pa.array(toks, pa.list_(token))[a:z], pa.array(ms, pa.list_(mention))[a:z]).to_pylist()
        assert got == [c for t, m in zip(toks[a:z], ms[a:z]) for c in _written([x["tok_end"] for x in t], [tuple(x.values()) for x in m])]
