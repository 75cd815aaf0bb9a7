"""Places of a text that is changed in several rounds, traced from the last form to the first and back.

A round runs over a text once and makes changes (pos, delta): pos is the place in the text before the round from which on
everything moves by delta, that is where an insertion (delta above 0) stands or where what was cut out (below 0) ended. Changes of one
round at one place add up; those with delta 0 don't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

#: What rounds come to: ``breaks`` lead back (from pos on, places of the last form are ``shift`` away from those of the first one) and
#: ``moves`` lead forth (from pos on, places of the first form).
_STEP = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("shift", T.IntegerType())]))
STATE = T.StructType([T.StructField("breaks", _STEP), T.StructField("moves", _STEP)])
_STEPS = pa.list_(pa.struct([("pos", pa.int32()), ("shift", pa.int32())]))


class Steps:
    """Piecewise shifts of many texts: text, pos and shift of each step, ascending; before its first step a text has shift 0."""

    def __init__(self, row, pos, shift):
        self.row, self.pos, self.shift = row, pos, shift

    @staticmethod
    def summed(row, pos, delta) -> Steps:
        """Steps from single changes in any order."""
        order = np.lexsort((pos, row))
        row, pos, delta = row[order], pos[order], delta[order]
        total = np.cumsum(delta)
        last = np.ones(len(row), bool)
        last[:-1] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])
        before = np.concatenate([[0], total])[np.searchsorted(row, row)]
        return Steps(row[last], pos[last], (total - before)[last])

    def changes(self):
        """row, pos and delta of each step."""
        first = np.ones(len(self.row), bool)
        first[1:] = self.row[1:] != self.row[:-1]
        return self.row, self.pos, self.shift - np.where(first, 0, np.concatenate([[0], self.shift[:-1]]))

    def _find(self, row, pos, side):
        """For each place, how many steps of all texts come before (``left``) or up to it (``right``)."""
        low = min(self.pos.min(initial=0), pos.min(initial=0))
        width = max(self.pos.max(initial=0), pos.max(initial=0)) - low + 1
        return np.searchsorted(self.row * width + self.pos - low, row * width + pos - low, side)

    def at(self, row, pos):
        """The shifts that hold at places."""
        k = self._find(row, pos, "right") - 1
        ok = (k >= 0) & (len(self.row) > 0)
        k = np.maximum(k, 0)
        return np.where(ok & (self.row[k] == row), self.shift[k], 0) if len(self.row) else np.zeros(len(row), np.int64)

    def then(self, other: Steps) -> Steps:
        """The steps of a move by these and then by ``other``: within each step, whose places all move alike, those of the other's steps
        that lie where it leads to."""
        far = np.int64(1) << 40
        rows = np.unique(np.concatenate([self.row, other.row]))
        row = np.concatenate([rows, self.row])
        start, shift = np.concatenate([np.full(len(rows), -far), self.pos]), np.concatenate([np.zeros(len(rows), np.int64), self.shift])
        order = np.lexsort((start, row))
        row, start, shift = row[order], start[order], shift[order]
        end = np.full(len(row), far)
        inner = np.flatnonzero(row[1:] == row[:-1])
        end[inner] = start[inner + 1]
        lo, hi = other._find(row, np.maximum(start + shift, -far), "right"), other._find(row, np.minimum(end + shift, far), "left")
        hi = np.maximum(hi, lo)
        which = np.repeat(np.arange(len(row)), hi - lo)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        own = start > -far
        out = [np.concatenate(x) for x in (
            (row[own], row[which]), (start[own], other.pos[inside] - shift[which]), (shift[own] + other.at(row[own], (start + shift)[own]), shift[which] + other.shift[inside]),
        )]
        order = np.lexsort((out[1], out[0]))
        return Steps(*(x[order] for x in out))


def join_states(first, second):
    """The (breaks, moves) of rounds and of those after them as one: a place goes back through the later ones first. Associative."""
    return second[0].then(first[0]), first[1].then(second[1])


def round_state(row, pos, delta):
    """The (breaks, moves) of one round's changes."""
    keep = delta != 0
    forth = Steps.summed(row[keep], pos[keep], delta[keep])
    row, pos, delta = forth.changes()
    return Steps.summed(row, pos + forth.shift, -delta), forth


def _read(column) -> Steps:
    column = column.cast(_STEPS)
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64))
    pos, shift = (x.to_numpy().astype(np.int64) for x in column.flatten().flatten())
    return Steps(row, pos, shift)


def _listed(steps: Steps, rows: int) -> pa.Array:
    keep = np.ones(len(steps.row), bool)  # steps that change nothing are left out
    keep[1:] = (steps.row[1:] != steps.row[:-1]) | (steps.shift[1:] != steps.shift[:-1])
    keep &= ~((steps.shift == 0) & np.concatenate([[True], steps.row[1:] != steps.row[:-1]])[: len(steps.row)])
    row, pos, shift = steps.row[keep], steps.pos[keep], steps.shift[keep]
    edges = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(shift.astype(np.int32))], ["pos", "shift"]))


def track(changes: DataFrame, keys: list[str], round_: str = "round") -> DataFrame:
    """keys, breaks and moves (see ``STATE``) of the changes (keys, round, pos, delta) of each text: each round is closed before the
    next one in the order of ``round_``, whose changes are places of the text as the rounds before left it.

    The rounds of one text are taken together, texts side by side. Null pos or delta don't count; texts without changes
    have no row.
    """
    rows = changes.where(F.col("pos").isNotNull() & F.col("delta").isNotNull())
    one = F.struct(F.col(round_).alias("round"), F.col("pos").cast("int").alias("pos"), F.col("delta").cast("int").alias("delta"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))
    place = F.transform("all", lambda x: F.struct(F.array_position(F.array_distinct(F.col("all.round")), x["round"]).cast("int").alias("round"), x["pos"].alias("pos"), x["delta"].alias("delta")))
    src = listed.select(*keys, place.alias("all"))
    schema = T.StructType([*(src.schema[k] for k in keys), *STATE.fields])
    n_keys = len(keys)

    def run(batches):
        for b in batches:
            text = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(n_keys)).to_numpy())
            which, pos, delta = (x.to_numpy().astype(np.int64) for x in b.column(n_keys).flatten().flatten())
            nothing = np.zeros(0, np.int64)
            state = round_state(nothing, nothing, nothing)
            for r in range(1, which.max(initial=0) + 1):
                on = which == r
                state = join_states(state, round_state(text[on], pos[on], delta[on]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keys)), *(_listed(s, b.num_rows) for s in state)], names=schema.names)

    return src.mapInArrow(run, schema)


@F.arrow_udf(STATE)
def compose(breaks: pa.Array, moves: pa.Array, later_breaks: pa.Array, later_moves: pa.Array) -> pa.Array:
    """struct of breaks and moves of tracked rounds and of rounds tracked after them, as if tracked together; null is no change."""
    out = join_states((_read(breaks), _read(moves)), (_read(later_breaks), _read(later_moves)))
    return pa.StructArray.from_arrays([_listed(s, len(breaks)) for s in out], ["breaks", "moves"])


def shift_at(steps: Column | str, pos: Column | str) -> Column:
    """The shift of the last step at or before a place (0 without one), by halving."""
    steps, pos = col(steps), col(pos)

    def halve(n, i):
        more = n + F.call_function("shiftleft", F.lit(1), i)
        return F.when((more <= F.size(steps)) & (F.get(steps, more - 1)["pos"] <= pos), more).otherwise(n)

    n = F.aggregate(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), F.lit(0), halve)
    return F.coalesce(F.get(steps, n - 1)["shift"], F.lit(0))


def traced(pos: Column | str, steps: Column | str) -> Column:
    """A place of the last form in the first one by ``breaks``, or the other way by ``moves``."""
    return col(pos) + shift_at(steps, pos)


def replacements(texts: DataFrame, keys: list[str], text: str, needle: str, new: str, keep: int = 0) -> DataFrame:
    """keys, pos and delta of the change at each occurrence (from the left, not overlapping) of ``needle``, of which ``keep`` characters stay,
    by ``new`` after these."""
    delta = len(new) + keep - len(needle)
    pieces = texts.select(*keys, F.posexplode(F.split(col(text), F.lit("\\Q" + needle + "\\E"), -1)).alias("i", "piece"))
    w = Window.partitionBy(*keys)
    upto = F.sum(F.length("piece") + len(needle)).over(w.orderBy("i"))
    pieces = pieces.select(*keys, "i", upto.cast("int").alias("pos"), F.max("i").over(w).alias("last"))
    return pieces.where("i < last").select(*keys, "pos", F.lit(delta).alias("delta"))
