"""As-of joins: to every row the last row of another table that isn't later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stretches that the range of the order column is cut into, each of which is a task's work within one key.
STRETCHES = 1024


def _number(c: Column, kind: T.DataType) -> Column:
    """The order column as a number that keeps its order and distances (micro-seconds for times, days for dates)."""
    if isinstance(kind, T.TimestampNTZType):
        seconds = (c - F.lit("1970-01-01").cast("timestamp_ntz")).cast("decimal(20,6)")
        return (seconds * 1_000_000).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, direction: str = "backward", exact: bool = True, tolerance: float | None = None, how: str = "left", stretches: int = STRETCHES) -> DataFrame:
    """All columns of ``left``, and of the row of ``right`` that it meets its columns other than ``by`` (``on`` as ``<on>_right``).

    A row meets, among those with equal ``by``, the one with the greatest ``on`` not above its own (``backward``), with the
    least not below it (``forward``), or the nearer of the two, the earlier one of equals (``nearest``); with ``exact=False`` only
    others than its own. ``on`` is a number, a date or a time. Of several right rows with that ``on`` it meets the one with the greatest other columns, in their
    order, nulls least; so these need types that have an order. ``tolerance`` is the greatest distance that counts (micro-seconds for times, days for dates). Left rows
    that meet none stay with nulls, with ``how="inner"`` they go. Null keys and a null ``on`` meet nothing.

    Nothing is joined: the rows of both tables are exchanged once, by key and stretch of ``on``, sorted, and the last right row
    is carried on. What a stretch inherits from those before it is their last right row, a partially aggregated maximum, so a
    key with most of the rows is spread over its stretches. Rows of one instant stay together.
    """
    by = by or []
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no direction {direction}")
    kind = left.schema[on].dataType
    payload = [c for c in right.columns if c not in by]
    names = {c: f"{c}_right" if c == on else c for c in payload}
    clash = set(names.values()) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    pos = _number(F.col(on), kind)
    found = F.struct(F.col("__pos").alias("pos"), F.struct(*[F.col(c) for c in payload]).alias("row"))
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    k = [f"__k{i}" for i in range(len(by))]
    b = right.withColumn("__pos", _number(F.col(on), right.schema[on].dataType)).where(F.col(on).isNotNull())
    for c in by:
        b = b.where(F.col(c).isNotNull())
    b = b.select(*keys, "__pos", F.lit(None).cast(left.schema).alias("__left"), found.alias("__right"))
    a = left.select(*keys, pos.alias("__pos"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"), F.lit(None).cast(b.schema["__right"].dataType).alias("__right"))
    ends = b.agg(F.min("__pos"), F.max("__pos")).collect()[0]
    low, high = (float(x) for x in ends) if ends[0] is not None else (0.0, 0.0)
    width = max((high - low) / stretches, 1e-300)
    stretch = F.least(F.greatest(F.floor((F.col("__pos") - F.lit(low)) / F.lit(width)), F.lit(-1)), F.lit(stretches)).cast("int")
    both = a.unionByName(b).withColumn("__s", F.coalesce(stretch, F.lit(-2)))
    picks = []
    for way in ("backward", "forward") if direction == "nearest" else (direction,):
        picks.append(f"__{way}")
        both = _carried(both, k, way, exact, picks[-1])
    got = both.where("__left is not null")
    for p in picks:
        distance = F.abs(F.col("__pos") - F.col(p)["pos"])
        ok = F.col(p).isNotNull() & F.col("__pos").isNotNull() & (F.lit(True) if tolerance is None else distance <= F.lit(tolerance))
        got = got.withColumn(p, F.when(ok, F.col(p)))
    best = F.col(picks[0])
    if len(picks) == 2:
        early, late = (F.col(p) for p in picks)
        best = F.when(early.isNull() | (F.abs(late["pos"] - F.col("__pos")) < F.abs(F.col("__pos") - early["pos"])), late).otherwise(early)
    got = got.select("__left.*", best.alias("__best"))
    if how == "inner":
        got = got.where("__best is not null")
    return got.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__best.row").getField(c).alias(names[c]) for c in payload])


def _carried(both: DataFrame, k: list[str], way: str, exact: bool, name: str) -> DataFrame:
    """The rows of both tables with the last right row up to each (``forward``: from its end) as ``name``."""
    ahead = way == "forward"
    order = F.desc if ahead else F.asc
    # among equal places, right rows stand first, so that left rows meet them, or last where only others count
    side = F.col("__left").isNotNull().cast("int") * F.lit(1 if exact else -1)
    first = F.when(F.col("__right").isNotNull(), F.struct(F.col("__pos") * F.lit(-1 if ahead else 1), F.col("__right")))
    last = both.groupBy(*k, "__s").agg(F.max(first).alias("__m")).withColumn("__m", F.col("__m")["__right"])
    before = Window.partitionBy(*k).orderBy(order("__s")).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("__m", F.last("__m", ignorenulls=True).over(before)).where("__m is not null")
    seeds = last.select(*k, "__s", F.col("__m").alias("__right"), F.lit(0).alias("__seed"))  # what a stretch begins with
    marked = both.withColumn("__seed", F.lit(1)).unionByName(seeds, allowMissingColumns=True)
    here = Window.partitionBy(*k, "__s").orderBy("__seed", order("__pos"), side, F.asc("__right")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(name, F.last("__right", ignorenulls=True).over(here)).where("__seed = 1").drop("__seed")
