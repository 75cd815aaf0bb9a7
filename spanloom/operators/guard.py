"""Whether streams of articles belong together: what differs, and how much of it, in the pass that compares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import common_prefix


def paired(gold: DataFrame, other: DataFrame, idx: str, id_col: str, text_col: str) -> DataFrame:
    """idx, id0, id1, text0, text1 and ``reason`` of the articles of two streams at equal places: null where they agree, ``id`` or ``text``
    (if the ids agree) where these differ, ``missing`` where one stream has no article. Nulls are equal to each other."""
    a = gold.select(F.col(idx), F.col(id_col).alias("id0"), F.col(text_col).alias("text0"), F.lit(True).alias("in0"))
    b = other.select(F.col(idx), F.col(id_col).alias("id1"), F.col(text_col).alias("text1"), F.lit(True).alias("in1"))
    reason = F.when(F.col("in0").isNull() | F.col("in1").isNull(), "missing").when(~F.col("id0").eqNullSafe(F.col("id1")), "id").when(~F.col("text0").eqNullSafe(F.col("text1")), "text")
    return a.join(b, idx, "full").select(idx, "id0", "id1", "text0", "text1", reason.alias("reason"))


def diagnostics(pairs: DataFrame, idx: str, shown: int = 10) -> DataFrame:
    """idx, reason, prefix_len, next0, next1, len0, len1 of the pairs that don't agree: the length of the common prefix, the next
    characters of both texts after it, and the texts' lengths (-1 for a null text)."""
    text0, text1 = F.coalesce("text0", F.lit("")), F.coalesce("text1", F.lit(""))
    bad = pairs.where("reason is not null").withColumn("prefix_len", common_prefix(text0, text1))
    after = F.col("prefix_len") + 1
    lengths = [F.coalesce(F.length(c), F.lit(-1)).alias(n) for c, n in (("text0", "len0"), ("text1", "len1"))]
    return bad.select(idx, "reason", "prefix_len", F.substring(text0, after, F.lit(shown)).alias("next0"), F.substring(text1, after, F.lit(shown)).alias("next1"), *lengths)


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The frame, and how many of its rows each condition holds for (and ``n_rows``), known as soon as the frame has been written or
    collected: no pass of its own is made for them. Counts are those of one run over the rows: a global sort behind it samples
    them first and would count them twice, so write the frame and sort what was written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]), seen


def guarded(gold: DataFrame, other: DataFrame, idx: str, id_col: str, text_col: str, name: str = "guard") -> tuple[DataFrame, Observation]:
    """``diagnostics`` of two streams, and the counts of pairs, of each reason and of pairs that agree, observed as they are compared."""
    pairs, seen = observed(paired(gold, other, idx, id_col, text_col), name, agree=F.col("reason").isNull(), **{f"other_{r}": F.col("reason") == r for r in ("id", "text", "missing")})
    return diagnostics(pairs, idx), seen


def brackets_observed(rows: DataFrame, keys: list[str], name: str = "brackets") -> tuple[DataFrame, Observation]:
    """The pairs of chain brackets (see ``markup.parse_coref``), and how many brackets are stray or never closed."""
    from .markup import bracket_pairs

    alone = F.col("partner").isNull()
    all_, seen = observed(bracket_pairs(rows, keys), name, stray=alone & ~F.col("is_open"), never_closed=alone & F.col("is_open"))
    pairs = all_.where("not is_open and partner is not null")
    return pairs.select(*keys, "entity", F.col("partner.tok_idx").alias("first_tok"), F.col("n.tok_idx").alias("last_tok"), F.col("n").alias("place")), seen


def doubtful_observed(scores: DataFrame, name: str = "scores") -> tuple[DataFrame, Observation]:
    """The scores, and how many have a negative part, a value above 1, or nothing to divide by, counted as they pass."""
    parts = [F.col(c) for c in ("r_nom", "r_den", "p_nom", "p_den")]
    negative, above = F.least(*parts) < 0, (F.col("r_nom") > F.col("r_den")) | (F.col("p_nom") > F.col("p_den"))
    return observed(scores, name, negative=negative, above_one=above, undefined=(F.col("r_den") == 0) | (F.col("p_den") == 0))
