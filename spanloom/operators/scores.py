"""Exact fractions: macro and micro averages, F1, formatting, merging of score tables.

Scores: doc_id, metric, r_nom, r_den, p_nom, p_den, weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value(nom: Column, den: Column) -> Column:
    """nom / den, 0 where den is 0."""
    return F.coalesce(F.try_divide(nom, den), F.lit(0.0))


def f1(r: Column, p: Column) -> Column:
    return F.when((r == 0) & (p == 0), 0.0).otherwise(2 * r * p / (r + p))


def add(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """Sum of two fractions with denominator 1; a side with denominator 0 is ignored, both give 0/0."""
    both = (d1 == 0) & (d2 == 0)
    return F.struct(F.when(both, 0.0).otherwise(value(n1, d1) + value(n2, d2)).alias("nom"), F.when(both, 0.0).otherwise(1.0).alias("den"))


def combine(scores: DataFrame) -> DataFrame:
    """Rows for the virtual documents macro and micro: macro is the weighted mean of values, where 0/0 counts as 0 with
    its weight; micro divides the weighted sums. Both come from one aggregation."""
    w = F.col("weight")
    sums = [F.sum(w * F.col(c)).alias(c) for c in ("r_nom", "r_den", "p_nom", "p_den")]
    means = [F.sum(w * value(F.col(f"{c}_nom"), F.col(f"{c}_den"))).alias(f"{c}_mean") for c in "rp"]
    both = scores.groupBy("metric").agg(*sums, *means, F.sum("weight").alias("weight"))

    def row(name, *fractions):
        return F.struct(F.lit(name).alias("doc_id"), *[c.alias(n) for c, n in zip(fractions, ("r_nom", "r_den", "p_nom", "p_den"))])

    macro = row("macro", F.col("r_mean"), w, F.col("p_mean"), w)
    micro = row("micro", *[F.col(c) for c in ("r_nom", "r_den", "p_nom", "p_den")])
    both = both.select("metric", "weight", F.explode(F.array(macro, micro)).alias("x"))
    return both.select("x.doc_id", "metric", "x.r_nom", "x.r_den", "x.p_nom", "x.p_den", "weight")


def display(scores: DataFrame) -> DataFrame:
    """recall, precision, f1 and their percentages with two decimals (no leading zero)."""
    r, p = value(F.col("r_nom"), F.col("r_den")), value(F.col("p_nom"), F.col("p_den"))

    def percent(x):
        return F.regexp_replace(F.format_string("%.2f", 100 * x), "^0\\.", ".")

    return scores.select("doc_id", "metric", r.alias("recall"), p.alias("precision"), f1(r, p).alias("f1"), percent(r).alias("recall_pct"), percent(p).alias("precision_pct"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two score tables; for a document and metric in both, the first table's row."""
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "metric").orderBy("src"))).where("r = 1").drop("r", "src")


def as_maps(scores: DataFrame) -> DataFrame:
    """doc_id and a map from metric to its fractions."""
    return scores.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("r_nom", "r_den", "p_nom", "p_den", "weight").alias("v"))))).alias("metrics"))


def condense(maps: DataFrame) -> DataFrame:
    return maps.select("doc_id", F.explode("metrics").alias("metric", "v")).select("doc_id", "metric", "v.*")


def parse_scorer(lines: DataFrame) -> DataFrame:
    """Scores in a scorer's output (file, line_no, line): METRIC and ====> lines set the state for the result lines after
    them; a TOTALS line ends the document, so totals are not scores."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    metric = F.when(line.startswith("METRIC "), F.regexp_extract(line, "^METRIC (.*).$", 1))
    doc = F.when(line.startswith("====> "), F.regexp_extract(line, "^====> (.*?):?$", 1)).when(line.startswith("====== TOTALS"), "")
    number = "([0-9.eE+-]+)"
    pattern = f"Recall: \\({number} / {number}\\).*Precision: \\({number} / {number}\\)"
    out = lines.withColumn("metric", F.last(metric, ignorenulls=True).over(w)).withColumn("doc_id", F.last(doc, ignorenulls=True).over(w))
    out = out.where(line.rlike(pattern) & (F.col("doc_id") != "") & F.col("metric").isNotNull())
    return out.select("file", "doc_id", "metric", *[F.regexp_extract("line", pattern, i).cast("double").alias(c) for i, c in enumerate(("r_nom", "r_den", "p_nom", "p_den"), 1)], F.lit(1.0).alias("weight"))


def doubtful(scores: DataFrame) -> DataFrame:
    """The rows whose recall or precision is above 1, negative or no number."""
    def bad(nom, den):
        v = value(F.col(nom), F.col(den))
        return (v > 1) | (v < 0) | F.isnan(v) | F.col(nom).isNull() | F.col(den).isNull()

    return scores.where(bad("r_nom", "r_den") | bad("p_nom", "p_den"))


def merge_info(rows: DataFrame, keys: list[str], order: str, info: str = "info") -> DataFrame:
    """keys and the union of the rows' maps; of a key in several the last row's value by ``order``."""
    pairs = F.coalesce(F.map_entries(info), F.array().cast("array<struct<key:string,value:string>>"))
    listed = F.array_sort(F.collect_list(F.struct(order, pairs.alias("pairs"))))
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def put(acc, x):
        return F.concat(F.filter(acc, lambda e: ~F.exists(x.pairs, lambda n: n.key == e.key)), x.pairs)

    return rows.groupBy(*keys).agg(F.map_from_entries(F.aggregate(listed, empty, put)).alias(info))
