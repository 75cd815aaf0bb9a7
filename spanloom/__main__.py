"""Command line: ``python -m spanloom GOLD.xml OTHER.xml ... --out DIR`` writes the report and prints evaluation and scores."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import report, scores
from .plans.compare import compare


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanloom", description="Compare annotated texts with a gold standard.")
    parser.add_argument("files", nargs="+", help="files of marked articles, the gold one first; a single one is compared with itself")
    parser.add_argument("--out", help="folder for the report: a head and a foot around the articles in order")
    parser.add_argument("--whole", action="store_true", help="compare whole mentions, not their minimal spans")
    parser.add_argument("--keep-no-entity", action="store_true", help="keep mentions whose entity stands for none")
    parser.add_argument("--human-readable", action="store_true", help="label entities with their first mention and number")
    parser.add_argument("--line-breaks", action="store_true", help="show line feeds as breaks")
    parser.add_argument("--no-scores", action="store_true", help="leave out coreference scores")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    c = compare(spark, options.files, min_only=not options.whole, drop_no_entity=not options.keep_no_entity)
    with_scores = not options.no_scores and len(options.files) > 1
    if options.out:
        head, foot = report.TEMPLATE.split("<article/>")
        body = c.report(options.human_readable, metrics=with_scores, line_breaks=options.line_breaks).select(F.col("doc_idx").cast("long").alias("o"), F.col("article").alias("value"))
        ends = spark.createDataFrame([(-1, head + c.head(with_scores)), (1 << 62, foot)], "o long, value string")
        body.unionByName(ends).orderBy("o").select("value").write.text(options.out)
    for r in c.marks.groupBy("ann", "eval").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("chars")).orderBy("ann", "eval").toLocalIterator():
        print(r["ann"], r["eval"] or "none", r["n"], r["chars"], sep="\t")
    if with_scores:
        totals = c.totals().withColumn("doc_id", F.concat_ws("\t", F.col("ann").cast("string"), "metric", "doc_id"))
        for r in scores.display(totals).orderBy("doc_id").toLocalIterator():
            print(r["doc_id"], r["recall_pct"], r["precision_pct"], f"{100 * r['f1']:.2f}", sep="\t")


if __name__ == "__main__":
    main()
