"""The whole comparison of annotated articles: a gold file and others."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NO_ENTITY, initials, tokens, xml_escape
from ..operators import chains, markup, report, scores, sweep
from ..sources import xml

KEY = ["doc_idx"]
#: Entities that are never principal, also where mentions without an entity are kept (fixed value).
HIDDEN = ("--OOKBE--",)


@dataclass
class Comparison:
    """``articles`` (doc_idx, doc_id, text) that all inputs have in common from the start, ``whole`` their mentions, and
    ``shown`` the mentions that are compared: the minimal spans, where they have one, if these are asked for."""

    names: list[str]
    articles: DataFrame
    whole: DataFrame
    shown: DataFrame

    @property
    def others(self) -> list[int]:
        return list(range(1, len(self.names)))

    @cached_property
    def nested(self) -> DataFrame:
        return sweep.nest(self.shown, self.articles.select("doc_idx", F.length("text").alias("n_chars")), KEY)

    @cached_property
    def marks(self) -> DataFrame:
        """A row per segment and other annotator (see ``sweep.marks``)."""
        return sweep.marks(self.nested, self.others, KEY, hidden=HIDDEN)

    @cached_property
    def chains(self) -> DataFrame:
        """doc_idx, ann, entity, chain_idx, n_mentions; other annotators' chains have the number of the gold chain that maps to
        them (by whole mentions, greedily), else fresh ones."""
        plain = chains.chains(self.shown, KEY)
        segs = sweep.wide(sweep.nest(self.whole, self.articles.select("doc_idx", F.length("text").alias("n_chars")), KEY), [0, *self.others], KEY)
        parts = [plain.where("ann = 0")]
        for a in self.others:
            to = chains.aligned_chain_idx(plain, chains.greedy_map(chains.cooccurrence(segs, KEY, 0, a), KEY), KEY, other=a)
            parts.append(plain.where(F.col("ann") == a).join(to, [*KEY, "entity"]).select(*KEY, "ann", "entity", F.col("aligned_idx").alias("chain_idx"), "n_mentions"))
        return reduce(DataFrame.unionByName, (p.withColumn("chain_idx", F.col("chain_idx").cast("long")) for p in parts))

    @cached_property
    def scores(self) -> DataFrame:
        """ann, doc_id, metric, r_nom, r_den, p_nom, p_den, weight: coreference scores of every article, mentions being the
        tokens that they reach from and to."""
        toks = tokens(self.articles, "doc_idx")
        bounds = markup.token_boundaries(markup.nest_tokens(sweep.nest(self.whole, None, KEY), toks, KEY), KEY)
        on_tokens = bounds.select(*KEY, "ann", "seq", F.col("first_tok").alias("m_start"), F.col("last_tok").alias("m_end"), "entity")
        each = [chains.all_scores(sweep.nest(on_tokens, None, KEY), KEY, other=a).withColumn("ann", F.lit(a)) for a in self.others]
        rows = reduce(DataFrame.unionByName, each).join(self.articles.select("doc_idx", "doc_id"), KEY)
        return rows.select("ann", "doc_idx", "doc_id", "metric", *chains.FRACTIONS, F.lit(1.0).alias("weight"))

    def totals(self) -> DataFrame:
        """ann, doc_id (macro or micro), metric and the averaged fractions."""
        return reduce(DataFrame.unionByName, (scores.combine(self.scores.where(F.col("ann") == a)).withColumn("ann", F.lit(a)) for a in self.others))

    def entity_names(self, human_readable: bool = False, short: str = "entity") -> DataFrame:
        """doc_idx, ann, entity, label (escaped, as the report shows it) and short. Human-readable labels have the string of the
        first mention and the number of first appearance too; ``short`` may be "initials"."""
        first = self.shown.groupBy(*KEY, "ann", "entity").agg(F.min_by(F.struct("m_start", "m_end"), sweep.rank()).alias("m")).join(chains.chains(self.shown, KEY), [*KEY, "ann", "entity"])
        label: Column = xml_escape("entity")
        if human_readable:
            first = first.join(self.articles.select("doc_idx", "text"), KEY)
            said = F.col("text").substr(F.col("m.m_start") + 1, F.col("m.m_end") - F.col("m.m_start"))
            label = F.concat_ws("; ", xml_escape(said), F.col("chain_idx").cast("string"), label)
        return first.select(*KEY, "ann", "entity", label.alias("label"), (initials("entity") if short == "initials" else F.col("entity")).alias("short"))

    def report(self, human_readable: bool = False, short: str = "entity", metrics: bool = True, line_breaks: bool = False) -> DataFrame:
        """doc_idx and ``article``, the XML report of each article, with its metrics block."""
        names = self.entity_names(human_readable, short)
        info = self.shown.select(*KEY, "ann", "seq", "info").where(F.size("info") > 0)
        body = report.contents(self.articles, self.nested, names, self.others, KEY, line_breaks=line_breaks, info=info, hidden=HIDDEN)
        body = body.join(report.entity_lists(names, KEY), KEY, "left").join(self.articles.select("doc_idx", "doc_id"), KEY)
        block = F.lit("")
        if metrics:
            body = body.join(report.metrics(self.scores, KEY), KEY, "left")
            block = F.coalesce("metrics", F.lit(""))
        return body.select("doc_idx", F.concat(F.lit("  <article id='"), xml_escape("doc_id"), F.lit("'>\n"), F.coalesce("entities", F.lit("<entity-list>\n</entity-list>\n")), "content", F.lit("\n"), block, F.lit("  </article>")).alias("article"))

    def head(self, metrics: bool = True) -> str:
        """What stands before the articles: the annotators, and the metrics of all articles."""
        out = report.annotators(self.names)
        if metrics:
            t = self.totals().withColumn("metric", F.concat_ws("", "metric", F.lit(" ("), "doc_id", F.lit(")"))).withColumn("all", F.lit(0))
            out += "".join(r["metrics"] for r in report.metrics(t, ["all"]).collect())
        return out


def compare(spark: SparkSession, paths: list[str], min_only: bool = True, drop_no_entity: bool = True) -> Comparison:
    """Compare files of marked articles, the gold one first; a single file is compared with itself. Articles count up to the
    first that differs in id or text. With ``min_only`` mentions are shown by their minimal spans; mentions whose entity
    stands for none are dropped unless ``drop_no_entity`` is off."""
    paths = [paths[0], paths[0]] if len(paths) == 1 else paths
    read = [xml.read(spark, p, i) for i, p in enumerate(paths)]
    articles = read[0][0].select("doc_idx", "doc_id", "text")
    for other, _ in read[1:]:
        articles = articles.join(sweep.zip_prefix(articles, other, "doc_idx", ["doc_id", "text"]), "doc_idx")
    mentions = reduce(DataFrame.unionByName, (m.select("ann", "doc_idx", "seq", "m_start", "m_end", "entity", "min_start", "min_end", "info") for _, m in read))
    if drop_no_entity:
        mentions = mentions.where(~F.col("entity").isin(*NO_ENTITY))
    whole = mentions.join(articles.select("doc_idx"), "doc_idx")
    shown = min_mentions(whole) if min_only else whole
    return Comparison(paths, articles, whole, shown)


def min_mentions(mentions: DataFrame) -> DataFrame:
    """The mentions by their minimal spans, where they have one."""
    return mentions.withColumns({"m_start": F.coalesce("min_start", "m_start"), "m_end": F.coalesce("min_end", "m_end")})
