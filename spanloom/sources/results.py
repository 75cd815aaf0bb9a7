"""Scores as JSON documents, written and read."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key under which documents lie in a whole result; a line may also be the map of documents itself.
ROOT = "docidToMetricToResult"
SCHEMA = "doc_id string, metric string, r_nom double, r_den double, p_nom double, p_den double, weight double"


def to_json(scores: DataFrame) -> DataFrame:
    """A JSON text per document: its id, its metrics by name, and their recall, precision and weight."""
    half = {s: F.struct(F.col(f"{s}_nom").alias("nom"), F.col(f"{s}_den").alias("denom")) for s in "rp"}
    info = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("info")
    listed = F.array_sort(F.collect_list(F.struct("metric", half["r"].alias("recall"), half["p"].alias("precision"), "weight")))
    metrics = F.map_from_entries(F.transform(listed, lambda x: F.struct(x.metric, F.struct(info, x.recall.alias("recall"), x.precision.alias("precision"), x.weight.alias("weight")))))
    docs = scores.groupBy("doc_id").agg(metrics.alias("m"))
    return docs.select("doc_id", F.to_json(F.struct(F.create_map(F.col("doc_id"), F.col("m")).alias(ROOT))).alias("value"))


def write(scores: DataFrame, path: str) -> None:
    """A line per document; no task needs more than one document at a time."""
    to_json(scores).select("value").write.text(path)


def _plain(x):
    """The value without type tags, which are pairs of a class name and what it tags."""
    if isinstance(x, list) and len(x) == 2 and isinstance(x[0], str) and isinstance(x[1], dict | list):
        return _plain(x[1])
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return x


def _rows(text: str):
    decoder, at = json.JSONDecoder(), 0
    while text[at:].strip():
        at += len(text[at:]) - len(text[at:].lstrip())
        found, at = decoder.raw_decode(text, at)
        found = _plain(found)
        for doc, metrics in (found.get(ROOT, found) or {}).items():
            for metric, v in (metrics or {}).items():
                halves = [float((v.get(side) or {}).get(part) or 0) for side in ("recall", "precision") for part in ("nom", "denom")]
                yield doc, metric, *halves, float(v.get("weight", 1.0))


def parse(raw: DataFrame) -> DataFrame:
    """Scores of JSON texts in column ``value``; each may hold several documents, indented or not, with or without type tags."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for t in b["value"] if t for r in _rows(t)], columns=["doc_id", "metric", "r_nom", "r_den", "p_nom", "p_den", "weight"])

    return raw.select(F.col("value").cast("string").alias("value")).mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scores of the JSON files below ``path``: whole files, or with ``lines`` a document per line (what ``write`` leaves)."""
    return parse(spark.read.text(path, wholetext=not lines))
