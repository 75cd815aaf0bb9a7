"""The quality ranker learns from every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import quality


def test_fit_takes_all_rows(spark):
    n, k = 24_000, len(quality.FEATURES)
    first = (F.col("id") % 1000) / 1000.0
    rows = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_key"), F.concat(F.array(first), F.array_repeat(F.lit(0.5), k - 1)).alias("x"), (F.col("id") % 1000 >= 900).cast("int").alias("y"))
    model = quality.fit(rows)
    x = (np.arange(n) % 1000) / 1000
    assert np.isclose(model["mean"][0], x.mean()) and np.isclose(model["mean"][k], (x**2).mean())
    z = (np.stack([x, x**2], axis=1) - model["mean"][[0, k]]) / model["sd"][[0, k]]
    assert (((z @ model["w"][[0, k]]) > model["threshold"]) == (x >= 0.9)).all()
