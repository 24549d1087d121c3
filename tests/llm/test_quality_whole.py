"""The quality model is fitted on all labelled training rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from guardlake.llm import quality
from guardlake.llm.shared import training_row


def test_every_labelled_training_row_shapes_the_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAIRS", 100)
    monkeypatch.setattr(quality, "ROWS_OF_GROUP", 500)
    monkeypatch.setattr(quality, "ROWS_OF_RANGE", 50)
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") * 7919 % 1000, F.repeat(F.lit(" !"), (F.col("id") * 31 % 17).cast("int"))).alias("text"))
    labels = df.select("doc_id", F.when(F.col("doc_id") * 31 % 17 + F.col("doc_id") % 5 < 18, 1).otherwise(0).alias("quality"))  # bad ones are rare
    model = quality.fit(df, labels)
    rows = df.join(labels, "doc_id").filter(training_row()).select("text", "quality").collect()
    x, y = np.array([quality.features(r.text) for r in rows]), np.array([r.quality for r in rows])
    assert len(x) > 20_000 and 0 < (y == 0).sum() < len(y) / 5
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0), atol=1e-6)
    s, bad = np.sort(model.strength(x)), int((y == 0).sum())
    assert abs(model.cut - (s[bad - 1] + s[bad]) / 2) < 1e-9
    assert np.array_equal(quality.fit(df, labels).weights, model.weights)
    assert ((model.score(x) >= 0.7) == y).mean() > 0.9
