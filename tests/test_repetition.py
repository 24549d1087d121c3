"""The repetition ratio counts bytes in arrays, with no pattern tried at each of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from guardlake.functions import text as X


def test_repetition_ratio_is_the_share_of_equal_neighbours(spark):
    texts = ["", None, "a", "aa", "aab", "ab", "b\n\nb", "éé", "漢漢字", "zz", "z" * 60_000, "", "z", "xyz" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    out = df.select("id", X.repetition_ratio(F.col("t")).alias("r"))
    share = lambda b: np.float32(sum(x == y for x, y in zip(b, b[1:])) / len(b)) if len(b) > 1 else 0.0
    assert {r.id: r.r for r in out.collect()} == {i: float(share((t or "").encode())) for i, t in enumerate(texts)}
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
