"""What keeps streams bounded: micro-batches in order of time, and few groups for rows that need no state."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake import catalog
from guardlake.plans import derived as D
from guardlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_registered_streams_come_in_bounded_micro_batches_in_order(spark, monkeypatch, tmp_path):
    stream = catalog._as_stream(D.audit_rows(spark, SF), "entries", "seq", 300)
    seen = []
    take = lambda batch, epoch: seen.append(batch.agg(F.count("*"), F.min("seq"), F.max("seq")).first())
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _, _ in seen) == D.audit_rows(spark, SF).count()
    assert len(seen) > 2 and max(n for n, _, _ in seen) < 600
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_streams_cut_into_micro_batches_give_the_whole_result(spark, monkeypatch):
    parts = catalog._as_stream
    monkeypatch.setattr(catalog, "_as_stream", lambda df, name, order: parts(df, name, order, 400))
    for stream, batch in (("u2_stream", "u2_build_chain"), ("a10_stream", "a10_evaluate")):
        got, want = (sorted(map(tuple, catalog.queries()[q](spark, SF).collect())) for q in (stream, batch))
        assert got == want and len(got) > 100


def test_rows_without_state_are_in_few_groups(spark):
    rows = spark.range(20_000).select(F.col("id").alias("order"), F.col("id").cast("string").alias("principal"), (F.col("id") % 100 == 0).alias("asks"))
    lanes = jobs._lane(rows, F.col("asks"), ["principal"])
    assert lanes.filter("asks and (lane <> 0 or principal is null)").count() == 0
    assert lanes.filter("not asks").select("lane", "principal").distinct().count() <= 256
