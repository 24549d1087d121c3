"""Proportional stratified interleaving: shards that all have the mixture of the whole.

Rows are shuffled by a seeded digest within their source and ranked; row r of n gets the fractional
rank (r - 1/2) / n; all rows are put in order of that and cut into equal runs. Each shard then holds
each source in proportion, to within a row or so.

Both rankings are two-level, so that neither a hot source nor the global order meets in one task:
a row's bucket follows from its digest (or its fractional rank), buckets hold about half the square
root of the row count each, and a bucket's rows are ranked on top of the count of the buckets before it.
Only ids, sizes and checksums are shuffled, never texts. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.shared import named, written

SHARDS = 16
SEED = "guardlake-1"
#: The sources' row counts are broadcast up to so many sources; beyond that they are joined.
MAX_BROADCAST_SOURCES = 100_000


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard, source, frac_rank for each row.

    Null text: size 1 and the checksum of no bytes, 0. A null source is a source of its own. Null ids
    take part. A row's digest is of its id and its text's checksum, so rows of one id are dealt apart; rows that agree in all of these may stand either way round. An empty table gives none.
    Extra columns are left out, so their names cannot clash.
    """
    total = docs.count()
    per_bucket = max(1, math.isqrt(total) // 2)
    text = named(text_col)
    source = named(source_col).cast("string")
    checksum = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(
        named(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        checksum.alias("text_crc32"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit("")), F.lit(":"), checksum.cast("string")).cast("binary")).alias("digest"),
    )
    sizes = written(rows.groupBy("stratum").agg(F.count("*").alias("n")), "source-sizes")
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST_SOURCES else sizes, "stratum").withColumn("bucket", F.expr(f"(cast(conv(substring(digest, 1, 8), 16, 10) as bigint) * ((n + {per_bucket - 1}) div {per_bucket})) div 4294967296"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("held")).select("stratum", "bucket", F.coalesce(F.sum("held").over(earlier.partitionBy("stratum").orderBy("bucket")), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("digest", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("place", F.row_number().over(in_bucket)).join(before, ["stratum", "bucket"])
    ranked = ranked.withColumn("frac_rank", (2 * (F.col("before") + F.col("place")) - 1) / (2 * F.col("n")))
    slices = max(1, -(-total // per_bucket))
    ranked = written(ranked.select("doc_id", "size", "text_crc32", "source", "stratum", "digest", "frac_rank", F.floor(F.col("frac_rank") * slices).alias("slice")), "shards")
    first = ranked.groupBy("slice").agg(F.count("*").alias("held")).select("slice", F.coalesce(F.sum("held").over(earlier.orderBy("slice")), F.lit(0)).alias("first"))
    in_slice = Window.partitionBy("slice").orderBy("frac_rank", "stratum", "digest", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("place", F.row_number().over(in_slice)).join(first, "slice").withColumn("position", F.col("first") + F.col("place") - 1)
    rows_total = max(1, total)
    placed = placed.withColumn("shard", F.expr(f"cast((position * {n_shards}) div {rows_total} as int)"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"position - (cast(shard as bigint) * {rows_total} + {n_shards - 1}) div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source", "frac_rank",
    )
