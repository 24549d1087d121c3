"""Mixing sources to target weights with hash thresholds.

A row's place in its source is a hash of its id and text. A histogram sums sizes by source and the leading bits of
the hash; the bucket in which a source's running sum passes its budget is the only one that is looked at again, with
the next bits, until it holds one row. What lies below the threshold is taken: a filter, no row is sorted, and
a smaller budget takes a subset of what a larger one takes. Rows that agree in id and text are told apart, once
the hash has no bits left, by a number given to them when they were written. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.shared import in_order, named, small, written

WEIGHTS = (5, 2, 1)
#: A row is taken at most so many times.
MOST = 3
SEED = "guardlake-mix"
#: Bits of a level of the histogram, and of a hash: the row's own, then that of its number.
LEVEL_BITS, HASH_BITS = 12, 60
LEVELS = 2 * HASH_BITS // LEVEL_BITS


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (stratum, size) with weight and target: sources in order take the weights in turn and share the sum of all
    sizes by them; a target stops at `most` times its source's size, and what is over goes to the others by weight,
    until none is above.

    Sources in order of size for their weight reach that bound first, so the bounded ones are the first few in that
    order, found by running sums.
    """
    numbered = in_order(sizes, ["stratum"], name="mix-order")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = numbered.withColumn("weight", weight).drop("position").withColumn("relative", F.col("size") / F.col("weight"))
    ranked = written(in_order(weighed, ["relative", "stratum"], sums=["size", "weight"], name="mix-order"), "mix-targets")
    total, weights_ = (x or 0 for x in ranked.agg(F.sum("size"), F.sum("weight")).first())
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    # a source is bounded if its share of what the ones before it leave is at least its bound
    over = (F.lit(total) - most * exact("size_before")) * exact("weight") >= most * exact("size") * (F.lit(weights_) - exact("weight_before"))
    bounded, weight_of = (x or 0 for x in ranked.filter(over).agg(F.sum("size"), F.sum("weight")).first())
    free = (F.col("weight") * F.lit(total - most * bounded)).cast("double") / F.lit(float(max(1, weights_ - weight_of)))
    return ranked.select("stratum", "size", "weight", F.when(over, (most * F.col("size")).cast("double")).otherwise(free).alias("target"))


def _prefix(level, key):
    """The bits of a 60-bit key that `level` levels look at."""
    bits = F.lit(HASH_BITS) - F.lit(LEVEL_BITS) * F.least(F.greatest(level, F.lit(0)), F.lit(HASH_BITS // LEVEL_BITS))
    return F.call_function("shiftright", key, bits.cast("int"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_col, source, size, source_size, target, copies and taken (size times copies) of each row.

    A size is the number of runs of anything but blanks (space and U+0009 to U+000D); a null text has none. A null
    source is a source of its own and the last one. Every row of a source is taken floor(target / size of the source)
    times, and those below the source's threshold once more; the row on the threshold is taken if that comes nearer the
    target. So a source is off its target by half a row at most. Rows that agree in id and text are taken in the right number, whichever of
    them. Rows with null ids take part. A source without words has target 0. An empty table gives none. Extra columns
    are left out, so their names cannot clash. Results depend on ids and texts alone, not on how rows are dealt.
    """
    spark, per_level = docs.sparkSession, 1 << LEVEL_BITS
    text, source = named(text_col), named(source_col).cast("string")
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(named(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    rows = docs.select(
        named(id_col).alias("_gl_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("stratum"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"), F.monotonically_increasing_id().alias("number"),
    )
    rows = written(rows, "mix-rows").withColumn("g", F.xxhash64("number").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    def histogram(held: DataFrame, level: int) -> DataFrame:
        """stratum, bucket, size, n, and the sum of the sizes in the buckets before it."""
        key = F.col("h") if level < LEVELS // 2 else F.col("g")
        bucket = _prefix(F.lit(level % (LEVELS // 2) + 1), key).bitwiseAND(F.lit(per_level - 1)).alias("bucket")
        sums = held.groupBy("stratum", bucket).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        earlier = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("passed", F.coalesce(F.sum("size").over(earlier), F.lit(0)))

    first = written(histogram(rows, 0), "mix-histogram")
    of_source = targets(first.groupBy("stratum").agg(F.sum("size").alias("size")), weights, most)
    sources = of_source.withColumnRenamed("size", "source_size").withColumn("base", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    sources = written(sources.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")).drop("weight"), "mix-sources")

    on_edge = (F.col("passed") + F.col("seen") < F.col("budget")) & (F.col("budget") <= F.col("passed") + F.col("seen") + F.col("size"))
    start = sources.filter("budget > 0").select("stratum", "budget", F.lit(0).alias("level"), F.lit(0).cast("long").alias("ph"), F.lit(0).cast("long").alias("pg"), F.lit(0).cast("long").alias("seen"), F.lit(2).cast("long").alias("held"))
    done, level, sums = [], 0, first
    open_ = start
    while True:
        own, deep = (("ph", "pg") if level < LEVELS // 2 else ("pg", "ph")), level + 1
        step = sums.join(small(open_), "stratum").filter(on_edge)
        step = step.select("stratum", "budget", F.lit(deep).alias("level"), (F.col(own[0]) * per_level + F.col("bucket")).alias(own[0]), own[1], (F.col("seen") + F.col("passed")).alias("seen"), F.col("n").alias("held"))
        edges = written(step.select("stratum", "budget", "level", "ph", "pg", "seen", "held"), "mix-edges")
        open_, level = edges.filter("held > 1"), deep
        if level == LEVELS or open_.isEmpty():
            done.append(edges)
            break
        done.append(edges.filter("held = 1"))
        in_edge = rows.join(small(open_.select("stratum", "ph", "pg")), "stratum").filter((_prefix(F.lit(level), F.col("h")) == F.col("ph")) & (_prefix(F.lit(level - LEVELS // 2), F.col("g")) == F.col("pg")))
        sums = histogram(in_edge, level)
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    cut = sources.join(edges.select("stratum", "level", "ph", "pg", "seen"), "stratum", "left")
    own_h, own_g = _prefix(F.col("level"), F.col("h")), _prefix(F.col("level") - LEVELS // 2, F.col("g"))
    edge = 2 * (F.col("budget") - F.col("seen")) > F.col("size")
    below = (own_h < F.col("ph")) | ((own_h == F.col("ph")) & ((own_g < F.col("pg")) | ((own_g == F.col("pg")) & edge)))
    out = rows.join(small(written(cut, "mix-cuts")), "stratum").withColumn("copies", F.col("base") + F.coalesce(below, F.lit(False)).cast("int"))
    return out.select(F.col("_gl_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
