"""Corpus evaluation: false-positive gate, drift, expectations, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import rules


def risk_gate(scores: DataFrame, gate: int = 50) -> DataFrame:
    return scores.filter(F.col("risk_score") >= gate)


def fp_gate(scores: DataFrame, baseline: DataFrame, gate: int = 50, slack: int = 1) -> DataFrame:
    """corpus, hits, allowed, passes for each corpus of the baseline."""
    hits = scores.groupBy("corpus").agg(F.count_if(F.col("risk_score") >= gate).alias("hits"))
    out = baseline.select("corpus", (F.col("baseline_hits") + slack).alias("allowed")).join(hits, "corpus", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("passes", F.col("hits") <= F.col("allowed"))


def corpus_drift(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """item_id, change: added, removed or rescored."""
    both = scores.select("item_id", F.col("risk_score").alias("now")).join(baseline.select("item_id", F.col("risk_score").alias("was")), "item_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "rescored")
    return both.withColumn("change", change).filter("change is not null").select("item_id", "change")


def baseline_drift(scores: DataFrame, baseline: DataFrame, gate: int = 50) -> DataFrame:
    """corpus, drift (threshold or size), was, now: what no longer fits the baseline; null where a corpus is absent."""
    size = scores.groupBy("corpus").agg(F.count("*").alias("size"))
    both = baseline.select("corpus", "threshold", "corpus_size").join(size, "corpus", "full_outer")
    moved = lambda name, was, now: F.struct(F.lit(name).alias("drift"), was.cast("long").alias("was"), now.cast("long").alias("now"))
    drifts = F.array_compact(F.array(
        F.when(F.col("threshold") != gate, moved("threshold", F.col("threshold"), F.lit(gate))),
        F.when(~F.col("corpus_size").eqNullSafe(F.col("size")), moved("size", F.col("corpus_size"), F.col("size"))),
    ))
    return both.select("corpus", F.explode(drifts).alias("d")).select("corpus", "d.*")


def expectations(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (item_id, rule_id, least_severity) with met."""
    rank = F.create_map(*[F.lit(x) for kv in rules.SEVERITY_RANK.items() for x in kv])
    best = findings.groupBy("item_id", "rule_id").agg(F.max(rank[F.col("severity")]).alias("rank"))
    return expected.join(best, ["item_id", "rule_id"], "left").withColumn("met", F.coalesce(F.col("rank") >= rank[F.col("least_severity")], F.lit(False))).drop("rank")


def rule_hits(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("hits"), F.count_distinct(id_col).alias("payloads"))


def build_baseline(scores: DataFrame, gate: int = 50) -> DataFrame:
    return scores.groupBy("corpus").agg(F.lit(gate).alias("threshold"), F.count("*").alias("corpus_size"), F.count_if(F.col("risk_score") >= gate).alias("baseline_hits"))


def item_scores(scores: DataFrame) -> DataFrame:
    """corpus, item_id, risk_score: the part of a baseline that shows which item moved."""
    return scores.select("corpus", "item_id", "risk_score")


def stripped_totals(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode("stripped_elements").alias("element", "n")).groupBy("element").agg(F.sum("n").alias("n"))
