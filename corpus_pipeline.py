"""A corpus pipeline of five operators: each stage reads what the one before it kept.

Documents that the quality ranking rejects go; lines repeated in many documents go, the rest of their
documents stays; of each class of near duplicates the document with the smallest id stays; documents that
hold a benchmark passage go; what is left is encoded, and decoded to prove it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.functions.steps import stage_steps
from guardlake.llm import bpe, decontam, linededup, neardup, quality
from guardlake.llm.queries import byte_vocabulary, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with its columns renamed by place, so that no operator's column can clash; and the names of id and text."""
    at = {c.lower(): f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]), at["doc_id"], at["text"]


def rank_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, id_col, text_col = _numbered(docs)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = quality.score(rows, model, text_col)
    return scored.filter("predicted = 1").select(*rows.columns).toDF(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null; n_chars, where there is such a column, follows the text."""
    rows, id_col, text_col = _numbered(docs)
    kept = linededup.drop_repeated_lines(rows, id_col=id_col, text_col=text_col)
    text = F.when(F.col(text_col).isNotNull(), F.col("kept_text"))
    out = [F.col(c) for c in rows.columns]
    for i, name in enumerate(docs.columns):
        if name.lower() == "text":
            out[i] = text.alias(f"_c{i}")
        elif name.lower() == "n_chars":
            out[i] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[name].dataType).alias(f"_c{i}")
    return kept.select(*out).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, id_col, text_col = _numbered(docs)
    return neardup.keep_one(rows, neardup.near_duplicates(rows, id_col, text_col), id_col).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _, text_col = _numbered(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), text_col=text_col)
    return found.filter(F.size("hit_words") == 0).select(*rows.columns).toDF(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the hash of the bytes that the ids decode to."""
    both = bpe.encode(docs.select("doc_id", "text"), byte_vocabulary(), keep=["doc_id"], decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality ranking", rank_quality),
    ("line dedup", drop_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenise),
]

#: Training and near-duplicate classes are beyond SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with stage_steps(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
