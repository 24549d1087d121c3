"""The pipeline on planted cases, against the operators' brute-force versions chained in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from guardlake.llm import bpe
from guardlake.llm.queries import byte_vocabulary
from tests.llm.test_operators import plain_classes, plain_contamination, plain_lines, words


def planted():
    rng = random.Random(21)
    items = [(i, words(rng, 20, 9000)) for i in range(5)]
    texts, good = [], []
    for i in range(160):
        text = "\n".join(words(rng, 40, 5000) for _ in range(3))
        if i % 8 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        good.append(i % 8 != 1)
        if i % 8 == 2:
            text += "\nAll Rights reserved "
        if i % 8 == 3:
            text = texts[i - 3] if i % 16 == 3 else texts[i - 3] + " more"
        if i % 8 == 4:
            text += " " + items[i % 5][1]
        texts.append(text)
    texts += [None, "", "solo"]
    good += [True] * 3
    return items, texts, good


@pytest.fixture
def tables(spark, tmp_path):
    items, texts, good = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good[:160])], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items, texts, good


def test_pipeline_equals_brute_force(spark, tables):
    path, items, texts, good = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, path)
        assert out.schema.names == docs.schema.names, name
    scored = {r.doc_id for r in corpus_pipeline.rank_quality(spark, docs, path).collect()}
    assert all((i in scored) == g for i, g in enumerate(good[:160]))
    rows = [(i, texts[i]) for i in sorted(scored)]
    lines = plain_lines([t for _, t in rows], 10)
    rows = [(i, None if t is None else line) for (i, t), line in zip(rows, lines)]
    keep = set(plain_classes(rows).values())
    rows = [(i, t) for i, t in rows if i in keep and not plain_contamination(t, items)[1]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    encoder = bpe.Encoder(byte_vocabulary())
    assert {i: r.ids for i, r in got.items()} == {i: encoder.ids(t or "").tolist() for i, t in rows}
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].n_tokens == len(got[i].ids) for i, t in rows)
    assert len(rows) < 120 and any(t and "reserved" not in t for _, t in rows)


def test_stages_take_empty_tables(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name
