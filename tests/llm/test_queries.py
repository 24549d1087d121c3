"""The registered queries on the test tables: against their SQL, or against plain versions of their digests."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from guardlake.llm import bpe, pii, quality, queries
from tests.llm.test_operators import plain_base
from tests.test_oracle import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(norm(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op2_predicts_every_document(spark, texts):
    out = run(spark, "op2_language_id")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_op3_digests_follow_the_base_rules(spark, texts):
    out = run(spark, "op3_pii")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        base = plain_base(texts[r.doc_id] or "")
        line = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == sha(",".join(line)) and set(line) <= set(r.spans.split(",")) | {""}
        assert r.n_found == len(base) + r.n_added == (len(r.spans.split(",")) if r.spans else 0)
        order = [(int(x.split(":")[1]), pii.ALL_KINDS.index(x.split(":")[0])) for x in r.spans.split(",") if x]
        assert order == sorted(order)
    added = [r for r in queries.op3_pii(spark, SF.replace("0.001", "0.01")).collect() if r.n_added]
    assert added and all(len(r.spans.split(",")) > sum(r[f"n_{k}"] for k in pii.KINDS) for r in added)


def test_op4_equals_the_library(spark, texts):
    import public_tokenizers as public
    import tiktoken

    vocabulary = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary) if t}, special_tokens={})
    out = run(spark, "op4_byte_bpe")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id] or ""))


def plain_fingerprint(text: str) -> str:
    """Least hash of each of 64 bins of the LZ78 phrases; an empty bin borrows from the next full one, marked by its distance."""
    known, at = set(), 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in known:
            known.add(text[at:end])
            at = end
    if not known:
        return ""
    least: dict[int, int] = {}
    for h in map(xxhash.xxh3_64_intdigest, known):
        least[h % 64] = min(h, least.get(h % 64, h))
    bins = {b: h // 64 % 65536 for b, h in least.items()}
    out = []
    for b in range(64):
        gap = next(g for g in range(64) if (b + g) % 64 in bins)
        value = bins[(b + gap) % 64]
        out.append(value if gap == 0 else (value * 31 + gap * 977 + 7) % 65536)
    return "".join(f"{v:04x}" for v in out)


def test_op7_equals_a_plain_version(spark, texts):
    out = run(spark, "op7_lz_fingerprint")
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    assert sorted(r.doc_id for r in out) == sorted(texts)
    alike = lambda a, b: float(a == b) if not a or not b else sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64
    for r in out:
        text, following = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        prints = [plain_fingerprint(t) for t in (text, edited, following)]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), *prints[:2])
        assert (r.near_edited, r.near_next) == (alike(prints[0], prints[1]), alike(prints[0], prints[2]))


def test_op9_scores_every_document(spark, texts):
    out = run(spark, "op9_quality")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in out)
    score = {r.doc_id: r for r in out}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held_out(r.doc_id) and r.quality is not None]
    assert sum(score[r.doc_id].predicted == r.quality for r in labels) >= 0.9 * len(labels)


def test_pair_weights_stand_at_the_least_loss():
    """The fitted weights against the Bradley-Terry loss itself: no small step in any direction lessens it."""
    rng = np.random.default_rng(3)
    d = rng.normal(size=(2_000, 5)) + [0.5, 0, -0.2, 0, 1]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.RIDGE * w @ w / 2
    weights = quality.fit_pairs(d)
    for step in np.concatenate([np.eye(5), -np.eye(5)]) * 1e-3:
        assert loss(weights) <= loss(weights + step)


def test_quality_of_very_long_texts_is_finite():
    x = np.array([quality.features(t) for t in ("a" * 2_000_000, "word " * 400_000, "\n" * 1_000_000, "")])
    assert np.isfinite(x).all()
