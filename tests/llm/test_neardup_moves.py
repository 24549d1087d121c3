"""Near-duplicate classes move each row narrow and each text few times, as joins that are not broadcast do it on large tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from guardlake.llm import neardup


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def moved(spark) -> int:
    """Bytes that the session's tasks have written for shuffles so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def below(rng, groups, copies, size=300):
    """Texts in groups: copies of a text with a few of their words changed, so that most pairs are just not alike."""
    for _ in range(groups):
        base = [f"w{rng.randrange(100_000)}" for _ in range(size)]
        for k in range(copies):
            share = 0.003 if k % 4 == 3 else 0.025
            yield " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base)


def test_few_bytes_are_moved_for_texts_that_are_just_not_alike(spark, no_broadcast):
    texts = list(below(random.Random(5), 20, 40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    sets = [neardup.shingles(t) for t in texts]
    alike = [(a, b) for g in range(0, len(texts), 40) for a in range(g, g + 40) for b in range(g, a) if neardup.similarity(sets[a], sets[b]) >= neardup.SIMILARITY]
    before = moved(spark)
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    size = sum(map(len, texts))
    up = {i: i for i in out}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in alike:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert out == {i: root(i) for i in out}
    assert moved(spark) - before < 4.5 * size


def test_a_text_goes_once_to_a_tile_and_tiles_lose_no_pair(spark, monkeypatch):
    texts = list(below(random.Random(6), 2, 30, 60))
    of = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = [(a, b, b // 30) for a in range(60) for b in range(a) if a // 30 == b // 30]
    sets = [neardup.shingles(t) for t in texts]
    want = {(a, b) for a, b, _ in pairs if neardup.similarity(sets[a], sets[b]) >= 0.5}
    assert 0 < len(want) < len(pairs)
    df = spark.createDataFrame(pairs, "a long, b long, near long")
    for leaders, partners in ((256, 1024), (7, 5), (1, 1)):
        monkeypatch.setattr(neardup, "LEADERS", leaders)
        monkeypatch.setattr(neardup, "PARTNERS", partners)
        out = Counter((r.a, r.b) for r in neardup.verified(df, of, 0.5, neardup.WORDS).collect())
        assert set(out) == want and set(out.values()) == {1}
        tile = neardup.tiles(df).groupBy("near", "x", "y").count()
        assert (tile.count() == 2) == (leaders == 256)
