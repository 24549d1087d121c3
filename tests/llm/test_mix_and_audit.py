"""Mixing, source divergence and centroid clustering against plain versions, on tables with nulls, ties, repeated rows and hot groups."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from guardlake.llm import divergence, mixing, vafile

EDGE = [None, "", " ", "\n", "one two", "one two", "é" * 3, "x" * 30_000]


# mixing


def plain_targets(sizes: dict, weights=mixing.WEIGHTS, most=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, bounded = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in bounded]
        left = total - most * sum(sizes[s] for s in bounded)
        out = {s: most * sizes[s] if s in bounded else left * weight[s] / sum(weight[x] for x in free) for s in order}
        more = {s for s in free if out[s] > most * sizes[s]}
        if not more:
            return out
        bounded |= more


def check_mix(rows, out):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    aims = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, size(t)) for i, t, _ in rows)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(aims[r.source], abs=1e-6)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - aims[source]) <= largest[source] / 2 + 1e-6, source


def mix_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_sources_come_within_half_a_row_of_their_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["hot"] * 8 + ["a", "b", "c", None, "é"])) for i in range(2000)]
    rows += [(5000 + i, t, "edge") for i, t in enumerate(EDGE)] + [(6000, None, "wordless")]
    out = mixing.mix(mix_rows(spark, rows)).collect()
    check_mix(rows, out)
    again = mixing.mix(mix_rows(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(out) == Counter(again)


def test_rows_that_are_all_alike_are_taken_in_the_right_number(spark):
    rows = [(7, "a b c", "hot")] * 900 + [(None, "d e", "hot")] * 200 + [(i, "x y z", "b") for i in range(50)] + [(None, None, "c")] * 30
    out = mixing.mix(mix_rows(spark, rows)).collect()
    check_mix(rows, out)
    assert Counter(out) == Counter(mixing.mix(mix_rows(spark, rows).repartition(5)).collect())


def test_smaller_budgets_take_a_part_of_larger_ones(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(400)]
    small = {r.doc_id: r.copies for r in mixing.mix(mix_rows(spark, rows), weights=(1, 3)).collect()}
    large = {r.doc_id: r.copies for r in mixing.mix(mix_rows(spark, rows), weights=(2, 3)).collect()}
    assert all(small[i] <= large[i] for i, _, s in rows if s == "a") and any(small[i] < large[i] for i, _, s in rows if s == "a")


def test_targets_are_bounded_and_the_rest_is_shared_again(spark):
    for sizes in ({"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 0}, {"a": 10, "b": 1, "c": 1, "d": 500, None: 3}, {"only": 9}):
        keyed = [("null" if s is None else f"={s}", n) for s, n in sizes.items()]
        got = {r.stratum: r.target for r in mixing.targets(spark.createDataFrame(keyed, "stratum string, size long")).collect()}
        want = plain_targets(sizes)
        assert got == pytest.approx({"null" if s is None else f"={s}": t for s, t in want.items()})
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mixing_takes_empty_tables_and_clashing_names(spark):
    assert mixing.mix(mix_rows(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "a b", "s", 3, 4, 5)], "`doc.id` long, text string, source string, size long, h long, stratum long")
    (r,) = mixing.mix(odd, id_col="doc.id").collect()
    assert (r["doc.id"], r["size"], r.taken) == (1, 2, 2)


# source divergence


def plain_divergence(rows, min_docs, top=10):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", re.findall("[a-z\x80-\U0010ffff]+", fold(text or ""))) for text, lang, source in rows]
    seen, out = defaultdict(Counter), []
    for lang, _, words in docs:
        seen[lang].update(set(words))
    groups = sorted({d[:2] for d in docs})
    counts = {g: Counter() for g in groups}
    for lang, source, words in docs:
        counts[lang, source].update(w for w in words if seen[lang][w] >= min_docs)
    for lang, source in groups:
        kept = [w for w in seen[lang] if seen[lang][w] >= min_docs]
        v = len(kept)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        own = counts[lang, source]
        pairs = [(s, sum(f(p(own, w), p(counts[lang, s], w)) for w in kept)) for x, s in groups if x == lang and s != source]
        terms = [(w, f(p(own, w), p(whole, w))) for w in kept if own[w] and p(own, w) > p(whole, w)]
        for part, found, most in (("pair", pairs, math.inf), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found) if i < most]
    return sorted(out)


AUDIT = "text string, lang string, source string"
#: Words of all lengths about the borders of one and two packed words, and of more bytes than both.
SIZES = ["a", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 4, "é" * 5, "é" * 8, "é" * 9, "z" * 500, "ab", "AB", "日本"]


def audit_rows(seed, n, langs=("en", "de", None), sources=("hot",) * 6 + ("a", "b", None, "é")):
    rng = random.Random(seed)
    words = SIZES + [f"{'xy' * rng.randrange(1, 6)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(rng.choice(["-", " ", "9", "\n"]).join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(langs), rng.choice(sources)) for _ in range(n)]
    return rows + [(None, "en", "a"), ("", "en", "empty"), ("  1 2", None, "wordless"), ("solo words", "xx", "one"), ("other", "xx", "two")]


@pytest.mark.parametrize("held", [divergence.HELD_WORDS, 40])
def test_divergence_equals_a_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_WORDS", held)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 3_000 if held == 40 else 4_000_000)
    rows = audit_rows(held, 400)
    got = sorted(tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, AUDIT), min_docs=5).collect())
    assert got == plain_divergence(rows, 5)


def test_divergence_over_several_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)
    rows = audit_rows(3, 300, ("en",), [f"s{i}" for i in range(11)])
    got = sorted(tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, AUDIT), min_docs=3).collect())
    assert got == plain_divergence(rows, 3)


def test_divergence_takes_empty_tables_extra_columns_and_repeated_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], AUDIT)).count() == 0
    rows = [("same words here", "en", "hot")] * 40 + [("same", "en", "b")] * 3
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], AUDIT + ", n long, w1 long, rest long")
    assert sorted(tuple(r) for r in divergence.divergence(df).collect()) == plain_divergence(rows, 10)


def test_packing_and_shares_are_exact(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) >> rng.integers(0, 60, 5000, dtype=np.uint64)
    assert (keys[divergence.radix_order(np.arange(5000), keys)] == np.sort(keys)).all()
    rows = [(n, n + m) for n in (0, 1, 7, 10**13) for m in (2, 3, 10**13, 10**15)]
    for r in spark.createDataFrame(rows, "n long, whole long").withColumn("p", divergence.share(*map(spark_col, ("n", "whole")))).collect():
        assert r.p == 1 + 10**9 * (r.n + 2) // r.whole


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_one_very_long_text_is_counted_whole(spark):
    text = "word " * 300_000 + "q" * 1_000_000
    counts = divergence.term_counts(spark.createDataFrame([(text, "en", "s"), ("word", "en", "s")], AUDIT)).collect()
    assert sorted((r.n, r.docs) for r in counts) == [(1, 1), (300_001, 2)]


# centroids


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    if not kept:
        return []
    text = lambda i: "" if i is None else str(i)
    now = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{text(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), i) for i, c in enumerate(now))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        now = [[sum(x) // len(own[i]) for x in zip(*own[i])] if own[i] else c for i, c in enumerate(now)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, c, d, sums[c], sum(sums.values()), digest[c]) for i, c, d in found]


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    return [(i, (centres[i % 12] + rng.normal(size=64) * 0.4).tolist()) for i in range(n)]


VEC = "vec_id long, embedding array<double>"


def test_clusters_equal_a_plain_version(spark):
    rows = vectors(2, 260)
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # one vector a third of all
    rows += [(5, rows[9][1]), (5, rows[5][1]), (None, rows[11][1]), (None, rows[11][1])]  # equal ids and null ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64), (2006, [1e30] * 64), (2007, [-2.5] * 64)]
    calls = []
    got = vafile.cluster(spark.createDataFrame(rows, VEC), watch=lambda file, a, b: calls.append((file.wanted(a, b).count(), file.count)))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_clusters(rows))
    assert calls and all(few < all_ / 2 for few, all_ in calls[2:])  # most vectors are not fetched


@pytest.mark.parametrize("rows", [[], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(30)], [(i, [float(i % 3)] + [0.0] * 63) for i in range(40)]], ids=["empty", "one", "all alike", "ties"])
def test_clusters_of_few_or_equal_vectors(spark, rows):
    assert Counter(tuple(r) for r in vafile.cluster(spark.createDataFrame(rows, VEC)).collect()) == Counter(plain_clusters(rows))


def test_clusters_take_floats_and_clashing_names(spark):
    rows = [(i, v) for i, v in vectors(4, 40)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "`vec.id` long, embedding array<float>, row int, v int, cluster int")
    exact = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert Counter(tuple(r) for r in vafile.cluster(df, id_col="vec.id").collect()) == Counter(plain_clusters(exact))


def test_intervals_never_name_a_wrong_centroid():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(3000, 16)) * 300).astype(np.int64)
    centroids = x[:6] // 2
    for bits in (1, 3, 7):
        first, last = vafile.cell_bounds(x[::7], x.min(0), x.max(0), bits)
        cells = vafile.cells_of(x, first)
        import pyarrow as pa

        assert (vafile.unpack_cells(pa.array(vafile.pack_cells(cells, bits), pa.binary()), 16, bits) == cells).all()
        assert all((first[d][cells[:, d]] <= x[:, d]).all() and (x[:, d] <= last[d][cells[:, d]]).all() for d in range(16))
        (known,) = vafile.sure(cells.astype(np.int64), [vafile.lookup(first, last, centroids)])
        assert ((known < 0) | (known == vafile.nearest(x, centroids))).all()
    assert (known >= 0).mean() > 0.5


def test_rows_are_put_in_order_over_many_ranges(spark, monkeypatch):
    from guardlake.llm import shared

    monkeypatch.setattr(shared, "ROWS_IN_ORDER", 7)
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(30):02d}", i, rng.randrange(9)) for i in range(200)]
    out = shared.in_order(spark.createDataFrame(rows, "k string, i long, n long"), ["k", "i"], ["n"]).collect()
    before = 0
    for place, (r, want) in enumerate(zip(sorted(out, key=lambda r: r.position), sorted(rows))):
        assert (r.position, r.k, r.i, r.n_before) == (place, *want[:2], before)
        before += r.n
    assert shared.in_order(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_mixing_takes_more_sources_than_one_range_and_broadcast(spark, monkeypatch):
    from guardlake.llm import shared

    monkeypatch.setattr(shared, "ROWS_IN_ORDER", 11)
    monkeypatch.setattr(shared.small, "__defaults__", (3,))
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 9), f"s{rng.randrange(60)}") for i in range(900)]
    check_mix(rows, mixing.mix(mix_rows(spark, rows)).collect())
