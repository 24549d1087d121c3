"""Source divergence audit: how unlike the words of sources of one language are, pair by pair and word by word.

Words are counted by length. A word of up to eight bytes is one uint64, one of up to sixteen is two: bytes from the
top, so that numbers sort as bytes do. Each batch of texts is cut, packed, radix-sorted (16 bits at a time) and
run-counted in numpy; longer words go to a byte-sorted bucket for each length. Tasks add up what they
counted before they send it, and Spark adds up the rest by the packed words.

Pairs of sources are compared in blocks: a block holds some of a language's words, and for a tile of sources their
scaled shares as one matrix. Words that a source lacks have one share for all, so they are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import in_batches, named, small, written

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Bytes of text that are cut at once (or one whole text), and counted words that a task holds before it sends them.
SLICE_BYTES, HELD_WORDS = 4_000_000, 400_000
#: Words of a block, about, and sources of a tile.
BLOCK_TERMS, TILE = 4096, 64

#: Bytes of words, folded; 0 for those that are in none.
_WORD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)
_KEY = ["w1", "w2", "rest"]
_COUNTS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()),
    T.StructField("rest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType()),
])


def radix_order(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """`order` put in order of the uint64 `keys`, stably, 16 bits at a time from the lowest."""
    for shift in range(0, 64, 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, skip: int = 0) -> np.ndarray:
    """Bytes skip to skip + 8 of each word as a uint64, the first on top, zeros after its end."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(skip, skip + 8):
        at = np.minimum(starts + i, len(data) - 1)
        out = (out << np.uint64(8)) | np.where(i < lengths, data[at], 0).astype(np.uint64)
    return out


def runs(columns: list[np.ndarray], order: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: where each run of equal columns begins, its length and its number of different docs."""
    if not len(order):
        return order, order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    docs = docs[order]
    other = new.copy()
    other[1:] |= docs[1:] != docs[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other.astype(np.int64), at)


class Counter:
    """Counts words by group (a number) in slices, and adds slices up."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []  # group, w1, w2, n, docs of short words
        self.size = 0
        self.long: list[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> None:
        """Words of texts that stand one after another in data."""
        data = _WORD[data]
        inside = data != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = inside[inner]  # a text's first word begins anew
        last[inner - 1] = inside[inner - 1]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - starts
        if not len(starts):
            return
        docs = np.searchsorted(offsets, starts, side="right") - 1
        group = groups[docs]
        by_group = np.argsort(group.astype(np.uint16) if group.max() < 65536 else group, kind="stable")
        for least, most in ((1, 8), (9, 16)):
            own = by_group[(lengths[by_group] >= least) & (lengths[by_group] <= most)]
            if not len(own):
                continue
            s, n, g, d = starts[own], lengths[own], group[own], docs[own]
            w1, w2 = packed(data, s, n), packed(data, s, n, 8) if most > 8 else np.zeros(len(own), np.uint64)
            order = np.arange(len(own))
            order = radix_order(radix_order(order, w2) if most > 8 else order, w1)
            at, count, seen = runs([w1, w2, g], order, d)
            self.held.append((g[at], w1[at], w2[at], count, seen))
            self.size += len(at)
        for length in np.unique(lengths[lengths > 16]).tolist():
            own = by_group[lengths[by_group] == length]
            words = np.array([data[a : a + length].tobytes() for a in starts[own].tolist()], dtype=f"S{length}")
            at, count, seen = runs([words, group[own]], np.argsort(words, kind="stable"), docs[own])
            self.long.append((group[own][at], words[at].tolist(), count, seen))
            self.size += len(at)
        if self.size > HELD_WORDS:
            self._join()

    def _join(self) -> None:
        """Adds up the short words of all slices held."""
        if len(self.held) > 1:
            g, w1, w2, n, seen = (np.concatenate(c) for c in zip(*self.held))
            order = radix_order(radix_order(radix_order(np.arange(len(g)), g.astype(np.uint64)), w2), w1)
            at, _, _ = runs([w1, w2, g], order, g)
            new = np.flatnonzero(np.isin(order, at, assume_unique=True))
            self.held = [(g[at], w1[at], w2[at], np.add.reduceat(n[order], new), np.add.reduceat(seen[order], new))]
        self.size = sum(len(x[0]) for x in self.held) + sum(len(x[1]) for x in self.long)

    def take(self):
        """What is held, as (group, w1, w2, rest, n, docs), which then is empty."""
        self._join()
        for g, w1, w2, n, seen in self.held:
            yield g, w1, w2, None, n, seen
        for g, words, n, seen in self.long:
            yield g, np.zeros(len(g), np.uint64), np.zeros(len(g), np.uint64), words, n, seen
        self.held, self.long, self.size = [], [], 0


def _slices(offsets: np.ndarray):
    """Ranges of texts of about SLICE_BYTES bytes, one text at least."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, end
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, the packed word (w1, w2, or rest if it is longer than 16 bytes), n and docs: how often it stands in
    the group's texts, and in how many of them."""

    def count(batches):
        counter, number = Counter(), {}

        def out():
            names = list(number)
            for g, w1, w2, rest, n, seen in counter.take():
                lang, source = ([names[i][k] for i in range(len(names))] for k in (0, 1))
                columns = [pa.array(lang, pa.string()).take(pa.array(g)), pa.array(source, pa.string()).take(pa.array(g)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))]
                columns += [pa.array(rest if rest is not None else [b""] * len(g), pa.binary()), pa.array(n.astype(np.int64)), pa.array(seen)]
                yield pa.RecordBatch.from_arrays(columns, names=_COUNTS.names)

        for batch in batches:
            groups = np.array([number.setdefault(x, len(number)) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], np.int64)
            texts = batch.column(0).cast(pa.large_binary())
            raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            for a, b in _slices(offsets):
                if offsets[b] > offsets[a]:
                    counter.add(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], groups[a:b])
                if counter.size > HELD_WORDS:
                    yield from out()
        yield from out()

    blank = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    rows = in_batches(docs.select(blank(text_col), blank(lang_col), blank(source_col)), count, _COUNTS)
    return rows.groupBy("lang", "source", *_KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term() -> Column:
    """The word that w1, w2 and rest stand for."""
    short = F.unhex(F.concat(F.hex("w1"), F.when(F.col("w2") != 0, F.hex("w2")).otherwise(F.lit("")))).cast("string")
    return F.when(F.col("w1") == 0, F.col("rest").cast("string")).otherwise(F.rtrim(short, F.lit("\0")))


def share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / whole), exactly; null if whole is 0."""
    exact = (F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(18,0)")).alias("x")
    return F.when(whole > 0, 1 + F.call_function("div", exact, whole.cast("decimal(18,0)")))


def pair_sums(tiles: DataFrame) -> DataFrame:
    """lang, a, b, value: for each two sources (numbers a < b) of a tile, the sum over the tile's words of floor((p-q)^2/(p+q)).

    tiles has lang, block, ta, tb, g (source), no (word, or -1 for the row that every source has: with p, the share of words that it
    lacks, and terms, the block's number of words) and p.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("value", T.LongType())])

    def compare(key, table):
        lang, _, ta, tb = (k.as_py() for k in key)
        g, no, p, terms = (table.column(c).to_numpy() for c in ("g", "no", "p", "terms"))
        head = no < 0
        sources = np.sort(g[head])
        lacking = np.zeros(len(sources), np.int64)
        lacking[np.searchsorted(sources, g[head])] = p[head]
        words, place = np.unique(no[~head], return_inverse=True)
        shares = np.repeat(lacking[:, None], len(words), axis=1)
        shares[np.searchsorted(sources, g[~head]), place] = p[~head]
        absent = (int(terms[head].max()) if head.any() else 0) - len(words)
        out_a, out_b, value = [], [], []
        for i in range(len(sources)):
            if sources[i] // TILE != ta:
                continue
            others = np.arange(i + 1, len(sources))
            others = others[sources[others] // TILE == tb]
            if not len(others):
                continue
            q = shares[others]
            sums = ((shares[i] - q) ** 2 // (shares[i] + q)).sum(1) if len(words) else np.zeros(len(others), np.int64)
            if absent:
                sums = sums + absent * ((lacking[i] - lacking[others]) ** 2 // (lacking[i] + lacking[others]))
            out_a += [sources[i]] * len(others)
            out_b += sources[others].tolist()
            value += sums.tolist()
        return pa.table([pa.array([lang] * len(value), pa.string()), pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(value, pa.int64())], names=schema.names)

    return tiles.groupBy("lang", "block", "ta", "tb").applyInArrow(compare, schema).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Null texts, languages and sources are empty. Words are runs of A-Z, a-z and anything beyond U+007F, A-Z lower-cased; a
    language keeps those in at least min_docs of its rows. A group's share of a word is p = 1 + floor(10^9 (n + 2) / (N + 2 V)): n its
    occurrences, N those of all V kept words. Two shares differ by floor((p - q)^2 / (p + q)). Part `pair` has a row for each other source
    of the language, with the sum of this over all kept words; part `term` the `top` words that the group has more of than its
    language, by this. Ranks go by value, largest first, then item. Rows with equal ids count as documents of their own. A language without kept words has
    pairs of value 0. An empty table gives none. Extra columns are not looked at.
    """
    blank = lambda c, name: F.coalesce(named(c).cast("string"), F.lit("")).alias(name)
    counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = written(counts.groupBy("lang", *_KEY).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    pairs_of = docs.select(blank(lang_col, "lang"), blank(source_col, "source")).distinct()
    stats = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = written(pairs_of.groupBy("lang").agg(F.count("*").alias("sources")).join(stats, "lang", "left").na.fill(0, ["v", "lang_total"]), "term-languages")
    size = F.floor(F.col("v") / BLOCK_TERMS) + 1

    in_block = Window.partitionBy("lang", "block").orderBy(*_KEY)
    placed = kept.join(small(langs), "lang").withColumn("block", F.pmod(F.xxhash64(*_KEY), size)).withColumn("no", (F.row_number().over(in_block) - 1).cast("long"))
    placed = written(placed.withColumn("q", share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v"))).select("lang", *_KEY, "block", "no", "q", "v"), "placed-terms")
    hits = written(counts.select("lang", "source", *_KEY, "n").join(placed, ["lang", *_KEY]), "term-hits")

    groups = pairs_of.join(hits.groupBy("lang", "source").agg(F.sum("n").alias("whole")), ["lang", "source"], "left").join(small(langs), "lang")
    groups = groups.withColumns({"whole": F.coalesce("whole", F.lit(0)) + 2 * F.col("v"), "g": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"), "tiles": F.floor((F.col("sources") - 1) / TILE)})
    groups = written(groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("whole")), F.lit(1))), "term-groups")
    shares = hits.join(small(groups.select("lang", "source", "g", "tiles", "whole")), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("whole")))
    differ = F.expr("((p - q) * (p - q)) div (p + q)")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), term().alias("item"), differ.alias("value"))
    terms = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    in_blocks = placed.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    blocks = langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("block")).join(in_blocks, ["lang", "block"], "left").na.fill(0, ["terms"])
    heads = groups.join(small(written(blocks, "term-blocks")), "lang").select("lang", "block", "g", F.lit(-1).cast("long").alias("no"), F.col("p0").alias("p"), "tiles", "terms")
    rows = heads.unionByName(shares.select("lang", "block", "g", "no", "p", "tiles", F.lit(0).cast("long").alias("terms")))
    tile = F.floor(F.col("g") / TILE)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "tiles"))).withColumns({"ta": F.least(tile, "other"), "tb": F.greatest(tile, "other")})
    sums = written(pair_sums(rows.select("lang", "block", "ta", "tb", "g", "no", "p", "terms")), "pair-sums")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda c, to: small(groups.select("lang", F.col("g").alias(c), F.col("source").alias(to)))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
