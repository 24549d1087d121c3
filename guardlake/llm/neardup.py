"""Near-duplicate classes by DartMinHash, banding and exact verification.

A text is the set of its shingles of five words. Darts are thrown at each element's region, as wide as
its weight, by hashing (element, cell); a dart's rank is its height, and every coordinate of the signature
keeps the earliest dart that falls to it. Two sets agree in a coordinate with the probability of their
(weighted) Jaccard similarity. Links are defined by the plain similarity of sets, so weights are 1 here.

Texts with equal shingle sets are one node from the start. Nodes that agree in a whole band of coordinates
share a bucket, and each node is compared with its buckets' smallest nodes, never all with all. Most buckets
are then one component and done. The nodes of the others, which often share a passage but are not alike,
are told apart by prefixes: of two sets with a similarity of 0.8 each has an element of the other among its
rarest fifth, in any order of elements that is the same for all. Nodes that share such an element and are
of different components are compared: a drawn share of them leads first, then more, until no uncompared pair of
different components is left. So no link between different texts that share a bucket is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import draw, in_batches, map_text, named, small, written
from guardlake.llm.words import folded_words

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: Ids of nodes, and elements or nodes with the number of a component, are broadcast up to this many rows; beyond it they are joined.
MAX_BROADCAST_IDS = 1_000_000
#: Of the nodes that must be compared with their tokens' others, so large a share leads first, then GROWTH times as many;
#: what has come together meanwhile need not be compared. Up to FEW rows all lead at once.
FIRST_SHARE, GROWTH, FEW = 1 / 64, 4, 2_000
#: Leaders whose sets a task holds at a time, and partners that it compares with them: a larger group of pairs is cut into such tiles.
LEADERS, PARTNERS = 256, 1024
SEED = 53
#: Tables of links and buckets are read with so many rows a task; those that fit one task need no shuffle.
ROWS_PER_TASK = 200_000
#: Cells in which elements are counted to put the rarest first.
CELLS = 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; a text of fewer words, but not none, has one of all."""
    found = folded_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(each))
    out = np.full(len(each) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _A + each[i : len(each) - n + 1 + i])
    return np.unique(out)


#: Weights from 2**-BELOW up have regions of their own; what lies below is one region.
BELOW = 20


def _darts(elements: np.ndarray, weights: np.ndarray | None, height: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank and hash of all darts below `height` that fall into the elements' regions.

    The half-plane of each element is cut into cells of area 1 with a dart each: between the weights 2**k and 2**(k+1)
    they are 2**k wide and 2**-k high. A dart counts if it lies left of the element's weight. So the darts looked at
    are about as many as the area has, whatever the weights are.
    """
    if weights is None:  # one cell for each strip of the unit weight, and all of it inside
        strips = np.arange(int(np.ceil(height)), dtype=np.uint64)
        cells = _mix(elements[:, None] + (strips[None, :] + np.uint64(1)) * _A)
        rank = strips[None, :] + (cells >> np.uint64(11)) / float(1 << 53)
        return rank[rank < height], cells[rank < height]
    ranks, hashes = [], []
    for k in range(-BELOW, int(np.ceil(np.log2(weights.max()))) + 1):
        low, wide = (0.0 if k == -BELOW else 2.0**k), (2.0 ** (k + 1) if k == -BELOW else 2.0**k)
        own = weights > low
        rows = np.arange(int(np.ceil(height * wide)), dtype=np.uint64)
        if not own.any() or not len(rows):
            continue
        cells = _mix(_mix(elements[own] ^ np.uint64((k + BELOW + 1) * int(_B) % 2**64))[:, None] + (rows[None, :] + np.uint64(1)) * _A)
        rank = (rows[None, :] + (cells >> np.uint64(11)) / float(1 << 53)) / wide
        right = low + wide * ((_mix(cells ^ _C) >> np.uint64(11)) / float(1 << 53))
        inside = (rank < height) & (right < weights[own][:, None])
        ranks.append(rank[inside])
        hashes.append(cells[inside])
    return np.concatenate(ranks), np.concatenate(hashes)


def dart_signature(elements: np.ndarray, weights: np.ndarray | None = None, size: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of each coordinate, for a set of element hashes with positive weights (1 each if none are given)."""
    total = float(len(elements)) if weights is None else float(weights.sum())
    darts = size * (np.log(size) + 4)
    while True:
        rank, cells = _darts(elements, weights, darts / total)
        place = (_mix(cells ^ _A) % np.uint64(size)).astype(np.int64)
        order = np.argsort(rank, kind="stable")[::-1]
        signature, hit = np.zeros(size, np.uint64), np.zeros(size, bool)
        signature[place[order]] = cells[order]
        hit[place] = True
        if hit.all():
            return signature
        darts *= 2


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature.reshape(bands, rows).T:
        out = _mix(out * _A + column)
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, words: int) -> DataFrame:
    """id, d1, d2 (digest of the shingle set, or of a text without words), n (shingles), bands, for each row with a text."""

    def make():
        def of(texts):
            d1, d2, n, hashes = [], [], [], []
            for text in texts:
                found = shingles(text, words)
                raw = found.tobytes() if len(found) else b"\x00" + (text or "").encode("utf-8", "surrogatepass")
                a, b = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()
                d1.append(a)
                d2.append(b)
                n.append(len(found))
                hashes.append(band_hashes(dart_signature(found, None, bands * rows), bands, rows) if len(found) else np.zeros(0, np.int64))
            return [d1, d2, n, hashes]

        return of

    fields = [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    rows_ = docs.filter(named(text_col).isNotNull() & named(id_col).isNotNull()).select(named(id_col).alias("id"), named(text_col).alias("_gl_text"))
    return map_text(rows_, ["_gl_text"], make, fields, ["id"])


def tiles(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, near) with the columns x and y: of the leaders (b) of one `near` about LEADERS share an x, of the partners (a) about PARTNERS a y."""
    many = pairs.groupBy("near").agg(F.count_distinct("b").alias("x"), F.count_distinct("a").alias("y"))
    part = lambda node, name, most: F.pmod(F.xxhash64(node), F.ceil(F.col(name) / most)).cast("int")
    return pairs.join(many, "near").select("near", part("b", "x", LEADERS).alias("x"), part("a", "y", PARTNERS).alias("y"), "a", "b")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """The pairs (a, b) whose texts are alike by the threshold, exactly; each of (a, b, near) is given once.

    Pairs of one `near` have many texts in common. They are dealt in tiles, to which each text goes once, not once a pair:
    a tile's leaders (b) come first and are held as sets, then come its partners, each with the leaders to compare it with.
    The pairs are written first: if they are few they go to the texts, and only the texts that a pair names are moved.
    """
    dealt = sized(tiles(sized(pairs, "pairs")), "tiles")
    tile = ["near", "x", "y"]
    partners = dealt.groupBy(*tile, F.col("a").alias("node")).agg(F.collect_list("b").alias("leaders"))
    leaders = dealt.select(*tile, F.col("b").alias("node")).distinct().withColumn("leaders", F.lit(None).cast(partners.schema["leaders"].dataType))
    ask = sized(partners.unionByName(leaders), "asked")
    near = 2 * dealt.count() <= MAX_BROADCAST_IDS  # so many rows at most, and half as many ids in their lists
    both = (F.broadcast(ask) if near else ask).join(texts, "node").withColumn("turn", F.col("leaders").isNotNull()).repartition(*tile).sortWithinPartitions(*tile, "turn")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches):
        held, last = {}, True
        for batch in batches:
            a, b = [], []
            for node, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if asked is None:
                    if last:  # a new tile
                        held = {}
                    held[node] = shingles(text, words)
                else:
                    found = shingles(text, words)
                    alike = [x for x in asked if similarity(found, held[x]) >= threshold]
                    a += [node] * len(alike)
                    b += alike
                last = asked is not None
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return in_batches(both.select("node", "text", "leaders"), run, schema)


def sized(df: DataFrame, name: str) -> DataFrame:
    """df, written, and read in tasks of ROWS_PER_TASK rows."""
    out = written(df, name)
    return out.coalesce(max(1, -(-out.count() // ROWS_PER_TASK)))


def few(df: DataFrame) -> DataFrame:
    """A written table of numbers, broadcast if it has at most MAX_BROADCAST_IDS rows, which are counted."""
    return small(df, MAX_BROADCAST_IDS)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, comp (the smallest node that it is linked with) of every node with an edge (a, b).

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked with the smallest,
    until nothing changes; a number of rounds that grows with the logarithm of the longest path.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = sized(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(edges.rdd.getNumPartitions())
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = sized(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = sized(small.coalesce(large.rdd.getNumPartitions()).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots).select(F.col("node").cast(kind), F.col("comp").cast(kind))


def element_counts(texts: DataFrame, words: int) -> np.ndarray:
    """In CELLS cells, how many elements of the texts' shingle sets fall to each: a bounded sketch of how common they are."""

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(cells, (shingles(text, words) % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    found = in_batches(texts.select("text"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[found.cell.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return out


def prefix(elements: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest elements, so many that a set with similarity `threshold` has one of them in its own prefix."""
    n = len(elements) - math.ceil(threshold * len(elements) - 1e-9) + 1
    return elements[np.lexsort((elements, counts[(elements % np.uint64(CELLS)).astype(np.int64)]))[:n]]


def prefixes(texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """node, n, pos, token, ahead (the token just ahead of it, if any) of each text's prefix, the rarest at position 0."""
    held = texts.sparkSession.sparkContext.broadcast(element_counts(texts, words))

    def make():
        def of(column):
            sets = [shingles(t, words) for t in column]
            return [[len(x) for x in sets], [prefix(x, held.value, threshold).view(np.int64) for x in sets]]

        return of

    fields = [T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    found = map_text(texts, ["text"], make, fields, ["node"]).select("node", "n", "tokens", F.posexplode("tokens").alias("pos", "token"))
    return found.select("node", "n", "pos", "token", F.get("tokens", F.col("pos") - 1).alias("ahead"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id_col, class_id (the smallest id of the class) and copy_of (the smallest id with the same shingle set), a row for each row.

    Two texts are linked if the Jaccard similarity of their shingle sets is `threshold` or more; classes are
    the linked components. A link of exactly 0.8 shares a bucket with probability 0.9999 (24 bands of 5).
    Texts without words are in a class only with their exact copies. Null texts are in no class but their
    own. Rows with the same id are one document. Rows with a null id have a null class. An empty table
    gives none. Extra columns are left out, so their names cannot clash.
    """
    sig = written(signatures(docs, id_col, text_col, bands, rows, words), "signatures")
    copies = written(sig.groupBy("d1", "d2").agg(F.min("id").alias("node")), "copies")
    nodes = sig.filter("n > 0").join(copies.select(F.col("node").alias("id")), "id", "left_semi")
    # dealt by bucket once, for the buckets' first nodes and for their members
    spread = nodes.select(F.col("id").alias("node"), "n", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = spread.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")).filter("first.node < last")
    members = sized(spread.join(shared.select("bucket", "first"), "bucket"), "buckets")

    # two sets whose first common element is at these positions share at most what is left from there on
    reach = lambda m, i, n, j: F.least(m - i, n - j) >= threshold / (1 + threshold) * (m + n) - 1e-6
    close = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)  # noqa: E731  no similarity is larger than the ratio of the sizes
    pairs = members.filter((F.col("node") != F.col("first.node")) & close(F.col("n"), F.col("first.n"))).select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct().withColumn("near", F.xxhash64("b"))
    texts = written(texts_of(docs, members.select("node").distinct(), id_col, text_col), "candidate-texts")
    comps = sized(components(sized(verified(pairs, texts, threshold, words), "links")), "classes")

    in_comp = members.join(comps, "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = in_comp.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo <> hi and size > 2").select("bucket")
    unsure = sized(in_comp.join(mixed, "bucket", "left_semi").select("node").distinct(), "unsure")
    state = None
    if not unsure.isEmpty():
        texts = written(texts.join(few(unsure), "node", "left_semi"), "unsure-texts")
        state = written(prefixes(texts, threshold, words), "prefixes")
        # the smaller set of a pair has the element among its rarest ninth
        early = F.max(F.col("pos") <= F.col("n") * (1 - 2 * threshold / (1 + threshold)) + 1e-6)
        several = state.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), early.alias("early")).filter("lo <> hi and early").select("token")
        state = sized(state.join(several, "token", "left_semi").withColumn("turned", F.lit(False)), "prefixes")
    share = FIRST_SHARE
    while state is not None:
        now = state.join(few(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        main = now.groupBy("token", "comp").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
        now = sized(now.join(few(sized(main.select("token", "main"), "main")), "token"), "mixed")
        asks = ~F.col("turned") & (F.col("comp") != F.col("main"))
        waiting = now.filter(asks).count()
        if not waiting:
            break
        leads = asks & (draw("node", SEED) < share) if waiting > FEW and share < 1 else asks
        now = now.withColumn("leads", leads)
        turn = now.filter("leads").select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("ahead").alias("ahead_b"), F.col("comp").alias("comp_b"))
        # a pair that also has the element just ahead in common is compared at its first common one, which has none ahead
        pairs = now.filter("not turned").join(turn, "token").filter(~F.coalesce(F.col("ahead") == F.col("ahead_b"), F.lit(False)) & (F.col("comp") != F.col("comp_b")) & (~F.col("leads") | (F.col("node") > F.col("b"))) & reach(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b")))
        more = sized(verified(pairs.groupBy(F.col("node").alias("a"), "b").agg(F.min("token").alias("near")), texts, threshold, words), "links")
        state = sized(now.select("token", "node", "n", "pos", "ahead", (F.col("turned") | F.col("leads")).alias("turned")), "prefixes")
        if not more.isEmpty():
            comps = sized(components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)), "classes")
        share *= GROWTH

    classed = sig.join(copies, ["d1", "d2"]).select("id", "node").join(comps, "node", "left").select("id", F.coalesce("comp", "node").alias("class"), "node")
    rest = docs.filter(named(text_col).isNull() | named(id_col).isNull()).select(named(id_col).alias("id"), named(id_col).alias("class"), named(id_col).alias("node"))
    out = classed.unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("class").alias("class_id"), F.col("node").alias("copy_of"))


def texts_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and text of the documents whose ids are in nodes; the ids are broadcast if there are few."""
    ids = nodes.select(F.col("node").alias("id"))
    few = ids.count() <= MAX_BROADCAST_IDS
    rows = docs.filter(named(text_col).isNotNull()).select(named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").select(F.col("id").alias("node"), "text")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stand for their class: the one with the smallest id; rows with a null id all stay."""
    stay = classes.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("_gl_id")).distinct()
    kept = docs.join(stay, named(id_col).eqNullSafe(F.col("_gl_id")), "left_semi")
    ids = classes.filter(F.col(id_col).isNotNull())
    if ids.count() != ids.select(id_col).distinct().count():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.filter(named(id_col).isNull()))
