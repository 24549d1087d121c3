"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the longest one met so far and one more code point. The set
of phrases stands for what a compressor would learn from the text, so two texts that share phrases would
compress well together. Phrases are hashed, and a minimum-hash signature of the set (one hash, its range
cut into bins, the least of each bin kept) is the fingerprint; the share of equal bins estimates the
Jaccard similarity of the phrase sets.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import draw, map_text, named

BINS = 64
#: Ids drawn for each cut of ids that are texts.
IDS_PER_CUT, SEED = 20, 71
#: Hex digits of a bin.
DIGITS = 4


def phrases(text: str) -> set[str]:
    """The LZ78 phrases of a text; what is left at its end may repeat one."""
    known: set[str] = set()
    add, phrase = known.add, ""
    for point in text:
        phrase += point
        if phrase not in known:
            add(phrase)
            phrase = ""
    return known


def phrase_hashes(text: str) -> np.ndarray:
    """Sorted hashes of the phrases of a text."""
    found = phrases(text)
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def fingerprint(text: str | None, bins: int = BINS) -> str:
    """Hex of the least phrase hash in each bin; empty bins take from the next full one. '' for a text without phrases."""
    hashes = phrase_hashes(text or "")
    if not len(hashes):
        return ""
    which = (hashes % np.uint64(bins)).astype(np.int64)
    values = np.full(bins, -1, np.int64)
    # sorted ascending, so the last written in descending order is the least
    values[which[::-1]] = ((hashes // np.uint64(bins)) % np.uint64(16**DIGITS))[::-1].astype(np.int64)
    if (values < 0).any():
        full = np.flatnonzero(values >= 0)
        empty = np.flatnonzero(values < 0)
        at = np.searchsorted(full, empty) % len(full)
        gap = (full[at] - empty) % bins
        values[empty] = (values[full[at]] * 31 + gap * 977 + 7) % 16**DIGITS
    return values.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal bins; 1 for two texts without phrases, 0 for one with and one without."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """The columns `keep` of docs (all by default) with the fingerprint of each text. Null is as empty; equal texts have equal ones."""
    make = lambda: lambda texts: [[fingerprint(t) for t in texts]]
    return map_text(docs, [text_col], make, [T.StructField(name, T.StringType())], list(docs.columns) if keep is None else keep)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, packed, fingerprint, next_packed, next_fingerprint: with those of the next document by descending id; after the last comes the first.

    packed is the text in UTF-8, compressed, as it is shuffled.

    Ids that are no whole numbers go by their text, in order of code points. Ids are cut into about the square root of their number of ranges, each sorted on its own; the first row of each
    range is also sent to the range before it, where it follows the last. Null ids come last; rows of one id are
    put in order by fingerprint and text. Null texts are empty.
    """
    kind = "long" if isinstance(docs.select(named(id_col)).schema[0].dataType, T.IntegralType) else "string"
    key_of = F.coalesce(named(id_col).cast(kind), F.lit(-(2**63) if kind == "long" else "").cast(kind))
    ids = docs.select(key_of.alias("key"))
    total = ids.count()
    per_range = max(1, math.isqrt(total) // 2)
    n_cuts = total // per_range if total else 0
    if kind == "long":
        cuts = sorted({int(x) for x in ids.approxQuantile("key", [i / (n_cuts + 1) for i in range(1, n_cuts + 1)], 0.2 * per_range / max(1, total))}) if total else []
    else:  # of a sample of IDS_PER_CUT ids for each cut, every so many-th
        drawn = ids.filter(draw("key", SEED) < min(1.0, IDS_PER_CUT * (n_cuts + 1) / max(1, total))).distinct().orderBy("key").collect()
        cuts = sorted({drawn[i * len(drawn) // (n_cuts + 1)]["key"] for i in range(1, n_cuts + 1)}) if drawn else []
    held = docs.sparkSession.sparkContext.broadcast(cuts)

    def ranges(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bisect_left(held.value, k) for k in batch.column(0).to_pylist()], pa.int64())], names=["key", "range"])

    heads = {r["range"]: r["head"] for r in ids.mapInArrow(ranges, f"key {kind}, range long").groupBy("range").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    goes_to = {heads[r]: order[i - 1] for i, r in enumerate(order)}  # order[-1] before the first: the ring closes
    held_to = docs.sparkSession.sparkContext.broadcast(goes_to)

    def make():
        def of(keys, texts):
            cuts, to, pack = held.value, held_to.value, zstandard.ZstdCompressor(level=1).compress
            out = [[], [], []]
            for key, text in zip(keys, texts):
                text = text or ""
                own = bisect_left(cuts, key)
                out[0].append([{"range": own, "guest": False}, *([{"range": to[key], "guest": True}] if key in to else [])])
                out[1].append(pack(text.encode("utf-8", "surrogatepass")))
                out[2].append(fingerprint(text))
            return out

        return of

    place = T.StructType([T.StructField("range", T.LongType()), T.StructField("guest", T.BooleanType())])
    fields = [T.StructField("places", T.ArrayType(place)), T.StructField("packed", T.BinaryType()), T.StructField("fingerprint", T.StringType())]
    source = docs.select(named(id_col).alias("id"), key_of.alias("key"), named(text_col).alias("_gl_text"))
    placed = map_text(source, ["key", "_gl_text"], make, fields, ["id", "key"]).withColumn("place", F.explode("places"))
    window = Window.partitionBy("place.range").orderBy("place.guest", F.desc("key"), "fingerprint", "packed")
    following = placed.select("id", "packed", "fingerprint", "place", F.lead(F.struct("packed", "fingerprint")).over(window).alias("next"))
    return following.filter("not place.guest").select("id", "packed", "fingerprint", F.col("next.packed").alias("next_packed"), F.col("next.fingerprint").alias("next_fingerprint"))


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    A table of one row is its own next. An empty table gives none.
    """
    fields = [
        T.StructField("n_chars", T.LongType()), T.StructField("edited_text", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ]

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def of(packed, prints, next_packed, next_prints):
            texts, heads = ([unpack(x).decode("utf-8", "surrogatepass") for x in column] for column in (packed, next_packed))
            changed = [edited(t, h) for t, h in zip(texts, heads)]
            new = [fingerprint(t) for t in changed]
            return [[len(t) for t in texts], changed, new, [likeness(a, b) for a, b in zip(prints, new)], [likeness(a, b) for a, b in zip(prints, next_prints)]]

        return of

    rows = neighbours(docs, id_col, text_col)
    out = map_text(rows, ["packed", "fingerprint", "next_packed", "next_fingerprint"], make, fields, ["id", "fingerprint"])
    return out.withColumnRenamed("id", id_col)
