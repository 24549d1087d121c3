"""Language ID by language-bitmask n-gram filters.

Each language's frequent n-grams go into one bit-sliced Bloom filter: a slot holds one bit for each
language, so the conjunction of an n-gram's few slots is the mask of all languages that hold it. A text's
masks are counted bit by bit; a language's count is corrected for the false positives that its fill of
the filter leads to, and the largest corrected count decides.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import bounded_share, draw, in_batches, map_text, named, training_row, written

NGRAMS = (3, 4)
#: Documents of each language that training takes, about so many at most: drawn by a hash of the id.
SAMPLE_PER_LANGUAGE = 3_000
#: An n-gram is a language's if this share of its documents hold it, and at least RELATIVE of the share in any other.
MIN_SHARE = 0.01
RELATIVE = 0.1
HASHES = 3
#: Slots of the filter for each n-gram of the language with the most of them: each language has a bit of its own in every slot.
SLOTS_PER_NGRAM = 16
#: Bytes of the filter at most. Beyond it there are fewer slots, so more false positives, which the counts are corrected for.
FILTER_BYTES = 128 << 20
#: So many languages are learnt, those with the most training rows; a bound of the training sample. Texts of others are still predicted.
MAX_LANGUAGES = 4096
SEED = 23
UNKNOWN = "und"
#: Code points that are looked at together; longer texts are taken in parts that overlap by an n-gram.
CHUNK = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(1)
def _letters() -> np.ndarray:
    """1 for letters, 2 for marks, 0 for all else."""
    kinds = {"L": 1, "M": 2}
    return np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def ngram_hashes(text: str, sizes: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, bool]:
    """The hashes of the n-grams of a text's words, with one space at either end of each word; and whether it has a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[points]
    if not (kind == 1).any():
        return np.zeros(0, np.uint64), False
    points = np.concatenate([[0], np.where(kind > 0, points, 0), [0]]).astype(np.uint64)
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    out = []
    for n in sizes:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for i in range(n):
            part = points[i : i + m]
            h = (h * _MIX) ^ part
            if 0 < i < n - 1:
                inside &= part != 0
        h = h[inside] * _MIX2
        out.append(h ^ (h >> np.uint64(29)))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), True


def _chunks(text: str):
    step = CHUNK - max(NGRAMS)
    return (text,) if len(text) <= CHUNK else (text[i : i + CHUNK] for i in range(0, len(text), step))


@dataclass
class Filters:
    languages: list[str]
    prior: list[int]
    slots: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray  # for each language

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """In how many of the n-grams each language's bit is set."""
        masks = None
        for place in places(hashes, len(self.slots)):
            got = self.slots[place.astype(np.int64)]
            masks = got if masks is None else masks & got
        n = len(self.languages)
        if n <= 12:
            by_mask = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << n)
            return np.array([by_mask[(np.arange(1 << n) >> i) & 1 == 1].sum() for i in range(n)], float)
        return np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little").sum(0)[:n].astype(float)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, total, letter = np.zeros(len(self.languages)), 0, False
        if text and self.languages:
            for part in _chunks(text):
                hashes, has = ngram_hashes(part)
                letter |= has
                total += len(hashes)
                if len(hashes):
                    counts += self.counts(hashes)
        if not letter:
            return UNKNOWN, 0.0
        right = np.clip((counts - total * self.false_rate) / (1 - self.false_rate), 0, None)
        if not right.any():
            return self.languages[0], self.prior[0] / max(1, sum(self.prior))
        best = int(right.argmax())
        return self.languages[best], float(right[best] / right.sum())


def slots_for(most: int, languages: int) -> int:
    """A power of two of slots for languages with at most `most` n-grams each, within FILTER_BYTES."""
    wanted = 1 << max(10, int(np.ceil(np.log2(max(1, most) * SLOTS_PER_NGRAM))))
    bound = 1 << int(np.log2(max(1024, FILTER_BYTES // (8 * max(1, -(-languages // 64))))))
    return min(wanted, bound)


def places(hashes: np.ndarray, slots: int):
    top, step, size = hashes >> np.uint64(32), (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1), np.uint64(slots - 1)
    return ((top + np.uint64(i) * step) & size for i in range(HASHES))


def plane(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The bits of one language: one for each slot, packed."""
    bits = np.zeros(slots, bool)
    for place in places(hashes, slots):
        bits[place.astype(np.int64)] = True
    return np.packbits(bits)


def assembled(languages: list[str], prior: list[int], planes: dict[int, np.ndarray], slots: int) -> Filters:
    """Filters from the languages' planes, by number."""
    found = Filters(languages, prior, np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64), np.zeros(len(languages)))
    for i, packed in planes.items():
        bits = np.unpackbits(packed, count=slots)
        found.slots[:, i // 64] |= bits.astype(np.uint64) << np.uint64(i % 64)
        found.false_rate[i] = min(0.9, float(bits.mean()) ** HASHES)
    return found


def build(languages: list[str], prior: list[int], ngrams: list[np.ndarray]) -> Filters:
    """Filters from each language's n-gram hashes; languages come with the most frequent first, which wins ties."""
    slots = slots_for(max(map(len, ngrams), default=0), len(languages))
    return assembled(languages, prior, {i: plane(h, slots) for i, h in enumerate(ngrams)}, slots)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from the training rows with a language, a bounded sample of each language.

    Of more than MAX_LANGUAGES languages those with the most rows are learnt (ties by name). Without any, every prediction is 'und'.
    """
    rows = docs.select(named(id_col).alias("_gl_id"), named(text_col).alias("_gl_text"), named(lang_col).cast("string").alias("_gl_lang"))
    rows = rows.filter(training_row("_gl_id") & F.col("_gl_lang").isNotNull() & F.col("_gl_text").isNotNull())
    sizes = [(-r["n"], r["_gl_lang"]) for r in rows.groupBy("_gl_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_gl_lang").limit(MAX_LANGUAGES).collect()]
    if not sizes:
        return build([], [], [])
    languages, prior = [x for _, x in sizes], [-n for n, _ in sizes]
    limits = docs.sparkSession.createDataFrame([(x, bounded_share(n, sample)) for x, n in zip(languages, prior)], "_gl_lang string, _gl_share double")
    drawn = rows.join(F.broadcast(limits), "_gl_lang").filter(draw("_gl_id", SEED) < F.col("_gl_share"))
    number = {x: i for i, x in enumerate(languages)}
    schema = T.StructType([T.StructField("lang", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(number[lang], []).append(np.unique(np.concatenate([np.unique(ngram_hashes(p)[0]) for p in _chunks(text)])))
            held = held | {-1 - i: [np.array([len(x)], np.uint64)] for i, x in held.items()}  # and how many documents
            for i, parts in held.items():
                if i >= 0:
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i, np.int32)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=schema.names)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int64()), pa.array([int(parts[0][0])], pa.int64())], names=schema.names)

    counts = in_batches(drawn.select("_gl_text", "_gl_lang"), count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at least 1 % of a language's documents hold each n-gram that is kept, so there are at most 100 times a document's n-grams
    counts = written(counts, "ngram-counts")
    docs_of = {-1 - r["lang"]: r["n"] for r in counts.filter("lang < 0").collect()}
    held = docs.sparkSession.createDataFrame([(i, float(max(1, docs_of.get(i, 0)))) for i in range(len(languages))], "lang int, _docs double")
    shares = counts.filter("lang >= 0").join(F.broadcast(held), "lang").withColumn("share", F.col("n") / F.col("_docs"))
    shares = shares.filter(F.col("share") >= MIN_SHARE)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = written(shares.join(most, "gram").filter(F.col("share") >= RELATIVE * F.col("most")).select("lang", "gram"), "ngrams")
    slots = slots_for(kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0, len(languages))

    def bits(key, table):
        return pa.table({"lang": pa.array([key[0].as_py()], pa.int32()), "plane": pa.array([plane(np.asarray(table.column("gram")).view(np.uint64), slots).tobytes()], pa.binary())})

    # a plane has an eighth of a byte a slot, so all of them are no larger than the filter
    planes = {r["lang"]: np.frombuffer(r["plane"], np.uint8) for r in kept.groupBy("lang").applyInArrow(bits, "lang int, plane binary").collect()}
    return assembled(languages, prior, planes, slots)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with `lang_pred` and `score` (the winner's share of corrected counts, 0 to 1).

    Null and empty texts, and texts without letters, are 'und' with score 0. A text with letters of which no
    n-gram is known is of the most frequent language, with its share as score. Ties go to the more frequent
    language. Columns of docs named lang_pred or score are replaced. An empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        return lambda texts: [list(x) for x in zip(*map(held.value.predict, texts))] or [[], []]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, [text_col], make, fields, list(docs.columns) if keep is None else keep)
