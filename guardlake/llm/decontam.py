"""Benchmark decontamination by one Aho-Corasick automaton over the items' words.

An item's windows are its runs of ten consecutive words; an item of fewer words, but not none, is one window.
Texts and items are folded alike. Every window holds a whole block of five words that begins at a multiple of
five in its item, so the automaton's keys are these blocks (and the short items), as sequences of word numbers:
about a tenth of what all windows would take. Each text is scanned once; where a block occurs, item and text are
compared to both sides, and a common run of ten words or more is what all windows inside it cover. Many items may share a block, as
tests do whose questions begin alike: then no place is walked, but the text's few windows around the block are looked up
among the windows of the items there. Hits are kept as word intervals and as code-point spans of the original text.
"""

from __future__ import annotations

import pickle
import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import map_text, named, unpacked, written
from guardlake.llm.words import WORD, folded_words

WINDOW = 10
#: A block at more places than this has its windows looked up instead of each place compared.
FEW_PLACES = 4
#: Items of up to so many bytes make one automaton, of about 160 MB broadcast and 350 MB in a Python process; only a larger
#: benchmark is scanned for in several passes.
MAX_AUTOMATON_BYTES = 8_000_000

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(_SPAN)),
    T.StructField("hit_spans", T.ArrayType(_SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


#: A word number is written in DIGITS digits of this base. Digits of each place have code points of their own, so that no
#: match begins inside a word; a node of the automaton has few children, which it looks through one by one.
BASE, DIGITS = 64, 4
_UNKNOWN = chr(BASE * DIGITS) * DIGITS


def _spelt(number: int) -> str:
    return "".join(chr(BASE * place + number // BASE**place % BASE) for place in range(DIGITS))


class Matcher:
    """The automaton of a collection of items, and what it takes to extend its hits."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.block = window, max(1, window // 2)
        self.spelt: dict[bytes, str] = {}
        alike: dict[str, list[str]] = {}
        for name, text in items:
            words = "".join([self.spelt.get(w) or self.spelt.setdefault(w, _spelt(len(self.spelt))) for w in folded_words(text)])
            if words:
                alike.setdefault(words, []).append(name)
        self.texts = list(alike)
        self.names = [sorted(set(x)) for x in alike.values()]
        keys: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(self.texts):
            n = len(words) // DIGITS
            if n < window:
                keys.setdefault(words, []).append((i, -1))
            else:
                for at in range(0, n - self.block + 1, self.block):
                    keys.setdefault(words[at * DIGITS : (at + self.block) * DIGITS], []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        self.around: dict[str, list[int]] = {}  # a window that holds a frequent block: the items with it
        for key, places in keys.items():
            whole = [p for p in places if p[1] < 0]
            blocks = [p for p in places if p[1] >= 0]
            if len(blocks) > FEW_PLACES:
                for item, at in blocks:
                    text = self.texts[item]
                    for first in range(max(0, at + self.block - window), min(at, len(text) // DIGITS - window) + 1):
                        self.around.setdefault(text[first * DIGITS : (first + window) * DIGITS], []).append(item)
                whole.append((-1, 0))
            else:
                whole += blocks
            self.automaton.add_word(key, (len(key) // DIGITS, whole))
        self.around = {w: sorted(set(items)) for w, items in self.around.items()}
        if keys:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Intervals of words that windows cover, not merged, and the numbers of the items whose windows occur."""
        intervals, hit = [], set()
        if not words or not len(self.automaton):
            return intervals, hit
        get = self.spelt.get
        doc = "".join([get(w, _UNKNOWN) for w in words])
        n, seen = len(words), {}  # by item and diagonal: where the last common run ended
        looked, found = -1, set()  # the first window after those looked up; windows that were found
        for end, (size, places) in self.automaton.iter(doc):
            first = end // DIGITS - size + 1
            for item, at in places:
                if at < 0:
                    intervals.append((first, first + size))
                    hit.add(item)
                    continue
                if item < 0:
                    for at in range(max(0, first + size - self.window, looked), min(first, n - self.window) + 1):
                        window = doc[at * DIGITS : (at + self.window) * DIGITS]
                        if window in self.around:
                            intervals.append((at, at + self.window))
                            found.add(window)
                        looked = at + 1
                    continue
                if seen.get((item, first - at), -1) >= first:
                    continue  # this block lies in a run that has been measured
                text = self.texts[item]
                a, b = 0, size
                while a < min(first, at) and _same(text, at - a - 1, doc, first - a - 1):
                    a += 1
                m = len(text) // DIGITS
                while first + b < n and at + b < m and _same(text, at + b, doc, first + b):
                    b += 1
                seen[(item, first - at)] = first + b - 1
                if a + b >= self.window:
                    intervals.append((first - a, first + b))
                    hit.add(item)
        return intervals, hit.union(*map(self.around.get, found))


def _same(a: str, i: int, b: str, j: int) -> bool:
    return a[i * DIGITS : (i + 1) * DIGITS] == b[j * DIGITS : (j + 1) * DIGITS]


def scan_text(matcher: Matcher, text: str | None, before: list | None = None, items: list | None = None) -> tuple:
    """n_words, hit word intervals, their code-point spans, items; on top of what earlier passes found."""
    words = folded_words(text)
    intervals, hit = matcher.find(words)
    names = set(items or ()).union(*(matcher.names[i] for i in hit))
    intervals += [(x["start"], x["end"]) for x in before or ()]
    if not intervals:
        return len(words), [], [], sorted(names)
    merged: list[list[int]] = []
    for a, b in sorted(set(intervals)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    at = [m.span() for m in WORD.finditer(text)]
    return len(words), [{"start": a, "end": b} for a, b in merged], [{"start": at[a][0], "end": at[b - 1][1]} for a, b in merged], sorted(names)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """The columns `keep` of docs (all by default) with n_words, hit_words, hit_spans and hit_items.

    hit_words are merged intervals of word numbers inside any occurrence of a window (end exclusive),
    hit_spans the same in code points of the text, hit_items the ids, as text, of the items whose windows
    occur. Null and empty texts have no words; items without words are never found; items with a null id
    are known as ''. Items that repeat, or have equal texts, are all named. Columns of docs with these names are
    replaced. Empty tables on either side give no hits.

    The items are collected only up to max_bytes of text, and their automaton is built once, on the driver, and
    broadcast. A larger benchmark is dealt into parts by a hash of the item, one scan for each, with written
    steps between.
    """
    spark = docs.sparkSession
    keep = list(docs.columns) if keep is None else keep
    items = benchmark.select(F.coalesce(named(item_col).cast("string"), F.lit("")).alias("item"), named(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    out = docs
    for part in range(parts):
        rows = (items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)).collect()
        packed = spark.sparkContext.broadcast(pickle.dumps(Matcher([(r["item"], r["text"]) for r in rows], window)))
        more = ["hit_words", "hit_items"] if part else []

        def make(packed=packed, more=more, name=uuid.uuid4().hex):
            matcher = unpacked(name, packed, pickle.loads)

            def of(texts, *found):
                found = found if more else ([None] * len(texts),) * 2
                return [list(x) for x in zip(*(scan_text(matcher, *row) for row in zip(texts, *found)))] or [[], [], [], []]

            return of

        columns = list(dict.fromkeys([*keep, text_col]))
        out = map_text(out, [text_col, *more], make, FIELDS, columns if part + 1 < parts else keep)
        if part + 1 < parts:
            out = written(out, "contamination")
    return out
