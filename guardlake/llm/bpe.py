"""Byte-level BPE without a regex: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation gives each code point one of four classes (letter, number, white space, other). Every
change of class is a constant function on the scanner's state ("a run began here") and every other code
point is the identity; composing such functions is associative and keeps the last constant, so the state
at all code points is one prefix scan, a running maximum. What the pattern adds to runs is local to their
ends: the last white space of a run goes to the next piece if it is a space and else stands alone, white
space at the end of a text stays whole, and an apostrophe that begins a piece takes s, t, m, d, re, ve or
ll with it. The pieces are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
import uuid
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from guardlake.llm.shared import in_batches, map_text, named

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pieces kept with their ids in each Python process, in two halves of which the older is given up.
CACHE_PIECES = 200_000
#: Pieces of more bytes are merged by a heap.
SHORT = 64


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    # \s is the property White_Space; chr.isspace also takes the four separators U+001C to U+001F
    for i in range(0x3001):
        if chr(i).isspace() and not 0x1C <= i <= 0x1F:
            table[i] = SPACE
    return table


_SINGLE = np.array([ord(c) for c in "stmd"], np.uint32)
_DOUBLE = [tuple(map(ord, x)) for x in ("re", "ve", "ll")]


def piece_starts(text: str) -> np.ndarray:
    """The code points at which pieces begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    began = np.maximum.accumulate(np.arange(n, dtype=np.int32) * change[:n])  # the scan: where each code point's run began
    starts = change.copy()
    last = np.flatnonzero((kind == SPACE) & change[1:])  # last code points of white-space runs
    if len(last) and last[-1] == n - 1:
        last = last[:-1]
    starts[last] = True
    spaces = last[points[last] == 32]
    starts[spaces + 1] = False
    quote = np.flatnonzero((points[: n - 1] == 39) & (kind[1:] == LETTER) & starts[: n - 1])
    quote = quote[began[quote] == quote]
    if len(quote):
        one = np.isin(points[quote + 1], _SINGLE)
        starts[quote[one] + 1] = False
        starts[quote[one] + 2] = True
        rest = quote[~one]
        rest = rest[rest + 2 < n]
        for a, b in _DOUBLE:
            two = rest[(points[rest + 1] == a) & (points[rest + 2] == b)]
            starts[two + 1] = False
            starts[two + 3] = True
    return np.flatnonzero(starts[:n])


def pair_ranks(vocabulary: list[bytes]) -> dict[int, int]:
    """The id that two adjacent ids merge into, by (left id << 32) + right id."""
    known = {token: i for i, token in enumerate(vocabulary) if token}
    pairs = {}
    for token, rank in known.items():
        for cut in range(1, len(token)):
            left, right = known.get(token[:cut]), known.get(token[cut:])
            if left is not None and right is not None:
                pairs[(left << 32) + right] = rank
    return pairs


_NONE = 1 << 60


def merge_pairs(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, leftmost first, until none is left; ids are those of single bytes."""
    get = pairs.get
    if len(ids) <= SHORT:
        ranks = [get((a << 32) + b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == _NONE:
                break
            at = ranks.index(rank)
            ids[at : at + 2] = [rank]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1] << 32) + rank, _NONE)
            if at < len(ranks):
                ranks[at] = get((rank << 32) + ids[at + 1], _NONE)
        return ids
    n = len(ids)
    after, ahead, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(ids)
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 32) + ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j >= n or alive[i] != left or alive[j] != right:
            continue  # a part of it has been merged meanwhile
        alive[i], alive[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            ahead[after[i]] = i
        for a, b in ((ahead[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := get((alive[a] << 32) + alive[b])) is not None:
                heapq.heappush(heap, (r, a, alive[a], alive[b]))
    return [x for x in alive if x >= 0]


class Encoder:
    """Texts to ids, with a bounded cache of pieces."""

    def __init__(self, vocabulary: list[bytes], pairs: dict[int, int] | None = None, cache: int = CACHE_PIECES):
        self.pairs = pair_ranks(vocabulary) if pairs is None else pairs
        single = {token: i for i, token in enumerate(vocabulary) if len(token) == 1}
        self.bytes, self.cache, self.old, self.size = [single[bytes([b])] for b in range(256)], {}, {}, cache

    def piece(self, piece: str) -> bytes:
        """The ids of a piece that the cache's younger half does not have, as packed 32-bit numbers."""
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge_pairs(list(map(self.bytes.__getitem__, piece.encode("utf-8", "surrogatepass"))), self.pairs)).tobytes()
        if len(piece) <= SHORT:
            if 2 * len(self.cache) >= self.size:
                self.cache, self.old = {}, self.cache
            self.cache[piece] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        starts = piece_starts(text).tolist()
        miss = self.piece
        ends = starts[1:]
        ends.append(len(text))
        return np.frombuffer(b"".join([self.cache.get(p) or miss(p) for p in [text[a:b] for a, b in zip(starts, ends)]]), np.int32)


#: The encoder of this process, with the name of its vocabulary: its cache outlives a task.
_kept: dict[str, Encoder] = {}


class Decoder:
    """Ids to the bytes that they stand for: one gather from the vocabulary's bytes."""

    def __init__(self, vocabulary: list[bytes]):
        self.blob = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.lengths = np.array([len(t) for t in vocabulary], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths

    def bytes(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        return self.blob[np.repeat(self.first[ids] - (to - size), size) + np.arange(total)].tobytes()


def kept_encoder(name: str, held) -> Encoder:
    if name not in _kept:
        _kept.clear()
        _kept[name] = Encoder(*held.value)
    return _kept[name]


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each id, by id, from a file of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        table[int(rank)] = base64.b64decode(token)
    return table


def _list_array(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text", keep: list[str] | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """The columns `keep` of docs (all by default), with `ids` and, if asked for, `offsets`: where each id's bytes begin in the
    UTF-8 text, and `decoded`: the bytes that the ids decode to, made from the ids in the same pass.

    Null and empty texts get no ids. Special tokens are ordinary text. Columns of docs named ids, offsets
    or decoded are replaced. The vocabulary is broadcast: its size does not depend on the data.
    """
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, pair_ranks(vocabulary)))
    name = uuid.uuid4().hex
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("offsets", T.ArrayType(T.LongType()))] * offsets + [T.StructField("decoded", T.BinaryType())] * decoded

    def make() -> Callable:
        encoder = kept_encoder(name, held)
        decoder = Decoder(held.value[0]) if offsets or decoded else None

        def of(texts):
            sizes, flat = [], []
            for text in texts:
                ids = encoder.ids(text) if text else np.zeros(0, np.int32)
                sizes.append(len(ids))
                flat.append(ids)
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            out = [_list_array(values, sizes, pa.int32())]
            if offsets:
                at = [np.cumsum(decoder.lengths[x]) - decoder.lengths[x] for x in flat]
                out.append(_list_array(np.concatenate(at) if at else np.zeros(0, np.int64), sizes, pa.int64()))
            if decoded:
                out.append(pa.array([decoder.bytes(x) for x in flat], pa.binary()))
            return out

        return of

    return map_text(docs, [text_col], make, fields, list(docs.columns) if keep is None else keep)


def decode(df: DataFrame, vocabulary: list[bytes], ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with `decoded`, the bytes of its ids.

    Null ids give null and no ids no bytes; an id outside the vocabulary is an error. A column named decoded is replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(vocabulary)
    keep = list(df.columns) if keep is None else keep
    fields = [T.StructField("decoded", T.BinaryType())]
    keep = [c for c in keep if c.lower() != "decoded"]
    source = df.select(*map(named, keep), named(ids_col).alias("_gl_ids"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches):
        decoder = Decoder(held.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            ids = column.flatten().to_numpy()
            out = [decoder.bytes(ids[ends[i] : ends[i + 1]]) if column[i].is_valid else None for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(out, pa.binary())], names=schema.names)

    return in_batches(source, run, schema)
