"""Centroid clustering (k-means on integers) over a VA-file.

Vectors are kept twice: whole, in a table bucketed by a row number, and as a vector approximation: for each dimension
the number of one of a few cells, packed to a few bits. In a round, lookup tables of the least and largest squared distance from
each cell to each centroid are added up over the dimensions, so a vector has an interval of distance to each
centroid. Where one interval lies below all others, its centroid is the nearest, and the vector is not looked at. Whole vectors
are fetched, by their row numbers, where intervals overlap, and where the nearest centroid is not the one of the round
before: sums of clusters are carried on by what leaves and what joins. The first round and the distances of
the last assignment need all vectors.

All arithmetic is exact, in integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import bounded_share, draw, in_batches, named, new_path, partitions, remove_path, written

DIMS, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3
SCALE = 1024
#: Bits of a cell.
BITS = 7
#: Vectors from which the cells' bounds are drawn, about: they decide how many vectors are fetched, not the result.
SAMPLE = 10_000
#: Rows of a bucket, about, in a large table.
ROWS_PER_BUCKET = 2_000_000


def most_component(dims: int) -> int:
    """Components lie below this, so that squared distances fit a signed 64-bit integer."""
    return 1 << ((62 - max(0, (dims - 1).bit_length())) // 2 - 1)


def kept_vectors(df: DataFrame, dims: int = DIMS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (integers floor(1024 x)) of the rows whose vector has `dims` components, none null or non-finite, and none of
    2^17 or more (for 64 dimensions), whose squared distances would not fit 64 bits."""
    vec, bound = named(vec_col), float(most_component(dims) // SCALE)
    fine = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < bound, F.lit(False)))
    return df.filter((F.size(vec) == dims) & fine).select(named(id_col).alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dims)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exactly."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row; of equally near ones the smallest."""
    return distances(x, centroids).argmin(1)


# cells


def cell_bounds(sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension, the least and largest component of each of 2**bits cells, which reach as far as the data.

    Cells are as wide as the root of the sample's density is small: of all ways to cut this makes the width of a vector's cell least,
    in the mean, and so the intervals.
    """
    n, m = 1 << bits, 4 << bits
    if not len(sample):
        sample = np.stack([low, high])
    firsts, lasts = [], []
    for d in range(len(low)):
        fine = np.quantile(sample[:, d], np.arange(m + 1) / m)  # m parts of equal mass
        fine[0], fine[-1] = low[d], high[d]
        fine = np.maximum.accumulate(np.clip(fine, low[d], high[d]))
        reached = np.concatenate([[0], np.sqrt(np.diff(fine)).cumsum()])
        cuts = np.ceil(np.interp(np.arange(1, n) / n * reached[-1], reached, fine)).astype(np.int64)
        first = np.concatenate([[low[d]], cuts])
        firsts.append(first)
        lasts.append(np.maximum(first, np.concatenate([cuts - 1, [high[d]]])))
    return np.array(firsts), np.array(lasts)


def cells_of(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The last cell of each dimension that begins at or below the component."""
    return np.stack([np.searchsorted(first[d], x[:, d], side="right") - 1 for d in range(x.shape[1])], axis=1).clip(0).astype(np.uint8)


def pack_cells(cells: np.ndarray, bits: int) -> list[bytes]:
    each = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(cells), cells.shape[1] * bits)
    return [row.tobytes() for row in np.packbits(each, axis=1)]


def unpack_cells(column: pa.Array, dims: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    each = np.unpackbits(raw, axis=1)[:, : dims * bits].reshape(len(raw), dims, bits)
    return (each @ (1 << np.arange(bits)[::-1])).astype(np.int64)


def lookup(first: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(dims * cells, 2 * centroids): the least, then the largest that a cell adds to the distance to each centroid.

    What a vector adds to its distances to all centroids alike is left out: with x and c taken from a point amid the
    centroids, (x - c)^2 less x^2 is c^2 - 2xc, which a cell leaves far less uncertain.
    """
    amid = centroids.sum(0) // len(centroids)
    c = (centroids - amid).T[:, None, :]  # dims, 1, centroids
    a, b = (c * c - 2 * (x - amid[:, None])[:, :, None] * c for x in (first, last))
    return np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=2).reshape(-1, 2 * len(centroids))


def sure(cells: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each lookup table, the centroid whose interval lies below all others', or -1 where intervals overlap."""
    n, dims = cells.shape
    out = [np.empty(n, np.int64) for _ in tables]
    for at in range(0, n, 2000):
        part = cells[at : at + 2000]
        for table, found in zip(tables, out):
            rows = part + np.arange(dims) * (len(table) // dims)
            k = table.shape[1] // 2
            sums = table[rows[:, 0]].copy()
            for d in range(1, dims):
                sums += table[rows[:, d]]
            least, most = sums[:, :k], sums[:, k:]
            best = most.argmin(1)
            mine = most[np.arange(len(part)), best][:, None]
            number = np.arange(k)[None, :]
            # an equal distance is one more than a later centroid may have, and no more than an earlier one must exceed
            below = (mine < least) | ((mine == least) & (best[:, None] < number)) | (number == best[:, None])
            found[at : at + 2000] = np.where(below.all(1), best, -1)
    return out


# rounds


class VectorFile:
    """Vectors and their approximations, written to the shared folder.

    `vectors` is a table bucketed by row, so that fetching by row moves row numbers and no vectors.
    """

    def __init__(self, kept: DataFrame, dims: int = DIMS, bits: int = BITS):
        self.spark, self.dims, self.bits = kept.sparkSession, dims, bits
        rows = kept.withColumn("row", F.monotonically_increasing_id())
        rows = written(rows, "vectors-in")
        self.count = rows.count()
        n = max(partitions(self.spark), -(-self.count // ROWS_PER_BUCKET))
        self.name, self.path = f"gl_vectors_{uuid.uuid4().hex}", new_path(self.spark, "vectors")
        rows.repartition(n, "row").write.option("path", self.path).bucketBy(n, "row").sortBy("row").saveAsTable(self.name)
        self.vectors = self.spark.table(self.name)
        self.first, self.last = self._bounds()
        self.cells = written(self._approximations(), "va-file")

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        dims = self.dims

        def extremes(batches):
            for batch in batches:
                x = matrix(batch.column(0), dims)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(x.min(0)), pa.array(x.max(0))], names=["d", "low", "high"])

        found = in_batches(self.vectors.select("v"), extremes, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").toPandas()
        if not len(found):
            return np.zeros((dims, 1), np.int64), np.zeros((dims, 1), np.int64)
        drawn = self.vectors.filter(draw("vec_id", SEED) < bounded_share(self.count, SAMPLE)).select("v").limit(4 * SAMPLE).toPandas().v
        sample = np.array([list(x) for x in drawn], np.int64).reshape(-1, dims)
        return cell_bounds(sample, found.low.to_numpy(np.int64), found.high.to_numpy(np.int64), self.bits)

    def _approximations(self) -> DataFrame:
        dims, bits, first = self.dims, self.bits, self.first

        def approximate(batches):
            for batch in batches:
                x = matrix(batch.column(1), dims)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack_cells(cells_of(x, first), bits), pa.binary())], names=["row", "cells"])

        return in_batches(self.vectors.select("row", "v"), approximate, "row long, cells binary")

    def wanted(self, before: np.ndarray, now: np.ndarray) -> DataFrame:
        """row, a, b of the vectors that may change sums: the nearest centroid before and now, -1 where intervals overlap."""
        dims, bits, first, last = self.dims, self.bits, self.first, self.last

        def look(batches):
            tables = [lookup(first, last, c) for c in (before, now)]
            for batch in batches:
                if not len(batch):
                    continue
                a, b = sure(unpack_cells(batch.column(1), dims, bits), tables)
                take = (a != b) | (a < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[take]), pa.array(a[take]), pa.array(b[take])], names=["row", "a", "b"])

        return in_batches(self.cells, look, "row long, a long, b long")

    def changes(self, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
        """cluster, d (component, or -1 for the number of vectors), change: what the clusters' sums gain from one assignment to the next."""
        dims = self.dims

        def change(batches):
            sums = np.zeros((len(now), dims + 1), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), dims)
                if not len(x):
                    continue
                whole = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                if before is None:
                    np.add.at(sums, nearest(x, now), whole)
                    continue
                a, b = (np.asarray(batch.column(i)).copy() for i in (1, 2))
                for known, centroids in ((a, before), (b, now)):
                    if (known < 0).any():
                        known[known < 0] = nearest(x[known < 0], centroids)
                moved = a != b
                np.add.at(sums, b[moved], whole[moved])
                np.subtract.at(sums, a[moved], whole[moved])
            at, d = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d - 1), pa.array(sums[at, d])], names=["cluster", "d", "change"])

        rows = self.vectors.select("v") if before is None else self.wanted(before, now).join(self.vectors.select("row", "v"), "row").select("v", "a", "b")
        return in_batches(rows, change, "cluster long, d long, change long").groupBy("cluster", "d").agg(F.sum("change").alias("change"))

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """vec_id, cluster, distance of every vector, from the whole vectors."""
        dims = self.dims
        schema = T.StructType([self.vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

        def assign(batches):
            for batch in batches:
                all_ = distances(matrix(batch.column(1), dims), centroids)
                best = all_.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(all_[np.arange(len(best)), best])], names=schema.names)

        return in_batches(self.vectors.select("vec_id", "v"), assign, schema)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove_path(self.spark, self.path)


def start_centroids(kept: DataFrame, centroids: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least sha256 of seed:id, in that order; of equal ids the least vector first. Null ids count as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()]


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, bits: int = BITS, id_col: str = "vec_id", vec_col: str = "embedding", watch: Callable | None = None) -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each kept vector.

    kept_vectors() says which are kept, and how they become integers. Centroids start as start_centroids(); each round assigns
    every vector to the nearest (ties: the smaller number) and then puts a centroid with vectors at the floor of the mean of each component;
    one without stays. Fewer kept vectors than centroids make fewer centroids; none give an empty table. Equal vectors and equal
    ids count as often as they stand there; null ids are kept. Extra columns are left out.

    On the driver are the centroids and the sums of their clusters, which do not grow with the data. watch, if given, is called with the
    VectorFile and the centroids before and after each round but the first.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, id_col, vec_col)
    kind = kept.schema["vec_id"].dataType.simpleString()
    now = np.array(start_centroids(kept, centroids), np.int64)
    if not len(now):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    file = VectorFile(kept, dims, bits)
    sums, before = [[0] * (dims + 1) for _ in now], None
    for _ in range(rounds):
        if before is not None and (before == now).all():
            break  # nothing moves any more
        if before is not None and watch:
            watch(file, before, now)
        for r in file.changes(before, now).collect():
            sums[r["cluster"]][r["d"] + 1] += r["change"]
        before = now
        now = np.array([[s // row[0] for s in row[1:]] if row[0] else c for row, c in zip(sums, before.tolist())], np.int64)
    found = written(file.assigned(now), "assigned")
    file.close()
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    of_cluster = [(i, inertia[i], sum(inertia.values()), digest(c)) for i, c in enumerate(now.tolist()) if i in inertia]
    of_cluster = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
