"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed, sorted table of (line hash, number of documents). Each new batch of line hashes is
anti-joined with the lines that the runs already know to be repeated often enough, and the rest becomes
a run of level 0. When a level has `fanout` runs they are merged into one of the next level, so a line's
count is found in few places and each count is rewritten a logarithmic number of times.

Lines are known by 128-bit hashes; a line's documents are counted by partial sums, so one line that
stands in every document is a few rows for each task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import in_batches, map_text, named, new_path, partitions, remove_path, unpacked, written

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
#: Up to so many repeated lines (16 bytes each) are broadcast; beyond that they are joined.
MAX_BROADCAST_LINES = 1_000_000

#: Lines of a run's bucket, about: larger tables have more buckets than the session has shuffle partitions.
LINES_PER_BUCKET = 5_000_000

_BLANK = b" \t\n\x0b\x0c\r"
_KEYS = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(text: str | None) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text and their hashes; None for lines whose key is empty."""
    lines = (text or "").split("\n")
    keys = [x.encode("utf-8", "surrogatepass").strip(_BLANK).lower() for x in lines]
    return lines, [_hash(k) if k else None for k in keys]


def _two_longs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)


def line_counts(docs: DataFrame, batches: int = 1, text_col: str = "text") -> DataFrame:
    """batch, h1, h2, n: in how many documents of the batch each line stands. Documents fall into batches by text hash."""
    schema = T.StructType([T.StructField("batch", T.IntegerType()), *_KEYS.fields, T.StructField("n", T.LongType())])

    def count(arrow_batches):
        for arrow in arrow_batches:
            held: list[dict[bytes, int]] = [{} for _ in range(batches)]
            for text in arrow.column(0).to_pylist():
                into = held[xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) % batches]
                for h in set(line_hashes(text)[1]):
                    if h is not None:
                        into[h] = into.get(h, 0) + 1
            for i, counts in enumerate(held):
                if counts:
                    longs = _two_longs(list(counts))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), i, np.int32)), pa.array(longs[:, 0].copy()), pa.array(longs[:, 1].copy()), pa.array(list(counts.values()), pa.int64())], names=schema.names)

    return in_batches(docs.select(named(text_col).alias("_gl_text")), count, schema).groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n), kept as bucketed tables under the shared folder.

    A run is written by one task a bucket, so it has one file a bucket. state() says all that another session needs to
    go on with the runs: LineRuns.resumed(spark, state).
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets or partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def state(self) -> dict:
        return {"min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets, "levels": [[self.paths[r] for r in level] for level in self.levels]}

    @classmethod
    def resumed(cls, spark: SparkSession, state: dict) -> LineRuns:
        runs = cls(spark, state["min_docs"], state["fanout"], state["buckets"])
        runs.levels = [[runs._known(path) for path in level] for level in state["levels"]]
        return runs

    def _known(self, path: str) -> str:
        """A name in this session's catalogue for a run's files."""
        name = f"gl_lines_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.paths[name] = path
        return name

    def _run(self, counts: DataFrame) -> str:
        """counts, which are dealt by (h1, h2) over the buckets."""
        name, path = f"gl_lines_{uuid.uuid4().hex}", new_path(self.spark, "lines")
        counts.write.option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        remove_path(self.spark, self.paths.pop(run))

    def _repeated(self, run: str) -> DataFrame:
        return self.spark.table(run).filter(F.col("n") >= self.min_docs)

    def absorb(self, counts: DataFrame) -> None:
        """Adds a batch of (h1, h2, n), one row for each line. Lines already known to be repeated are not counted on."""
        counts = counts.select("h1", "h2", "n").repartition(self.buckets, "h1", "h2")
        for run in [r for level in self.levels for r in level]:
            counts = counts.join(self._repeated(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._run(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _merged(self, runs: list[str]) -> str:
        """One run of several, whose files then go: a task that fails before writes the merged run again."""
        if len(runs) == 1:
            return runs[0]
        both = self.spark.table(runs[0])
        for run in runs[1:]:  # sorted, bucketed alike: a merge without a shuffle
            other = self.spark.table(run).withColumnRenamed("n", "more")
            both = both.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        merged = self._run(both)
        for run in runs:
            self._drop(run)
        return merged

    def repeated(self) -> DataFrame:
        """h1, h2 of the lines that stand in min_docs documents or more. Compacts all runs into one."""
        runs = [r for level in self.levels for r in level]
        self.levels = [[], [self._merged(runs)]] if runs else [[]]
        if not runs:
            return self.spark.createDataFrame([], _KEYS)
        return self._repeated(self.levels[1][0]).select("h1", "h2")

    def close(self) -> None:
        """Drops all runs and their files."""
        for run in [r for level in self.levels for r in level]:
            self._drop(run)
        self.levels = [[]]


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, text_col: str = "text") -> DataFrame:
    """h1, h2 of each line key that stands in min_docs documents or more; the texts are read once."""
    spark = docs.sparkSession
    counts = written(line_counts(docs, batches, text_col), "line-counts")
    runs = LineRuns(spark, min_docs, fanout, max(partitions(spark), -(-counts.count() // LINES_PER_BUCKET)))
    for i in range(batches):
        runs.absorb(counts.filter(F.col("batch") == i).select("h1", "h2", "n"))
    found = written(runs.repeated(), "repeated-lines")
    runs.close()
    return found


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, max_broadcast: int = MAX_BROADCAST_LINES) -> DataFrame:
    """The columns `keep` of docs (all by default), with `kept_text`, `n_lines` and `n_dropped`.

    A text is split at newlines; null and empty texts have one empty line. Lines whose key (blanks cut at
    both ends, A-Z lower-cased) is not empty and stands in min_docs rows or more are dropped everywhere;
    the others stay as they are, joined by newlines. Rows with the same id count as documents of their
    own. Columns of docs named kept_text, n_lines or n_dropped are replaced. An empty table gives none.
    """
    spark = docs.sparkSession
    keep = list(docs.columns) if keep is None else keep
    found = repeated_lines(docs, min_docs, batches, fanout, text_col)
    fields = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    few = found.limit(max_broadcast + 1).toPandas()

    def split(texts: list[str | None], repeated) -> list:
        kept, n_lines, n_dropped = [], [], []
        for i, text in enumerate(texts):
            lines, hashes = line_hashes(text)
            drop = repeated(i)
            stay = [line for line, h in zip(lines, hashes) if h not in drop]
            kept.append("\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return [kept, n_lines, n_dropped]

    if len(few) <= max_broadcast:
        packed, name = spark.sparkContext.broadcast(few.to_numpy(np.int64).astype(">i8").tobytes()), uuid.uuid4().hex

        def by_set():
            drop = unpacked(name, packed, lambda raw: {raw[i : i + 16] for i in range(0, len(raw), 16)})
            return lambda texts: split(texts, lambda i: drop)

        return map_text(docs, [text_col], by_set, fields, keep)

    def own():
        def of(texts):
            each = [sorted({h for h in line_hashes(t)[1] if h is not None}) for t in texts]
            return [[[dict(h1=a, h2=b) for a, b in _two_longs(x).tolist()] if x else [] for x in each]]

        return of

    # equal texts drop equal lines, so texts are told apart by their hashes; each text's lines are its own, in one array
    marked = docs.withColumn("_gl_key", F.sha2(F.coalesce(named(text_col), F.lit("")), 256))
    texts = marked.select("_gl_key", named(text_col).alias("_gl_text")).dropDuplicates(["_gl_key"])
    lines = map_text(texts, ["_gl_text"], own, [T.StructField("_gl_keys", T.ArrayType(_KEYS))], ["_gl_key"]).select("_gl_key", F.explode("_gl_keys").alias("k")).select("_gl_key", "k.h1", "k.h2")
    drops = lines.join(found, ["h1", "h2"]).groupBy("_gl_key").agg(F.collect_list(F.struct("h1", "h2")).alias("_gl_drop"))
    joined = marked.join(drops, "_gl_key", "left").drop("_gl_key")

    def by_row():
        def of(texts, drops):
            sets = [{np.array([d["h1"], d["h2"]], dtype=np.int64).astype(">i8").tobytes() for d in x or []} for x in drops]
            return split(texts, lambda i: sets[i])

        return of

    return map_text(joined, [text_col, "_gl_drop"], by_row, fields, keep)
