"""Quality scores learnt from preference pairs by the Bradley-Terry model.

A document's strength is a weighted sum of surface features of its whole text. The chance that one
document is preferred to another is the logistic function of the difference of their strengths; weights
are fitted by Newton steps on the logistic loss over pairs of a good and a bad labelled document. The
threshold is the quantile of strengths below which the share of bad labels lies; strengths are moved so
that it stands at the score THRESHOLD.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.shared import in_batches, map_text, named, training_row, written

THRESHOLD = 0.7
#: Pairs of a small table, about; a larger one has two for each row of its larger class.
PAIRS = 60_000
#: Rows of a group in which rows are paired, and how many of the rarer class it has at least, about.
ROWS_OF_GROUP = 4_000
RARE_OF_GROUP = 30
#: Rows of a range that the driver puts in order.
ROWS_OF_RANGE = 10_000
SEED = 11
RIDGE = 1e-3

_MARKS = [ord(c) for c in "!?|#*$%&.,;:'\"()-_/@=+<>{}[]~^\\`"]
_BLANKS = [32, 10, 9]
N_FEATURES = 3 + len(_BLANKS) + len(_MARKS) + 2 + 9


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes (as square roots) and the shape of words and lines; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    lengths = np.array([len(w) for w in words] or [0])
    shares = [counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), *counts[_BLANKS], *counts[_MARKS], counts[:32].sum() - counts[10] - counts[9], counts[128:].sum()]
    shape = [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean() / 10, np.log1p(lengths.max()), (lengths <= 3).mean(),
        len(set(words)) / n_words, len(set(lines)) / n_lines, np.log1p(n_lines), np.log1p(n / n_lines),
    ]
    return np.concatenate([np.sqrt(np.maximum(0, np.array(shares, float)) / n), shape])


@dataclass
class Model:
    """Strength = (clipped, standardised features) . weights; score = logistic(strength - cut + logit(threshold))."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray | None = None
    cut: float = 0.0
    threshold: float = THRESHOLD

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        z = self.strength(x) - self.cut + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def newton(sums: Callable, k: int, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Weights that maximise the likelihood whose parts sums(weights) gives: number of pairs, slope and curve, as pair_sums() does."""
    weights = np.zeros(k)
    for _ in range(steps):
        n, slope, curve = sums(weights)
        step = np.linalg.solve(curve / n + ridge * np.eye(k), slope / n - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def pair_sums(differences: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(differences @ weights, -500, 500)))
    return len(differences), differences.T @ (1 - p), (differences * (p * (1 - p))[:, None]).T @ differences


def fit_pairs(differences: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Weights that maximise the Bradley-Terry likelihood of 'the first is preferred' over feature differences."""
    return newton(lambda weights: pair_sums(differences, weights), differences.shape[1], ridge, steps)


def _matrix(column) -> np.ndarray:
    """Rows of features, or of differences, out of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, N_FEATURES)


def _summed(df: DataFrame, part: Callable) -> np.ndarray:
    """The numbers and arrays that part(matrix) gives, in one row, summed over the column of bytes of df."""

    def run(batches):
        total = None
        for batch in batches:
            made = part(_matrix(batch.column(0)))
            total = made if total is None else [a + b for a, b in zip(total, made)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"made": [np.concatenate([np.ravel(x) for x in total]).astype(float).tobytes()]})

    # in an order that does not depend on which task ends first
    return np.sum([np.frombuffer(x, float) for x in sorted(bytes(r[0]) for r in in_batches(df, run, "made binary").collect())], axis=0)


def _kth(df: DataFrame, k: int) -> float:
    """The value at place k, from 0, of the one column `s` of df in order: ranges are counted and narrowed down."""
    lo, hi, n = df.agg(F.min("s"), F.max("s"), F.count("*")).first()
    while lo < hi and n > ROWS_OF_RANGE:
        part = F.least(F.lit(999), F.floor((F.col("s") - lo) / (hi - lo) * 1000))
        for r in df.filter(F.col("s").between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("part").collect():
            if k < r["n"]:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
    return lo if lo == hi else sorted(r[0] for r in df.filter(F.col("s").between(lo, hi)).collect())[k]


def _pairs(rows: DataFrame, sizes: tuple[int, int], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """One column of bytes: differences of standardised features of a good and a bad row. Every row is in pairs.

    Rows are dealt to groups by a hash. In a group each row of the larger class meets some of the smaller one, in turn; rows of a class
    that is rare are in several groups, so that all groups have some.
    """
    groups = max(1, sum(sizes) // ROWS_OF_GROUP)
    rare, fewer = int(sizes[1] < sizes[0]), min(sizes)
    copies = -(-RARE_OF_GROUP * groups // fewer) if groups > 1 else 1
    partners = max(2, min(fewer, -(-PAIRS // max(sizes))))
    copy = F.explode(F.sequence(F.lit(1), F.when(F.col("_gl_label") == rare, copies).otherwise(1)))
    dealt = rows.withColumn("_gl_copy", copy).withColumn("_gl_group", F.pmod(F.xxhash64(F.lit(SEED), "_gl_id", "_gl_copy"), F.lit(groups)))

    def pair(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("_gl_label").to_pylist(), table.column("x").to_pylist()))  # in an order that does not depend on tasks
        z = np.clip((np.frombuffer(b"".join(x for _, x in found), float).reshape(-1, N_FEATURES) - mean) / scale, -8, 8)
        labels = np.array([y for y, _ in found])
        order = np.random.default_rng(SEED).permutation(len(z))
        good, bad = (z[order][labels[order] == y] for y in (1, 0))
        if not len(good) or not len(bad):
            return pa.table({"d": pa.array([], pa.binary())})
        i, most = np.arange(max(len(good), len(bad))), min(partners, len(good), len(bad))
        by_good, by_bad = (1, 0) if len(good) < len(bad) else (0, 1)  # the smaller class is moved on
        return pa.table({"d": pa.array([(good[(i + by_good * s) % len(good)] - bad[(i + by_bad * s) % len(bad)]).tobytes() for s in range(most)], pa.binary())})

    return dealt.select("_gl_group", "_gl_label", "x").groupBy("_gl_group").applyInArrow(pair, "d binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> Model:
    """A model from all labelled documents whose rows are for training.

    Labels other than 0 and 1 are left out; an id with several labels has the largest. If a class has no
    labels, nothing can be learnt and every document scores 1. Features move as one value of bytes a row, texts do not; the driver gets
    sums by task.
    """
    marked = labels.filter(training_row(id_col)).filter(named(label_col).isin(0, 1)).groupBy(named(id_col).alias("_gl_id")).agg(F.max(named(label_col)).cast("int").alias("_gl_label"))
    rows = docs.filter(training_row(id_col)).select(named(id_col).alias("_gl_id"), named(text_col).alias("_gl_text"))
    rows = map_text(rows, ["_gl_text"], lambda: lambda texts: [[features(t).tobytes() for t in texts]], [T.StructField("x", T.BinaryType())], ["_gl_id"])
    rows = written(rows.join(marked, "_gl_id"), "quality-features")
    found = {r["_gl_label"]: r["n"] for r in rows.groupBy("_gl_label").agg(F.count("*").alias("n")).collect()}
    sizes = (found.get(0, 0), found.get(1, 0))
    if not all(sizes):
        return Model(threshold=threshold)
    n = sum(sizes)
    mean = _summed(rows.select("x"), lambda x: [x.sum(0)]) / n
    model = Model(mean, np.sqrt(_summed(rows.select("x"), lambda x: [((x - mean) ** 2).sum(0)]) / n) + 1e-9, None, 0.0, threshold)
    pairs = written(_pairs(rows, sizes, model.mean, model.scale), "quality-pairs")

    def sums(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        made = _summed(pairs, lambda d: list(pair_sums(d, weights)))
        return made[0], made[1 : 1 + N_FEATURES], made[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES)

    model.weights = newton(sums, N_FEATURES)
    strength = lambda batches: (pa.RecordBatch.from_pydict({"s": model.strength(_matrix(b.column(0)))}) for b in batches)
    strengths = written(in_batches(rows.select("x"), strength, "s double"), "quality-strengths")
    at = min(sizes[0] - 1, n - 2)
    model.cut = (_kth(strengths, at) + _kth(strengths, at + 1)) / 2
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with `score` (0 to 1) and `predicted` (1 if score >= threshold).

    Null and empty texts have the features of no text. Equal texts score alike. Columns of docs named
    score or predicted are replaced. An empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(texts):
            scores = held.value.score(np.array([features(t) for t in texts])) if texts else np.zeros(0)
            return [scores.tolist(), (scores >= held.value.threshold).astype(int).tolist()]

        return of

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_text(docs, [text_col], make, fields, list(docs.columns) if keep is None else keep)
