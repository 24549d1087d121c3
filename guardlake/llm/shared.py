"""What the training-data operators share: text mapping, drawing of samples; and the library's written steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.functions.steps import new_path, remove_path, spread, written  # noqa: F401

#: Rows that a task's Python side handles together.
ROWS_AT_ONCE = 1000
#: Bytes that a batch of rows has at most, but for a row that is larger on its own.
BYTES_AT_ONCE = 16 << 20
#: A written table of up to so many rows is broadcast in a join; a larger one is shuffled.
MAX_BROADCAST_ROWS = 100_000
#: Rows that one task puts in order.
ROWS_IN_ORDER = 500_000


def in_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow(function, schema), with batches of at most ROWS_AT_ONCE rows and BYTES_AT_ONCE bytes: texts are long, and
    Spark's default of 10,000 rows would hold tens of megabytes for each task on both sides. The session keeps the smaller sizes."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        name = f"spark.sql.execution.arrow.{name}"
        now = str(conf.get(name))
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # functions take columns by place; mapInArrow takes no names with dots
    return plain.mapInArrow(function, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_text(df: DataFrame, text: Sequence[str], make: Callable, fields: Sequence[T.StructField], keep: Sequence[str]) -> DataFrame:
    """The columns `keep` of df and new ones made from its columns `text`, in Arrow batches.

    make() is called once in each task and returns a function from lists (one for each of `text`,
    None for nulls) to a list of Arrow arrays or Python lists, one for each of `fields`.
    A kept column whose name a new one has is left out. No shuffle.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    source = df.select(*[named(c) for c in keep], *[named(c).alias(f"_gl_in{i}") for i, c in enumerate(text) if c not in keep])
    places = [keep.index(c) if c in keep else len(keep) + sum(x not in keep for x in text[:i]) for i, c in enumerate(text)]
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields])
    n = len(keep)

    def run(batches):
        function = make()
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            made = function(*[batch.column(i).to_pylist() for i in places])
            made = [x if isinstance(x, pa.Array) else pa.array(x, target.field(n + i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *made], names=target.names)

    return in_batches(source, run, schema)


#: What tasks of this process have unpacked last, by name.
_unpacked: dict[str, object] = {}


def unpacked(name: str, packed, make: Callable):
    """make(packed.value), worked out once in a process and not once a task; the last value only is kept."""
    if name not in _unpacked:
        _unpacked.clear()
        _unpacked[name] = make(packed.value)
    return _unpacked[name]


def training_row(doc_id: str = "doc_id") -> Column:
    """True for the rows from which labels may be learnt: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def bounded_share(rows: int, bound: int) -> float:
    return 1.0 if rows <= bound else bound / rows


def draw(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the row's id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), named(doc_id)), 11) / F.lit(float(1 << 53))


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few enough rows, which are counted: for tables that are written already."""
    return F.broadcast(df) if df.count() <= most else df


def in_order(df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), name: str = "in-order") -> DataFrame:
    """df with `position` (from 0, by the columns `order`) and, for each column x of `sums`, x_before: its sum over the rows before.

    Ranges of the order are sorted on their own, and stand on top of the counts and sums of the ranges before them.
    """
    parts = max(1, -(-df.count() // ROWS_IN_ORDER))
    rows = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    over = earlier.orderBy("_range")
    offsets = held.select("_range", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_o{c}") for c in held.columns[1:]])
    own = Window.partitionBy("_range").orderBy(*order)
    out = rows.withColumns({"position": F.row_number().over(own) - 1, **{f"{c}_before": F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}})
    out = out.join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, (F.col("position") + F.col("_o_n")).cast("long").alias("position"), *[(F.col(f"{c}_before") + F.col(f"_o_s_{c}")).alias(f"{c}_before") for c in sums])
