"""Steps written to the shared folder: they cut lineage and survive lost executors.

All steps of an application stand in one folder, which remove_steps() deletes when their results are no longer read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for local sessions that name no shared folder, as in tests.
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may do without; it gets a temporary folder of its own."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="guardlake-"))
        base = _own_dir[0]
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


#: The folder of the stage that is being made, below the application's.
_stage: list[str] = []


def steps_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/guardlake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return "/".join([steps_dir(spark), *_stage[-1:], f"{name}-{uuid.uuid4().hex}"])


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df, written to the shared folder and read again; in folders by the columns `by`, if any are named."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whichever store it is; one that is not there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df, written for as long as the block runs: for what several outputs are made of."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_path(df.sparkSession, path)


@contextmanager
def stage_steps(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that writes a stage's result, as written() does; all other steps that are written in the block go at its end."""
    _stage.append(f"stage-{uuid.uuid4().hex}")
    own = f"{steps_dir(spark)}/{_stage[-1]}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{steps_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        _stage.pop()
        remove_path(spark, own)


def remove_steps(spark: SparkSession) -> None:
    """Deletes all steps that this application has written. Results that still read them must have been saved before."""
    remove_path(spark, steps_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer partitions than the session has cores, dealt out evenly: for work that costs much CPU a row.

    A large table has more partitions than that and stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with the columns `made`, worked out once a row.

    They come out of a generator of one row: the optimiser cannot put them in place where later projections and filters name
    them, nor push what follows below a union, so a long expression stands in the plan once.
    """
    old = [c for c in df.columns if c not in made]
    return df.select(*old, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
