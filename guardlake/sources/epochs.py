"""Tables that appear together: each epoch's rows in a folder of its own, and a mark that says that all of them are there.

A repeated epoch writes its folders anew, so it doubles nothing; readers look at marked epochs only, so they see all of
an epoch's tables or none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"


def run_of(checkpoint: str) -> str:
    """The name under which a stream with this checkpoint writes: epochs count from 0 in each checkpoint."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def commit(tables: dict[str, DataFrame], path: str, run: str, epoch: int) -> None:
    """Writes the tables of an epoch, then its mark."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run={run}/epoch={epoch}")
        spark = df.sparkSession
    spark.range(1).select(F.lit(len(tables)).alias("tables")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{COMMITS}/run={run}/epoch={epoch}")


def committed(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame | None:
    """The rows of a table in marked epochs, with run and epoch; None if there are no marks yet. Marks are as many as epochs."""
    base = spark.read.option("basePath", f"{path}/{COMMITS}").schema("tables int, run string, epoch long")
    try:
        marks = base.parquet(f"{path}/{COMMITS}").select("run", "epoch").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = (spark.read.schema(f"{schema}, run string, epoch long") if schema else spark.read).parquet(f"{path}/{name}")
    rows = rows.withColumns({"run": F.col("run").cast("string"), "epoch": F.col("epoch").cast("long")})
    return rows.join(marks, ["run", "epoch"], "left_semi")


def start(stream: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str):
    """A started query that commits the tables that make() makes of each micro-batch. It ends when the input is used up."""
    run = run_of(checkpoint)
    write = lambda batch, epoch: commit(make(batch), path, run, epoch)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
