"""Sources and sinks: content, episodes, audit logs, sessions, allowlists."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.functions.steps import held
from guardlake.operators import content
from guardlake.sources import epochs

EPISODE = "id string, ts timestamp, session_id string, kind string, summary string, details string, tags array<string>, source string"
SKIP = "# FETCH_FAILED"


def _is_stub(body: Column) -> Column:
    return F.startswith(F.ltrim(F.decode(F.substring(body, 1, 4096), "ISO-8859-1")), F.lit(SKIP))


def read_content(spark: SparkSession, path: str, kind: str = "binaryFile") -> DataFrame:
    """content_id, body of payload files (or parquet rows with these columns); fetch stubs are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("content_id"), F.col("content").alias("body")) if kind == "binaryFile" else spark.read.parquet(path).select("content_id", "body")
    return raw.filter(~_is_stub(F.col("body")))


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; empty lines are skipped, a malformed one fails the read, a missing path is an empty log."""
    try:
        return spark.read.schema(EPISODE).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EPISODE)


def append_episodes(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def parse_audit(lines: DataFrame, line: str = "line") -> DataFrame:
    """payload (the exact hashed bytes), content_hash, prev_hash, hmac of lines of chained entries."""
    text = F.col(line)
    fields = F.get_json_object(text, "$.fields").isNotNull()
    head = F.regexp_extract(text, r'(?s)^(.*),"content_hash":"[0-9a-f]*","prev_hash":"[0-9a-f]*","hmac":"[0-9a-f]*"\}\s*$', 1)
    payload = F.when(fields, F.concat(head, F.lit("}"))).otherwise(F.regexp_extract(head, r'(?s)^\{"event":(.*)$', 1))
    return lines.filter(F.trim(text) != "").withColumn("payload", payload).withColumns({c: F.get_json_object(text, f"$.{c}") for c in ("content_hash", "prev_hash", "hmac")})


def render_audit(chain: DataFrame) -> DataFrame:
    """chain with line: the entry as it stands on disk. Payloads that are not of the fields form are the event alone."""
    whole = F.startswith("payload", F.lit('{"event":'))
    head = F.when(whole, F.expr("substring(payload, 1, length(payload) - 1)")).otherwise(F.concat(F.lit('{"event":'), F.col("payload")))
    tail = F.format_string(',"content_hash":"%s","prev_hash":"%s","hmac":"%s"}', "content_hash", "prev_hash", "hmac")
    return chain.withColumn("line", F.concat(head, tail))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit(spark.read.text(path).withColumnRenamed("value", "line"))


def append_audit(chain: DataFrame, path: str) -> None:
    render_audit(chain).sortWithinPartitions("log_id", "seq").select("line").write.mode("append").text(path)


def unquoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Enum columns that are stored as JSON strings, without their quotes."""
    return df.withColumns({c: F.regexp_replace(c, '^"|"$', "") for c in columns})


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return unquoted(spark.read.parquet(path), ["state", "tool", "execution_class"])


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    return unquoted(spark.read.parquet(path), ["capability"]).withColumn("expires_at", F.to_timestamp("expires_at"))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """platform, user_id, name, tier, line_no from JSON lines."""
    return spark.read.schema("platform string, user_id string, name string, tier string, line_no long").option("mode", "FAILFAST").json(path)


def write_sanitized(df: DataFrame, path: str, id_col: str = "content_id") -> None:
    """Adds the tables of sanitized rows (clean, reports, findings, quarantine), which appear together: epochs.committed() reads them."""
    with held(df, "sanitized") as done:
        epochs.commit(content.outputs(done, id_col), path, f"batch-{uuid.uuid4().hex}", 0)


# streams: files are read once, as they come; a line that is no row is set aside in `bad` instead of failing the batch


def _lines(spark: SparkSession, path: str, files_at_once: int) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).load(path).filter(F.trim("value") != "")


def stream_content(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """content_id, body of payload files as they come; fetch stubs are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(path)
    return raw.select(F.col("path").alias("content_id"), F.col("content").alias("body")).filter(~_is_stub(F.col("body")))


def stream_episodes(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Episodes and `bad`: the line, where it is no JSON object of these fields."""
    row = F.from_json("value", f"{EPISODE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = _lines(spark, path, files_at_once).select("value", row.alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    return rows.withColumn("bad", F.when(bad, F.col("value"))).select("r.*", "bad").drop("_bad")


def stream_audit(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """read_audit() as lines come, and `bad`: the line, where it is no chained entry."""
    rows = parse_audit(_lines(spark, path, files_at_once).withColumnRenamed("value", "line"))
    whole = (F.coalesce("payload", F.lit("")) != "") & F.col("content_hash").isNotNull() & F.col("prev_hash").isNotNull() & F.col("hmac").isNotNull()
    return rows.withColumn("bad", F.when(~whole, F.col("line")))
