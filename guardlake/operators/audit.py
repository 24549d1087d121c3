"""Hash-chained audit logs: building is sequential in a log, verifying is parallel in it."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.functions.hashing import GENESIS, content_hash, hmac_sha256
from guardlake.functions.ordered import fields, scan_in_order


def chained(key: bytes, own_hash: str, prev: str) -> str:
    """The hash of an entry that follows the one with hash prev."""
    return hmac.new(key, (own_hash + prev).encode(), hashlib.sha256).hexdigest()


def build_chain(entries: DataFrame, key: bytes, heads: DataFrame | None = None) -> DataFrame:
    """entries (log_id, seq, payload) with content_hash, prev_hash, hmac; from `heads` (log_id, hmac) on, else from genesis."""
    hashed = entries.select("log_id", "seq", "payload", content_hash(F.col("payload")).alias("content_hash"))
    if heads is not None:
        hashed = hashed.join(heads.select("log_id", F.col("hmac").alias("head")), "log_id", "left")
    else:
        hashed = hashed.withColumn("head", F.lit(None).cast("string"))

    def link(prev, row):
        prev = prev or row["head"] or GENESIS
        mac = chained(key, row["content_hash"], prev)
        return mac, {**{c: row[c] for c in ("log_id", "seq", "payload", "content_hash")}, "prev_hash": prev, "hmac": mac}

    return scan_in_order(hashed, ["log_id"], ["seq"], link, fields(hashed, "log_id", "seq", "payload", "content_hash", prev_hash=T.StringType(), hmac=T.StringType()))


#: Entries of one log that are looked at together: a log is cut into runs of so many sequence numbers.
RUN = 100_000


def _runs(entries: DataFrame) -> Column:
    return F.floor(F.col("seq") / RUN)


def verify_entries(chain: DataFrame, key: bytes) -> DataFrame:
    """chain with content_ok, prev_ok, hmac_ok, from stored values only, so entries of one log are checked apart.

    The entry before is found inside a run of sequence numbers; only each run's last hash goes on to the next one.
    """
    rows = chain.withColumn("_run", _runs(chain))
    inside = F.lag("hmac").over(Window.partitionBy("log_id", "_run").orderBy("seq"))
    ends = rows.groupBy("log_id", "_run").agg(F.max_by("hmac", "seq").alias("_end"))
    ends = ends.select("log_id", "_run", F.lag("_end").over(Window.partitionBy("log_id").orderBy("_run")).alias("_before"))
    first = F.row_number().over(Window.partitionBy("log_id", "_run").orderBy("seq")) == 1
    rows = rows.withColumns({"_inside": inside, "_first": first}).join(ends, ["log_id", "_run"])
    before = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_inside"))
    return rows.select(
        *chain.columns,
        (F.col("content_hash") == content_hash(F.col("payload"))).alias("content_ok"),
        (F.col("prev_hash") == F.coalesce(before, F.lit(GENESIS))).alias("prev_ok"),
        (F.col("hmac") == hmac_sha256(F.concat("content_hash", "prev_hash"), key)).alias("hmac_ok"),
    )


def verify_summary(verified: DataFrame) -> DataFrame:
    """log_id, entries, valid (entries before the first break), broken_seq, reason (content, then prev, then hmac).

    Places are counted inside runs of sequence numbers, on top of the entries of the runs before.
    """
    reason = F.when(~F.col("content_ok"), "content").when(~F.col("prev_ok"), "prev").when(~F.col("hmac_ok"), "hmac")
    rows = verified.select("log_id", "seq", _runs(verified).alias("run"), reason.alias("reason"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("log_id", "run").orderBy("seq")) - 1)
    runs = rows.groupBy("log_id", "run").agg(F.count("*").alias("n"), F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "place", "reason"))).alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("log_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("log_id", "n", F.when(F.col("first").isNotNull(), F.struct(F.col("first.seq").alias("seq"), (earlier + F.col("first.place")).alias("place"), F.col("first.reason").alias("reason"))).alias("first"))
    out = runs.groupBy("log_id").agg(F.sum("n").alias("entries"), F.min("first").alias("first"))
    return out.select("log_id", "entries", F.coalesce("first.place", "entries").cast("long").alias("valid"), F.col("first.seq").alias("broken_seq"), F.col("first.reason").alias("reason"))


def chain_head(chain: DataFrame) -> DataFrame:
    """log_id, hmac of each log's last entry; logs without entries begin at genesis."""
    return chain.groupBy("log_id").agg(F.max_by("hmac", "seq").alias("hmac"))


def audit_events(decisions: DataFrame, sanitized: DataFrame | None = None) -> DataFrame:
    """request_id, stage, ts, session_id, decision, payload: one event for each decision but allowed chat reads, and one more for each report.

    The payload has the request's id and time, a summary of action and origin, the decision with its reason, the session if the decisions
    have one, and in the second event the report. Fields that are null are left out.
    """
    reads = F.col("action").isin("ListSessions", "GetSessionStatus", "ReadSessionOutput", "ListGroups", "GetSystemStatus") & F.col("origin_kind").isin("BridgeTelegram", "BridgeSlack") & (F.col("decision") == "Allow")
    session = F.col("session_id").cast("string") if "session_id" in decisions.columns else F.lit(None).cast("string")
    rows = decisions.filter(~F.coalesce(reads, F.lit(False))).withColumn("session_id", session)
    own = ("request_id", F.unix_micros("ts").alias("ts_us"), "action", "origin_kind", "principal", "decision", F.nullif("reason", F.lit("")).alias("reason"), "session_id")
    event = lambda stage, *more: [F.lit(stage).alias("stage"), "ts", "session_id", "decision", F.to_json(F.struct(*own, *more)).alias("payload")]
    first = rows.select("request_id", *event(0))
    if sanitized is None:
        return first
    report = F.struct(*[F.col(f"_report.{c}") for c in sanitized.columns if c != "request_id"]).alias("report")
    reported = sanitized.select("request_id", F.struct(*[c for c in sanitized.columns if c != "request_id"]).alias("_report"))
    return first.unionByName(decisions.withColumn("session_id", session).join(reported, "request_id").select("request_id", *event(1, report)))


#: Folders of one day over which sessions are dealt.
SESSION_PARTS = 8


def _session_part(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(SESSION_PARTS)).cast("int")


def write_events(events: DataFrame, path: str) -> None:
    """Adds events (ts, session_id, ...) to a table in folders by day and, in a day, by a hash of the session."""
    laid = events.withColumns({"day": F.to_date("ts"), "part": _session_part(F.col("session_id"))})
    laid.repartition("day", "part").write.mode("append").partitionBy("day", "part").parquet(path)


def audit_search(events: DataFrame, since=None, until=None, session=None, decision=None) -> DataFrame:
    """The events from `since` on, before `until`, of a session, with a decision; what is None does not matter.

    On a table of write_events() only the days and the session's folders that can hold such events are read.
    """
    for value, test in ((since, F.col("ts") >= F.lit(since)), (until, F.col("ts") < F.lit(until)), (session, F.col("session_id") == F.lit(session)), (decision, F.col("decision") == F.lit(decision))):
        if value is not None:
            events = events.filter(test)
    if "day" in events.columns and "part" in events.columns:
        for value, test in ((since, F.col("day") >= F.to_date(F.lit(since))), (until, F.col("day") <= F.to_date(F.lit(until))), (session, F.col("part") == _session_part(F.lit(session)))):
            if value is not None:
                events = events.filter(test)
    return events
