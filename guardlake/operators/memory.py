"""Memory: episodes, recurring candidates, promotion, staleness, archival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.config import MemoryConfig
from guardlake.functions.text import norm_key

MARK = "guardlake"


def filter_episodes(episodes: DataFrame, session=None, kind=None, tag=None, since=None, until=None) -> DataFrame:
    """since is inclusive, until exclusive, a tag must be equal to one of the episode's."""
    tests = ((session, lambda v: F.col("session_id") == v), (kind, lambda v: F.col("kind") == v), (tag, lambda v: F.array_contains("tags", v)), (since, lambda v: F.col("ts") >= F.lit(v)), (until, lambda v: F.col("ts") < F.lit(v)))
    for value, test in tests:
        if value is not None:
            episodes = episodes.filter(test(value))
    return episodes


def search(episodes: DataFrame, learnings: DataFrame, query: str) -> DataFrame:
    """kind ('episode' or 'learning') and text of what holds the query, in any case."""
    q = query.lower()
    has = F.contains(F.lower("summary"), F.lit(q)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q)))
    return episodes.filter(has).select(F.lit("episode").alias("kind"), F.col("summary").alias("text")).unionByName(learnings.filter(F.contains(F.lower("text"), F.lit(q))).select(F.lit("learning").alias("kind"), "text"))


def memory_stats(episodes: DataFrame, learnings: DataFrame) -> DataFrame:
    """name, n: episodes, sessions, episodes by kind, learnings, stale learnings."""
    total = episodes.agg(F.count("*").alias("episodes"), F.count_distinct("session_id").alias("sessions"))
    kinds = episodes.groupBy(F.concat(F.lit("kind:"), F.col("kind")).alias("name")).agg(F.count("*").alias("n"))
    held = learnings.agg(F.count("*").alias("learnings"), F.count_if("stale").alias("stale"))
    flat = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("x.*")
    return flat(total).unionByName(kinds).unionByName(flat(held))


def candidates(episodes: DataFrame) -> DataFrame:
    """key, sessions, last_seen, text: candidate learnings by key; the text is the first line of the latest date."""
    c = episodes.filter("kind = 'CandidateLearning'").withColumns({"key": norm_key(F.col("summary")), "day": F.to_date("ts")})
    return c.groupBy("key").agg(F.count_distinct("session_id").alias("sessions"), F.max("day").alias("last_seen"), F.max_by("summary", F.struct("day", -F.col("line_no"))).alias("text"))


def promote(found: DataFrame, learnings: DataFrame, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The candidates that recur in enough sessions and are not yet learnt, in the form of learnings."""
    known = learnings.select(norm_key(F.col("text")).alias("key")).distinct()
    new = found.join(known, "key", "left_anti").filter(F.col("sessions") >= config.promotion_sessions)
    return new.select("text", F.col("sessions").cast("int").alias("count"), "last_seen", F.lit(False).alias("stale"))


def reinforce(found: DataFrame, learnings: DataFrame) -> DataFrame:
    """learnings; the first of each key takes what a candidate of its key adds."""
    w = Window.partitionBy("key").orderBy("pos")
    rows = learnings.withColumn("key", norm_key(F.col("text"))).withColumn("place", F.row_number().over(w))
    hit = rows.join(found.select("key", F.col("sessions").cast("int").alias("c_sessions"), F.col("last_seen").alias("c_seen")), "key", "left")
    take = (F.col("place") == 1) & F.col("c_sessions").isNotNull()
    return hit.select("pos", "text", F.when(take, F.greatest("count", "c_sessions")).otherwise(F.col("count")).alias("count"), F.when(take, F.greatest("last_seen", "c_seen")).otherwise(F.col("last_seen")).alias("last_seen"), F.when(take, F.lit(False)).otherwise(F.col("stale")).alias("stale"))


def mark_stale(learnings: DataFrame, now: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    """Learnings not seen for long are stale; those never dated are never."""
    old = F.coalesce(F.col("last_seen") < F.date_sub(F.to_date(now), config.stale_days), F.lit(False))
    return learnings.withColumn("stale", F.col("stale") | old)


def archive(episodes: DataFrame, now: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The episodes that are past retention."""
    return episodes.filter(F.col("ts") < now - F.expr(f"interval {config.archive_days} days"))


def consolidate(episodes: DataFrame, learnings: DataFrame, now: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The learnings after one pass: reinforced, joined by promoted ones, then marked stale. A second pass changes nothing."""
    found = candidates(episodes)
    kept = reinforce(found, learnings).select("text", "count", "last_seen", "stale")
    return mark_stale(kept.unionByName(promote(found, learnings, config)), now, config)


def consolidation_report(episodes: DataFrame, learnings: DataFrame, now: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    """One row about a pass: promoted, marked_stale, archived, and a summary line that says so."""
    found = candidates(episodes)
    new = promote(found, learnings, config)
    before = reinforce(found, learnings).select("text", "count", "last_seen", "stale").unionByName(new).withColumn("was", F.col("stale"))
    turned = mark_stale(before, now, config).filter("stale and not was")
    kinds = [("promoted", new), ("marked_stale", turned), ("archived", archive(episodes, now, config))]
    each = [df.select(F.lit(name).alias("kind")) for name, df in kinds]
    counts = each[0].unionByName(each[1]).unionByName(each[2]).agg(*[F.count_if(F.col("kind") == name).alias(name) for name, _ in kinds])
    return counts.withColumn("summary", F.format_string("promoted %d, marked %d stale, %d episodes for archival", "promoted", "marked_stale", "archived"))


def parse_learnings(lines: DataFrame, mark: str = MARK) -> DataFrame:
    """doc_id, pos, text, count, last_seen, stale from Markdown lines (doc_id, line_no, line): a bullet and, on the next line, its comment."""
    trimmed = lines.withColumn("t", F.trim("line"))
    follow = trimmed.withColumn("next", F.lead("t").over(Window.partitionBy("doc_id").orderBy("line_no")))
    bullets = follow.filter(F.startswith("t", F.lit("- ")))
    body = F.substring("t", 3, 2**31 - 1)
    stale = F.startswith(body, F.lit("[stale] "))
    meta = rf"^<!-- {mark}:(.*) -->$"
    inner = F.when(F.col("next").rlike(meta), F.regexp_extract("next", meta, 1))
    number = F.regexp_extract(inner, r"(?:^|,)count=([^,]*)", 1)
    good = inner.isNotNull() & ((number == "") | number.rlike("^[0-9]+$"))
    count = F.when(good & (number != ""), number.cast("int")).otherwise(1)
    day = F.when(good, F.try_to_date(F.regexp_extract(inner, r"(?:^|,)last=([^,]*)", 1), "yyyy-MM-dd"))
    return bullets.select("doc_id", F.col("line_no").alias("pos"), F.when(stale, F.substring(body, 9, 2**31 - 1)).otherwise(body).alias("text"), count.alias("count"), day.alias("last_seen"), stale.alias("stale"))


def render_learnings(learnings: DataFrame, mark: str = MARK) -> DataFrame:
    """doc_id, markdown of learnings (doc_id, pos, text, count, last_seen, stale)."""
    comment = F.concat(F.lit(f"  <!-- {mark}:count="), F.col("count").cast("string"), F.lit(",last="), F.date_format("last_seen", "yyyy-MM-dd"), F.lit(" -->\n"))
    piece = F.concat(F.lit("\n- "), F.when(F.col("stale"), "[stale] ").otherwise(""), F.col("text"), F.lit("\n"), F.coalesce(comment, F.lit("")))
    rows = learnings.select("doc_id", F.struct("pos", piece.alias("piece")).alias("row"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["piece"]), "").alias("body")).select("doc_id", F.concat(F.lit("# Learnings\n"), F.col("body")).alias("markdown"))
