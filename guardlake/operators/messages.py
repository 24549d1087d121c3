"""Message intake: bots, identity, size, commands, rates, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.config import RateConfig
from guardlake.functions.ordered import fields, scan_in_order
from guardlake.functions.text import clip_reply, strip_invisible

MAX_MESSAGE_BYTES = 32 * 1024
COMMANDS = ("/status", "/sessions", "/check", "/send", "/help")


def author(messages: DataFrame) -> DataFrame:
    """messages with author: Person, Bot (by id, subtype or flag) or, for other event types and empty updates, null."""
    slack, telegram = (F.col("platform") == "slack") & (F.col("type") == "message"), (F.col("platform") == "telegram") & F.col("text").isNotNull()
    slack_bot = F.col("bot_id").isNotNull() | F.coalesce(F.col("subtype") == "bot_message", F.lit(False))
    bot = (slack & slack_bot) | (telegram & F.coalesce("from_is_bot", F.lit(False)))
    return messages.withColumn("author", F.when(bot, "Bot").when(slack | telegram, "Person"))


def drop_bots(messages: DataFrame) -> DataFrame:
    """What people wrote: no other event types, bot ids or bot subtypes."""
    return author(messages).filter("author = 'Person'").drop("author")


def resolve_identity(messages: DataFrame, allowlist: DataFrame) -> DataFrame:
    """messages with tier, and reject 'UnknownSender' for who is not on the list."""
    known = allowlist.select("platform", "user_id", F.col("tier").alias("user_tier")).dropDuplicates(["platform", "user_id"])
    out = messages.join(known.withColumn("_known", F.lit(True)), ["platform", "user_id"], "left")
    return out.withColumn("reject", F.when(F.col("_known").isNull(), "UnknownSender")).drop("_known")


def intake(messages: DataFrame, most: int = MAX_MESSAGE_BYTES, text: str = "text") -> DataFrame:
    """With clean, is_command and, where there is no reject yet, reject 'MessageTooLarge' by the bytes that are left."""
    clean = strip_invisible(F.col(text))
    out = messages.withColumn("clean", clean)
    reject = F.coalesce("reject", F.when(F.octet_length("clean") > most, "MessageTooLarge")) if "reject" in messages.columns else F.when(F.octet_length("clean") > most, "MessageTooLarge")
    return out.withColumns({"is_command": F.col("clean").startswith("/"), "reject": reject})


def parse_target(text: Column) -> Column:
    """struct(name, message) of '@name message' or '/send name message', or null."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    rest = F.when(t.startswith("@"), F.substring(t, 2, 2**31 - 1)).when(t.startswith("/send "), F.regexp_replace(F.substring(t, 7, 2**31 - 1), r"(?U)^\s+", ""))
    name = F.substring_index(rest, " ", 1)
    message = F.when(F.contains(rest, F.lit(" ")), F.regexp_replace(F.regexp_replace(rest, "^[^ ]* ", ""), r"(?U)^\s+|\s+$", "")).otherwise("")
    return F.when(name != "", F.struct(name.alias("name"), message.alias("message")))


def parse_command(text: Column) -> Column:
    """struct(command, name, message); command is 'unknown' for others."""
    part = lambda i: F.trim(F.coalesce(F.get(F.split(text, " ", 3), F.lit(i)), F.lit("")))
    head = F.get(F.split(text, " ", 3), F.lit(0))
    return F.struct(F.when(head.isin(*COMMANDS), head).otherwise("unknown").alias("command"), part(1).alias("name"), part(2).alias("message"))


def rate_step(times: list[float], state: list | None, config: RateConfig) -> tuple[list[bool], list]:
    """Which messages at these times pass, in order; windows begin at the first message after the last one ended."""
    out = []
    minute, hour, in_minute, in_hour = state or (None, None, 0, 0)
    for now in times:
        minute, hour = (now, now) if minute is None else (minute, hour)
        if int(now - minute) >= 60:
            minute, in_minute = now, 0
        if int(now - hour) >= 3600:
            hour, in_hour = now, 0
        ok = in_minute < config.per_minute and in_hour < config.per_hour
        in_minute, in_hour = in_minute + ok, in_hour + ok
        out.append(ok)
    return out, [minute, hour, in_minute, in_hour]


def rate_limit(messages: DataFrame, key: str = "sender", config: RateConfig = RateConfig()) -> DataFrame:
    """message_id, allowed. Rows with a null key bypass the limit."""

    def step(state, row):
        (ok,), state = rate_step([row["at"] / 1e6], state, config)
        return state, {"message_id": row["message_id"], "allowed": ok}

    rows = messages.filter(F.col(key).isNotNull()).select("message_id", key, F.unix_micros("ts").alias("at"))
    keyed = scan_in_order(rows, [key], ["at", "message_id"], step, fields(rows, "message_id", allowed=T.BooleanType()))
    return keyed.unionByName(messages.filter(F.col(key).isNull()).select("message_id", F.lit(True).alias("allowed")))


def message_rate(messages: DataFrame, key: str = "sender", width: str = "1 minute") -> DataFrame:
    """Messages of each key in calendar windows."""
    return messages.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def redact(text: Column, secrets: list[str]) -> Column:
    for s in sorted(secrets, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text


def intake_outcomes(messages: DataFrame, allowlist: DataFrame, most: int = MAX_MESSAGE_BYTES, key: str = "sender", config: RateConfig = RateConfig()) -> DataFrame:
    """outcome, n: every message once, as Bot, Ignored (no message), UnknownSender, MessageTooLarge, RateLimited or Accepted.

    Only messages that nothing else rejected count against a sender's limits.
    """
    by = author(messages)
    people = intake(resolve_identity(by.filter("author = 'Person'").drop("author"), allowlist), most)
    limited = people.filter("reject is null").join(rate_limit(people.filter("reject is null"), key, config), "message_id", "left")
    outcomes = (
        by.filter("author is null or author <> 'Person'").select(F.when(F.col("author") == "Bot", "Bot").otherwise("Ignored").alias("outcome"))
        .unionByName(people.filter("reject is not null").select(F.col("reject").alias("outcome")))
        .unionByName(limited.select(F.when(F.col("allowed"), "Accepted").otherwise("RateLimited").alias("outcome")))
    )
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def only_new(updates: DataFrame, state: DataFrame, source: str = "source", id_col: str = "update_id") -> tuple[DataFrame, DataFrame]:
    """The updates beyond each source's highest seen id, and the state after them."""
    fresh = updates.join(state, source, "left").filter(F.col("last_id").isNull() | (F.col(id_col) > F.col("last_id"))).drop("last_id")
    after = state.unionByName(fresh.select(source, F.col(id_col).alias("last_id"))).groupBy(source).agg(F.max("last_id").alias("last_id"))
    return fresh, after


def reply_events(replies: DataFrame, text: str = "text") -> DataFrame:
    """message_id, payload: the audit event of each reply, with its lengths."""
    clean = F.length(strip_invisible(F.col(text)))
    sent = F.length(clip_reply(F.col(text)))
    fields = F.struct(F.length(text).alias("text_len"), (clean > 4096).alias("truncated"), clean.alias("normalized_len"), sent.alias("sent_len"))
    return replies.select("message_id", F.to_json(F.struct(F.lit("reply").alias("event"), fields.alias("fields"))).alias("payload"))
