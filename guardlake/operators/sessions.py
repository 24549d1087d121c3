"""Session health: signals, live states, changes, reconciliation, escalation, titles, forests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import rules
from guardlake.functions.steps import written
from guardlake.functions.text import strip_ansi, tail_lines

STATES = ("Running", "Waiting", "Idle", "Error", "Stopped")
WAIT_SECONDS = 600


def signals(output: Column, patterns=rules.STATUS_PATTERNS) -> Column:
    """States that the tail of an output speaks of, in the table's order."""
    tail = F.array_join(tail_lines(output), "\n")
    return F.array_compact(F.array(*[F.when(tail.rlike(p), F.lit(s)) for s, p in patterns]))


def signal_rows(outputs: DataFrame, patterns: DataFrame, id_col: str = "session_id") -> DataFrame:
    """id_col, position, kind (Completion or Status), state, confidence, summary (what matched): a row for each signal in the last 20
    lines of an output (tool, output), in the order of its tool's patterns.

    patterns is as rules.signal_patterns(): a small table; those of 'default' serve the tools without any. A null output has no signals.
    Outputs meet the patterns of their tool by equality, one at a time.
    """
    own = patterns.select("tool").distinct().withColumn("_own", F.lit(True))
    tail = F.array_join(tail_lines(strip_ansi(F.col("output"))), "\n")
    rows = outputs.join(F.broadcast(own), "tool", "left").select(id_col, F.when(F.col("_own"), F.col("tool")).otherwise("default").alias("tool"), tail.alias("_tail"))
    held = patterns.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "state", "confidence", "pattern"))).alias("_patterns"))
    found = rows.join(F.broadcast(held), "tool").select(id_col, "_tail", F.explode("_patterns").alias("p"))
    found = found.select(id_col, "p.position", "p.kind", "p.state", "p.confidence", F.regexp_substr(F.col("_tail"), F.col("p.pattern")).alias("summary"))
    return found.filter("summary is not null")


def tool_missing(output: Column) -> Column:
    return F.exists(tail_lines(output, 10), lambda line: F.contains(line, F.lit(rules.TOOL_MISSING[0])) | F.contains(line, F.lit(rules.TOOL_MISSING[1])) | F.contains(line, F.lit(rules.TOOL_MISSING[2])))


def live_state(stored: DataFrame, outputs: DataFrame) -> DataFrame:
    """session_id, live: Error without a runtime row, else the first signal of its output, else Running."""
    out = stored.select("session_id").join(outputs, "session_id", "left")
    first = F.get(signals(strip_ansi(F.col("output"))), F.lit(0))
    return out.select("session_id", F.when(F.col("output").isNull(), "Error").otherwise(F.coalesce(first, F.lit("Running"))).alias("live"))


def live_state_by_tool(stored: DataFrame, outputs: DataFrame, patterns: DataFrame) -> DataFrame:
    """live_state with the patterns of each session's tool, from a table (tool, position, state, pattern)."""
    tables = patterns.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("position", "state", "pattern"))).alias("own"))
    default = tables.filter("tool = 'default'").select(F.col("own").alias("common"))
    out = stored.select("session_id", "tool").join(outputs, "session_id", "left").join(F.broadcast(tables), "tool", "left").join(F.broadcast(default), F.lit(True), "left")
    tail = F.array_join(tail_lines(strip_ansi(F.col("output"))), "\n")
    out = out.select("session_id", "output", tail.alias("tail"), F.coalesce("own", "common").alias("table"))
    first = F.get(F.filter("table", lambda p: F.regexp_like(F.col("tail"), p["pattern"])), F.lit(0))["state"]
    return out.select("session_id", F.when(F.col("output").isNull(), "Error").otherwise(F.coalesce(first, F.lit("Running"))).alias("live"))


def with_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.join(live, "session_id", "left").withColumn("live", F.coalesce("live", F.lit("Error")))


def _now(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stopped sessions are not probed."""
    return with_live(stored, live).withColumn("now", F.when(F.col("state") == "Stopped", F.col("state")).otherwise(F.col("live")))


def heartbeat(stored: DataFrame, live: DataFrame) -> DataFrame:
    """One row: total, and a count of each state."""
    return _now(stored, live).agg(F.count("*").alias("total"), *[F.count_if(F.col("now") == s).alias(s.lower()) for s in STATES])


def needs_attention(stored: DataFrame, live: DataFrame) -> DataFrame:
    """session_id, title of the sessions that are in error or wait, a row for each."""
    return _now(stored, live).filter(F.col("now").isin("Error", "Waiting")).select("session_id", "title")


def status_report(beat: DataFrame, needs: DataFrame) -> DataFrame:
    """part (0 for the head, 1 for a session that needs attention) and line, a row for each line of the report."""
    parts = F.array_compact(F.array(*[F.when(F.col(s.lower()) > 0, F.concat(F.col(s.lower()).cast("string"), F.lit(f" {s.lower()}"))) for s in STATES]))
    head = F.concat(F.lit("[STATUS] "), F.col("total").cast("string"), F.lit(" sessions"), F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise(""), F.lit("."))
    return beat.select(F.lit(0).alias("part"), head.alias("line")).unionByName(needs.select(F.lit(1).alias("part"), F.concat(F.lit("NEED: "), F.col("title"), F.lit(" - needs attention")).alias("line")))


def state_changes(stored: DataFrame, live: DataFrame) -> DataFrame:
    seen = with_live(stored, live).filter(F.col("state") != "Stopped")
    return seen.filter(~F.col("state").eqNullSafe(F.col("live"))).select("session_id", "title", F.col("state").alias("old_state"), F.col("live").alias("new_state"))


def reconcile(stored: DataFrame, live: DataFrame) -> DataFrame:
    """session_id, old_state, new_state, reason of the corrections."""
    seen = with_live(stored, live)
    up = lambda c: F.col(c).isin("Running", "Waiting", "Idle")
    to = lambda state, why: F.struct(F.lit(state).alias("new_state"), F.lit(why).alias("reason"))
    # The reasons' texts.
    fix = (
        F.when(up("state") & (F.col("live") == "Error"), to("Error", "runtime session not found"))
        .when((F.col("state") == "Running") & (F.col("live") == "Stopped"), to("Stopped", "runtime reports session stopped"))
        .when((F.col("state") == "Stopped") & up("live"), to("Running", "runtime session is alive but stored as stopped"))
    )
    return seen.withColumn("fix", fix).filter("fix is not null").select("session_id", F.col("state").alias("old_state"), "fix.new_state", "fix.reason")


def escalate(sessions: DataFrame, wait: int = WAIT_SECONDS, phrases=rules.DECISION_PHRASES) -> DataFrame:
    """session_id, priority, reason. Phrases are looked for in the lower-cased output as they stand in the table."""
    low = F.lower(F.col("output"))
    hit = F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases])
    to = lambda priority, reason: F.struct(F.lit(priority).alias("priority"), reason.alias("reason"))
    # The reasons' texts.
    why = (
        F.when(F.col("state") == "Error", to("High", F.lit("session is in error state")))
        .when((F.col("state") == "Waiting") & hit.isNotNull(), to("High", F.concat(F.lit('output contains decision-request pattern: "'), hit, F.lit('"'))))
        .when((F.col("state") == "Waiting") & (F.col("waiting_seconds") >= wait), to("Medium", F.concat(F.lit("waiting for "), F.floor(F.col("waiting_seconds") / 60).cast("string"), F.lit(" minutes"))))
    )
    return sessions.withColumn("why", why).filter("why is not null").select("session_id", "why.priority", "why.reason")


def change_episodes(changes: DataFrame) -> DataFrame:
    """Episodes of sessions that went from work to rest."""
    done = changes.filter((F.col("old_state") == "Running") & F.col("new_state").isin("Waiting", "Idle"))
    return done.select("session_id", F.lit("ActionCompleted").alias("kind"), F.concat("title", F.lit(": "), F.lower("old_state"), F.lit(" -> "), F.lower("new_state")).alias("summary"))


def idle_trigger(cycles: DataFrame, n: int = 3, key: str = "log_id") -> DataFrame:
    """cycles with fires: true at every n-th cycle in a row without running or failed sessions."""
    idle = (F.col("running") == 0) & (F.col("error") == 0)
    w = Window.partitionBy(key).orderBy("cycle")
    rows = cycles.withColumns({"idle": idle, "island": F.sum((~idle).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    place = F.sum(F.col("idle").cast("int")).over(Window.partitionBy(key, "island").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("fires", F.col("idle") & (place % n == 0)).drop("idle", "island")


def dedup_titles(sessions: DataFrame) -> DataFrame:
    """session_id, title: the oldest keeps a title, others take the smallest free ' (N)' from 2 on, in order of age."""
    w = Window.partitionBy("title").orderBy("created_at", "session_id")
    ranked = sessions.withColumns({"place": F.row_number().over(w), "size": F.count("*").over(Window.partitionBy("title"))})
    parsed = sessions.select(F.regexp_extract("title", r"(?s)^(.*) \(([0-9]+)\)$", 1).alias("title"), F.regexp_extract("title", r"(?s)^(.*) \(([0-9]+)\)$", 2).alias("n")).filter("n <> '' and n not like '0%'")
    used = parsed.select("title", F.col("n").try_cast("int").alias("n")).distinct().filter("n >= 2")
    wanted = ranked.filter("size > 1").groupBy("title").agg(F.max("size").alias("size")).join(used.groupBy("title").agg(F.count("*").alias("taken")), "title", "left")
    free = wanted.select("title", F.explode(F.sequence(F.lit(2), F.col("size").cast("int") + F.coalesce("taken", F.lit(0)).cast("int"))).alias("n")).join(used, ["title", "n"], "left_anti")
    free = free.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy("n")) + 1)
    out = ranked.join(free, ["title", "place"], "left")
    return out.select("session_id", F.when(F.col("n").isNotNull(), F.concat("title", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"))


def _steps(sessions: DataFrame) -> DataFrame:
    return sessions.filter("parent_id is not null and parent_id <> session_id").select("session_id", F.col("parent_id").alias("ancestor_id"))


def ancestors(sessions: DataFrame) -> DataFrame:
    """session_id, ancestor_id, depth (the least, in a cycle), by self-joins that double their reach until no new pair appears."""
    found, reach = written(_steps(sessions).distinct().withColumn("depth", F.lit(1)), "ancestors"), 1
    while True:
        ahead = found.select(F.col("session_id").alias("ancestor_id"), F.col("ancestor_id").alias("far"), F.col("depth").alias("more"))
        further = found.filter(F.col("depth") == reach).join(ahead, "ancestor_id").select("session_id", F.col("far").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth"))
        further = further.groupBy("session_id", "ancestor_id").agg(F.min("depth").alias("depth")).join(found, ["session_id", "ancestor_id"], "left_anti")
        further = written(further, "ancestors")
        if further.isEmpty():
            return found
        found, reach = found.unionByName(further), reach * 2


def in_cycles(sessions: DataFrame) -> DataFrame:
    """session_id of the sessions in cycles of two or more: where jumps land whose reach is more than there are sessions.

    Each session keeps its one target; chains that end drop out.
    """
    jumps, reach, count = written(_steps(sessions).distinct(), "jumps"), 1, sessions.count()
    while reach <= count and not jumps.isEmpty():
        on = jumps.select(F.col("session_id").alias("ancestor_id"), F.col("ancestor_id").alias("far"))
        jumps, reach = written(jumps.join(on, "ancestor_id").select("session_id", F.col("far").alias("ancestor_id")).distinct(), "jumps"), reach * 2
    return jumps.select(F.col("ancestor_id").alias("session_id")).distinct()


def parent_errors(sessions: DataFrame) -> DataFrame:
    """session_id, error: own parent, missing parent, or a cycle (a session among its own ancestors)."""
    own = sessions.filter("parent_id = session_id").select("session_id", F.lit("self-parent").alias("error"))
    missing = sessions.filter("parent_id is not null").join(sessions.select(F.col("session_id").alias("parent_id")), "parent_id", "left_anti").select("session_id", F.lit("missing parent").alias("error"))
    cycle = in_cycles(sessions).select("session_id", F.lit("cycle").alias("error"))
    return own.unionByName(missing).unionByName(cycle)


def resolve_sessions(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """ref, session_id, status: by title, else id, else an unambiguous id prefix in any case.

    Ids are counted by prefix before refs meet them, so neither an empty ref nor ids that begin alike make pairs.
    """
    least = lambda by, rank, key: sessions.groupBy(by.alias("key")).agg(F.min("session_id").alias("session_id"), F.count_distinct("session_id").alias("n")).join(refs.select("ref", key.alias("key")).distinct(), "key").select("ref", "session_id", "n", F.lit(rank).alias("rank"))
    by_title = least(F.col("title"), 1, F.col("ref"))
    by_id = least(F.col("session_id"), 2, F.col("ref"))
    ids = sessions.select("session_id").distinct().select("session_id", F.lower("session_id").alias("id"))
    heads = ids.select("session_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("id")), lambda k: F.left(F.col("id"), k))).alias("head"))
    heads = heads.groupBy("head").agg(F.min("session_id").alias("session_id"), F.count("*").alias("n"))
    by_prefix = refs.select("ref", F.lower("ref").alias("head")).distinct().join(heads, "head").select("ref", "session_id", "n", F.lit(3).alias("rank"))
    best = by_title.unionByName(by_id).unionByName(by_prefix).groupBy("ref").agg(F.min_by(F.struct("session_id", "n", "rank"), "rank").alias("b"))
    out = refs.select("ref").distinct().join(best, "ref", "left")
    many = (F.col("b.rank") == 3) & (F.col("b.n") > 1)
    return out.select("ref", F.when(~many, F.col("b.session_id")).alias("session_id"), F.when(F.col("b").isNull(), "not found").when(many, "ambiguous").otherwise("ok").alias("status"))


def list_sessions(sessions: DataFrame, state: str | None = None) -> DataFrame:
    return (sessions if state is None else sessions.filter(F.col("state") == state)).orderBy("created_at", "session_id")


def groups(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("group_id").isNotNull()).select("group_id").distinct().orderBy("group_id")


def status_counts(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES])
