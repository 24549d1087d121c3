"""The streaming forms: keyed state, sources that set bad rows aside, late rows, and sinks whose tables appear together.

Event time replaces the clock. A stateful job takes a key's rows of a micro-batch in order of time, on top of its state, so
where micro-batches are cut changes nothing as long as rows come in order of time. What is kept for a key is
small (a few times, grants, one hash, open windows) and goes when the watermark or a day without rows has passed it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from guardlake.config import ContentConfig, FatigueConfig, RateConfig
from guardlake.functions.hashing import content_hash
from guardlake.functions.steps import held, written
from guardlake.operators import audit, content, messages, policy, sessions
from guardlake.sources import epochs, files

STATE_TTL_MS = 24 * 3600 * 1000
#: Rows later than this behind the newest are late.
DELAY = "1 hour"
_NEVER_US = 2**62


#: Rows that a key's result is given back in at a time.
_OUT_ROWS = 10_000
#: Groups of the rows that need no state and only pass through.
_PASSING = 256


def _plain(pdf: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a frame as tuples; missing values are None."""
    return zip(*[[None if v is None or v != v else v for v in pdf[c].tolist()] for c in pdf.columns])


def _in_order(rows: Iterator[pd.DataFrame], *order: str) -> Iterator[dict]:
    """The rows of a key in a micro-batch, in order; nulls first. Missing values are None. They are held as tuples and given one by one."""
    held, names = [], []
    for pdf in rows:
        names = list(pdf.columns)
        held.extend(_plain(pdf))
    places = [names.index(c) for c in order] if held else []
    held.sort(key=lambda row: tuple((row[i] is not None, row[i]) for i in places))
    return (dict(zip(names, row)) for row in held)


def _frames(out: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most _OUT_ROWS rows; none if there are no rows."""
    while piece := list(islice(out, _OUT_ROWS)):
        yield pd.DataFrame(piece, columns=columns)


def _lane(df: DataFrame, stateful: Column, keys: list[str]) -> DataFrame:
    """df with `lane`: 0 for rows that meet their key's state. The others have no key, and are dealt to a few groups that are as
    many whatever the keys are, as each group costs some milliseconds."""
    keyless = F.lit(1) + F.pmod(F.xxhash64("order"), F.lit(_PASSING)).cast("int")
    lane = df.withColumn("lane", F.when(stateful, 0).otherwise(keyless))
    return lane.withColumns({k: F.when(F.col("lane") == 0, F.col(k)) for k in keys})


class _Held(StatefulProcessor):
    """One JSON value for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string")

    def load(self):
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def save(self, value) -> None:
        self.state.update((json.dumps(value),))

    def close(self) -> None:
        pass


class _Steps(_Held):
    """Runs a step function over a key's rows in time order. State goes when the watermark is a day past the key's last row."""

    def __init__(self, id_col: str, out: str, step, config, kind):
        self.id_col, self.out, self.step, self.config, self.kind = id_col, out, step, config, kind

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", self.id_col])
        times = (pdf.ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()
        held = self.load() or {"last": 0, "state": None}
        found, state = self.step(times, held["state"], self.config)
        last = max(held["last"], int(times[-1] * 1000))
        self.save({"last": last, "state": state})
        self.handle.registerTimer(last + STATE_TTL_MS)
        yield pd.DataFrame({self.id_col: pdf[self.id_col], self.out: found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.load()
        if held and held["last"] + STATE_TTL_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame({self.id_col: pd.Series(dtype=self.kind), self.out: pd.Series(dtype=object)})


def _fatigue(times, state, config):
    return policy.fatigue_step(times, tuple(state) if state else ([], None), config)


def _stateful(df: DataFrame, key: str, id_col: str, out: str, kind: str, step, config) -> DataFrame:
    rows = df.select(id_col, key, "ts").withWatermark("ts", DELAY)
    id_kind = df.schema[id_col].dataType.simpleString()
    steps = _Steps(id_col, out, step, config, object if id_kind == "string" else "int64")
    return rows.groupBy(key).transformWithStateInPandas(steps, f"{id_col} {id_kind}, {out} {kind}", "Append", "EventTime")


def fatigue(requests: DataFrame, key: str = "guard_key", config: FatigueConfig = FatigueConfig()) -> DataFrame:
    """request_id, level of a stream of requests."""
    return _stateful(requests, key, "request_id", "level", "string", _fatigue, config)


def rate_limit(stream: DataFrame, key: str = "sender", config: RateConfig = RateConfig()) -> DataFrame:
    """message_id, allowed of a stream of messages."""
    return _stateful(stream, key, "message_id", "allowed", "boolean", messages.rate_step, config)


def message_rate(stream: DataFrame, key: str = "sender", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Messages of each key in calendar windows, emitted when the watermark has passed them."""
    return messages.message_rate(stream.withWatermark("ts", late), key, width)


def new_updates(stream: DataFrame, source: str = "source", id_col: str = "update_id", late: str = "1 hour") -> DataFrame:
    """Each update once, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([source, id_col])


# grants and decisions


class _Grants(_Held):
    """Requests spend grants: state is a key's usable grants, newest first; a timer at each one's end drops it.

    Rows are grants (turn 0) and requests (turn 1). Requests that ask for nothing have a lane other than 0 and pass through,
    in any order.
    """

    def _keep(self, grants: list, row: dict | None = None) -> None:
        if grants:
            self.save(grants)
        elif self.state.exists():
            self.state.clear()
        if row is not None and row["until"] < _NEVER_US:
            self.handle.registerTimer(int(row["until"]) // 1000 + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        grants = self.load()
        for row in _in_order(iter([initialState]), "at", "id"):
            grants, _ = policy.grant_step(grants, row)
            self._keep(grants, row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0]:
            for pdf in rows:
                yield pdf[["ts", "body", "grant_id"]]
            return
        yield from _frames(self._spend(rows), ["ts", "body", "grant_id"])

    def _spend(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        grants = self.load()
        met = bool(grants)  # only then, or with a new grant, a row can change the state
        for row in _in_order(rows, "at", "turn", "order", "id"):
            grants, spent = policy.grant_step(grants, row)
            if row["turn"] == 0:
                met = True
                self._keep(grants, row)
            else:
                yield row["ts"], row["body"], spent
        if met:
            self._keep(grants)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        grants = self.load()
        if grants is not None:
            self._keep([g for g in grants if g[2] // 1000 >= expiredTimerInfo.getExpiryTimeInMs()])
        return iter(())


_GRANT_ROW = ["principal", "capability", "turn", "at", "id", "grant_id", "scope", "until", "left"]


def _spending(asked: DataFrame, grants: DataFrame | None, new_grants: DataFrame | None, delay: str | None) -> DataFrame:
    """ts, body, grant_id of a stream of requests (principal, capability, ts, order, asks, resource, body)."""
    none = {"grant_id": "string", "scope": "string", "until": "long", "left": "long"}
    rows = asked.select("principal", "capability", F.lit(1).alias("turn"), F.unix_micros("ts").alias("at"), F.lit(None).cast("string").alias("id"), "ts", "order", "asks", "resource", "body", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    if new_grants is not None:
        given = policy.grant_row(new_grants).withColumns({"until": F.coalesce("until", F.lit(_NEVER_US)), "ts": F.timestamp_micros("at"), "order": F.lit(None).cast("long"), "asks": F.lit(False), "resource": F.lit(None).cast("string"), "body": F.lit(None).cast("string")})
        rows = rows.unionByName(given.withColumn("grant_id", F.col("grant_id").cast("string")))
    if delay:
        rows = rows.withWatermark("ts", delay)
    key = ["lane", "principal", "capability"]
    start = policy.grant_row(grants).withColumns({"until": F.coalesce("until", F.lit(_NEVER_US)), "grant_id": F.col("grant_id").cast("string"), "lane": F.lit(0)}).select("lane", *_GRANT_ROW).groupBy(*key) if grants is not None else None
    return _lane(rows, (F.col("turn") == 0) | F.col("asks"), key[1:]).groupBy(*key).transformWithStateInPandas(_Grants(), "ts timestamp, body string, grant_id string", "Append", "EventTime", initialState=start, eventTimeColumnName="ts")


def consume_grants(requests: DataFrame, grants: DataFrame | None = None, new_grants: DataFrame | None = None, delay: str = DELAY) -> DataFrame:
    """request_id (as text), grant_id of a stream of requests (request_id, principal, capability, resource, ts) that spend grants.

    `grants` is a table that is there when the stream begins, `new_grants` a stream of more; both serve from their issue on. The result is
    policy.consume_grants()'s for any cut of the input into micro-batches, if rows come in order of time. Grants that have ended
    leave the state by timers.
    """
    asked = requests.select("principal", "capability", "ts", F.col("request_id").cast("long").alias("order"), F.lit(True).alias("asks"), "resource", F.col("request_id").cast("string").alias("body"))
    return _spending(asked, grants, new_grants, delay).filter("grant_id is not null").select(F.col("body").alias("request_id"), "grant_id")


class _Tired(_Held):
    """The fatigue level of a principal's guarded rows; the others have a lane other than 0 and pass through. State goes once no row can feel it."""

    def __init__(self, config: FatigueConfig):
        self.config = config

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["ts", "order", "body", "level"]
        if key[0]:
            for pdf in rows:
                yield pdf[columns[:3]].assign(level=None)
            return
        yield from _frames(self._levels(rows), columns)

    def _levels(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        state, last = self.load(), 0
        for row in _in_order(rows, "at", "order"):
            (level,), state = _fatigue([row["at"] / 1e6], state, self.config)
            last = row["at"]
            yield row["ts"], row["order"], row["body"], level
        self.save(state)
        self.handle.registerTimer(last // 1000 + 1000 * (max(self.config.window_seconds, self.config.cooldown_seconds) + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        reach = 1000 * (max(self.config.window_seconds, self.config.cooldown_seconds) + 1)
        if state and max([*state[0], state[1] or 0]) * 1000 + reach <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())


def evaluate(requests: DataFrame, grants: DataFrame, overrides: DataFrame | None = None, postures: DataFrame | None = None, dims: policy.Dimensions = policy.Dimensions(), fatigue_config: FatigueConfig = FatigueConfig(), delay: str = DELAY) -> DataFrame:
    """request_id, action, origin_kind, principal, ts, decision, reason of a stream of requests (request_id long, ...).

    Two stateful operators in a row under one watermark: fatigue by principal, then grants by principal and capability; between them
    a row's columns travel as one JSON value. The decisions are those of policy.evaluate() with guard_key 'principal', for any cut of the
    input, if rows come in order of time.
    """
    keep = ["request_id", "action", "origin_kind", "principal", "capability", "required_tier", "requires_grant", "effective", "zone", "zone_ok", "posture", "resource"]
    placed = policy.placed(requests.withWatermark("ts", delay), overrides, postures, dims)
    types = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in keep)
    rows = placed.select("principal", "ts", F.unix_micros("ts").alias("at"), F.col("request_id").cast("long").alias("order"), policy.is_guarded().alias("guarded"), F.to_json(F.struct(*keep)).alias("body"))
    tired = _lane(rows, F.col("guarded"), ["principal"]).groupBy("lane", "principal").transformWithStateInPandas(_Tired(fatigue_config), "ts timestamp, order long, body string, level string", "Append", "EventTime", eventTimeColumnName="ts")
    read = tired.select("ts", "order", "level", "body", F.from_json("body", types).alias("r")).select("ts", "order", "level", "body", "r.*")
    asked = read.select("principal", "capability", "ts", "order", policy.is_asking().alias("asks"), "resource", F.to_json(F.struct("level", "body")).alias("body"))
    spent = _spending(asked, grants, None, None)
    outer = F.from_json("body", "level string, body string")
    back = spent.select("ts", "grant_id", outer.alias("o")).select("ts", "grant_id", "o.level", F.from_json("o.body", types).alias("r")).select("ts", "grant_id", "level", "r.*")
    return policy.decided(back)


# audit logs


class _Chain(_Held):
    """The last hash of a log."""

    def __init__(self, key: bytes):
        self.secret = key

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.save(initialState["hmac"].iloc[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self._linked(rows), ["log_id", "seq", "payload", "content_hash", "prev_hash", "hmac"])

    def _linked(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        head = self.load() or audit.GENESIS
        for row in _in_order(rows, "seq"):
            mac = audit.chained(self.secret, row["content_hash"], head)
            yield row["log_id"], row["seq"], row["payload"], row["content_hash"], head, mac
            head = mac
        self.save(head)


def build_chain(entries: DataFrame, key: bytes, heads: DataFrame | None = None) -> DataFrame:
    """audit.build_chain() of a stream of entries (log_id, seq, payload) that come in order of seq; heads (log_id, hmac) are where logs stand."""
    hashed = entries.select("log_id", "seq", "payload", content_hash(F.col("payload")).alias("content_hash"))
    start = heads.select("log_id", "hmac").groupBy("log_id") if heads is not None else None
    kinds = {c: entries.schema[c].dataType.simpleString() for c in ("log_id", "seq")}
    schema = f"log_id {kinds['log_id']}, seq {kinds['seq']}, payload string, content_hash string, prev_hash string, hmac string"
    return hashed.groupBy("log_id").transformWithStateInPandas(_Chain(key), schema, "Append", "None", initialState=start)


def append_audit(entries: DataFrame, key: bytes, path: str, checkpoint: str):
    """A started query that appends a stream of entries to the logs at path, as chained lines (log_id, seq, line).

    A query with a new checkpoint goes on from the heads of what is there; one with an old checkpoint from its state. A repeated epoch
    writes its folder anew, so no entry stands twice.
    """
    spark = entries.sparkSession
    before = read_chain(spark, path)
    kind = entries.schema["log_id"].dataType.simpleString()
    heads = spark.createDataFrame([], f"log_id {kind}, hmac string") if before is None else audit.chain_head(before).select(F.col("log_id").cast(kind), "hmac")
    made = build_chain(entries, key, written(heads, "audit-heads"))
    return epochs.start(made, lambda batch: {"lines": files.render_audit(batch).select("log_id", "seq", "line")}, path, checkpoint)


def read_chain(spark: SparkSession, path: str) -> DataFrame | None:
    """log_id, seq, payload, content_hash, prev_hash, hmac of the logs at path; None if there are none."""
    lines = epochs.committed(spark, path, "lines")
    return None if lines is None else files.parse_audit(lines).select("log_id", "seq", "payload", "content_hash", "prev_hash", "hmac")


# idle cycles


class _Idle(_Held):
    """How many idle cycles a log has behind it, in a row."""

    def __init__(self, n: int):
        self.n = n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self._fires(key[0], rows), ["key", "cycle", "fires"])

    def _fires(self, key, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        run = self.load() or 0
        for row in _in_order(rows, "cycle"):
            run = run + 1 if row["running"] == 0 and row["error"] == 0 else 0
            yield key, row["cycle"], run > 0 and run % self.n == 0
        self.save(run)


def idle_trigger(cycles: DataFrame, n: int = 3, key: str = "log_id") -> DataFrame:
    """key, cycle, fires of a stream of cycles (cycle, running, error): sessions.idle_trigger() for runs that cross micro-batches."""
    kinds = {c: cycles.schema[c].dataType.simpleString() for c in (key, "cycle")}
    out = cycles.select(F.col(key).alias("key"), "cycle", "running", "error").groupBy("key").transformWithStateInPandas(_Idle(n), f"key {kinds[key]}, cycle {kinds['cycle']}, fires boolean", "Append", "None")
    return out.withColumnRenamed("key", key)


# late rows


class _Windows(_Held):
    """Counts of a key's open windows; a timer at each one's end emits it. Rows behind the watermark come out as they are."""

    def __init__(self, width_us: int):
        self.width = width_us

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, windows, late = timerValues.getCurrentWatermarkInMs() * 1000, self.load() or {}, []
        for row in _in_order(rows, "at"):
            if row["at"] < passed:
                late.append((key[0], row["at"], None, row["body"]))
                continue
            begin = row["at"] // self.width * self.width
            if str(begin) not in windows:
                windows[str(begin)] = 0
                self.handle.registerTimer((begin + self.width) // 1000)
            windows[str(begin)] += 1
        self.save(windows)
        yield from _frames(iter(late), ["key", "at", "n", "body"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows, begin = self.load() or {}, expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.width
        n = windows.pop(str(begin), None)
        self.save(windows) if windows else self.state.clear()
        yield pd.DataFrame([] if n is None else [(key[0], begin, n, None)], columns=["key", "at", "n", "body"])


def rates_and_late(stream: DataFrame, key: str = "sender", width_seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """key, at, n, body: counts of calendar windows (n of the window that begins at `at`, in microseconds), emitted when the watermark
    has passed them, and rows that came behind the watermark (n null; body is the row as JSON).

    The time goes in as a plain number, as Spark leaves rows behind the watermark out of what it knows as event time.
    """
    rows = stream.withWatermark("ts", delay)
    rows = rows.select(F.col(key).alias("key"), F.unix_micros("ts").alias("at"), F.to_json(F.struct(*[F.unix_micros("ts").alias("ts_us"), *[c for c in stream.columns if c != "ts"]])).alias("body"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(_Windows(width_seconds * 1_000_000), f"key {kind}, at long, n long, body string", "Append", "EventTime")


def rates_to(stream: DataFrame, path: str, checkpoint: str, key: str = "sender", width_seconds: int = 60, delay: str = "10 minutes"):
    """A started query that commits `rates` and `late`: every row is counted in a window or stands in `late`, once."""

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        return {
            "rates": batch.filter("n is not null").select(F.col("key").alias(key), F.timestamp_micros("at").alias("begin"), "n"),
            "late": batch.filter("n is null").select(F.col("key").alias(key), F.timestamp_micros("at").alias("ts"), F.col("body").alias("row")),
        }

    return epochs.start(rates_and_late(stream, key, width_seconds, delay), split, path, checkpoint)


# the sanitizer


def sanitize_to(stream: DataFrame, path: str, checkpoint: str, config: ContentConfig = ContentConfig(), id_col: str = "content_id"):
    """A started query that sanitizes each micro-batch once and commits clean, reports, findings and quarantine together."""
    run = epochs.run_of(checkpoint)

    def write(batch: DataFrame, epoch: int) -> None:
        with held(content.sanitize(batch, config, id_col), "sanitized") as done:
            epochs.commit(content.outputs(done, id_col), path, run, epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# sources


def bad_rows_to(stream: DataFrame, name: str, path: str, checkpoint: str):
    """A started query of a stream with a column `bad` (the line that is no row, or null) that commits `name` and `bad`."""
    make: Callable = lambda batch: {name: batch.filter("bad is null").drop("bad"), "bad": batch.filter("bad is not null").select(F.col("bad").alias("line"))}
    return epochs.start(stream, make, path, checkpoint)
