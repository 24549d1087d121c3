"""Policy: classification, principals, zones, grants, fatigue, decisions, domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake import rules
from guardlake.config import FatigueConfig
from guardlake.functions.ordered import fields, scan_in_order

TIERS = {"T0": 0, "T1": 1, "T2": 2, "T3": 3}


def tier_of(name: Column, strict: bool = False) -> Column:
    """0 to 3 for T0 to T3 in any case. Another name is null, or, if strict, fails the query; a null name is null."""
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.upper(name)]
    return F.when(name.isNotNull() & tier.isNull(), F.raise_error(F.concat(F.lit("unknown tier: "), name)).cast("int")).otherwise(tier) if strict else tier


@dataclass(frozen=True)
class Dimensions:
    """The policy's tables, each small by nature; what is not given is the catalogue of `rules`.

    actions: action, capability, required_tier, requires_grant, resource_param, needs_sanitizing; origins: origin_kind, zone,
    default_ceiling; transitions: zone, target_zone, least_ceiling.
    """

    actions: DataFrame | None = None
    origins: DataFrame | None = None
    transitions: DataFrame | None = None

    def of(self, name: str, spark: SparkSession) -> DataFrame:
        given = getattr(self, name)
        return F.broadcast(getattr(rules, name)(spark) if given is None else given)


def classify_actions(requests: DataFrame, dims: Dimensions = Dimensions()) -> DataFrame:
    """requests with capability, required_tier, requires_grant, resource_param, needs_sanitizing; all null for unknown actions."""
    return requests.join(dims.of("actions", requests.sparkSession), "action", "left")


def resource_scope(classified: DataFrame, params: str = "params") -> DataFrame:
    """With resource: the parameter that the action acts on, or null."""
    return classified.withColumn("resource", F.when(F.col("resource_param").isNotNull(), F.col(params)[F.col("resource_param")]))


def ceilings_from_allowlist(allowlist: DataFrame) -> DataFrame:
    """(platform, user_id) with its ceiling; of repeated rows the last by order wins, an unknown tier is T1."""
    w = Window.partitionBy("platform", "user_id").orderBy(F.desc("line_no"))
    rows = allowlist.withColumn("place", F.row_number().over(w)).filter("place = 1")
    return rows.select("platform", "user_id", F.coalesce(tier_of(F.col("tier")), F.lit(1)).alias("ceiling"))


def resolve_principal(requests: DataFrame, overrides: DataFrame | None = None, postures: DataFrame | None = None, dims: Dimensions = Dimensions()) -> DataFrame:
    """With principal, zone, ceiling, posture. Overrides are by (platform, user_id) and hold for chat origins only."""
    kind = F.col("origin_kind")
    out = requests.join(dims.of("origins", requests.sparkSession), "origin_kind", "left")
    name = (
        F.when(kind == "LocalCli", "local").when(kind == "BridgeTelegram", F.concat(F.lit("telegram:"), F.col("user_id"))).when(kind == "BridgeSlack", F.concat(F.lit("slack:"), F.col("user_id")))
        .when(kind == "AgentGenerated", F.concat(F.lit("agent:"), F.col("user_id"))).when(kind == "SystemHeartbeat", "system:heartbeat").otherwise(F.col("user_id"))
    )
    platform = F.when(kind == "BridgeTelegram", "telegram").when(kind == "BridgeSlack", "slack")
    out = out.withColumns({"principal": name, "platform": platform})
    if overrides is not None:
        out = out.join(overrides, ["platform", "user_id"], "left").withColumn("default_ceiling", F.coalesce("ceiling", "default_ceiling")).drop("ceiling")
    if postures is not None:
        out = out.join(postures, "principal", "left")
    else:
        out = out.withColumn("posture", F.lit(None).cast("string"))
    return out.withColumnRenamed("default_ceiling", "ceiling").withColumn("posture", F.coalesce("posture", F.lit("Trusted")))


def effective_ceiling(ceiling: Column, posture: Column) -> Column:
    """Degraded principals are held to T0; revoked ones have none."""
    return F.when(posture == "Revoked", -1).when(posture == "Degraded", F.least(ceiling, F.lit(0))).otherwise(ceiling)


def zone_check(resolved: DataFrame, dims: Dimensions = Dimensions()) -> DataFrame:
    """With target_zone and zone_ok: the transition is listed and the ceiling is enough."""
    target = F.when(F.col("required_tier") >= 3, "HostPrivileged").otherwise("ControlPlane")
    out = resolved.withColumn("target_zone", target).join(dims.of("transitions", resolved.sparkSession), ["zone", "target_zone"], "left")
    return out.withColumn("zone_ok", F.coalesce(F.col("effective") >= F.col("least_ceiling"), F.lit(False))).drop("least_ceiling")


def covers(scope: Column, resource: Column) -> Column:
    """An unscoped grant covers all; a scoped one its resource and, by whole components, what is below it."""
    return scope.isNull() | F.coalesce((resource == scope) | resource.startswith(F.concat(F.rtrim(scope, F.lit("/")), F.lit("/"))), F.lit(False))


def scope_keys(resource: Column) -> Column:
    """What covers a resource: no scope (''), the resource itself ('='), a path above it, by whole components ('<')."""
    parts = F.split(resource, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("<"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(resource.isNull(), F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit(""), F.concat(F.lit("="), resource)), above))


def match_grants(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """request_id, grant_id: the newest issued grant that is valid at the request's time.

    Requests meet grants by principal, capability and scope, each by equality. Of the grants of one such key only those
    matter that outlast all issued after them; among these the one that ends next after the request is the newest.
    """
    key = ["principal", "capability", "scope_key"]
    usable = grants.filter(F.col("max_uses").isNull() | (F.col("uses") < F.col("max_uses")))
    scopes = F.when(F.col("scope").isNull(), F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("="), F.col("scope")), F.concat(F.lit("<"), F.rtrim(F.col("scope"), F.lit("/")))))
    g = usable.select("grant_id", "principal", "capability", F.explode(scopes).alias("scope_key"), "expires_at", "issued_at")
    newer = Window.partitionBy(*key).orderBy(F.desc("issued_at"), F.desc("grant_id")).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_later", F.max("expires_at").over(newer)).filter(F.col("_later").isNull() | (F.col("expires_at") > F.col("_later")))
    ends = g.select(*key, F.col("expires_at").alias("at"), F.lit(1).alias("turn"), F.struct("issued_at", "grant_id").alias("grant"))
    asked = requests.select("request_id", "principal", "capability", F.explode(scope_keys(F.col("resource"))).alias("scope_key"), F.col("ts").alias("at"), F.lit(0).alias("turn"))
    asked = asked.join(ends.select(*key).distinct(), key, "left_semi")
    # from the latest time back, a request before what ends at that very time: the last end seen is the next one
    back = Window.partitionBy(*key).orderBy(F.desc("at"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(ends, allowMissingColumns=True).withColumn("grant", F.last("grant", ignorenulls=True).over(back))
    return both.filter("turn = 0 and grant is not null").groupBy("request_id").agg(F.max("grant").alias("grant")).select("request_id", "grant.grant_id")


def grant_row(grants: DataFrame) -> DataFrame:
    """grants as rows that grant_step() takes: by principal and capability, at the time of issue."""
    left = (F.col("max_uses") - F.col("uses")).cast("long").alias("left")
    return grants.select("principal", "capability", F.lit(0).alias("turn"), F.unix_micros("issued_at").alias("at"), F.col("grant_id").cast("string").alias("id"), "grant_id", "scope", F.unix_micros("expires_at").alias("until"), left)


def grant_step(state: list[list] | None, row: dict) -> tuple[list[list], object]:
    """The usable grants after a row, newest first, each as [grant_id, scope, until, left, issued]; and the grant that a request spends, or None.

    A row is a grant (turn 0) or a request (turn 1); requests come in order of time. A scope covers its resource and, by whole
    components, what is below it. A grant serves from its issue until it ends or has no use left.
    """
    state, now = state or [], row["at"]
    if row["turn"] == 0:
        if row["until"] > now and (row["left"] is None or row["left"] > 0):
            place = next((i for i, g in enumerate(state) if (g[4], g[0]) < (now, row["grant_id"])), len(state))
            state.insert(place, [row["grant_id"], row["scope"], row["until"], row["left"], now])
        return state, None
    state, resource = [g for g in state if g[2] > now], row["resource"]
    for i, g in enumerate(state):
        if g[4] <= now and (g[1] is None or (resource is not None and (resource == g[1] or resource.startswith(g[1].rstrip("/") + "/")))):
            if g[3] is not None:
                g[3] -= 1
                if g[3] == 0:
                    del state[i]
            return state, g[0]
    return state, None


def consume_grants(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """request_id, grant_id: requests spend uses in time order; a spent grant gives way to the next newest. Grants serve from
    their issue on; rows of one time are taken grants first, then by id."""
    asked = requests.select("principal", "capability", F.lit(1).alias("turn"), F.unix_micros("ts").alias("at"), F.col("request_id").cast("string").alias("id"), "request_id", "resource")

    def spend(state, row):
        state, grant = grant_step(state, row)
        return state, None if grant is None else {"request_id": row["request_id"], "grant_id": grant}

    both = asked.unionByName(grant_row(grants), allowMissingColumns=True)
    schema = T.StructType([requests.schema["request_id"], grants.schema["grant_id"]])
    return scan_in_order(both, ["principal", "capability"], ["at", "turn", "request_id", "id"], spend, schema)


def fatigue_step(times: list[float], state: tuple[list[float], float | None], config: FatigueConfig) -> tuple[list[str], tuple[list[float], float | None]]:
    """Levels of requests at these times, in order, on top of a state of recent times and the last high-risk one."""
    recent, high = state
    out = []
    for now in times:
        if high is not None and int(now - high) < config.cooldown_seconds:
            out.append("Cooldown")
            continue
        recent = [t for t in recent if t >= now - config.window_seconds] + [now]
        if len(recent) > config.threshold:
            high = now
            out.append("HighRisk")
        else:
            out.append("Warning" if len(recent) > config.threshold // 2 else "Normal")
    return out, (recent, high)


def fatigue(requests: DataFrame, key: str = "guard_key", config: FatigueConfig = FatigueConfig()) -> DataFrame:
    """request_id, level of each request, in time order for each key. Order-dependent: one key is one task's work, in a stream."""

    def step(state, row):
        (level,), state = fatigue_step([row["at"] / 1e6], state or ([], None), config)
        return state, {"request_id": row["request_id"], "level": level}

    rows = requests.select("request_id", key, F.unix_micros("ts").alias("at"))
    return scan_in_order(rows, [key], ["at", "request_id"], step, fields(rows, "request_id", level=T.StringType()))


def fatigue_rate(requests: DataFrame, key: str = "principal", config: FatigueConfig = FatigueConfig()) -> DataFrame:
    """With recent: how many requests of the key lie in the window that ends at each one. No feedback; for monitoring."""
    width = config.window_seconds * 1_000_000
    at = F.unix_micros("ts")
    # Periods of the window's length: a window meets its row's own period and the one before. A row counts from its time on in its own
    # period, and as a row that leaves in the next one, so a period is a running sum, and a key's work is many tasks'.
    rows = requests.withColumns({"_at": at, "_from": at - F.pmod(at, F.lit(width)), "_in": F.lit(1), "_out": F.lit(0)})
    gone = requests.filter(at.isNotNull()).select(key, (at + width + 1).alias("_at"), (at - F.pmod(at, F.lit(width)) + width).alias("_from"), F.lit(0).alias("_in"), F.lit(1).alias("_out"))
    period = Window.partitionBy(key, "_from")
    to_now = period.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(gone, allowMissingColumns=True)
    recent = F.sum(F.col("_in") - F.col("_out")).over(to_now) + F.sum("_out").over(period)
    return both.withColumn("recent", recent).filter("_in = 1").drop("_at", "_from", "_in", "_out")


def checked(requests: DataFrame, overrides: DataFrame | None = None, postures: DataFrame | None = None, guard_key: str | None = None, dims: Dimensions = Dimensions()) -> DataFrame:
    """requests with what decides before grants: capability, tier, principal, effective ceiling, zone_ok and, if a guard
    key is named, the fatigue level of requests from T2 on that passed the others."""
    r = placed(requests, overrides, postures, dims)
    if not guard_key:
        return r.withColumn("level", F.lit(None).cast("string"))
    return r.join(fatigue(r.filter(is_guarded()), guard_key), "request_id", "left")


def placed(requests: DataFrame, overrides: DataFrame | None = None, postures: DataFrame | None = None, dims: Dimensions = Dimensions()) -> DataFrame:
    """requests with all that depends on the row and the dimensions alone: no state, so on a stream too."""
    r = resource_scope(classify_actions(requests, dims))
    r = resolve_principal(r, overrides, postures, dims).withColumn("effective", effective_ceiling(F.col("ceiling"), F.col("posture")))
    return zone_check(r, dims)


def is_guarded() -> Column:
    """Of placed rows, those that fatigue looks at: from T2 on, and not denied before."""
    tier = F.col("required_tier")
    return F.coalesce((F.col("posture") != "Revoked") & (tier <= F.col("effective")) & F.col("zone_ok") & (tier >= 2), F.lit(False))


def is_asking() -> Column:
    """Of checked rows, those that only a grant can allow: nothing denied them, and neither a human nor, below T3, the local origin approved."""
    tier, origin = F.col("required_tier"), F.col("origin_kind")
    passed = (F.col("posture") != "Revoked") & (tier <= F.col("effective")) & F.col("zone_ok") & ~F.coalesce(F.col("level").isin("Cooldown", "HighRisk"), F.lit(False))
    return F.coalesce(passed & ((tier >= 2) | F.col("requires_grant")) & (origin != "HumanApproved") & ((tier >= 3) | (origin != "LocalCli")), F.lit(False))


def asks_grants(checked: DataFrame) -> DataFrame:
    return checked.filter(is_asking())


def evaluate(requests: DataFrame, grants: DataFrame, overrides: DataFrame | None = None, postures: DataFrame | None = None, guard_key: str | None = None, dims: Dimensions = Dimensions()) -> DataFrame:
    """request_id, decision (Allow, Deny, NeedsApproval, Error, Unknown), reason.

    Order: revoked, tier, zone (an error, not a denial), fatigue from T2 on if a guard key is named, then approval:
    T3 and up need a human or a grant; T2, and what always needs a grant, also pass from the local origin. A request
    that a grant allows spends one use of it, in time order.
    """
    r = checked(requests, overrides, postures, guard_key, dims)
    return decided(r.join(consume_grants(asks_grants(r), grants), "request_id", "left"))


def decided(r: DataFrame) -> DataFrame:
    """The decision on checked rows with the grant_id that they spend, or null."""
    human, tier = F.col("origin_kind") == "HumanApproved", F.col("required_tier")
    step = (
        F.when(F.col("capability").isNull() | F.col("zone").isNull(), "Unknown:unknown action or origin")
        .when(F.col("posture") == "Revoked", "Deny:revoked").when(tier > F.col("effective"), "Deny:tier").when(~F.col("zone_ok"), "Error:zone")
        .when(F.col("level").isin("Cooldown", "HighRisk"), "Deny:fatigue")
        .when((tier >= 3) & (human | F.col("grant_id").isNotNull()), "Allow:").when(tier >= 3, "NeedsApproval:tier 3+")
        .when(((tier >= 2) | F.col("requires_grant")) & (human | (F.col("origin_kind") == "LocalCli") | F.col("grant_id").isNotNull()), "Allow:")
        .when((tier >= 2) | F.col("requires_grant"), "NeedsApproval:tier 2").otherwise("Allow:")
    )
    return r.select("request_id", "action", "origin_kind", "principal", "ts", F.split(step, ":")[0].alias("decision"), F.split(step, ":")[1].alias("reason"))


def evaluate_result(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """request_id, decision: where sanitizing of a type is asked for, a report of that very type must exist."""
    out = requests.join(reports, "request_id", "left")
    ok = F.col("required_type").isNull() | F.col("report_type").eqNullSafe(F.col("required_type"))
    return out.select("request_id", F.when(ok, "Allow").otherwise("Deny").alias("decision"), F.when(~ok & F.col("report_type").isNull(), "report missing").when(~ok, "type mismatch").otherwise("").alias("reason"))


def is_usable(now: Column) -> Column:
    """A grant that is neither expired nor used up."""
    return (F.col("expires_at") > now) & (F.col("max_uses").isNull() | (F.col("uses") < F.col("max_uses")))


def cleanup_grants(grants: DataFrame, now: Column) -> DataFrame:
    """The grants that are neither expired nor used up."""
    return grants.filter(is_usable(now))


def cleanup_report(grants: DataFrame, now: Column) -> DataFrame:
    """One row: kept, removed, and of the removed how many had expired and how many were used up but not expired."""
    gone, late = ~F.coalesce(is_usable(now), F.lit(False)), F.col("expires_at") <= now
    return grants.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"), F.count_if(gone & late).alias("expired"), F.count_if(gone & ~late).alias("used_up"))


def upsert_grants(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new by grant_id; a grant in both keeps what it is and takes uses, expires_at and max_uses."""
    taken = ["uses", "expires_at", "max_uses"]
    b = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    both = old.join(b, F.col("grant_id") == F.col("n_grant_id"), "full_outer")
    has_new = F.col("n_grant_id").isNotNull()
    return both.select(*[(F.when(has_new, F.col(f"n_{c}")).otherwise(F.col(c)) if c in taken else F.when(F.col("grant_id").isNotNull(), F.col(c)).otherwise(F.col(f"n_{c}"))).alias(c) for c in old.columns])


def domain_allowed(requests: DataFrame, allowlist: DataFrame, host: str = "host") -> DataFrame:
    """requests with allowed: no raw address; an entry equals the host, or begins with a dot and covers its domain and all below."""
    h = F.lower(F.col(host))
    raw = h.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") | h.contains(":") | h.startswith("[")
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    listed = allowlist.select(F.lower("entry").alias("entry")).distinct()
    tried = requests.select(host).distinct().select(host, F.explode(F.concat(F.array(h), suffixes)).alias("entry"))
    hit = tried.join(listed, "entry", "left_semi").select(host).distinct().withColumn("_hit", F.lit(True))
    return requests.join(hit, host, "left").withColumn("allowed", ~raw & F.coalesce("_hit", F.lit(False))).drop("_hit")


def parse_proxy_line(line: Column) -> Column:
    """struct(method, host, port, path) of a proxy request line, or null."""
    part = lambda i: F.get(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), F.lit(i))
    connect = F.upper(part(0)) == "CONNECT"
    authority = F.when(connect, part(1)).when(part(1).startswith("http://"), F.regexp_extract(part(1), "^http://([^/]*)", 1))
    path = F.when(~connect, F.coalesce(F.nullif(F.regexp_extract(part(1), "^http://[^/]*(/.*)$", 1), F.lit("")), F.lit("/")))
    has_port = authority.contains(":")
    host = F.when(has_port, F.regexp_extract(authority, r"(?s)^(.*):[^:]*$", 1)).otherwise(authority)
    number = F.regexp_extract(authority, r"(?s)^.*:([^:]*)$", 1)
    port = F.when(has_port, F.when(number.rlike(r"^\+?[0-9]+$"), F.ltrim(number, F.lit("+")).try_cast("int"))).when(~connect, 80)
    ok = part(2).isNotNull() & (part(2) != "") & F.coalesce(host != "", F.lit(False)) & F.coalesce(port.between(0, 65535), F.lit(False))
    return F.when(ok, F.struct(F.when(connect, "CONNECT").otherwise(part(0)).alias("method"), host.alias("host"), port.alias("port"), path.alias("path")))


def decision_rollup(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision", "action", "origin_kind").agg(F.count("*").alias("n"))
