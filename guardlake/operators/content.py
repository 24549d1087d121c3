"""Content safety: intake, routing, scanning, scoring, provenance, the sanitizer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import rules
from guardlake.config import ContentConfig
from guardlake.functions import text as X
from guardlake.functions.hashing import fingerprint, hmac_sha256
from guardlake.functions.steps import once, written
from guardlake.operators import formats

# What makes the first 1024 bytes an HTML document.
SNIFF = r"(?is)<!doctype(?:\z|[ \t\n\f\r]+(?:html(?:[ \t\n\f\r>/]|\z)|.{0,3}\z))|<html(?:[ \t\n\f\r>/]|\z)"
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:@]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(#.*)?$"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
#: Content types that have a cleaning job of their own.
FORMATS = ("Html", "Markdown", "Json")
#: A token that can hold one of the runs that rules look for.
LONG_LEAST = min(rules.BASE64_LEAST, rules.HEX_LEAST, rules.TOKEN_LEAST // 4)
LONG = r"[^ \t\n\r]{%d}" % LONG_LEAST


# intake


def size_guard(df: DataFrame, body: str = "body", most: int = ContentConfig.max_bytes) -> DataFrame:
    """df with reject_reason 'SizeExceeded' where the body has more bytes, before anything else looks at it."""
    return df.withColumn("reject_reason", F.when(F.octet_length(body) > most, "SizeExceeded"))


def utf8_guard(body: Column) -> Column:
    """True if the bytes are UTF-8; they are never repaired."""
    return F.is_valid_utf8(body.cast("string"))


def content_type_of(name: Column) -> Column:
    """The content type an alias stands for, or null."""
    out = F.lit(None).cast("string")
    for alias, kind in rules.CONTENT_TYPES.items():
        out = F.when(F.lower(name) == alias, kind).otherwise(out)
    return out


def html_root_sniff(body: Column) -> Column:
    return F.coalesce(F.decode(F.substring(body.cast("binary"), 1, 1024), "ISO-8859-1").rlike(SNIFF), F.lit(False))


def route(df: DataFrame, declared: str = "declared_type", body: str = "text") -> DataFrame:
    """df with content_type and routed_from: plain text that begins as HTML is treated as HTML."""
    lying = (F.col(declared) == "PlainText") & html_root_sniff(F.col(body))
    return df.withColumns({"content_type": F.when(lying, "Html").otherwise(F.col(declared)), "routed_from": F.when(lying, "PlainText")})


def canonical_source(url: Column, keep_query: bool = False) -> Column:
    """struct(kind, scheme, host, port, path, query, fragment, rendered): without userinfo, path parameters, default
    port and, unless kept, query and fragment. A URL without a host is kept as it is, with kind Other."""
    part = lambda i: F.regexp_extract(url, URL, i)
    ok = F.coalesce(url.rlike(URL), F.lit(False))
    scheme, host = F.lower(part(1)), F.lower(part(2))
    default = F.coalesce(F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])[scheme], F.lit(""))
    port = F.when((part(3) != "") & (part(3) != default), part(3))
    path = F.regexp_replace(part(4), r"(;|%3[Bb])[^/]*", "")
    path = F.when(path == "", "/").otherwise(path)
    query, fragment = (F.when(part(i) != "", part(i)) if keep_query else F.lit(None).cast("string") for i in (5, 6))
    whole = F.concat(scheme, F.lit("://"), host, F.coalesce(F.concat(F.lit(":"), port), F.lit("")), path, F.coalesce(query, F.lit("")), F.coalesce(fragment, F.lit("")))
    only = lambda c: F.when(ok, c)
    return F.struct(
        F.when(ok, "Url").otherwise("Other").alias("kind"), only(scheme).alias("scheme"), only(host).alias("host"), only(port).alias("port"),
        only(path).alias("path"), only(query).alias("query"), only(fragment).alias("fragment"), F.when(ok, whole).otherwise(url).alias("rendered"),
    )


def render_source(kind: Column, value: Column) -> Column:
    """How a source of each kind is written in headers."""
    return F.when(kind == "File", F.concat(F.lit("file://"), value)).when(kind == "Bridge", F.concat(F.lit("bridge://"), value)).otherwise(value)


def fetched(requests: DataFrame, landed: DataFrame, url: str = "url") -> DataFrame:
    """requests with body and fetched: the landed content (url, body) of the same canonical source; of several, the first by body."""
    key = lambda c: canonical_source(F.col(c))["rendered"]
    got = landed.groupBy(key("url").alias("_source")).agg(F.min("body").alias("body"))
    out = requests.withColumn("_source", key(url)).join(got, "_source", "left").drop("_source")
    return out.withColumn("fetched", F.col("body").isNotNull())


# scanning


def _finding(rule_id: str, severity: str, text: Column, sample: Column | None = None, at: Column | None = None) -> Column:
    if sample is None:
        return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("sample"))
    start = F.octet_length(F.left(text, at - 1))
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), start.alias("start"), (start + F.octet_length(sample)).alias("end"), preview(sample).alias("sample"))


def preview(sample: Column) -> Column:
    """Up to 64 bytes of whole characters, with an ellipsis if there was more."""
    cut = F.aggregate(
        F.split(F.left(sample, F.lit(rules.SAMPLE_BYTES)), ""),
        F.struct(F.lit("").alias("s"), F.lit(True).alias("go")),
        lambda acc, c: F.when(acc["go"] & (F.octet_length(acc["s"]) + F.octet_length(c) <= rules.SAMPLE_BYTES), F.struct(F.concat(acc["s"], c).alias("s"), F.lit(True).alias("go"))).otherwise(F.struct(acc["s"].alias("s"), F.lit(False).alias("go"))),
        lambda acc: acc["s"],
    )
    return F.when(F.octet_length(sample) <= rules.SAMPLE_BYTES, sample).otherwise(F.concat(cut, F.lit("…")))


def base64_run(text: Column) -> Column:
    """The first run of 40 or more base64 characters that has a lower-case letter and an upper-case one or a digit."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/=]{%d,}" % rules.BASE64_LEAST), F.lit(0))
    return F.get(F.filter(runs, lambda r: r.rlike("[a-z]") & r.rlike("[A-Z0-9]")), F.lit(0))


def hex_run(text: Column) -> Column:
    return F.regexp_substr(text, F.lit("[0-9A-Fa-f]{%d,}" % rules.HEX_LEAST))


def long_token(text: Column) -> Column:
    """The first token between blanks with 200 or more bytes."""
    return F.get(F.filter(F.split(text, "[ \t\n\r]"), lambda t: F.octet_length(t) >= rules.TOKEN_LEAST), F.lit(0))


def html_markers(text: Column) -> Column:
    openers = F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rules.HTML_OPENER), F.lit(1)), F.lower)))
    return text.rlike(rules.HTML_ROOT) | ((openers >= rules.HTML_OPENERS_LEAST) & (F.regexp_count(text, F.lit(rules.HTML_CLOSE)) >= rules.HTML_CLOSE_LEAST))


def collision(text: Column, sentinels: tuple[str, ...] = (rules.SENTINEL_START, rules.SENTINEL_END)) -> Column:
    hit = F.lit(False)
    for s in sentinels:
        hit = hit | text.contains(s)
    return hit


def _hit(text: Column, low: Column, rule: rules.Rule) -> Column:
    """The rule's pattern, tried only on texts that hold a string it needs."""
    hit = text.rlike(rule.pattern)
    return reduce(lambda a, b: a | b, [low.contains(x) for x in rule.needs]) & hit if rule.needs else hit


def has_long(text: Column) -> Column:
    """The text has a token that can hold a run. Most texts have no such stretch even between spaces alone, which is cheap to see."""
    return F.exists(F.split(text, " "), lambda part: F.octet_length(part) >= LONG_LEAST) & text.rlike(LONG)


def _runs(text: Column, long: Column) -> dict[str, Column]:
    """The runs of the three rules that look for them; only texts with a long token can have one."""
    return {rule_id: F.when(long, run) for rule_id, run in (("ENC-001", base64_run(text)), ("ENC-002", hex_run(text)), ("REP-001", long_token(text)))}


def _findings(text: Column, hits: list[Column], runs: dict[str, Column], marked: Column, mixed: Column, ratio: Column, catalogue, config: ContentConfig) -> Column:
    found = [F.when(hit, _finding(r.rule_id, r.severity, text, F.regexp_substr(text, F.lit(r.pattern)), F.regexp_instr(text, F.lit(r.pattern)))) for r, hit in zip(catalogue, hits)]
    found += [F.when(run.isNotNull(), _finding(rule_id, "Low", text, run, F.instr(text, run))) for rule_id, run in runs.items()]
    whole = (("MIX-001", "Medium", mixed), ("FMT-001", "Info", marked), ("REP-002", "Low", ratio >= F.lit(config.repetition_rule).cast("float")), ("WRP-001", "Info", collision(text)))
    return F.array_compact(F.array(*found, *[F.when(hit, _finding(rule_id, severity, text)) for rule_id, severity, hit in whole]))


def _marked(text: Column, content_type: Column | None) -> Column:
    plain = F.lit(True) if content_type is None else content_type.isin("PlainText", "Log")
    return plain & text.contains("<") & html_markers(text)


def scan(text: Column, content_type: Column | None = None, mixed: Column | None = None, catalogue=rules.REGEX_RULES, config: ContentConfig = ContentConfig()) -> Column:
    """The findings of a normalised text, in catalogue order: one expression, built from the rule table."""
    hits = [_hit(text, F.lower(text), r) for r in catalogue]
    mixed = X.has_mixed_script(text) if mixed is None else mixed
    return _findings(text, hits, _runs(text, has_long(text)), _marked(text, content_type), mixed, X.repetition_ratio(text), catalogue, config)


def scanned(df: DataFrame, content_type: Column | None = None, catalogue=rules.REGEX_RULES, config: ContentConfig = ContentConfig()) -> DataFrame:
    """normalised rows with findings and repetition_ratio. The projections follow one another, so that what several rules
    look at (the lower-cased text, each rule's hit, the long runs) is worked out once a row."""
    text, columns = F.col("cleaned"), df.columns
    df = df.withColumns({"_low": F.lower(text), "_long": has_long(text), "repetition_ratio": X.repetition_ratio(text)})
    hits = {f"_hit{i}": _hit(text, F.col("_low"), r) for i, r in enumerate(catalogue)}
    runs = {f"_run{i}": run for i, run in enumerate(_runs(text, F.col("_long")).values())}
    df = df.withColumns({**hits, **runs, "_marked": _marked(text, content_type)})
    named_runs = {rule_id: F.col(c) for rule_id, c in zip(_runs(text, text), runs)}
    found = _findings(text, [F.col(c) for c in hits], named_runs, F.col("_marked"), F.array_contains("categories", "mixed-script"), F.col("repetition_ratio"), catalogue, config)
    # a generator of one row: what is filtered or derived later cannot be put in place of the scan, which would repeat it
    return df.select(*columns, F.inline_outer(F.array(F.struct("repetition_ratio", found.alias("findings")))))


def explode_findings(df: DataFrame, findings: str = "findings") -> DataFrame:
    """A row for each finding. The outer form keeps the optimiser from making a filter of the whole scan of it."""
    keep = [c for c in df.columns if c != findings]
    return df.select(*keep, F.posexplode_outer(findings).alias("finding_no", "f")).filter("finding_no is not null").select(*keep, "finding_no", "f.*")


# scoring


def risk_score(findings: Column, stripped: Column, ratio: Column, config: ContentConfig = ContentConfig()) -> Column:
    """Weights of the distinct rules (the gravest severity of each), with bonuses, at most 100."""
    weight = F.create_map(*[F.lit(x) for kv in rules.SEVERITY_WEIGHT.items() for x in kv])
    ids = F.array_distinct(F.transform(findings, lambda f: f["rule_id"]))
    worst = lambda i: F.array_max(F.transform(F.filter(findings, lambda f: f["rule_id"] == i), lambda f: weight[f["severity"]]))
    total = F.aggregate(ids, F.lit(0), lambda n, i: n + worst(i))
    return F.least(F.lit(100), total + F.when(stripped > 0, 10).otherwise(0) + F.when(ratio >= F.lit(config.repetition_bonus_at).cast("float"), 15).otherwise(0))


def derive_flags(findings: Column, categories: Column) -> Column:
    has = lambda p: F.exists(findings, lambda f: f["rule_id"].startswith(p))
    # The flag of each rule family.
    families = (("INJ-", "injection_pattern"), ("ENC-", "encoded_payload"), ("REP-", "repetition"), ("MIX-", "mixed_script"), ("FMT-", "content_type_mismatch"), ("WRP-", "wrapper_collision"))
    base = F.array_compact(F.array(*[F.when(has(p), F.lit(n)) for p, n in families]))
    more = F.transform(F.filter(categories, lambda c: c != "mixed-script"), lambda c: F.concat(F.lit("normalize_"), F.replace(c, F.lit("-"), F.lit("_"))))
    return F.array_distinct(F.concat(base, more))


# provenance


def header_injection(**headers: Column) -> Column:
    """struct(field, offset) of the first header with a control character or line separator, or null. Offsets are bytes."""
    bad = "[\\x00-\\x1f\\x7f\u2028\u2029]"
    out = F.lit(None).cast("struct<field:string,offset:int>")
    for name, value in reversed(headers.items()):
        at = F.regexp_instr(value, F.lit(bad))
        out = F.when(at > 0, F.struct(F.lit(name).alias("field"), F.octet_length(F.left(value, at - 1)).alias("offset"))).otherwise(out)
    return out


def assign_nonce(content_id: Column, body: Column, config: ContentConfig = ContentConfig(), attempts: int = 5) -> Column:
    """16 hex digits that the body does not hold, from the id alone so that a repeated task gives the same; null if all fail."""
    tries = [F.left(hmac_sha256(F.concat(content_id.cast("string"), F.lit(f":{i}")), config.salt), F.lit(16)) for i in range(attempts)]
    return F.coalesce(*[F.when(~body.contains(t), t) for t in tries])


def wrap_provenance(body: Column, nonce: Column, source: Column, content_type: Column, flags: Column, rule_ids: Column) -> Column:
    head = F.concat(
        F.lit(rules.SENTINEL_START), nonce, F.lit(rules.SENTINEL_CLOSE + "\nsource: "), source, F.lit("\ncontent_type: "), content_type,
        F.lit("\nfetched_at: unknown\nflags: "), F.array_join(flags, ","), F.lit("\nrule_ids: "), F.array_join(rule_ids, ","), F.lit("\n---\n"),
    )
    return F.concat(head, body, F.when(body.endswith("\n"), "").otherwise("\n"), F.lit(rules.SENTINEL_END), nonce, F.lit(rules.SENTINEL_CLOSE))


def unwrap(wrapped: Column) -> Column:
    """The body of a wrapped text, or null if its sentinels do not match."""
    q = lambda s: s.replace("|", r"\|")
    pattern = rf"(?s)\A{q(rules.SENTINEL_START)}([0-9a-f]{{16}})\|>\n(?:[a-z_]+: [^\n]*\n){{5}}---\n(.*){q(rules.SENTINEL_END)}\1\|>\z"
    return F.when(wrapped.rlike(pattern), F.regexp_extract(wrapped, pattern, 2))


# the whole


def normalised(df: DataFrame, text: str = "text") -> DataFrame:
    """df with cleaned, stripped_count, categories of its text."""
    t = F.col(text)
    return df.withColumns({"cleaned": X.strip_invisible(t), "stripped_count": X.strip_counts(t)["total"], "categories": X.strip_categories(t)})


def scored(df: DataFrame, text: str = "text", content_type: str | None = None, config: ContentConfig = ContentConfig()) -> DataFrame:
    """df with cleaned, stripped_count, categories, findings, repetition_ratio, risk_score, flags. One narrow stage."""
    return assessed(normalised(df, text), content_type, config)


def assessed(clean: DataFrame, content_type: str | None = None, config: ContentConfig = ContentConfig()) -> DataFrame:
    """normalised rows with findings, repetition_ratio, risk_score, flags."""
    clean = scanned(clean, F.col(content_type) if content_type else None, config=config)
    return clean.withColumns({"risk_score": risk_score(F.col("findings"), F.col("stripped_count"), F.col("repetition_ratio"), config), "flags": derive_flags(F.col("findings"), F.col("categories"))})


def admit(df: DataFrame, config: ContentConfig = ContentConfig(), id_col: str = "content_id", text: str = "text", source: str = "source", declared: str = "declared_type") -> DataFrame:
    """id_col, source, body (text, null if rejected), content_type, routed_from, bytes_in, fingerprint_in, reject_reason.

    Payloads are bytes or strings. Reasons, the first that holds: Missing (no payload or no source), UnsupportedContentType (a declared
    type that is null or no alias of one), SizeExceeded, InvalidEncoding (bytes that are not UTF-8, which are never repaired).
    """
    raw = F.col(text).cast("binary")
    typed = route(df.select(F.col(id_col), F.col(source).cast("string").alias("source"), raw.alias("_raw"), content_type_of(F.col(declared)).alias("_kind")), "_kind", "_raw")
    raw = F.col("_raw")
    reason = (
        F.when(raw.isNull() | F.col("source").isNull(), "Missing").when(F.col("_kind").isNull(), "UnsupportedContentType")
        .when(F.octet_length(raw) > config.max_bytes, "SizeExceeded").when(~utf8_guard(raw), "InvalidEncoding")
    )
    rows = once(typed, content_type=F.col("content_type"), routed_from=F.col("routed_from"), bytes_in=F.octet_length(raw), fingerprint_in=fingerprint(raw, config.key), reject_reason=reason)
    return rows.withColumn("body", F.when(F.col("reject_reason").isNull(), raw.cast("string"))).drop("_raw", "_kind")


def clean_formats(admitted: DataFrame, config: ContentConfig = ContentConfig()) -> DataFrame:
    """admitted rows with plain (the text that its format's cleaning leaves), elements (map of what was stripped to its count)
    and, for JSON, format_error and the count and categories of what its strings lost.

    Plain texts, logs and rejected rows are cleaned where they are read. Those of a format of their own are written once, in a
    folder for each format, and each format's job reads its own, once for each distinct text; formats without rows have no job.
    """
    own = F.col("reject_reason").isNull() & F.coalesce(F.col("content_type").isin(*FORMATS), F.lit(False))
    none = {"format_error": F.lit(None).cast("string"), "format_count": F.lit(None).cast("int"), "format_categories": F.lit(None).cast("array<string>")}
    counted = lambda **n: F.map_from_entries(F.array_compact(F.array(*[F.when(c > 0, F.struct(F.lit(k.replace("_", "-")).alias("key"), c.cast("int").alias("value"))) for k, c in n.items()])))

    out = admitted.filter(~own).withColumns({"plain": X.strip_ansi(F.col("body")), "elements": F.create_map(F.lit("ansi-escape"), X.ansi_count(F.coalesce("body", F.lit("")))), **none})
    lanes = written(admitted.filter(own).withColumn("_key", F.sha2("body", 256)), "format-lanes", ("content_type",))

    def html(texts: DataFrame) -> DataFrame:
        return formats.clean_html(texts, "_key", "_text").select("_key", F.col("text").alias("plain"), F.col("stripped").cast("map<string,int>").alias("elements")).withColumns(none)

    def markdown(texts: DataFrame) -> DataFrame:
        elements = counted(markdown_html_block=F.col("html_block"), markdown_html_comment=F.col("comment"), markdown_html_inline=F.col("inline"))
        return formats.clean_markdown(texts, "_key", "_text").select("_key", F.col("text").alias("plain"), elements.alias("elements")).withColumns(none)

    def parsed(texts: DataFrame) -> DataFrame:
        out = formats.normalize_json(texts, "_key", "_text", config.max_json_depth)
        return out.select("_key", F.col("cleaned").alias("plain"), counted(json_key_collision=F.col("collisions")).alias("elements"), F.col("error").alias("format_error"), F.col("stripped_count").alias("format_count"), F.col("categories").alias("format_categories"))

    for kind in sorted(r[0] for r in lanes.select("content_type").distinct().collect()):
        rows = lanes.filter(F.col("content_type") == kind)
        clean = dict(zip(FORMATS, (html, markdown, parsed)))[kind]
        texts = rows.select("_key", F.col("body").alias("_text")).dropDuplicates(["_key"])
        out = out.unionByName(rows.join(clean(texts), "_key", "left").drop("_key"))
    return once(out, plain=F.col("plain"), elements=F.col("elements"))


def sanitize(df: DataFrame, config: ContentConfig = ContentConfig(), id_col: str = "content_id", text: str = "text", source: str = "source", declared: str = "declared_type") -> DataFrame:
    """One row for each payload: its wrapped text and report, or a reject_reason; never both, never neither.

    Stages in order: presence, declared type (by alias), size, encoding, HTML sniff, the format's own cleaning (terminal escapes for plain
    text and logs), invisible characters, scan, score, header guard, nonce, wrap. Payloads are bytes or strings.
    """
    clean = normalised(clean_formats(admit(df, config, id_col, text, source, declared), config), "plain")
    clean = clean.withColumns({"stripped_count": F.coalesce("format_count", "stripped_count"), "categories": F.coalesce("format_categories", "categories")})
    out = assessed(clean, "content_type", config)
    nonce = assign_nonce(F.col(id_col), F.col("cleaned"), config)
    rule_ids = F.array_distinct(F.transform("findings", lambda f: f["rule_id"]))
    first = F.coalesce(F.col("reject_reason"), F.col("format_error"), F.when(header_injection(source=F.col("source")).isNotNull(), "HeaderInjection"))
    out = once(out, nonce=nonce, rule_ids=rule_ids, reject_reason=first, flags=F.col("flags"), risk_score=F.col("risk_score"))
    reason = F.coalesce(F.col("reject_reason"), F.when(F.col("nonce").isNull(), "NonceCollision"))
    wrapped = wrap_provenance(F.col("cleaned"), F.col("nonce"), F.col("source"), F.col("content_type"), F.col("flags"), F.col("rule_ids"))
    return out.select(
        F.col(id_col), "source", "content_type", "routed_from", "bytes_in", F.octet_length("cleaned").alias("bytes_out"),
        F.coalesce("elements", F.expr("CAST(map() AS map<string,int>)")).alias("stripped_elements"), "stripped_count", "categories", "findings", "risk_score", "repetition_ratio", "flags",
        F.lit(config.schema_version).alias("schema_version"), F.lit(config.ruleset_version).alias("ruleset_version"), F.lit(config.scoring_version).alias("scoring_version"),
        F.when(reason.isNull(), F.col("nonce")).alias("nonce"), F.when(reason.isNull(), wrapped).alias("wrapped"), reason.alias("reject_reason"),
        "fingerprint_in", fingerprint(F.col("cleaned"), config.key).alias("fingerprint_out"),
    )


def outputs(sanitized: DataFrame, id_col: str = "content_id") -> dict[str, DataFrame]:
    """The tables that sanitized rows make: clean (wrapped texts), reports and findings of those that passed, and quarantine.

    Every row is in clean and reports, or in quarantine. A quarantined row keeps its source, size and fingerprint, and no text.
    """
    passed = sanitized.filter("reject_reason is null")
    report = [id_col, "content_type", "routed_from", "bytes_in", "bytes_out", "stripped_elements", "stripped_count", "categories", "risk_score", "repetition_ratio", "flags", "schema_version", "ruleset_version", "scoring_version", "fingerprint_in", "fingerprint_out"]
    return {
        "clean": passed.select(id_col, "source", "content_type", "nonce", "wrapped"),
        "reports": passed.select(*report),
        "findings": explode_findings(passed.select(id_col, "content_type", "findings")),
        "quarantine": sanitized.filter("reject_reason is not null").select(id_col, "source", "content_type", "bytes_in", "reject_reason", "fingerprint_in"),
    }
