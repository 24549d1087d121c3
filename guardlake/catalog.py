"""All registered queries of the core library, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake import rules
from guardlake.functions import hashing as H
from guardlake.functions import text as X
from guardlake.functions.steps import new_path, written
from guardlake.operators import audit, content, evaluation, formats, memory, messages, policy, sessions
from guardlake.plans import derived as D
from guardlake.sources import epochs, files
from guardlake.streaming import jobs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _q(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_C = f"c AS ({D.CONTENT_SQL})"
_ALL = "[" + "".join(X.INVISIBLE.values()) + "]"
_STRIP = lambda e: f"regexp_replace({e}, {_str(_ALL)}, '', 'g')"
_COUNT = lambda e, p: f"len(regexp_extract_all({e}, {_str(p)}))"
#: Where the first match of a pattern begins, in characters from 1; 0 if there is none.
_AT = lambda e, p: f"CASE WHEN regexp_matches({e}, {_str(p)}) THEN length(regexp_extract({e}, {_str('(?s)^(.*?)(?:' + p + ')')}, 1)) + 1 ELSE 0 END"


# text functions


@_q("n1_strip_invisible", f"WITH {_C} SELECT doc_id, sha256({_STRIP('text')}) AS cleaned_sha, length({_STRIP('text')})::INTEGER AS n FROM c")
def n1(spark, sf):
    t = X.strip_invisible(F.col("text"))
    return D.content(spark, sf).select("doc_id", F.sha2(t, 256).alias("cleaned_sha"), F.length(t).alias("n"))


@_q("n2_strip_counts", f"WITH {_C} SELECT doc_id, " + ", ".join(f"{_COUNT('text', '[' + b + ']')}::INTEGER AS {n.replace('-', '_')}" for n, b in X.INVISIBLE.items()) + f", {_COUNT('text', _ALL)}::INTEGER AS total FROM c")
def n2(spark, sf):
    return D.content(spark, sf).select("doc_id", X.strip_counts(F.col("text")).alias("s")).select("doc_id", "s.*")


_CATS = lambda e: "list_transform(list_sort(list_filter([" + ", ".join(f"{{'p': {_AT(e, '[' + b + ']')}, 'n': '{n}'}}" for n, b in X.INVISIBLE.items()) + "], lambda x: x.p > 0)), lambda x: x.n)"
_WORDS = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{24B6}-\\x{24E9}\\x{200C}\\x{200D}]+"
#: A word of the text has letters of both scripts.
_MIXED = lambda e: f"(len(list_filter(regexp_extract_all({e}, {_str(_WORDS)}), lambda w: regexp_matches(w, '[{X.LATIN}]') AND regexp_matches(w, '[{X.CYRILLIC}]'))) > 0)"


@_q("n3_strip_categories", f"WITH {_C} SELECT doc_id, array_to_string(list_concat({_CATS('text')}, CASE WHEN {_MIXED(_STRIP('text'))} THEN ['mixed-script'] ELSE [] END), ',') AS categories FROM c")
def n3(spark, sf):
    return D.content(spark, sf).select("doc_id", F.array_join(X.strip_categories(F.col("text")), ",").alias("categories"))


@_q("n4_mixed_script", f"WITH {_C} SELECT doc_id, {_MIXED(_STRIP('text'))} AS mixed FROM c")
def n4(spark, sf):
    return D.content(spark, sf).select("doc_id", X.has_mixed_script(X.strip_invisible(F.col("text"))).alias("mixed"))


_BLANK = "\\s\\x0b\\x{85}\\p{Z}"


@_q("n5_norm_key", f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}{_BLANK}]', '', 'g'), '[{_BLANK}]+', ' ', 'g')) AS key FROM conversations")
def n5(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", X.norm_key(F.col("text")).alias("key"))


_PATHS = "CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '/srv/a/../b/' || page_id WHEN 1 THEN '/srv/./b//' || page_id WHEN 2 THEN '/etc/' || chr(7) || page_id ELSE '/srvx/' || page_id END"


@_q("n6_n7_paths", f"SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'control' END AS refused, page_id % 4 IN (0, 1) AS inside, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '/srv/b/' || page_id WHEN 1 THEN '/srv/b/' || page_id ELSE {_PATHS} END AS resolved FROM pages")
def n6(spark, sf):
    p = D.table(spark, sf, "pages").selectExpr("page_id", f"{_PATHS} AS path")
    return p.select("page_id", X.path_check(F.col("path")).alias("refused"), X.path_within(F.col("path"), F.array(F.lit("/srv"), F.lit("/opt/"))).alias("inside"), X.lexical_path(F.col("path")).alias("resolved"))


@_q("f1_strip_ansi", f"WITH {_C} SELECT doc_id, sha256(regexp_replace(text, {_str(X.ANSI)}, '', 'g')) AS text_sha, (length(text) - length(replace(text, chr(27), '')))::INTEGER AS ansi FROM c")
def f1(spark, sf):
    t = D.content(spark, sf)
    return t.select("doc_id", F.sha2(X.strip_ansi(F.col("text")), 256).alias("text_sha"), X.ansi_count(F.col("text")).alias("ansi"))


_STYLES = "CASE CAST(page_id % 7 AS INT) WHEN 0 THEN 'color:red;display: none' WHEN 1 THEN 'visibility:collapse' WHEN 2 THEN 'opacity:.0%' WHEN 3 THEN '--display:none' WHEN 4 THEN 'opacity:0.5' WHEN 5 THEN 'display/* x */:none' ELSE 'opacity:+00' END"


@_q("f4_hidden_style", "SELECT page_id, page_id % 7 IN (0, 1, 2, 5, 6) AS hides FROM pages")
def f4(spark, sf):
    return D.table(spark, sf, "pages").selectExpr("page_id", f"{_STYLES} AS style").select("page_id", X.is_hidden_style(F.col("style")).alias("hides"))


# intake


@_q("c1_size_guard", f"WITH {_C} SELECT doc_id, CASE WHEN strlen(text) > 20000 THEN 'SizeExceeded' END AS reject_reason FROM c")
def c1(spark, sf):
    return content.size_guard(D.content(spark, sf), "text", 20_000).select("doc_id", "reject_reason")


@_q("c2_utf8_guard", "SELECT doc_id, doc_id % 5 <> 0 AS valid FROM documents")
def c2(spark, sf):
    d = D.table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("C328")))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    return d.select("doc_id", content.utf8_guard(body).alias("valid"))


_ALIAS = "(['html', 'MD', 'markdown', 'json', 'text', 'Plain', 'log', 'pdf'])[CAST(doc_id % 8 AS INT) + 1]"
_KIND = "(['Html', 'Markdown', 'Markdown', 'Json', 'PlainText', 'PlainText', 'Log', NULL])[CAST(doc_id % 8 AS INT) + 1]"


@_q("c3_content_type", f"SELECT doc_id, {_KIND} AS content_type FROM documents")
def c3(spark, sf):
    alias = F.element_at(F.array(*map(F.lit, ("html", "MD", "markdown", "json", "text", "Plain", "log", "pdf"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return D.table(spark, sf, "documents").select("doc_id", content.content_type_of(alias).alias("content_type"))


#: content_type and routed_from of texts that are declared as plain text if their id is even, else as logs.
_LYING = f"(doc_id % 2 = 0 AND regexp_matches(left(text, 1024), {_str(content.SNIFF)}))"
_ROUTED = f"CASE WHEN {_LYING} THEN 'Html' WHEN doc_id % 2 = 0 THEN 'PlainText' ELSE 'Log' END AS content_type, CASE WHEN {_LYING} THEN 'PlainText' END AS routed_from"


@_q("c4_c5_route", f"WITH {_C} SELECT doc_id, {_ROUTED} FROM c")
def c4(spark, sf):
    d = D.content(spark, sf).withColumn("declared_type", F.when(F.col("doc_id") % 2 == 0, "PlainText").otherwise("Log"))
    return content.route(d).select("doc_id", "content_type", "routed_from")


_URLS = "CASE CAST(page_id % 5 AS INT) WHEN 0 THEN url WHEN 1 THEN 'HTTPS://user:pw@Example.COM:443/a;k=v/b%3Bx/c?q=1#f' WHEN 2 THEN 'http://[::1]:8080' WHEN 3 THEN 'mailto:x' ELSE 'http://h:80/p/' || page_id || '?a=b' END"
_UP = lambda i: f"regexp_extract(u, {_str(content.URL)}, {i})"
_UPORT = f"CASE WHEN {_UP(3)} <> '' AND NOT (lower({_UP(1)}) || ':' || {_UP(3)} IN ({', '.join(_str(k + ':' + v) for k, v in content.DEFAULT_PORTS.items())})) THEN ':' || {_UP(3)} ELSE '' END"
_UPATH = f"regexp_replace({_UP(4)}, '(;|%3[Bb])[^/]*', '', 'g')"


@_q("c6_c7_canonical_source", f"WITH p AS (SELECT page_id, {_URLS} AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, {_str(content.URL)}) THEN 'Url' ELSE 'Other' END AS kind, CASE WHEN regexp_matches(u, {_str(content.URL)}) THEN lower({_UP(1)}) || '://' || lower({_UP(2)}) || {_UPORT} || CASE WHEN {_UPATH} = '' THEN '/' ELSE {_UPATH} END ELSE u END AS rendered FROM p")
def c6(spark, sf):
    p = D.table(spark, sf, "pages").selectExpr("page_id", f"{_URLS} AS u").withColumn("s", content.canonical_source(F.col("u")))
    return p.select("page_id", "s.kind", content.render_source(F.col("s.kind"), F.col("s.rendered")).alias("rendered"))


@_q("c8_fingerprint", f"SELECT doc_id, {H.hmac_sql('coalesce(text, chr(63))', b'k1', H.DOMAIN_TAG)} AS fingerprint FROM documents")
def c8(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", H.fingerprint(F.coalesce("text", F.lit("?")), b"k1").alias("fingerprint"))


# scan and score


def _scored(spark, sf):
    return content.scored(D.content(spark, sf))


_T = "t"
_RULE_SQL = []
for _r in rules.REGEX_RULES:
    _p = _str(_r.pattern)
    _RULE_SQL.append((_r.rule_id, _r.severity, f"regexp_matches(t, {_p})", f"strlen(regexp_extract(t, {_str('(?s)^(.*?)(?:' + _r.pattern.replace('(?i)', '') + ')') if not _r.pattern.startswith('(?i)') else _str('(?si)^(.*?)(?:' + _r.pattern[4:] + ')')}, 1))", f"regexp_extract(t, {_p})"))
_B64 = "list_filter(regexp_extract_all(t, '[A-Za-z0-9+/=]{40,}'), lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z0-9]'))[1]"
_HEX = "CASE WHEN regexp_matches(t, '[0-9A-Fa-f]{64,}') THEN regexp_extract(t, '[0-9A-Fa-f]{64,}') END"
_TOK = "list_filter(string_split_regex(t, '[ \t\n\r]'), lambda x: strlen(x) >= 200)[1]"
for _id, _e in (("ENC-001", _B64), ("ENC-002", _HEX), ("REP-001", _TOK)):
    _RULE_SQL.append((_id, "Low", f"({_e}) IS NOT NULL", f"strlen(string_split(t, {_e})[1])", _e))
_MARKED = lambda e: f"(regexp_matches({e}, {_str(rules.HTML_ROOT)}) OR (len(list_distinct(list_transform(regexp_extract_all({e}, {_str(rules.HTML_OPENER)}, 1), lambda x: lower(x)))) >= {rules.HTML_OPENERS_LEAST} AND {_COUNT(e, rules.HTML_CLOSE)} >= {rules.HTML_CLOSE_LEAST}))"
_RULE_SQL += [
    ("MIX-001", "Medium", _MIXED("t"), None, None),
    ("FMT-001", "Info", f"(plain AND {_MARKED('t')})", None, None),
    ("REP-002", "Low", "(ratio >= 0.9::FLOAT)", None, None),
    ("WRP-001", "Info", f"(contains(t, {_str(rules.SENTINEL_START)}) OR contains(t, {_str(rules.SENTINEL_END)}))", None, None),
]
_HEXED = "regexp_extract_all(hex(encode(t)), '..')"
_RATIO = "(CASE WHEN len(b) < 2 THEN 0 ELSE len(list_filter(list_zip(b[:-2], b[2:]), lambda x: x[1] = x[2]))::DOUBLE / len(b) END)::FLOAT"
_FOUND = f"r AS MATERIALIZED (SELECT n0.*, {_RATIO} AS ratio FROM (SELECT *, {_HEXED} AS b FROM n) n0), f AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT doc_id, source, {i} AS pos, '{rid}' AS rule_id, '{sev}' AS severity, {f'({at})::INTEGER' if at else 'NULL::INTEGER'} AS start, {f'strlen({m})::INTEGER' if m else 'NULL::INTEGER'} AS size FROM r WHERE {cond}"
    for i, (rid, sev, cond, at, m) in enumerate(_RULE_SQL)
) + ")"
_FINDINGS = f"{_C}, n AS MATERIALIZED (SELECT doc_id, source, text AS raw, {_STRIP('text')} AS t, true AS plain FROM c), {_FOUND}"


@_q("p1_p16_scan", f"WITH {_FINDINGS} SELECT doc_id, rule_id, severity, start, size FROM f")
def p16(spark, sf):
    rows = content.explode_findings(_scored(spark, sf).select("doc_id", "findings"))
    return rows.select("doc_id", "rule_id", "severity", "start", (F.col("end") - F.col("start")).alias("size"))


@_q("p9_p11_samples", f"WITH {_C}, n AS (SELECT doc_id, {_STRIP('text')} AS t FROM c) SELECT doc_id, {_B64} AS base64_run, {_HEX} AS hex_run, strlen({_TOK})::INTEGER AS long_token FROM n")
def p9(spark, sf):
    t = X.strip_invisible(F.col("text"))
    return D.content(spark, sf).select("doc_id", content.base64_run(t).alias("base64_run"), content.hex_run(t).alias("hex_run"), F.octet_length(content.long_token(t)).alias("long_token"))


@_q("p12_repetition", f"WITH {_C}, n AS (SELECT doc_id, {_STRIP('text')} AS t FROM c), b AS (SELECT doc_id, {_HEXED} AS b FROM n) SELECT doc_id, {_RATIO} AS ratio FROM b")
def p12(spark, sf):
    return D.content(spark, sf).select("doc_id", X.repetition_ratio(X.strip_invisible(F.col("text"))).alias("ratio"))


@_q("p14_html_markers", f"SELECT page_id AS id, {_MARKED('html')} AS marked FROM pages")
def p14(spark, sf):
    return D.table(spark, sf, "pages").select(F.col("page_id").alias("id"), content.html_markers(F.col("html")).alias("marked"))


@_q("p17_rule_hits", f"WITH {_FINDINGS} SELECT rule_id, severity, count(*) AS hits, count(DISTINCT doc_id) AS payloads FROM f GROUP BY ALL")
def p17(spark, sf):
    return evaluation.rule_hits(content.explode_findings(_scored(spark, sf).select("doc_id", "findings")))


_WEIGHT = "CASE severity WHEN 'High' THEN 50 WHEN 'Medium' THEN 20 WHEN 'Low' THEN 6 ELSE 0 END"
_SCORED = f"s AS (SELECT r.*, least(100, coalesce(w, 0) + CASE WHEN raw <> t THEN 10 ELSE 0 END + CASE WHEN ratio >= 0.85::FLOAT THEN 15 ELSE 0 END)::INTEGER AS risk_score FROM r LEFT JOIN (SELECT doc_id, sum(w) AS w FROM (SELECT doc_id, rule_id, max({_WEIGHT}) AS w FROM f GROUP BY ALL) GROUP BY doc_id) USING (doc_id))"
_SCORES = f"{_FINDINGS}, {_SCORED}"


@_q("r1_risk_score", f"WITH {_SCORES} SELECT doc_id, risk_score FROM s")
def r1(spark, sf):
    return _scored(spark, sf).select("doc_id", "risk_score")


@_q("r2_risk_gate", f"WITH {_SCORES} SELECT doc_id, risk_score FROM s WHERE risk_score >= 50")
def r2(spark, sf):
    return evaluation.risk_gate(_scored(spark, sf).select("doc_id", "risk_score"))


@_q("risk_by_source", f"WITH {_SCORES} SELECT source, count(*) AS n, count(*) FILTER (risk_score >= 50) AS hits, round(avg(risk_score), 4) AS mean_score FROM s GROUP BY source")
def risk_by_source(spark, sf):
    return _scored(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("risk_score") >= 50).alias("hits"), F.round(F.avg("risk_score"), 4).alias("mean_score"))


_FAMILIES = (("INJ-", "injection_pattern"), ("ENC-", "encoded_payload"), ("REP-", "repetition"), ("MIX-", "mixed_script"), ("FMT-", "content_type_mismatch"), ("WRP-", "wrapper_collision"))
_IDS = "(SELECT doc_id, list(DISTINCT rule_id) AS ids, string_agg(rule_id, ',' ORDER BY pos) AS rule_ids FROM f GROUP BY doc_id)"
#: The list of flags of a row with ids (its rule ids) and raw (its text before invisible characters went).
_FLAGS = "list_concat(list_filter([" + ", ".join(f"CASE WHEN len(list_filter(ids, lambda i: starts_with(i, '{p}'))) > 0 THEN '{n}' END" for p, n in _FAMILIES) + f"], lambda x: x IS NOT NULL), list_transform({_CATS('raw')}, lambda c: 'normalize_' || replace(c, '-', '_')))"


@_q("r3_flags", f"WITH {_FINDINGS} SELECT doc_id, array_to_string(list_transform({_FLAGS}, lambda x: x || ','), '') AS flags FROM n LEFT JOIN {_IDS} USING (doc_id)")
def r3(spark, sf):
    flags = F.array_join(F.transform("flags", lambda x: F.concat(x, F.lit(","))), "")
    return _scored(spark, sf).select("doc_id", flags.alias("flags"))


_NONCE = f"left({H.hmac_sql(chr(40) + 'doc_id || ' + _str(':0') + chr(41), b'guardlake')}, 16)"


@_q("r4_r7_wrap", f"SELECT doc_id, sha256('<|guardlake_external_start:' || nonce || '|>' || chr(10) || 'source: ' || source || chr(10) || 'content_type: PlainText' || chr(10) || 'fetched_at: unknown' || chr(10) || 'flags: a,b' || chr(10) || 'rule_ids: ' || chr(10) || '---' || chr(10) || body || CASE WHEN suffix(body, chr(10)) THEN '' ELSE chr(10) END || '<|guardlake_external_end:' || nonce || '|>') AS wrapped_sha, sha256(body || CASE WHEN suffix(body, chr(10)) THEN '' ELSE chr(10) END) AS back_sha FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS body, {_NONCE} AS nonce FROM documents)")
def r4(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("body"))
    d = d.withColumn("nonce", content.assign_nonce(F.col("doc_id"), F.col("body")))
    w = content.wrap_provenance(F.col("body"), F.col("nonce"), F.col("source"), F.lit("PlainText"), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"))
    return d.withColumn("w", w).select("doc_id", F.sha2("w", 256).alias("wrapped_sha"), F.sha2(content.unwrap(F.col("w")), 256).alias("back_sha"))


@_q("r5_header_guard", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'flags' WHEN page_id % 3 = 1 THEN 'source' END AS field, CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 1 THEN strlen(url) + 2 END::INTEGER AS \"offset\" FROM pages")
def r5(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("é\n"))).otherwise(F.col("url")).alias("source"), F.when(F.col("page_id") % 3 == 0, "ab\x7f").otherwise("ab").alias("flags"))
    return p.select("page_id", content.header_injection(source=F.col("source"), flags=F.col("flags")).alias("h")).select("page_id", "h.field", "h.offset")


_PLAIN = f"regexp_replace(text, {_str(X.ANSI)}, '', 'g')"
#: What each lane leaves of a text: the documents' only markup is the overlay's doctype, and they hold no entities.
_LANES = f"d AS (SELECT *, {_ROUTED} FROM c), p AS (SELECT *, CASE WHEN content_type = 'Html' THEN regexp_replace(text, '(?i)<!doctype html>', '') ELSE {_PLAIN} END AS raw FROM d), n AS MATERIALIZED (SELECT *, {_STRIP('raw')} AS t, content_type <> 'Html' AS plain FROM p)"
_HMAC = lambda e: H.hmac_sql(e, b"guardlake-test-key", H.DOMAIN_TAG)
_REPORT = f"doc_id, content_type, strlen(text)::INTEGER AS bytes_in, strlen(t)::INTEGER AS bytes_out, (length(raw) - length(t))::INTEGER AS stripped_count, 1 AS schema_version, 3 AS ruleset_version, 2 AS scoring_version, {_HMAC('text')} AS fingerprint_in, NULL::VARCHAR AS reject_reason"
_WRAPPED = "'<|guardlake_external_start:' || nonce || '|>' || chr(10) || 'source: ' || source || chr(10) || 'content_type: ' || content_type || chr(10) || 'fetched_at: unknown' || chr(10) || 'flags: ' || flags || chr(10) || 'rule_ids: ' || coalesce(rule_ids, '') || chr(10) || '---' || chr(10) || t || CASE WHEN suffix(t, chr(10)) THEN '' ELSE chr(10) END || '<|guardlake_external_end:' || nonce || '|>'"


@_q("r8_sanitize", f"WITH {_C}, {_LANES}, {_FOUND}, {_SCORED}, w AS (SELECT s.*, rule_ids, array_to_string({_FLAGS}, ',') AS flags, {_NONCE} AS nonce FROM s LEFT JOIN {_IDS} USING (doc_id)) SELECT {_REPORT}, routed_from, risk_score, flags, sha256({_WRAPPED}) AS wrapped_sha, {_HMAC('t')} AS fingerprint_out FROM w")
def r8(spark, sf):
    d = D.content(spark, sf).withColumn("declared_type", F.when(F.col("doc_id") % 2 == 0, "PlainText").otherwise("Log"))
    out = content.sanitize(d, id_col="doc_id", text="text")
    return out.select("doc_id", "content_type", "routed_from", "bytes_in", "bytes_out", "stripped_count", "risk_score", F.array_join("flags", ",").alias("flags"), F.sha2("wrapped", 256).alias("wrapped_sha"), "reject_reason", "fingerprint_in", "fingerprint_out", "schema_version", "ruleset_version", "scoring_version")


@_q("r8_r9_report", f"WITH {_C}, {_LANES} SELECT {_REPORT} FROM n")
def r8_report(spark, sf):
    return r8(spark, sf).select("doc_id", "content_type", "bytes_in", "bytes_out", "stripped_count", "schema_version", "ruleset_version", "scoring_version", "fingerprint_in", "reject_reason")


# formats


@_q("f2_html_text")
def f2(spark, sf):
    out = formats.clean_html(D.pages(spark, sf))
    return out.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"), F.array_join(F.transform(F.map_entries("stripped"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("stripped"))


_FAST_TOKEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|<[!?][^>]*>|</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^\"'>])*>|[^<]+|<"


@_q("f2a_html_tokens", f"SELECT page_id, {_COUNT('html', _FAST_TOKEN)}::BIGINT AS tokens FROM ({D.PAGES_SQL})")
def f2a(spark, sf):
    return formats.html_tokens(D.pages(spark, sf)).groupBy("page_id").agg(F.count("*").alias("tokens"))


@_q("f2d_attr_signals", f"WITH p AS ({D.PAGES_SQL}) SELECT page_id, 'comment' AS signal, {_COUNT('html', '(?s)<!--.*?-->')}::BIGINT AS n FROM p WHERE contains(html, '<!--') UNION ALL SELECT page_id, 'aria-label', 1 FROM p WHERE page_id % 9 = 6 UNION ALL SELECT page_id, 'alt-non-img', 1 FROM p WHERE page_id % 9 = 7")
def f2d(spark, sf):
    p = D.pages(spark, sf)
    return formats.attr_signals(formats.hidden_tokens(formats.html_tokens(p), formats.hidden_classes(p)))


@_q("f3_hidden_classes", f"SELECT page_id, 'x' AS cls FROM ({D.PAGES_SQL}) WHERE page_id % 9 = 3")
def f3(spark, sf):
    return formats.hidden_classes(D.pages(spark, sf))


@_q("f5a_markdown_lines", f"""WITH d AS ({D.MARKDOWN_SQL}), l AS (SELECT doc_id, x.i AS line_no, x.s AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s, i: {{'i': i - 1, 's': s}})) AS x FROM d)),
m AS (SELECT *, regexp_matches(line, '^ {{0,3}}(?:```|~~~)') AS fence FROM l), c AS (SELECT *, fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS in_code FROM m)
SELECT doc_id, count(*) AS lines, count(*) FILTER (in_code) AS code_lines FROM c GROUP BY doc_id""")
def f5a(spark, sf):
    return formats.markdown_lines(D.markdown(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("in_code").alias("code_lines"))


_ESCAPED = lambda e: f"replace(replace(replace(replace(replace(replace(replace({e}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@_q("f5_clean_markdown", f"""WITH d AS ({D.MARKDOWN_SQL}), l AS (SELECT doc_id, x.i AS line_no, x.s AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s, i: {{'i': i - 1, 's': s}})) AS x FROM d)),
m AS (SELECT *, regexp_matches(line, '^ {{0,3}}(?:```|~~~)') AS fence FROM l), c AS (SELECT *, fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS in_code FROM m),
e AS (SELECT *, sum((in_code OR trim(line) = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM c),
g AS (SELECT *, min(CASE WHEN NOT in_code AND regexp_matches(line, '^ {{0,3}}</?[A-Za-z][^<>]*>?\\s*') THEN line_no END) OVER (PARTITION BY doc_id, part) AS bf FROM e),
k AS (SELECT *, NOT in_code AND trim(line) <> '' AND coalesce(line_no >= bf, false) AS in_block, regexp_replace(line, {_str(formats._COMMENT)}, '', 'g') AS nc FROM g),
t AS (SELECT *, CASE WHEN in_code THEN line WHEN NOT in_block THEN {_ESCAPED(f"regexp_replace(nc, {_str(formats._INLINE)}, '', 'g')")} END AS kept FROM k)
SELECT doc_id, sha256(coalesce(string_agg(kept, chr(10) ORDER BY line_no) FILTER (kept IS NOT NULL), '')) AS text_sha, sum((in_block AND line_no = bf)::INT)::BIGINT AS html_block,
sum(CASE WHEN in_code OR in_block THEN 0 ELSE {_COUNT('nc', formats._INLINE)} END)::BIGINT AS inline, sum(CASE WHEN in_code OR in_block THEN 0 ELSE {_COUNT('line', formats._COMMENT)} END)::BIGINT AS comment FROM t GROUP BY doc_id""")
def f5(spark, sf):
    out = formats.clean_markdown(D.markdown(spark, sf))
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha"), "html_block", "inline", "comment")


_PROPS = "CASE CAST(event_id % 5 AS INT) WHEN 1 THEN '{\"k​\": 1, \"k\": 2}' WHEN 2 THEN '{\"a\": \"x\\u200by\", \"b\": null}' ELSE props END"


@_q("f6a_json_flat", "SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 1 THEN 'k=1' WHEN 2 THEN 'a=xy;b=' ELSE 'k=' || json_extract_string(props, '$.k') END AS pairs, CASE WHEN event_id % 5 = 1 THEN 1 ELSE 0 END AS collisions, CASE WHEN event_id % 5 IN (1, 2) THEN 1 ELSE 0 END AS stripped_count FROM events")
def f6a(spark, sf):
    e = D.table(spark, sf, "events")
    odd = F.when(F.col("event_id") % 5 == 1, F.lit('{"k​": 1, "k": 2}')).when(F.col("event_id") % 5 == 2, F.lit('{"a": "x​y", "b": null}')).otherwise(F.col("props"))
    out = formats.normalize_json_flat(e.select("event_id", odd.alias("props")))
    pairs = F.array_join(F.transform("cleaned", lambda p: F.concat(p["key"], F.lit("="), F.coalesce(p["value"], F.lit("")))), ";")
    return out.select("event_id", pairs.alias("pairs"), "collisions", "stripped_count")


@_q("f6b_json", "SELECT event_id, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '{\"a\":[1,{\"k\":\"v\"}],\"z\":null}' WHEN 2 THEN regexp_replace(props, '\\s', '', 'g') END AS cleaned, CASE WHEN event_id % 3 = 1 THEN 'JsonParse' END AS error FROM events")
def f6b(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, '{"z": null, "a": [1, {"k​": "v"}]}').when(F.col("event_id") % 3 == 1, "{bad").otherwise(F.col("props")).alias("j"))
    return formats.normalize_json(e, "event_id", "j").select("event_id", "cleaned", "error")


# policy


_ACTION_SQL = "(VALUES " + ", ".join(f"('{a}', '{c}', {t}, {g}, {_str(r) if r else 'NULL'})" for a, c, r in rules.ACTIONS for n, t, g in rules.CAPABILITIES if n == c) + ") dim(action, capability, required_tier, requires_grant, resource_param)"
_ORIGIN_SQL = "(VALUES " + ", ".join(f"('{k}', '{z}', {c})" for k, z, c in rules.ORIGINS) + ") o(origin_kind, zone, default_ceiling)"
_NAME = "CASE origin_kind WHEN 'LocalCli' THEN 'local' WHEN 'BridgeTelegram' THEN 'telegram:' || r.user_id WHEN 'BridgeSlack' THEN 'slack:' || r.user_id WHEN 'AgentGenerated' THEN 'agent:' || r.user_id WHEN 'SystemHeartbeat' THEN 'system:heartbeat' ELSE r.user_id END"
_RESOLVED = f"""r AS ({D.REQUESTS_SQL}), a AS ({D.ALLOW_SQL}), x AS (
SELECT r.*, dim.capability, dim.required_tier, dim.requires_grant, CASE WHEN dim.resource_param IS NOT NULL THEN r.path END AS resource, o.zone, {_NAME} AS principal, coalesce(a.ceiling, o.default_ceiling) AS ceiling
FROM r JOIN {_ACTION_SQL} USING (action) JOIN {_ORIGIN_SQL} USING (origin_kind)
LEFT JOIN a ON a.user_id = r.user_id AND a.platform = CASE origin_kind WHEN 'BridgeTelegram' THEN 'telegram' WHEN 'BridgeSlack' THEN 'slack' END)"""


def _resolved(spark, sf):
    r = policy.resource_scope(policy.classify_actions(D.requests(spark, sf)))
    return policy.resolve_principal(r, policy.ceilings_from_allowlist(D.allowlist(spark, sf)))


@_q("a1_a3_classify", f"WITH {_RESOLVED} SELECT request_id, capability, required_tier, requires_grant, resource, principal, zone, ceiling FROM x")
def a1(spark, sf):
    return _resolved(spark, sf).select("request_id", "capability", "required_tier", "requires_grant", "resource", "principal", "zone", "ceiling")


_POSTURE = "CASE CAST(request_id % 3 AS INT) WHEN 0 THEN 'Revoked' WHEN 1 THEN 'Degraded' ELSE 'Trusted' END"


@_q("a4_effective_ceiling", f"WITH {_RESOLVED} SELECT request_id, CASE WHEN request_id % 3 = 0 THEN -1 WHEN request_id % 3 = 1 THEN least(ceiling, 0) ELSE ceiling END AS effective FROM x")
def a4(spark, sf):
    r = _resolved(spark, sf).selectExpr("request_id", "ceiling", f"{_POSTURE} AS p")
    return r.select("request_id", policy.effective_ceiling(F.col("ceiling"), F.col("p")).alias("effective"))


_ZONE_OK = "(zone = target_zone OR (zone IN ('Ingress', 'AgentRuntime') AND target_zone = 'ControlPlane') OR (zone = 'ControlPlane' AND target_zone = 'HostPrivileged' AND ceiling >= 3))"


@_q("a5_zone_check", f"WITH {_RESOLVED}, z AS (SELECT *, CASE WHEN required_tier >= 3 THEN 'HostPrivileged' ELSE 'ControlPlane' END AS target_zone FROM x) SELECT request_id, target_zone, {_ZONE_OK} AS zone_ok FROM z")
def a5(spark, sf):
    r = _resolved(spark, sf).withColumn("effective", F.col("ceiling"))
    return policy.zone_check(r).select("request_id", "target_zone", "zone_ok")


#: Used with x or, where only some requests ask, with a table of these named x.
_MATCH = f"g AS ({D.GRANTS_SQL}), m AS (SELECT x.request_id, arg_max(g.grant_id, {{'i': g.issued_us, 'g': g.grant_id}}) AS grant_id FROM x JOIN g ON g.principal = x.principal AND g.capability = x.capability AND g.expires_us > x.ts_us AND (g.max_uses IS NULL OR g.uses < g.max_uses) AND (g.scope IS NULL OR x.resource = g.scope OR starts_with(x.resource, g.scope || '/')) GROUP BY x.request_id)"


@_q("a6_match_grants", f"WITH {_RESOLVED}, {_MATCH} SELECT request_id, grant_id FROM m")
def a6(spark, sf):
    return policy.match_grants(_resolved(spark, sf), D.grants(spark, sf))


_ZONED = "z AS (SELECT *, CASE WHEN required_tier >= 3 THEN 'HostPrivileged' ELSE 'ControlPlane' END AS target_zone FROM x), q AS (SELECT *, required_tier <= ceiling AS tier_ok, " + _ZONE_OK + " AS zone_ok FROM z)"
#: The level of each row of o (request_id, principal, t, n), one after the other.
_LEVELS = """c AS (SELECT request_id, principal, n, [t] AS recent, NULL::BIGINT AS high, 'Normal' AS level FROM o WHERE n = 1 UNION ALL
SELECT request_id, principal, n, CASE WHEN cool THEN was ELSE seen END, CASE WHEN NOT cool AND len(seen) > 10 THEN t ELSE high END, CASE WHEN cool THEN 'Cooldown' WHEN len(seen) > 10 THEN 'HighRisk' WHEN len(seen) > 5 THEN 'Warning' ELSE 'Normal' END
FROM (SELECT o.request_id, o.principal, o.n, o.t, c.high, c.recent AS was, c.high IS NOT NULL AND o.t - c.high < 120000000 AS cool, list_append(list_filter(c.recent, lambda y: y >= o.t - 300000000), o.t) AS seen FROM c JOIN o ON o.principal = c.principal AND o.n = c.n + 1))"""
_ASKED = "(required_tier >= 2 OR requires_grant) AND origin_kind <> 'HumanApproved' AND (required_tier >= 3 OR origin_kind <> 'LocalCli')"
#: Requests in order: fatigue of those that passed tier and zone, then grants. A principal of the derived table has one grant
#: at most, so a grant serves the first max_uses of the requests that it covers and that ask for it.
_CHECKED = f"""{_RESOLVED}, {_ZONED}, o AS (SELECT request_id, principal, ts_us AS t, row_number() OVER (PARTITION BY principal ORDER BY ts_us, request_id) AS n FROM q WHERE tier_ok AND zone_ok AND required_tier >= 2), {_LEVELS},
k AS (SELECT q.*, coalesce(c.level IN ('HighRisk', 'Cooldown'), false) AS tired FROM q LEFT JOIN c USING (request_id)), {_MATCH.replace('FROM x JOIN g', f'FROM (SELECT * FROM k WHERE tier_ok AND zone_ok AND NOT tired AND {_ASKED}) x JOIN g')},
spent AS (SELECT m.request_id, m.grant_id, g.max_uses, row_number() OVER (PARTITION BY m.grant_id ORDER BY k.ts_us, k.request_id) AS nth FROM m JOIN k USING (request_id) JOIN g USING (grant_id)), held AS (SELECT request_id, grant_id FROM spent WHERE max_uses IS NULL OR nth <= max_uses)"""


@_q("a7_consume_grants", f"WITH RECURSIVE {_CHECKED} SELECT request_id, grant_id FROM held")
def a7(spark, sf):
    checked = policy.checked(D.requests(spark, sf), policy.ceilings_from_allowlist(D.allowlist(spark, sf)), guard_key="principal")
    return policy.consume_grants(policy.asks_grants(checked), D.grants(spark, sf))


@_q("a8_fatigue", f"WITH RECURSIVE {_RESOLVED}, o AS (SELECT request_id, principal, ts_us AS t, row_number() OVER (PARTITION BY principal ORDER BY ts_us, request_id) AS n FROM x WHERE required_tier >= 2), {_LEVELS} SELECT request_id, level FROM c")
def a8(spark, sf):
    return policy.fatigue(_resolved(spark, sf).filter("required_tier >= 2"), "principal")


@_q("a9_fatigue_rate", f"WITH {_RESOLVED} SELECT request_id, count(*) OVER (PARTITION BY principal ORDER BY ts_us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS recent FROM x")
def a9(spark, sf):
    return policy.fatigue_rate(_resolved(spark, sf)).select("request_id", "recent")


_DECISION = """CASE WHEN NOT tier_ok THEN 'Deny:tier' WHEN NOT zone_ok THEN 'Error:zone' WHEN tired THEN 'Deny:fatigue'
WHEN required_tier >= 3 AND (origin_kind = 'HumanApproved' OR grant_id IS NOT NULL) THEN 'Allow:' WHEN required_tier >= 3 THEN 'NeedsApproval:tier 3+'
WHEN (required_tier >= 2 OR requires_grant) AND (origin_kind IN ('HumanApproved', 'LocalCli') OR grant_id IS NOT NULL) THEN 'Allow:' WHEN required_tier >= 2 OR requires_grant THEN 'NeedsApproval:tier 2' ELSE 'Allow:' END"""
_EVALUATED = f"{_CHECKED}, e AS (SELECT k.*, string_split({_DECISION}, ':')[1] AS decision, string_split({_DECISION}, ':')[2] AS reason FROM k LEFT JOIN held USING (request_id))"


def _evaluated(spark, sf):
    return policy.evaluate(D.requests(spark, sf), D.grants(spark, sf), policy.ceilings_from_allowlist(D.allowlist(spark, sf)), guard_key="principal")


@_q("a10_evaluate", f"WITH RECURSIVE {_EVALUATED} SELECT request_id, principal, decision, reason FROM e")
def a10(spark, sf):
    return _evaluated(spark, sf).select("request_id", "principal", "decision", "reason")


@_q("a11_evaluate_result", "SELECT event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN 'Allow' WHEN event_id % 3 = 0 THEN 'Deny' WHEN event_id % 5 = 0 THEN 'Deny' ELSE 'Allow' END AS decision FROM events")
def a11(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 4 != 0, "Html").alias("required_type"))
    reports = e.filter("request_id % 3 <> 0").select("request_id", F.when(F.col("request_id") % 5 == 0, "Json").otherwise("Html").alias("report_type"))
    return policy.evaluate_result(e, reports).select("request_id", "decision")


@_q("a12_cleanup_grants", f"SELECT grant_id FROM ({D.GRANTS_SQL}) WHERE max_uses IS NULL OR uses < max_uses")
def a12(spark, sf):
    return policy.cleanup_grants(D.grants(spark, sf), F.timestamp_micros(F.lit(D.EPOCH_US))).select("grant_id")


@_q("a12_cleanup_report", f"WITH g AS (SELECT grant_id, max_uses, CASE WHEN substr(grant_id, 2)::BIGINT % 9 = 0 THEN coalesce(max_uses, 0) ELSE uses END AS uses, CASE WHEN substr(grant_id, 2)::BIGINT % 7 = 0 THEN {D.EPOCH_US} ELSE expires_us END AS ends FROM ({D.GRANTS_SQL})) SELECT count(*) FILTER (NOT late AND NOT spent) AS kept, count(*) FILTER (late OR spent) AS removed, count(*) FILTER (late) AS expired, count(*) FILTER (spent AND NOT late) AS used_up FROM (SELECT ends <= {D.EPOCH_US} AS late, max_uses IS NOT NULL AND uses >= max_uses AS spent FROM g)")
def a12_report(spark, sf):
    n, now = F.substring("grant_id", 2, 20).cast("long"), F.timestamp_micros(F.lit(D.EPOCH_US))
    g = D.grants(spark, sf).withColumns({"uses": F.when(n % 9 == 0, F.coalesce("max_uses", F.lit(0))).otherwise(F.col("uses")), "expires_at": F.when(n % 7 == 0, now).otherwise(F.col("expires_at"))})
    return policy.cleanup_report(g, now)


@_q("a13_upsert_grants", f"SELECT grant_id, CASE WHEN substr(grant_id, 2)::BIGINT % 3 = 0 THEN 7 ELSE uses END::INTEGER AS uses, scope FROM ({D.GRANTS_SQL})")
def a13(spark, sf):
    g = D.grants(spark, sf)
    new = g.filter("substr(grant_id, 2) % 3 = 0").withColumns({"uses": F.lit(7), "scope": F.lit("ignored")})
    return policy.upsert_grants(g, new).select("grant_id", "uses", "scope")


_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@_q("a14_domain_allowed", f"SELECT page_id, ({_HOST} = 'm.ththth.example.net' OR {_HOST} = 'example.com' OR suffix({_HOST}, '.example.com')) AS allowed FROM pages")
def a14(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))
    listed = spark.createDataFrame([("M.ththth.example.net",), (".example.com",)], "entry string")
    return policy.domain_allowed(p, listed).select("page_id", "allowed")


_LINE = "CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'CONNECT h' || page_id || ':443 HTTP/1.1' WHEN 1 THEN 'GET http://h.example/p?q HTTP/1.0' WHEN 2 THEN 'GET http://h.example:99999/ HTTP/1.0' WHEN 3 THEN 'get http://h.example:8080 HTTP/1.1' ELSE 'CONNECT h HTTP/1.1' END"


@_q("a15_proxy_line", "SELECT page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'CONNECT' WHEN 1 THEN 'GET' WHEN 3 THEN 'get' END AS method, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'h' || page_id WHEN 1 THEN 'h.example' WHEN 3 THEN 'h.example' END AS host, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 3 THEN 8080 END::INTEGER AS port, CASE CAST(page_id % 5 AS INT) WHEN 1 THEN '/p?q' WHEN 3 THEN '/' END AS path FROM pages")
def a15(spark, sf):
    return D.table(spark, sf, "pages").selectExpr("page_id", f"{_LINE} AS line").select("page_id", policy.parse_proxy_line(F.col("line")).alias("p")).select("page_id", "p.method", "p.host", "p.port", "p.path")


@_q("a16_a18_ceilings", D.ALLOW_SQL)
def a18(spark, sf):
    return policy.ceilings_from_allowlist(D.allowlist(spark, sf))


@_q("a17_decision_rollup", f"WITH RECURSIVE {_EVALUATED} SELECT decision, action, origin_kind, count(*) AS n FROM e GROUP BY ALL")
def a17(spark, sf):
    return policy.decision_rollup(_evaluated(spark, sf))


# audit


#: The first entry's link is the genesis hash, so changing it to that changes nothing.
_AUDIT = "l AS (SELECT user_id % 8 AS log_id, event_id AS seq, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS place FROM events), b AS (SELECT *, CASE WHEN log_id = 2 AND seq % 97 = 3 THEN 'content' WHEN log_id = 3 AND seq % 89 = 5 AND place > 0 THEN 'prev' WHEN log_id = 4 AND seq % 83 = 7 THEN 'hmac' END AS reason FROM l)"


@_q("u1_content_hash", "SELECT event_id AS seq, sha256('{\"id\":' || event_id || ',\"action\":\"' || action || '\"}') AS content_hash FROM (SELECT request_id AS event_id, action FROM (" + D.REQUESTS_SQL + "))")
def u1(spark, sf):
    return D.audit_rows(spark, sf).select("seq", H.content_hash(F.col("payload")).alias("content_hash"))


_LINKED = H.hmac_sql("(ch || prev)", D.AUDIT_KEY)
_PAYLOAD = "'{\"id\":' || request_id || ',\"action\":\"' || action || '\"}'"


@_q("u2_build_chain", f"""WITH RECURSIVE l AS (SELECT user_id::BIGINT % 8 AS log_id, request_id AS seq, {_PAYLOAD} AS payload, sha256({_PAYLOAD}) AS ch, row_number() OVER (PARTITION BY user_id::BIGINT % 8 ORDER BY request_id) AS n FROM ({D.REQUESTS_SQL})),
c AS (SELECT log_id, seq, payload, n, ch, prev, {_LINKED} AS hmac FROM (SELECT *, '{H.GENESIS}' AS prev FROM l WHERE n = 1) UNION ALL SELECT log_id, seq, payload, n, ch, prev, {_LINKED} FROM (SELECT l.*, c.hmac AS prev FROM c JOIN l ON l.log_id = c.log_id AND l.n = c.n + 1))
SELECT log_id, seq, payload, ch AS content_hash, prev AS prev_hash, hmac FROM c""")
def u2(spark, sf):
    return audit.build_chain(D.audit_rows(spark, sf), D.AUDIT_KEY)


@_q("u3_verify_entries", f"WITH {_AUDIT}, p AS (SELECT *, lag(reason) OVER (PARTITION BY log_id ORDER BY seq) AS before FROM b) SELECT log_id, seq, reason IS DISTINCT FROM 'content' AS content_ok, reason IS DISTINCT FROM 'prev' AND before IS DISTINCT FROM 'hmac' AS prev_ok, reason IS NULL OR reason = 'content' AS hmac_ok FROM p")
def u3(spark, sf):
    return audit.verify_entries(D.tampered(spark, sf), D.AUDIT_KEY).select("log_id", "seq", "content_ok", "prev_ok", "hmac_ok")


@_q("u4_verify_summary", f"WITH {_AUDIT} SELECT log_id, count(*) AS entries, coalesce(min(place) FILTER (reason IS NOT NULL), count(*))::BIGINT AS valid, arg_min(seq, place) FILTER (reason IS NOT NULL) AS broken_seq, arg_min(reason, place) FILTER (reason IS NOT NULL) AS reason FROM b GROUP BY log_id")
def u4(spark, sf):
    return audit.verify_summary(audit.verify_entries(D.tampered(spark, sf), D.AUDIT_KEY))


@_q("u5_chain_head", "SELECT user_id % 8 AS log_id, count(*) AS n, true AS matches FROM events GROUP BY 1")
def u5(spark, sf):
    c = audit.build_chain(D.audit_rows(spark, sf), D.AUDIT_KEY)
    last = c.groupBy("log_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n")).join(c, ["log_id", "seq"]).select("log_id", "n", F.col("hmac").alias("h"))
    return last.join(audit.chain_head(c), "log_id").select("log_id", "n", (F.col("h") == F.col("hmac")).alias("matches"))


#: An audit event up to its last brace: the request's id, time and origin, and the decision with its reason.
_EVENT = """'{"request_id":' || request_id || ',"ts_us":' || ts_us || ',"action":"' || action || '","origin_kind":"' || origin_kind || '","principal":"' || principal || '","decision":"' || decision || '"' || CASE WHEN reason <> '' THEN ',"reason":"' || reason || '"' ELSE '' END"""


@_q("u6_audit_events", f"WITH RECURSIVE {_EVALUATED}, p AS (SELECT * FROM e WHERE NOT (action IN ('ListSessions', 'GetSessionStatus', 'ReadSessionOutput', 'ListGroups', 'GetSystemStatus') AND origin_kind IN ('BridgeTelegram', 'BridgeSlack') AND decision = 'Allow')) SELECT request_id, 0 AS stage, {_EVENT} || '}}' AS payload FROM p UNION ALL SELECT request_id, 1, {_EVENT} || ',\"report\":{{\"risk_score\":' || (request_id % 100) || '}}}}' FROM e WHERE action = 'FetchExternalContent' AND decision = 'Allow'")
def u6(spark, sf):
    e = _evaluated(spark, sf)
    reports = e.filter("action = 'FetchExternalContent' AND decision = 'Allow'").select("request_id", (F.col("request_id") % 100).alias("risk_score"))
    return audit.audit_events(e, reports).select("request_id", "stage", "payload")


@_q("u7_audit_search", f"WITH RECURSIVE {_EVALUATED} SELECT request_id FROM e WHERE ts_us >= {D.EPOCH_US} + 3600000000 AND ts_us < {D.EPOCH_US} + 7200000000 AND decision = 'Deny'")
def u7(spark, sf):
    from datetime import datetime, timezone

    at = lambda h: datetime(2024, 1, 1, h, tzinfo=timezone.utc)
    return audit.audit_search(_evaluated(spark, sf).withColumn("session_id", F.lit(None)), at(1), at(2), decision="Deny").select("request_id")


@_q("u7_search_layout", f"SELECT event_id FROM (SELECT event_id, 's' || user_id AS session_id, epoch_us(ts) AS us FROM events) WHERE session_id = 's7' AND us >= {D.EPOCH_US} + 86400000000 AND us < {D.EPOCH_US} + 3 * 86400000000")
def u7_layout(spark, sf):
    """A table of events over several days, by day and session, and a search of it."""
    from datetime import datetime, timezone

    us = f"{D.EPOCH_US} + timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    events = D.table(spark, sf, "events").selectExpr("event_id", "concat('s', user_id) AS session_id", f"timestamp_micros({us}) AS ts")
    path = new_path(spark, "events")
    audit.write_events(events, path)
    at = lambda day: datetime(2024, 1, day, tzinfo=timezone.utc)
    return audit.audit_search(spark.read.parquet(path), at(2), at(4), "s7").select("event_id")


@_q("s4_s5_audit_lines", "SELECT user_id % 8 AS log_id, event_id AS seq, true AS same FROM events")
def s4(spark, sf):
    c = audit.build_chain(D.audit_rows(spark, sf), D.AUDIT_KEY)
    fields = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"event":'), F.col("payload"), F.lit(',"fields":{"n":1}}'))).otherwise(F.col("payload"))
    c = c.withColumns({"payload": fields, "want": fields})
    return files.parse_audit(files.render_audit(c).select("log_id", "seq", "want", "line")).select("log_id", "seq", (F.col("payload") == F.col("want")).alias("same"))


# messages


_ALLOWED_M = "(user_id::BIGINT % 11 <> 0 AND ((user_id::BIGINT % 6 = 1 AND platform = 'telegram') OR (user_id::BIGINT % 6 = 2 AND platform = 'slack')))"


@_q("m1_m3_intake", f"SELECT message_id, CASE WHEN NOT {_ALLOWED_M} THEN 'UnknownSender' WHEN strlen(text) > 20 THEN 'MessageTooLarge' END AS reject, starts_with(text, '/') AS is_command FROM ({D.MESSAGES_SQL}) WHERE NOT bot")
def m1(spark, sf):
    return _intake(spark, sf).select("message_id", "reject", "is_command")


def _intake(spark, sf):
    return messages.intake(messages.resolve_identity(messages.drop_bots(D.messages(spark, sf)), D.allowlist(spark, sf)), most=20)


_TARGETS = "CASE CAST(message_id % 7 AS INT) WHEN 2 THEN 'web|deploy it now' WHEN 3 THEN 'api|please hold' END"
_COMMANDS = "CASE CAST(message_id % 7 AS INT) WHEN 0 THEN '/status||' WHEN 1 THEN '/check|build|' WHEN 2 THEN 'unknown|deploy|it now' WHEN 3 THEN '/send|api|please hold' WHEN 4 THEN 'unknown|there|' WHEN 5 THEN '/help||' ELSE 'unknown|x|y z' END"


@_q("m4_m5_parse", f"SELECT message_id, {_TARGETS} AS target, {_COMMANDS} AS command FROM ({D.MESSAGES_SQL})")
def m4(spark, sf):
    t, c = messages.parse_target(F.col("text")), messages.parse_command(F.col("text"))
    bar = lambda *x: F.concat_ws("|", *x)
    return D.messages(spark, sf).select("message_id", F.when(t.isNotNull(), bar(t["name"], t["message"])).alias("target"), bar(c["command"], c["name"], c["message"]).alias("command"))


#: Whether each row of r (message_id, sender, ts_us, n) passes the limits, one after the other.
_LIMITED = """c AS (SELECT message_id, sender, n, ts_us AS m, ts_us AS h, 1 AS im, 1 AS ih, true AS allowed FROM r WHERE n = 1 UNION ALL
SELECT message_id, sender, n, m, h, im + (im < 30 AND ih < 200)::INT, ih + (im < 30 AND ih < 200)::INT, im < 30 AND ih < 200 FROM (SELECT r.message_id, r.sender, r.n, CASE WHEN r.ts_us - c.m >= 60000000 THEN r.ts_us ELSE c.m END AS m, CASE WHEN r.ts_us - c.h >= 3600000000 THEN r.ts_us ELSE c.h END AS h,
CASE WHEN r.ts_us - c.m >= 60000000 THEN 0 ELSE c.im END AS im, CASE WHEN r.ts_us - c.h >= 3600000000 THEN 0 ELSE c.ih END AS ih FROM c JOIN r ON r.sender = c.sender AND r.n = c.n + 1))"""


@_q("m6_rate_limit", f"WITH RECURSIVE r AS (SELECT message_id, platform || ':' || user_id AS sender, ts_us, row_number() OVER (PARTITION BY platform || ':' || user_id ORDER BY ts_us, message_id) AS n FROM ({D.MESSAGES_SQL})), {_LIMITED} SELECT message_id, allowed FROM c")
def m6(spark, sf):
    return messages.rate_limit(D.messages(spark, sf))


@_q("m7_message_rate", f"SELECT platform || ':' || user_id AS sender, (ts_us - {D.EPOCH_US}) // 60000000 AS minute, count(*) AS n FROM ({D.MESSAGES_SQL}) GROUP BY ALL")
def m7(spark, sf):
    r = messages.message_rate(D.messages(spark, sf))
    return r.select("sender", F.expr(f"(unix_micros(start) - {D.EPOCH_US}) div 60000000").alias("minute"), "n")


@_q("m8_redact", "SELECT page_id, replace(replace(url, 'example.com', '[REDACTED]'), 'http', '[REDACTED]') AS url FROM pages")
def m8(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", messages.redact(F.col("url"), ["http", "example.com"]).alias("url"))


_JUDGED = f"j AS (SELECT *, CASE WHEN bot THEN 'Bot' WHEN NOT {_ALLOWED_M} THEN 'UnknownSender' WHEN strlen({_STRIP('text')}) > 20 THEN 'MessageTooLarge' END AS reject FROM ({D.MESSAGES_SQL}))"


@_q("m9_outcomes", f"WITH RECURSIVE {_JUDGED}, r AS (SELECT message_id, platform || ':' || user_id AS sender, ts_us, row_number() OVER (PARTITION BY platform || ':' || user_id ORDER BY ts_us, message_id) AS n FROM j WHERE reject IS NULL), {_LIMITED} SELECT outcome, count(*) AS n FROM (SELECT reject AS outcome FROM j WHERE reject IS NOT NULL UNION ALL SELECT CASE WHEN allowed THEN 'Accepted' ELSE 'RateLimited' END FROM c) GROUP BY outcome")
def m9(spark, sf):
    return messages.intake_outcomes(D.messages(spark, sf), D.allowlist(spark, sf), most=20)


_NOTE = "' … [truncated, ' || length(t) || ' chars]'"


@_q("m10_clip_reply", f"SELECT conv_id, turn, sha256(CASE WHEN length(t) <= 200 THEN t ELSE left(t, 200 - length({_NOTE})) || {_NOTE} END) AS reply_sha FROM (SELECT conv_id, turn, {_STRIP('text')} AS t FROM conversations)")
def m10(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(X.clip_reply(F.col("text"), 200), 256).alias("reply_sha"))


@_q("m11_only_new", "SELECT event_id AS update_id FROM events WHERE event_id > 100 * (user_id % 3)")
def m11(spark, sf):
    u = D.table(spark, sf, "events").select((F.col("user_id") % 3).alias("source"), F.col("event_id").alias("update_id"))
    return messages.only_new(u, spark.createDataFrame([(0, 0), (1, 100), (2, 200)], "source long, last_id long"))[0].select("update_id")


@_q("m12_reply_events", f"SELECT conv_id * 1000 + turn AS message_id, '{{\"event\":\"reply\",\"fields\":{{\"text_len\":' || length(text) || ',\"truncated\":' || (length({_STRIP('text')}) > 4096) || ',\"normalized_len\":' || length({_STRIP('text')}) || ',\"sent_len\":' || least(4096, length({_STRIP('text')})) || '}}}}' AS payload FROM conversations")
def m12(spark, sf):
    return messages.reply_events(D.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS message_id", "text"))


# sessions


_SEEN = f"seen AS (SELECT s.*, coalesce(l.live, 'Error') AS live FROM ({D.SESSIONS_SQL}) s LEFT JOIN ({D.LIVE_SQL}) l USING (session_id))"


_SIGNALS = ", ".join(f"CASE WHEN regexp_matches(tail, {_str(p)}) THEN '{state}' END" for state, p in rules.STATUS_PATTERNS)
_MISSING = " OR ".join(f"contains(line, {_str(p)})" for p in rules.TOOL_MISSING)


@_q("h1_h4_output", f"WITH o AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, '') || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'sh: x: not found' ELSE 'error: y' END, chr(10)) AS lines FROM documents), t AS (SELECT *, array_to_string(lines[-20:], chr(10)) AS tail FROM o) SELECT doc_id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) > 20 AS long, len(list_filter(lines[-10:], lambda line: {_MISSING})) > 0 AS missing, array_to_string(list_filter([{_SIGNALS}], lambda x: x IS NOT NULL), ',') AS signals FROM t")
def h1(spark, sf):
    d = D.table(spark, sf, "documents")
    t = F.coalesce("text", F.lit(""))
    out = F.concat(t, F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "sh: x: not found").otherwise("error: y"))
    return d.select("doc_id", (F.size(X.tail_lines(t, 21)) > 20).alias("long"), sessions.tool_missing(out).alias("missing"), F.array_join(sessions.signals(out), ",").alias("signals"))


@_q("h2_signals", f"WITH o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'codex' ELSE 'other' END AS tool, array_to_string(string_split(coalesce(text, '') || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Task  Complete' WHEN 1 THEN 'all DONE.' WHEN 2 THEN 'error: it was not finished. Bash(x)' ELSE 'What would you like' END, chr(10))[-20:], chr(10)) AS tail FROM documents), s AS (SELECT doc_id, unnest([{{'position': 0, 'kind': 'Completion', 'state': NULL, 'confidence': 'High', 'summary': CASE WHEN tool <> 'codex' THEN nullif(regexp_extract(tail, '(?i)(task complete|done\\.|finished\\.|completed successfully)'), '') ELSE nullif(regexp_extract(tail, '(?i)all done'), '') END}}, {{'position': 1, 'kind': 'Status', 'state': 'Waiting', 'confidence': 'Medium', 'summary': CASE WHEN tool <> 'codex' THEN nullif(regexp_extract(tail, '(?m)(╰─|>\\s*$|What would you like)'), '') END}}, {{'position': 2, 'kind': 'Status', 'state': 'Error', 'confidence': 'Medium', 'summary': CASE WHEN tool <> 'codex' THEN nullif(regexp_extract(tail, '(?mi)(^error:|panic|fatal error|segmentation fault)'), '') END}}, {{'position': 3, 'kind': 'Status', 'state': 'Running', 'confidence': 'Medium', 'summary': CASE WHEN tool <> 'codex' THEN nullif(regexp_extract(tail, '(Read\\(|Edit\\(|Bash\\(|Write\\(|Grep\\(|Glob\\()'), '') END}}]) AS x FROM o) SELECT doc_id, x.position, x.kind, x.state, x.confidence, x.summary FROM s WHERE x.summary IS NOT NULL")
def h2(spark, sf):
    last = F.element_at(F.array(*[F.lit(x) for x in ("Task  Complete", "all DONE.", "error: it was not finished. Bash(x)", "What would you like")]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = D.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "codex").otherwise("other").alias("tool"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), last).alias("output"))
    own = spark.createDataFrame([("codex", 0, "Completion", None, "High", "(?i)all done")], rules.SIGNAL_SCHEMA)
    return sessions.signal_rows(d, rules.signal_patterns(spark).unionByName(own), "doc_id")


@_q("h3_live_state", "SELECT 's' || user_id AS session_id, CASE WHEN user_id % 7 = 0 THEN 'Error' WHEN user_id % 3 = 0 THEN 'Waiting' ELSE 'Running' END AS live FROM (SELECT DISTINCT user_id FROM events)")
def h3(spark, sf):
    s = D.sessions(spark, sf)
    n = F.substring("session_id", 2, 20).cast("int")
    outputs = s.filter(n % 7 != 0).select("session_id", F.when(n % 3 == 0, "\x1b[1mdone\x1b[0m\n> ").otherwise("busy").alias("output"))
    return sessions.live_state(s, outputs)


_BEAT = f"{_SEEN}, w AS (SELECT session_id, title, CASE WHEN state = 'Stopped' THEN state ELSE live END AS now FROM seen)"
_STATE_COUNTS = ", ".join(f"count(*) FILTER (now = '{s}') AS {s.lower()}" for s in sessions.STATES)


@_q("h5_heartbeat", f"WITH {_BEAT} SELECT count(*) AS total, {_STATE_COUNTS} FROM w")
def h5(spark, sf):
    return sessions.heartbeat(D.sessions(spark, sf), D.live(spark, sf))


@_q("h5_needs_attention", f"WITH {_BEAT} SELECT session_id, title FROM w WHERE now IN ('Error', 'Waiting')")
def h5b(spark, sf):
    return sessions.needs_attention(D.sessions(spark, sf), D.live(spark, sf))


@_q("h6_state_changes", f"WITH {_SEEN} SELECT session_id, title, state AS old_state, live AS new_state FROM seen WHERE state <> 'Stopped' AND state <> live")
def h6(spark, sf):
    return sessions.state_changes(D.sessions(spark, sf), D.live(spark, sf))


@_q("h7_reconcile", f"WITH {_SEEN} SELECT session_id, state AS old_state, CASE WHEN state IN ('Running', 'Waiting', 'Idle') AND live = 'Error' THEN 'Error' WHEN state = 'Running' AND live = 'Stopped' THEN 'Stopped' WHEN state = 'Stopped' AND live IN ('Running', 'Waiting', 'Idle') THEN 'Running' END AS new_state FROM seen WHERE new_state IS NOT NULL")
def h7(spark, sf):
    return sessions.reconcile(D.sessions(spark, sf), D.live(spark, sf)).select("session_id", "old_state", "new_state")


@_q("h8_escalate", f"SELECT session_id, CASE WHEN state = 'Error' OR contains(output, 'confirm') THEN 'High' ELSE 'Medium' END AS priority, CASE WHEN state = 'Error' THEN 'session is in error state' WHEN contains(output, 'confirm') THEN 'output contains decision-request pattern: \"confirm\"' ELSE 'waiting for ' || (waiting_seconds // 60) || ' minutes' END AS reason FROM ({D.SESSIONS_SQL}) WHERE state = 'Error' OR (state = 'Waiting' AND (contains(output, 'confirm') OR waiting_seconds >= 600))")
def h8(spark, sf):
    return sessions.escalate(D.sessions(spark, sf))


_PARTS = " || ".join(f"CASE WHEN {s.lower()} > 0 THEN ', ' || {s.lower()} || ' {s.lower()}' ELSE '' END" for s in sessions.STATES)


@_q("h9_status_report", f"WITH {_BEAT}, b AS (SELECT count(*) AS total, {_STATE_COUNTS} FROM w) SELECT 0 AS part, '[STATUS] ' || total || ' sessions (' || substr({_PARTS}, 3) || ').' AS line FROM b UNION ALL SELECT 1, 'NEED: ' || title || ' - needs attention' FROM w WHERE now IN ('Error', 'Waiting')")
def h9(spark, sf):
    s, live = D.sessions(spark, sf), D.live(spark, sf)
    return sessions.status_report(sessions.heartbeat(s, live), sessions.needs_attention(s, live))


@_q("h10_change_episodes", f"WITH {_SEEN} SELECT session_id, 'ActionCompleted' AS kind, title || ': running -> ' || lower(live) AS summary FROM seen WHERE state = 'Running' AND live IN ('Waiting', 'Idle')")
def h10(spark, sf):
    return sessions.change_episodes(sessions.state_changes(D.sessions(spark, sf), D.live(spark, sf)))


@_q("h11_idle_trigger", "WITH c AS (SELECT user_id AS log_id, event_id AS cycle, CASE WHEN event_type = 'click' OR value > 50 THEN 1 ELSE 0 END AS running FROM events), i AS (SELECT *, sum(running) OVER (PARTITION BY log_id ORDER BY cycle) AS island FROM c) SELECT log_id, cycle, running = 0 AND sum(1 - running) OVER (PARTITION BY log_id, island ORDER BY cycle) % 3 = 0 AS fires FROM i")
def h11(spark, sf):
    c = D.table(spark, sf, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("cycle"), F.when((F.col("event_type") == "click") | (F.col("value") > 50), 1).otherwise(0).alias("running"), F.lit(0).alias("error"))
    return sessions.idle_trigger(c).select("log_id", "cycle", "fires")


@_q("h12_dedup_titles", f"SELECT session_id, CASE WHEN n > 1 THEN title || ' (' || n || ')' ELSE title END AS title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY created_at, session_id) AS n FROM ({D.SESSIONS_SQL}))")
def h12(spark, sf):
    return sessions.dedup_titles(D.sessions(spark, sf))


#: Each session's walk up, which ends before an ancestor that it has met.
_WALK = f"s AS ({D.SESSIONS_SQL}), p AS (SELECT session_id, parent_id FROM s WHERE parent_id IS NOT NULL AND parent_id <> session_id), a AS (SELECT session_id, parent_id AS ancestor_id, 1 AS depth, [parent_id] AS met FROM p UNION ALL SELECT a.session_id, p.parent_id, a.depth + 1, list_append(met, p.parent_id) FROM a JOIN p ON p.session_id = a.ancestor_id WHERE NOT list_contains(met, p.parent_id))"


@_q("h13_ancestors", f"WITH RECURSIVE {_WALK} SELECT session_id, ancestor_id, depth FROM a")
def h13(spark, sf):
    return sessions.ancestors(D.sessions(spark, sf))


@_q("h13_parent_errors", f"WITH RECURSIVE {_WALK} SELECT session_id, 'self-parent' AS error FROM s WHERE parent_id = session_id UNION ALL SELECT session_id, 'missing parent' FROM s WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT session_id FROM s) UNION ALL SELECT session_id, 'cycle' FROM a WHERE ancestor_id = session_id")
def h13b(spark, sf):
    return sessions.parent_errors(D.sessions(spark, sf))


_REFS = "SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'work ' || (user_id % 50) WHEN user_id % 3 = 1 THEN 's' || user_id ELSE 'S1' || (user_id % 20) END AS ref FROM events"


@_q("h14_resolve_sessions", f"WITH s AS ({D.SESSIONS_SQL}), r AS ({_REFS}), m AS (SELECT ref, (SELECT min(session_id) FROM s WHERE title = ref) AS t, (SELECT min(session_id) FROM s WHERE session_id = ref) AS i, (SELECT min(session_id) FROM s WHERE starts_with(lower(session_id), lower(ref))) AS p, (SELECT count(*) FROM s WHERE starts_with(lower(session_id), lower(ref))) AS n FROM r) SELECT ref, coalesce(t, i, CASE WHEN n = 1 THEN p END) AS session_id, CASE WHEN t IS NOT NULL OR i IS NOT NULL OR n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS status FROM m")
def h14(spark, sf):
    e = D.table(spark, sf, "events").select("user_id").distinct()
    refs = e.selectExpr("CASE WHEN user_id % 3 = 0 THEN 'work ' || (user_id % 50) WHEN user_id % 3 = 1 THEN 's' || user_id ELSE 'S1' || (user_id % 20) END AS ref").distinct()
    return sessions.resolve_sessions(refs, D.sessions(spark, sf))


@_q("h15_groups", f"SELECT DISTINCT group_id FROM ({D.SESSIONS_SQL}) WHERE group_id IS NOT NULL")
def h15(spark, sf):
    return sessions.groups(D.sessions(spark, sf))


@_q("h15_list_sessions", f"SELECT session_id, title, created_at FROM ({D.SESSIONS_SQL}) WHERE state = 'Waiting'")
def h15b(spark, sf):
    return sessions.list_sessions(D.sessions(spark, sf), "Waiting").select("session_id", "title", "created_at")


@_q("h16_status_counts", f"SELECT count(*) AS total, {_STATE_COUNTS.replace('now', 'state')} FROM ({D.SESSIONS_SQL})")
def h16(spark, sf):
    return sessions.status_counts(D.sessions(spark, sf))


# memory


@_q("k1_filter_episodes", f"SELECT line_no FROM ({D.EPISODES_SQL}) WHERE kind = 'CandidateLearning' AND list_contains(tags, 'user') AND day >= DATE '2023-09-01' AND day < DATE '2024-02-01'")
def k1(spark, sf):
    from datetime import date

    e = D.episodes(spark, sf).withColumn("ts", F.col("day"))
    return memory.filter_episodes(e, kind="CandidateLearning", tag="user", since=date(2023, 9, 1), until=date(2024, 2, 1)).select("line_no")


@_q("k2_search", f"SELECT 'episode' AS kind, summary AS text FROM ({D.EPISODES_SQL}) WHERE contains(lower(summary), 'time') UNION ALL SELECT 'learning', text FROM ({D.LEARNINGS_SQL}) WHERE contains(lower(text), 'time')")
def k2(spark, sf):
    return memory.search(D.episodes(spark, sf), D.learnings(spark), "TIME")


@_q("k3_memory_stats", f"WITH e AS ({D.EPISODES_SQL}), l AS ({D.LEARNINGS_SQL}) SELECT 'episodes' AS name, count(*) AS n FROM e UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM e UNION ALL SELECT 'kind:' || kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'learnings', count(*) FROM l UNION ALL SELECT 'stale', count(*) FILTER (stale) FROM l")
def k3(spark, sf):
    return memory.memory_stats(D.episodes(spark, sf), D.learnings(spark))


_KEY = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_CAND = f"cand AS (SELECT {_KEY('summary')} AS key, count(DISTINCT session_id) AS sessions, max(day) AS last_seen, arg_max(summary, {{'d': day, 'l': -line_no}}) AS text FROM ({D.EPISODES_SQL}) WHERE kind = 'CandidateLearning' GROUP BY 1)"


@_q("k4_candidates", f"WITH {_CAND} SELECT key, sessions, last_seen, text FROM cand")
def k4(spark, sf):
    return memory.candidates(D.episodes(spark, sf))


_LEARN = f"l AS (SELECT *, {_KEY('text')} AS key FROM ({D.LEARNINGS_SQL}))"
_PROMOTED = "pro AS (SELECT text, sessions::INTEGER AS count, last_seen, false AS stale FROM cand WHERE sessions >= 3 AND key NOT IN (SELECT key FROM l))"
_REINF = "re AS (SELECT l.pos, l.text, CASE WHEN c.key IS NOT NULL THEN greatest(l.count, c.sessions) ELSE l.count END::INTEGER AS count, CASE WHEN c.key IS NOT NULL THEN greatest(l.last_seen, c.last_seen) ELSE l.last_seen END AS last_seen, CASE WHEN c.key IS NOT NULL THEN false ELSE l.stale END AS stale FROM l LEFT JOIN cand c USING (key))"


@_q("k5_promote", f"WITH {_CAND}, {_LEARN}, {_PROMOTED} SELECT * FROM pro")
def k5(spark, sf):
    return memory.promote(memory.candidates(D.episodes(spark, sf)), D.learnings(spark))


@_q("k6_reinforce", f"WITH {_CAND}, {_LEARN}, {_REINF} SELECT pos, text, count, last_seen, stale FROM re")
def k6(spark, sf):
    return memory.reinforce(memory.candidates(D.episodes(spark, sf)), D.learnings(spark))


_STALE = "coalesce(last_seen < DATE '2024-06-30' - 180, false)"


@_q("k7_mark_stale", f"SELECT day, summary, {_STALE.replace('last_seen', 'day')} AS stale FROM ({D.EPISODES_SQL})")
def k7(spark, sf):
    e = D.episodes(spark, sf).select("day", "summary", F.col("day").alias("last_seen"), F.lit(False).alias("stale"))
    return memory.mark_stale(e, F.lit("2024-06-30")).select("day", "summary", "stale")


@_q("k8_archive", f"SELECT line_no FROM ({D.EPISODES_SQL}) WHERE day < DATE '2024-06-30' - 90")
def k8(spark, sf):
    return memory.archive(D.episodes(spark, sf), F.to_timestamp(F.lit("2024-06-30"))).select("line_no")


@_q("k9_consolidate", f"WITH {_CAND}, {_LEARN}, {_PROMOTED}, {_REINF}, a AS (SELECT text, count, last_seen, stale FROM re UNION ALL SELECT * FROM pro) SELECT text, count, last_seen, stale OR {_STALE} AS stale FROM a")
def k9(spark, sf):
    return memory.consolidate(D.episodes(spark, sf), D.learnings(spark), F.lit("2024-06-30"))


@_q("k9_report", f"WITH {_CAND}, {_LEARN}, {_PROMOTED}, {_REINF}, a AS (SELECT text, count, last_seen, stale FROM re UNION ALL SELECT * FROM pro), n AS (SELECT (SELECT count(*) FROM pro) AS promoted, (SELECT count(*) FROM a WHERE {_STALE} AND NOT stale) AS marked_stale, (SELECT count(*) FROM ({D.EPISODES_SQL}) WHERE day < DATE '2024-06-30' - 90) AS archived) SELECT *, 'promoted ' || promoted || ', marked ' || marked_stale || ' stale, ' || archived || ' episodes for archival' AS summary FROM n")
def k9_report(spark, sf):
    return memory.consolidation_report(D.episodes(spark, sf), D.learnings(spark), F.to_timestamp(F.lit("2024-06-30")))


@_q("s7_s8_learnings", f"SELECT row_number() OVER (PARTITION BY session_id ORDER BY line_no) > 0 AS ok, session_id AS doc_id, summary AS text, CASE WHEN line_no % 2 = 0 THEN 5 ELSE 1 END::INTEGER AS count, CASE WHEN line_no % 2 = 0 THEN day END AS last_seen, line_no % 3 = 0 AS stale FROM ({D.EPISODES_SQL})")
def s7(spark, sf):
    e = D.episodes(spark, sf).select(F.col("session_id").alias("doc_id"), F.col("line_no").alias("pos"), F.col("summary").alias("text"), F.when(F.col("line_no") % 2 == 0, 5).otherwise(1).alias("count"), F.when(F.col("line_no") % 2 == 0, F.col("day")).alias("last_seen"), (F.col("line_no") % 3 == 0).alias("stale"))
    lines = memory.render_learnings(e).select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    return memory.parse_learnings(lines).select(F.lit(True).alias("ok"), "doc_id", "text", "count", "last_seen", "stale")


# evaluation


_CORPUS = f"{_SCORES}, i AS (SELECT doc_id AS item_id, source AS corpus, risk_score FROM s)"


def _corpus(spark, sf):
    return _scored(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("source").alias("corpus"), "risk_score")


@_q("e1_fp_gate", f"WITH {_CORPUS} SELECT corpus, count(*) FILTER (risk_score >= 50) AS hits, count(*) FILTER (risk_score >= 51) + 1 AS allowed, count(*) FILTER (risk_score >= 50) <= count(*) FILTER (risk_score >= 51) + 1 AS passes FROM i GROUP BY corpus")
def e1(spark, sf):
    s = written(_corpus(spark, sf), "scores")
    return evaluation.fp_gate(s, evaluation.build_baseline(s, 51)).select("corpus", "hits", "allowed", "passes")


@_q("e2_corpus_drift", "SELECT doc_id AS item_id, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 3 = 0 THEN 'rescored' END AS change FROM documents WHERE (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0) AND NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)")
def e2(spark, sf):
    s = written(_corpus(spark, sf), "scores")
    now = s.filter("item_id % 5 <> 0")
    was = s.filter("item_id % 7 <> 0").withColumn("risk_score", F.when(F.col("item_id") % 3 == 0, F.col("risk_score") + 1).otherwise(F.col("risk_score")))
    return evaluation.corpus_drift(now, was)


@_q("e2_baseline_drift", "WITH b AS (SELECT source AS corpus, count(*)::BIGINT AS was, (count(*) FILTER (doc_id % 5 <> 0))::BIGINT AS kept FROM documents GROUP BY 1) SELECT corpus, 'threshold' AS drift, 51::BIGINT AS was, 50::BIGINT AS now FROM b UNION ALL SELECT corpus, 'size', was, nullif(kept, 0) FROM b WHERE kept <> was")
def e2b(spark, sf):
    s = written(_corpus(spark, sf), "scores")
    return evaluation.baseline_drift(s.filter("item_id % 5 <> 0"), evaluation.build_baseline(s, 51))


_EXPECT = "(VALUES (0, 'INJ-001', 'High'), (8, 'ENC-002', 'Low'), (8, 'ENC-002', 'Medium'), (10, 'REP-001', 'Low'), (1, 'INJ-001', 'High')) x(k, rule_id, least_severity)"


@_q("e3_expectations", f"WITH {_FINDINGS} SELECT n.doc_id AS item_id, x.rule_id, x.least_severity, EXISTS (SELECT 1 FROM f WHERE f.doc_id = n.doc_id AND f.rule_id = x.rule_id AND CASE f.severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END >= CASE x.least_severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS met FROM n JOIN {_EXPECT} ON n.doc_id % 23 = x.k")
def e3(spark, sf):
    found = content.explode_findings(_scored(spark, sf).select(F.col("doc_id").alias("item_id"), "findings"))
    x = spark.createDataFrame([(0, "INJ-001", "High"), (8, "ENC-002", "Low"), (8, "ENC-002", "Medium"), (10, "REP-001", "Low"), (1, "INJ-001", "High")], "k long, rule_id string, least_severity string")
    wanted = D.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 23).alias("k")).join(F.broadcast(x), "k").drop("k")
    return evaluation.expectations(found, wanted)


@_q("e5_baseline", f"WITH {_CORPUS} SELECT corpus, 50 AS threshold, count(*) AS corpus_size, count(*) FILTER (risk_score >= 50) AS baseline_hits FROM i GROUP BY corpus")
def e5(spark, sf):
    return evaluation.build_baseline(_corpus(spark, sf))


@_q("e5_item_scores", f"WITH {_CORPUS} SELECT corpus, item_id, risk_score FROM i")
def e5b(spark, sf):
    return evaluation.item_scores(_corpus(spark, sf))


@_q("e6_stripped_totals", f"WITH {_C} SELECT 'ansi-escape' AS element, sum(length(text) - length(replace(text, chr(27), '')))::BIGINT AS n FROM c")
def e6(spark, sf):
    d = D.content(spark, sf).withColumn("declared_type", F.lit("Log"))
    return evaluation.stripped_totals(content.sanitize(d, id_col="doc_id"))


# sources and sinks: rows are written to the shared folder and read back


@_q("s1_read_content", f"WITH {_C} SELECT doc_id::VARCHAR AS content_id, sha256(text) AS body_sha FROM c WHERE doc_id % 10 <> 3 AND NOT starts_with(ltrim(text), '{files.SKIP}')")
def s1(spark, sf):
    path = new_path(spark, "content")
    body = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit(f" {files.SKIP} "), F.col("text"))).otherwise(F.col("text"))
    D.content(spark, sf).select(F.col("doc_id").cast("string").alias("content_id"), body.cast("binary").alias("body")).write.parquet(path)
    return files.read_content(spark, path, "parquet").select("content_id", F.sha2("body", 256).alias("body_sha"))


@_q("s2_s3_episodes", f"SELECT line_no::VARCHAR AS id, session_id, kind, summary, array_to_string(tags, ',') AS tags, day FROM ({D.EPISODES_SQL})")
def s2(spark, sf):
    path = new_path(spark, "episodes")
    e = D.episodes(spark, sf).select(F.col("line_no").cast("string").alias("id"), "ts", "session_id", "kind", "summary", F.lit(None).cast("string").alias("details"), "tags", F.lit("conversations").alias("source"))
    for rest in (0, 1):
        files.append_episodes(e.filter(F.col("id") % 2 == rest), path)
    return files.read_episodes(spark, path).select("id", "session_id", "kind", "summary", F.array_join("tags", ",").alias("tags"), F.to_date("ts").alias("day"))


@_q("s6_sessions", f"SELECT session_id, title, state FROM ({D.SESSIONS_SQL})")
def s6(spark, sf):
    path = new_path(spark, "sessions")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    D.sessions(spark, sf).select("session_id", "title", quoted(F.col("state")).alias("state"), F.lit('"shell"').alias("tool"), F.lit('"Builder"').alias("execution_class")).write.parquet(path)
    return files.read_sessions(spark, path).select("session_id", "title", "state")


@_q("s6_grants", f"SELECT grant_id, principal, capability, expires_us FROM ({D.GRANTS_SQL})")
def s6b(spark, sf):
    path = new_path(spark, "grants")
    g = D.grants(spark, sf)
    g.withColumns({"capability": F.concat(F.lit('"'), "capability", F.lit('"')), "expires_at": F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")}).write.parquet(path)
    return files.read_grants(spark, path).select("grant_id", "principal", "capability", F.unix_micros("expires_at").alias("expires_us"))


@_q("s9_allowlist", f"SELECT platform, user_id, 'T' || ceiling AS tier FROM ({D.ALLOW_SQL})")
def s9(spark, sf):
    path = new_path(spark, "allowlist")
    D.allowlist(spark, sf).withColumn("name", F.concat(F.lit("user "), "user_id")).write.json(path)
    return files.read_allowlist(spark, path).select("platform", "user_id", "tier")


@_q("s10_sanitized", f"WITH {_C}, {_LANES} SELECT content_type, count(*) AS n, sum(strlen(t))::BIGINT AS bytes_out FROM n GROUP BY content_type")
def s10(spark, sf):
    path = new_path(spark, "sanitized")
    d = D.content(spark, sf).withColumn("declared_type", F.when(F.col("doc_id") % 2 == 0, "PlainText").otherwise("Log"))
    files.write_sanitized(content.sanitize(d, id_col="doc_id"), path, "doc_id")
    return epochs.committed(spark, path, "reports").groupBy("content_type").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out"))


# dimensions as tables


@_q("x2_status_by_tool", f"SELECT session_id, CASE WHEN n % 7 = 0 THEN 'Error' WHEN n % 2 = 0 AND n % 3 = 0 THEN 'Idle' WHEN n % 3 = 0 THEN 'Waiting' ELSE 'Running' END AS live FROM (SELECT session_id, substr(session_id, 2)::BIGINT AS n FROM ({D.SESSIONS_SQL}))")
def x2(spark, sf):
    n = F.substring("session_id", 2, 20).cast("int")
    s = D.sessions(spark, sf).withColumn("tool", F.when(n % 2 == 0, "shell").otherwise("agent"))
    outputs = s.filter(n % 7 != 0).select("session_id", F.when(n % 3 == 0, "\x1b[1mdone\x1b[0m\n> ").otherwise("busy").alias("output"))
    own = spark.createDataFrame([("shell", 0, "Idle", r"(?m)^> $")], "tool string, position int, state string, pattern string")
    return sessions.live_state_by_tool(s, outputs, rules.status_patterns(spark).unionByName(own))


@_q("x3_fetched", "SELECT page_id, page_id % 3 <> 0 AS fetched, CASE WHEN page_id % 3 <> 0 THEN sha256(html) END AS body_sha FROM pages")
def x3(spark, sf):
    p = D.table(spark, sf, "pages").withColumn("asked", F.concat(F.lit("HTTP://u:p@Host"), F.col("page_id").cast("string"), F.lit(".Example:80/x;s=1?q=2#f")))
    landed = p.filter("page_id % 3 <> 0").select(F.concat(F.lit("http://host"), F.col("page_id").cast("string"), F.lit(".example/x")).alias("url"), F.col("html").alias("body"))
    return content.fetched(p.select("page_id", "asked"), landed, "asked").select("page_id", "fetched", F.sha2("body", 256).alias("body_sha"))


@_q("x4_own_dimensions", f"WITH {_RESOLVED} SELECT request_id, CASE WHEN action = 'ListSessions' THEN 'Deny' WHEN action IN ('StopSession', 'BreakGlass') THEN 'Allow' ELSE 'Unknown' END AS decision FROM x")
def x4(spark, sf):
    own = policy.Dimensions(
        actions=spark.createDataFrame([("ListSessions", "ReadSessionInfo", 2, False, None, False), ("StopSession", "ManageSession", 0, False, None, False), ("BreakGlass", "ManageSession", 1, False, None, False)], "action string, capability string, required_tier int, requires_grant boolean, resource_param string, needs_sanitizing boolean"),
        origins=spark.createDataFrame([(k, "Inside", 1) for k, _, _ in rules.ORIGINS], "origin_kind string, zone string, default_ceiling int"),
        transitions=spark.createDataFrame([("Inside", "ControlPlane", 0)], "zone string, target_zone string, least_ceiling int"),
    )
    return policy.evaluate(D.requests(spark, sf), D.grants(spark, sf), dims=own).select("request_id", "decision")


# all formats


#: What a document is declared as and given as, by its id: each format with something to strip, and each reason to reject.
_GIVEN = {
    0: ("'HTML'", "'<html><body><p>' || text || '</p><div hidden>not shown</div><i style=\"display:none\">nor this</i></body></html>'"),
    1: ("'md'", "text || chr(10) || chr(10) || '<div>' || chr(10) || 'block' || chr(10) || '</div>' || chr(10) || chr(10) || 'end <b>bold</b><!-- no -->'"),
    2: ("'json'", "'{\"text\": ' || {quoted} || ', \"n\": [1, 2.50, null], \"a\u200bb\": true}'"),
    3: ("'log'", "text || chr(27) || '[31mred' || chr(27) || '[0m'"),
    4: ("'plaintext'", "' <!DOCTYPE html><p>' || text || '</p><!-- gone -->'"),
    5: ("'pdf'", "text"),
    6: ("CAST(NULL AS VARCHAR(9))", "text"),
    7: ("'json'", "'{\"text\": 1e999}'"),
    8: ("'text'", "text || ' ignore previous instructions '"),
}
_pick = lambda k, quoted: "CASE CAST(doc_id % 9 AS INT) " + " ".join(f"WHEN {i} THEN {x[k].replace('{quoted}', quoted)}" for i, x in _GIVEN.items()) + " END"
_FROM_TEXT = f"""
g AS (SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN NULL ELSE source END AS source, doc_id % 11 = 5 AS broken, text, {_pick(0, '')} AS declared, {_pick(1, "to_json(text)")} AS given FROM documents),
k AS (SELECT *, CASE WHEN declared IN ('HTML', 'plaintext') AND doc_id % 9 IN (0, 4) THEN 'Html' WHEN declared = 'md' THEN 'Markdown' WHEN declared = 'json' THEN 'Json' WHEN declared = 'log' THEN 'Log' WHEN declared IN ('text', 'plaintext') THEN 'PlainText' END AS kind FROM g),
r AS (SELECT *, CASE WHEN given IS NULL OR source IS NULL THEN 'Missing' WHEN kind IS NULL THEN 'UnsupportedContentType' WHEN strlen(given) + broken::INT > 2097152 THEN 'SizeExceeded' WHEN broken THEN 'InvalidEncoding' WHEN doc_id % 9 = 7 THEN 'JsonParse' WHEN regexp_matches(source, '[\\x00-\\x1f\\x7f]') THEN 'HeaderInjection' END AS reason FROM k),
s AS (SELECT *, CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN text || chr(10) WHEN 4 THEN ' ' || CASE WHEN text = '' THEN '' ELSE chr(10) END || text || chr(10)
  WHEN 1 THEN {_ESCAPED('text')} || chr(10) || chr(10) || chr(10) || 'end bold' WHEN 2 THEN '{{"ab":true,"n":[1,2.5,null],"text":' || to_json({_STRIP('text')}) || '}}' WHEN 3 THEN text || 'red' ELSE given END AS body FROM r)
"""


def _formats(spark, sf):
    rows = D.table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 11 = 3 THEN NULL ELSE source END AS source", "text", "doc_id % 11 = 5 AS broken")
    quoted = "substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"
    rows = rows.selectExpr("doc_id", "source", f"{_pick(0, '')} AS declared_type", f"CAST({_pick(1, quoted)} AS BINARY) AS given", "broken")
    return content.sanitize(rows.withColumn("text", F.when(F.col("broken"), F.concat("given", F.unhex(F.lit("FF")))).otherwise(F.col("given"))), id_col="doc_id")


@_q("r8_formats", f"WITH {_FROM_TEXT} SELECT doc_id, kind AS content_type, CASE WHEN doc_id % 9 = 4 THEN 'PlainText' END AS routed_from, (strlen(given) + broken::INT)::INTEGER AS bytes_in, reason AS reject_reason, CASE WHEN reason IS NULL THEN sha256({_STRIP('body')} || CASE WHEN suffix({_STRIP('body')}, chr(10)) THEN '' ELSE chr(10) END) END AS body_sha, CASE WHEN reason IS NULL THEN CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'hidden-attr=1,hidden-style-i=1' WHEN 1 THEN 'markdown-html-block=1,markdown-html-comment=1,markdown-html-inline=2' WHEN 3 THEN 'ansi-escape=2' WHEN 4 THEN 'comment=1' ELSE '' END END AS stripped FROM s")
def r8_formats(spark, sf):
    """All five formats, with what each strips, and all reasons to reject, of every document."""
    out = _formats(spark, sf)
    stripped = F.array_join(F.array_sort(F.transform(F.filter(F.map_entries("stripped_elements"), lambda e: e["value"] > 0), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return out.select("doc_id", "content_type", "routed_from", "bytes_in", "reject_reason", F.sha2(content.unwrap(F.col("wrapped")), 256).alias("body_sha"), F.when(F.col("reject_reason").isNull(), stripped).alias("stripped"))


@_q("s10_outputs", f"WITH {_FROM_TEXT}, t AS (SELECT 'clean' AS name, kind, NULL AS why FROM s WHERE reason IS NULL UNION ALL SELECT 'reports', kind, NULL FROM s WHERE reason IS NULL UNION ALL SELECT 'quarantine', kind, reason FROM s WHERE reason IS NOT NULL) SELECT name, kind AS content_type, why AS reject_reason, count(*) AS n FROM t GROUP BY ALL")
def s10_outputs(spark, sf):
    """The sanitizer's tables as they are read back: how many rows of each kind stand in each."""
    path = new_path(spark, "outputs")
    files.write_sanitized(_formats(spark, sf), path, "doc_id")
    tables = [(name, epochs.committed(spark, path, name)) for name in ("clean", "reports", "quarantine")]
    each = [df.select(F.lit(name).alias("name"), "content_type", (F.col("reject_reason") if name == "quarantine" else F.lit(None).cast("string")).alias("reject_reason")) for name, df in tables]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("name", "content_type", "reject_reason").agg(F.count("*").alias("n"))


# the same operators as streams: a table is written, read as a stream, and what the stream commits is read back


#: Rows of a micro-batch of the registered streams, about: a key's rows of one are held in memory.
STREAM_ROWS = 2_000_000


def _as_stream(df: DataFrame, name: str, order: str, most: int = STREAM_ROWS) -> DataFrame:
    """df, written to a step and read from it as a stream of micro-batches of about `most` rows, in order of the column `order`.

    Rows of one value of `order` are in one micro-batch. A larger table is written by ranges of the order first, and the ranges are then
    added one after the other, in equally many files each, as streams read files by their time.
    """
    spark, path, files_each = df.sparkSession, new_path(df.sparkSession, name), None
    rows = written(df, f"{name}-rows")
    parts = max(1, -(-rows.count() // most))
    if parts == 1:
        rows.write.parquet(path)
    else:
        ranged = written(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), f"{name}-ranges", ("_range",))
        sizes = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect())
        files_each = 8 if min(n for _, n in sizes) >= 1000 else 1
        for i, _ in sizes:
            ranged.filter(F.col("_range") == i).drop("_range").repartition(files_each).write.mode("append").parquet(path)
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)  # the store that keyed state with timers needs
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(path)


def _committed(stream: DataFrame, name: str) -> DataFrame:
    """What a stream makes of all its input, committed and read back."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)
    epochs.start(stream, lambda batch: {name: batch}, path, f"{path}-checkpoint").awaitTermination()
    return epochs.committed(spark, path, name, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)).select(*stream.columns)


@_q("a7_stream", _SQL["a7_consume_grants"])
def a7_stream(spark, sf):
    checked = policy.checked(D.requests(spark, sf), policy.ceilings_from_allowlist(D.allowlist(spark, sf)), guard_key="principal")
    asked = _as_stream(policy.asks_grants(checked).select("request_id", "principal", "capability", "resource", "ts"), "asked", "ts")
    return _committed(jobs.consume_grants(asked, written(D.grants(spark, sf), "grants")), "spent").select(F.col("request_id").cast("long").alias("request_id"), "grant_id")


@_q("a10_stream", _SQL["a10_evaluate"])
def a10_stream(spark, sf):
    requests = _as_stream(D.requests(spark, sf), "requests", "ts")
    overrides = written(policy.ceilings_from_allowlist(D.allowlist(spark, sf)), "overrides")
    made = jobs.evaluate(requests, written(D.grants(spark, sf), "grants"), overrides)
    return _committed(made, "decisions").select("request_id", "principal", "decision", "reason")


@_q("u2_stream", _SQL["u2_build_chain"])
def u2_stream(spark, sf):
    return _committed(jobs.build_chain(_as_stream(D.audit_rows(spark, sf), "entries", "seq"), D.AUDIT_KEY), "chain")


@_q("h11_stream", _SQL["h11_idle_trigger"])
def h11_stream(spark, sf):
    c = D.table(spark, sf, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("cycle"), F.when((F.col("event_type") == "click") | (F.col("value") > 50), 1).otherwise(0).alias("running"), F.lit(0).alias("error"))
    return _committed(jobs.idle_trigger(_as_stream(c, "cycles", "cycle")), "idle")
