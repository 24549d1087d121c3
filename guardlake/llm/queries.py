"""One query for each numbered operator, on whole tables, with the digests its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm import bpe, chat, decontam, divergence, langid, linededup, lzprint, mixing, neardup, pii, quality, sharding, vafile
from guardlake.llm.shared import spread, training_row, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores where a few files give less."""
    return spread(table(spark, sf_dir, "documents"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents")).drop("source", "frac_rank")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs), keep=["doc_id"]).select("doc_id", (~training_row()).alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans has all spans: the base ones of the contract's four kinds, and those that the method adds, of these kinds or `secret`, which
    comes after the four where spans begin together."""
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.fit(docs), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(n, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"), F.size("pii").cast("long").alias("n_found"),
    )


def byte_vocabulary() -> list[bytes]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(documents(spark, sf_dir), byte_vocabulary(), keep=["doc_id"], decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Conversation -1: control strings inside texts.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    messages = written(chat.from_turns(rows.unionByName(control)), "messages")
    formatted = chat.format_trees(messages)
    formatted = formatted.join(messages.filter("node = 1").select("tree", "tree_id"), "tree")
    read = chat.turn_texts(formatted, ["tree_id", "n_turns", "formatted"])
    return read.select(
        F.col("tree_id").alias("conv_id"), "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.drop_repeated_lines(docs, keep=["doc_id"]).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lzprint.edit_test(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", (~training_row()).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("hit_items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.cluster(table(spark, sf_dir, "embeddings"))


def _crc_entry(c: int) -> int:
    for _ in range(8):
        c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
    return c


_CRC_TABLE = "[" + ", ".join(str(_crc_entry(i)) for i in range(256)) + "]"
_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
_CRC = f"coalesce(xor(list_reduce({_BYTES}, lambda crc, b: xor(crc >> 8, ({_CRC_TABLE})[(xor(crc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT), 0)"

OP1_SQL = f"""
WITH sums AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size, {_CRC} AS text_crc32, coalesce('=' || source, 'null') AS stratum FROM documents),
rows AS (SELECT *, md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32) AS digest FROM sums),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, text_crc32, size) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS f FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY f, stratum, digest, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 16 // n)::INTEGER AS shard,
       (p - ((p * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH lines AS (
  SELECT rowid AS r, doc_id, x.i AS i, x.line AS line, {_FOLD.format("trim(x.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents),
       (SELECT unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda line, i: {{'i': i, 'line': line}})) AS x)),
hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (hot.k IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (k) GROUP BY r
"""

_WORDS = f"regexp_extract_all({_FOLD.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (
  SELECT p.r, p.i, wins.n, wins.item
  FROM (SELECT r, i, s.n AS n, array_to_string(w[i:i + s.n - 1], ' ') AS win FROM pos, (SELECT DISTINCT n FROM wins) s WHERE i + s.n - 1 <= len(w)) p
  JOIN wins ON wins.n = p.n AND wins.win = p.win),
hit_words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


OP5_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + 5 * (length(role) - length(replace(role, chr(10), ''))) + 1
           + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


OP11_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, 'null') AS stratum, len(coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []))::BIGINT AS size,
         ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h
  FROM documents),
sources AS (SELECT stratum, sum(size)::BIGINT AS size, CASE (row_number() OVER (ORDER BY stratum) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM rows GROUP BY stratum),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY size / weight, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
         coalesce(sum(weight) OVER (ORDER BY size / weight, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
         sum(size) OVER () AS total, sum(weight) OVER () AS weights FROM sources),
marked AS (SELECT *, (total - 3 * size_before) * weight >= 3 * size * (weights - weight_before) AS bounded FROM ranked),
aims AS (
  SELECT stratum, size AS source_size, CASE WHEN bounded THEN (3 * size)::DOUBLE
         ELSE (weight * (total - 3 * coalesce(sum(size) FILTER (bounded) OVER (), 0)))::DOUBLE / (weights - coalesce(sum(weight) FILTER (bounded) OVER (), 0))::DOUBLE END AS target FROM marked),
based AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS base FROM aims),
seen AS (SELECT rows.*, source_size, target, base, sum(size) OVER (PARTITION BY stratum ORDER BY h, r) - size AS before FROM rows JOIN based USING (stratum))
SELECT doc_id, size, source_size, target, (base + (2 * (target - base * source_size - before) > size AND target > base * source_size)::INTEGER)::INTEGER AS copies,
       (size * (base + (2 * (target - base * source_size - before) > size AND target > base * source_size)::INTEGER))::BIGINT AS taken
FROM seen
"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS n FROM tok GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, source, t, count(*) AS n FROM tok SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT grp.lang, grp.source, v, (SELECT coalesce(sum(n), 0) FROM held WHERE held.lang = grp.lang AND held.source = grp.source) AS total FROM grp LEFT JOIN l USING (lang)),
p AS (
  SELECT g.lang, g.source, kept.t, coalesce(held.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(held.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
         1 + (1000000000::HUGEINT * (kept.n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN held ON held.lang = g.lang AND held.source = g.source AND held.t = kept.t),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
"""


def _kmeans_sql(rounds: int = 10, k: int = 8) -> str:
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c.c AS c, {d} AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS MATERIALIZED (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j)")
            steps.append(f"m{i} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = best.c
"""


OP13_SQL = _kmeans_sql()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_language_id": op2_language_id,
        "op3_pii": op3_pii,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_chat_format": op5_chat_format,
        "op6_line_dedup": op6_line_dedup,
        "op7_lz_fingerprint": op7_lz_fingerprint,
        "op8_near_dedup": op8_near_dedup,
        "op9_quality": op9_quality,
        "op10_decontamination": op10_decontamination,
        "op11_mixing": op11_mixing,
        "op12_divergence": op12_divergence,
        "op13_centroids": op13_centroids,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op5_chat_format": OP5_SQL, "op6_line_dedup": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_mixing": OP11_SQL, "op12_divergence": OP12_SQL, "op13_centroids": OP13_SQL}
