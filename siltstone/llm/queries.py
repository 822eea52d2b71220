"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, dialogue, langid, lines, minhash, mixing, packing, passages, quality, rules, topk, toxicity, urls
from .common import fold_is, fold_of, read_table

WORD = r"[^\x20\x09-\x0D]+"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", fold_is(F.col("doc_id"), 4, 2))
    model = langid.train(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("row")


#: All pairs of documents that share a shingle, then all that can be reached over links: for small tables.
SQL_NEAR = rf"""
WITH RECURSIVE near_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
near_sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM near_words),
near_sizes AS (SELECT doc_id, count(*) AS n FROM near_sets GROUP BY doc_id),
near_links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM near_sets x JOIN near_sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN near_sizes m ON m.doc_id = a JOIN near_sizes n ON n.doc_id = b WHERE 100 * met >= 85 * (m.n + n.n - met)),
near_both AS (SELECT a, b FROM near_links UNION ALL SELECT b, a FROM near_links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN near_both l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM reached LEFT JOIN near_sizes USING (doc_id) GROUP BY doc_id"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_is(F.col("doc_id"), 4, 2)
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 4) != 2), judges=~held_out)
    out = toxicity.score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_is(F.col("doc_id"), 5, 0)
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0))
    out = quality.score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("digest"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Documents without the lines that at least eight sites have as a minor part of a page; `{docs}` names the table.
LINES_CTE = rf"""
line_rows AS (
  SELECT doc_id, source, page, i, l, trim(l, {_BLANKS}) AS t FROM (
    SELECT doc_id, coalesce(source, chr(0)) AS source, length(text) AS page, unnest(string_split(text, chr(10))) AS l,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {{docs}})),
line_wide AS (SELECT t FROM line_rows WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 8),
line_pages AS (SELECT doc_id FROM line_rows JOIN line_wide USING (t) GROUP BY doc_id HAVING 100 * sum(length(l)) <= 50 * any_value(page)),
line_bad AS (
  SELECT t FROM line_rows JOIN line_wide USING (t) JOIN line_pages USING (doc_id) GROUP BY t HAVING count(DISTINCT source) >= 8),
line_docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad), '') AS rest
  FROM (SELECT r.*, b.t IS NOT NULL AS bad FROM line_rows r LEFT JOIN line_bad b USING (t)) GROUP BY doc_id),
lined AS (
  SELECT d.* EXCLUDE (text), coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_removed, CASE WHEN n_bad > 0 THEN rest ELSE d.text END AS text
  FROM {{docs}} d LEFT JOIN line_docs USING (doc_id))"""

SQL_LINES = f"""WITH {LINES_CTE.format(docs="documents")}
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars_left, md5(text) AS digest FROM lined"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM p q JOIN p c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clusters.clustered(read_table(spark, sf_dir, "embeddings"))
    return clusters.inertia(assigned, centroids)


def _sql_round(n: int) -> str:
    """Vectors by the nearest of the centroids c{n}, and the centroids after them."""
    return f"""
d{n} AS (SELECT vec_id, j, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM p JOIN c{n} c USING (i) GROUP BY ALL),
a{n} AS (SELECT vec_id, j AS cluster, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, j) AS r FROM d{n}) WHERE r = 1),
m{n} AS (SELECT cluster AS j, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{n} JOIN p USING (vec_id) GROUP BY ALL),
c{n + 1} AS (SELECT c.j, c.i, CASE WHEN n IS NULL THEN c.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{n} c LEFT JOIN m{n} USING (j, i))"""


SQL_CLUSTERS = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM v),
c0 AS (SELECT j, i, x FROM f JOIN p USING (vec_id) WHERE j < 16),{",".join(_sql_round(n) for n in range(4))},
h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY j)
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN h ON j = cluster"""


#: Verdicts by host and path.
URL_RULES = (
    urls.UrlRule("allow", "com"), urls.UrlRule("block", "example.com", "/en/"), urls.UrlRule("allow", "www.example.com", "/en/"),
    urls.UrlRule("block", "net", "/es/"), urls.UrlRule("block", "net", "/fr/"),
)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def _sql_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Arcs have the degree of where they begin; a host's arc to itself brings its seed.
SQL_URLS = rf"""
WITH RECURSIVE rule_list AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'),
  ('block', 'net', '/fr/')) t(verdict, rule_host, rule_path)),
parts AS (
  SELECT page_id, html, {_sql_lower("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (
  SELECT p.*, r.rule, r.said FROM parts p LEFT JOIN (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS said
    FROM parts JOIN rule_list ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path) GROUP BY page_id) r USING (page_id)),
counts AS (
  SELECT host, count(*) FILTER (said = 'allow') * {urls.UNIT} // count(*) AS good, count(*) FILTER (said = 'block') * {urls.UNIT} // count(*) AS bad FROM judged WHERE host <> '' GROUP BY host),
linked AS (SELECT DISTINCT host AS a, {_sql_lower("unnest(regexp_extract_all(html, '" + urls.LINK.replace("'", "''") + "', 1))")} AS b FROM parts WHERE host <> ''),
hosts AS (SELECT host FROM counts UNION SELECT b FROM linked WHERE a <> b),
under AS (SELECT host AS a, nullif(regexp_extract(host, '^[^.]+\.(.+\..+)$', 1), '') AS b FROM hosts),
links AS (SELECT a, b FROM linked WHERE a <> b UNION SELECT a, b FROM under WHERE b IS NOT NULL UNION SELECT b, a FROM under WHERE b IS NOT NULL),
arcs AS (SELECT 't' AS kind, a, b FROM links UNION ALL SELECT 'd', b, a FROM links),
seeds AS (
  SELECT kind, host, seed * {urls.DAMPING[1] - urls.DAMPING[0]} // {urls.DAMPING[1]} AS seed FROM (SELECT 't' AS kind, host, good AS seed FROM counts UNION ALL SELECT 'd', host, bad FROM counts)),
nodes AS (SELECT kind, host FROM seeds UNION SELECT kind, a FROM arcs UNION SELECT kind, b FROM arcs),
steps AS (
  SELECT kind, a, b, count(*) OVER (PARTITION BY kind, a) AS degree, 0::BIGINT AS seed FROM arcs
  UNION ALL SELECT kind, host, host, NULL, coalesce(seed, 0) FROM nodes LEFT JOIN seeds USING (kind, host)),
scores AS (
  SELECT 0 AS n, kind, b AS host, seed::BIGINT AS score FROM steps WHERE degree IS NULL
  UNION ALL
  SELECT n + 1, s.kind, s.b, sum(CASE WHEN degree IS NULL THEN seed ELSE score // degree * {urls.DAMPING[0]} // {urls.DAMPING[1]} END)::BIGINT
  FROM scores JOIN steps s ON s.kind = scores.kind AND s.a = scores.host WHERE n < {urls.ROUNDS} GROUP BY ALL),
last AS (SELECT host, sum(score) FILTER (kind = 't')::BIGINT AS trust, sum(score) FILTER (kind = 'd')::BIGINT AS distrust FROM scores WHERE n = {urls.ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust - trust >= {urls.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM judged LEFT JOIN last USING (host)"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of `conv_id:turn` (nulls: one space): rows that are `gone`, empty, without ends of sentences, repeated or the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    twice = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), twice.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.audited(dialogue.repair(damaged(read_table(spark, sf_dir, "conversations")), gone=F.col("gone")))


#: Per document: its base counts and those that the rules need besides.
RULES_CTE = rf"""
rule_words AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
rule_windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM rule_words WHERE len(w) >= 3)),
rule_repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM rule_windows) WHERE c >= 2)
  GROUP BY doc_id),
rule_lines AS (
  SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
rule_base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_text_lines, 0)::BIGINT AS n_text_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(coalesce(text, ''), '[\p{{L}}\x20\x09-\x0D]+', '', 'g')) AS other,
    length(regexp_replace(coalesce(text, ''), '[^\p{{Lu}}]+', '', 'g')) AS capitals,
    len(list_distinct(w)) AS n_kinds
  FROM rule_words d LEFT JOIN rule_repeats USING (doc_id) LEFT JOIN rule_lines USING (doc_id)),
rule_failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rule_base),
ruled AS (
  SELECT *, NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 10 * n_symbols > 4 * n_words OR (n_dup_lines >= 4 AND 2 * n_dup_lines > n_text_lines) OR 100 * n_repeat_words > 30 * n_words
    OR 10 * other > 4 * word_chars OR 10 * capitals > 4 * word_chars OR 2 * n_kinds < least(n_words, 10)) AS kept
  FROM rule_failed)"""

SQL_RULES = f"WITH {RULES_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ruled"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_source_mix": op2_source_mix,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_toxicity": op5_toxicity,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_maxscore_topk": op10_maxscore_topk,
        "op11_yinyang_clusters": op11_yinyang_clusters,
        "op12_url_filter": op12_url_filter,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_minhash_dedup": SQL_NEAR,
        "op7_line_dedup": SQL_LINES,
        "op8_quality_rules": SQL_RULES,
        "op10_maxscore_topk": SQL_TOPK,
        "op11_yinyang_clusters": SQL_CLUSTERS,
        "op12_url_filter": SQL_URLS,
    }
