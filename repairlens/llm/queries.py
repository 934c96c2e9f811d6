"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from repairlens.llm import chat, collocations, filter_audit, language, licenses, quality, secrets, token_files, toxicity, word_bpe
from repairlens.llm.decontaminate import decontaminate
from repairlens.llm.near_dedup import near_duplicates
from repairlens.llm.substrings import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_and_read(rows.unionByName(own))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.evidence(_table(spark, sf_dir, "documents"))).drop("id", "row")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdict(quality.ledger(_table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failed").cast("long").alias("failed_bits"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_toxicity, op2_word_bpe, op3_token_files, op4_substring_dedup, op5_decontaminate, op6_near_dedup, op7_chat_format, op8_language_id, op9_quality_rules, op10_secret_scan, op11_license_scan, op12_filter_audit, op13_collocations)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_ASCII_LOWER.format('coalesce(text, {q})')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("{q}", "''")

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r AS component_id, d.doc_id = r AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS r FROM c GROUP BY node) ON node = d.doc_id
"""

OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?INST\]|\[ROLE |\[/ROLE\]')) AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN was IS NULL THEN role IN ('system', 'user') WHEN was IN ('system', 'assistant') THEN role = 'user' ELSE role = 'assistant' END) AS valid
FROM t GROUP BY conv_id
"""

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS b FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b & 3 <> 0 AS base_failed, b & 15 = 0 AS kept, CAST(b AS BIGINT) AS failed_bits FROM f
"""


def _spans_sql(kind: int, pattern: str, group: int, least: int) -> str:
    regex = pattern.replace("'", "''")
    return rf"""
    SELECT doc_id, owner, source, {kind} AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
      length(m[i]) AS n, v[i] AS value
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, owner, source, string_split_regex(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {group}) AS v FROM d WHERE regexp_matches(t, '{regex}')))
    WHERE length(v[i]) >= {least}"""


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, split_part(source, '/', 1) AS owner, source FROM documents),
base AS ({_spans_sql(0, secrets.ASSIGN, 1, 12)} UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_spans_sql(2, secrets.HEX, 0, 16)}),
more AS (
  SELECT * FROM ({_spans_sql(3, "[A-Za-z0-9+/_-]{20,}", 0, 20)}) x
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.s + x.n AND x.s < b.s + b.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
rare AS (SELECT value FROM every GROUP BY value HAVING count(DISTINCT owner) <= 2 AND count(DISTINCT source) <= 10),
named AS (SELECT *, value IN (SELECT value FROM rare) AS live, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS line FROM every),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(line, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY s, kind) AS spans, count(*) FILTER (live) AS n_live
  FROM named WHERE kind < 3 OR live GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)
"""


_NOTICES = ", ".join(f"('{label}', '{text}')" for label, text in licenses.TEMPLATES)

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
ph AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) v(p, label)),
pl AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(p) - 1] = p)) - 1 AS i FROM d, ph),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM pl GROUP BY doc_id),
te AS (SELECT label, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS v FROM (VALUES {_NOTICES}) x(label, t)),
bl AS (SELECT doc_id, unnest(list_transform(range(1, len(w) + 1, 32), lambda i: w[i : i + 63])) AS bw FROM d),
m AS (
  SELECT doc_id, list(DISTINCT label) AS met, max(o / n) AS best
  FROM (SELECT doc_id, label, len(v) AS n, len(list_intersect(v, bw)) AS o FROM bl, te) WHERE 100 * o >= 90 * n GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP12_SQL = rf"""
WITH RECURSIVE o AS (SELECT '' AS s UNION ALL SELECT s || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE strpos(s, c) = 0),
st AS (SELECT s AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(s) = 5),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (
  SELECT d.doc_id, part, quality, toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN labels USING (doc_id)),
x AS (SELECT *, filter_order[step] AS c, translate(filter_order[1 : step - 1], fails, '') <> filter_order[1 : step - 1] AS gone, strpos(fails, filter_order[step]) > 0 AS own FROM f, st),
g AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, c, count(*) FILTER (NOT gone AND NOT own) AS kept, count(*) FILTER (own AND NOT gone) AS removed, count(*) FILTER (own AND gone) AS redundant,
    count(*) FILTER (fails = c) AS unique_fails, count(*) FILTER (own AND NOT gone AND quality = 1) AS good_lost, count(*) FILTER (own AND NOT gone AND toxic = 1) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM g
"""


OP13_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, array_to_string(v[1 : i], ' ') AS x, array_to_string(v[i + 1 : k], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS i) WHERE i < k),
s AS (
  SELECT cut.lang, cut.k, cut.phrase, a, i, fl.f AS l, fr.f AS r, (1000000::HUGEINT * a * a) // (fl.f::HUGEINT * fr.f) AS score
  FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.phrase = x JOIN f fr ON fr.lang = cut.lang AND fr.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, array_to_string(v[i : i + 1], ' ') AS phrase, max(a) AS longer FROM c, (SELECT unnest([1, 2]) AS i) WHERE k = 3 GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN inside USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict:
    return {"op4_substring_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_near_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op9_quality_rules": OP9_SQL, "op10_secret_scan": OP10_SQL, "op11_license_scan": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_collocations": OP13_SQL}
