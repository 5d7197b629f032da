"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import ann, html_extract, jaccard_join, language_mix, line_rules, merkle, packing, piece_bpe, quality, secrets_scan, sharding, toxicity, turn_trie
from riskloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(read_table(spark, sf_dir, "documents"))


@query
def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


@query
def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


@query
def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(read_table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


@query
def op12_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.identify(read_table(spark, sf_dir, "documents"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.build_trie(read_table(spark, sf_dir, "conversations"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


BLANKS = r"\x20\x09-\x0D"

ORACLE["op4_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BLANKS}]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS own FROM w),
x AS (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS p, b.doc_id AS q FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT p, q FROM links UNION SELECT reach.p, links.q FROM reach JOIN links ON reach.q = links.p)
SELECT s.doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.q, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT p, min(q) AS q FROM reach GROUP BY p) r ON r.p = s.doc_id
"""

ORACLE["op10_line_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^{BLANKS}]+') AS ws,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^{BLANKS}]')] AS ls FROM d),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS k FROM windows) WHERE k > 1),
again AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
lines AS (SELECT r, host, text, trim(regexp_replace(lower(x), '[{BLANKS}]+', ' ', 'g'), ' ') AS line FROM (SELECT r, host, text, unnest(ls) AS x FROM w)),
shared AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT text) > {line_rules.MIN_DOCUMENTS}),
removed AS (SELECT r, sum(len(string_split(line, ' '))) AS n FROM lines JOIN shared USING (host, line) GROUP BY r),
b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN again ON again.r = w.r LEFT JOIN removed ON removed.r = w.r),
f AS (SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed_words >= CAST({line_rules.MIN_LEFT} AS DOUBLE) * n_words AS kept FROM f
"""

#: crc32 of a decimal number, by a table that SQL makes.
CRC32 = """
bits AS (SELECT i, 0 AS n, CAST(i AS BIGINT) AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE n = 8),
crcs AS (
  SELECT k, xor(list_reduce([4294967295] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(k AS VARCHAR), '')],
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT {key} AS k FROM {table} WHERE {key} IS NOT NULL), crc_table)"""

ORACLE["op11_merkle_manifest"] = rf"""
WITH RECURSIVE {CRC32.format(key="doc_id", table="documents")},
d AS (
  SELECT row_number() OVER () AS r, documents.doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS key,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    text, coalesce(crc, 0) % 3 = 0 AS hit FROM documents LEFT JOIN crcs ON k = doc_id),
l AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS tampered FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM l),
nodes AS (
  SELECT key, 0 AS level, place, n, leaf AS h FROM p
  UNION ALL SELECT key, level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY key, level, place // 8),
subroots AS (SELECT key, h, row_number() OVER (ORDER BY encode(key)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, n, h FROM subroots
  UNION ALL SELECT level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 8),
every AS (SELECT key, 0 AS part, level, place, h FROM nodes WHERE n > 1 UNION ALL SELECT '', 1, level, place, h FROM tops WHERE n > 1),
sides AS (
  SELECT a.key, a.part, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM every a JOIN every b ON a.key = b.key AND a.part = b.part AND a.level = b.level AND a.place // 8 = b.place // 8 GROUP BY ALL),
heights AS (SELECT key, max(level) AS height FROM nodes GROUP BY key),
steps AS (
  SELECT p.r, x.part, x.level, x.before, x.after FROM p JOIN heights USING (key)
    JOIN sides x ON x.part = 0 AND x.key = p.key AND x.place = p.place // CAST(power(8, x.level) AS BIGINT)
  UNION ALL SELECT p.r, x.part, x.level, x.before, x.after FROM p JOIN subroots s ON s.key = p.key
    JOIN sides x ON x.part = 1 AND x.place = s.place // CAST(power(8, x.level) AS BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY part, level) AS k FROM steps),
proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256, max(k) AS k FROM numbered GROUP BY r),
fold AS (
  SELECT r, 0 AS k, tampered AS h FROM p
  UNION ALL SELECT fold.r, numbered.k, sha256(before || h || after) FROM fold JOIN numbered ON numbered.r = fold.r AND numbered.k = fold.k + 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = t.h AS verified
FROM p JOIN subroots s ON s.key = p.key CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
  LEFT JOIN proof ON proof.r = p.r JOIN fold ON fold.r = p.r AND fold.k = coalesce(proof.k, 0)
"""

ORACLE["op13_conversation_trie"] = rf"""
WITH RECURSIVE {CRC32.format(key="conv_id", table="conversations")},
turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS digest FROM turns),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM hashed),
convs AS (SELECT DISTINCT c, crc % 9 AS h FROM turns JOIN crcs ON k = c),
parts AS (
  SELECT v.c, 0 AS part, o.place, o.digest, strlen(o.text) AS size FROM convs v JOIN own o ON o.c = v.c - v.c % 5 AND o.place < v.h
  UNION ALL SELECT v.c, 1, o.place, o.digest, strlen(o.text) FROM convs v JOIN own o ON o.c = v.c AND o.place >= v.h),
path AS (SELECT c, list(digest ORDER BY part, place) AS digests, list(size ORDER BY part, place) AS sizes FROM parts GROUP BY c),
whole AS (SELECT v.c, coalesce(digests, []) AS digests, coalesce(sizes, []) AS sizes FROM convs v LEFT JOIN path USING (c)),
steps AS (SELECT c, digests, sizes, unnest(range(0, len(digests) + 1)) AS d FROM whole),
cells AS (SELECT c, d, sha256(array_to_string(digests[1:d], ',')) AS node, sha256(array_to_string(digests[1:d - 1], ',')) AS above, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = len(digests) AS closes FROM steps),
nodes AS (
  SELECT d, node, any_value(CASE WHEN d > 0 THEN above END) AS above, min(c) AS owner, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (closes), '')) AS ends FROM cells GROUP BY d, node),
kids AS (SELECT d - 1 AS d, above AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
told AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (d, node)),
below AS (
  SELECT cells.d, cells.node, sum((t.n - 1) * t.size) AS saved, count(*) FILTER (t.k = 0) AS leaves
  FROM told t JOIN cells ON cells.c = t.owner AND cells.d <= t.d GROUP BY ALL)
SELECT t.owner AS conv_id, CAST(t.d AS BIGINT) AS depth, p.owner AS parent_conv_id, t.n AS n_convs, CAST(t.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, t.ends AS ends_sha256
FROM told t JOIN below USING (d, node) LEFT JOIN nodes p ON p.d = t.d - 1 AND p.node = t.above
"""
