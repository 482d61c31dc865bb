"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import best_fit_packing, chat_format, license_scan, line_dedup, media_columns, ngram_join, quality_rules, sentencepiece_codec, sharding, token_counts
from graphloom.sources.tables import table

CAPACITY, BUDGET, SHARDS, SEED = 2048, 1024, 24, 20240229


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), model)
    return ids.select("doc_id", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), BUDGET)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_columns.read_media(media_columns.to_png(table(spark, sf_dir, "documents")))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.formatted_turns(chat_format.canonical_turns(rows.unionByName(more), "conv_id")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARDS, SEED)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_ngram_join, op4_license_scan, op5_token_counts, op6_line_dedup, op7_media_columns, op8_best_fit_packing, op9_chat_format, op10_sharding)}


_OP3 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, hash(concat(len(w), ':', array_to_string(w, ' '))) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""

_OP6 = r"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM raw),
l1 AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS p FROM l0),
l2 AS (SELECT doc_id, pos, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM l1 WHERE p <> ''),
l AS MATERIALIZED (SELECT doc_id, pos, line, string_split(line, ' ') AS w, concat(len(string_split(line, ' ')), ':', array_to_string(string_split(line, ' ')[1:3], ' ')) AS leaf FROM l2),
whole AS MATERIALIZED (SELECT line, min(doc_id) AS first FROM l GROUP BY line HAVING count(DISTINCT doc_id) >= 10),
rest AS MATERIALIZED (SELECT * FROM l WHERE line NOT IN (SELECT line FROM whole)),
leaves AS (SELECT leaf FROM rest GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
parts AS MATERIALIZED (SELECT doc_id, pos, leaf, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM rest WHERE leaf IN (SELECT leaf FROM leaves)),
fixed AS (SELECT leaf, place, word FROM parts WHERE place >= 3 AND word <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
told AS (SELECT p.*, (f.word IS NOT NULL OR (p.place < 3 AND p.word <> '<*>')) AS fix FROM parts p LEFT JOIN fixed f USING (leaf, place, word)),
made AS (SELECT doc_id, pos, leaf, string_agg(CASE WHEN fix THEN word ELSE '<*>' END, ' ' ORDER BY place) AS template FROM told GROUP BY ALL HAVING avg(fix::INT) >= 0.8),
again AS (SELECT leaf, template, min(doc_id) AS first FROM made GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
drops AS (SELECT l.doc_id, l.pos FROM l JOIN whole USING (line) WHERE l.doc_id <> whole.first
  UNION ALL SELECT m.doc_id, m.pos FROM made m JOIN again a ON m.leaf = a.leaf AND m.template = a.template WHERE m.doc_id <> a.first),
gone AS (SELECT doc_id, list(pos) AS drops FROM drops GROUP BY doc_id)
SELECT raw.doc_id, CASE WHEN raw.text IS NULL THEN NULL WHEN gone.drops IS NULL THEN raw.text
    ELSE array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone.drops, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
  CASE WHEN raw.text IS NULL THEN 0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) END::BIGINT AS n_lines, coalesce(len(gone.drops), 0)::BIGINT AS n_dropped
FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id
"""

_OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS head FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def llm_oracles() -> dict[str, str]:
    return {"op3_ngram_join": _OP3, "op6_line_dedup": _OP6, "op9_chat_format": _OP9}
