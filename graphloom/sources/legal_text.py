"""A stand-in for rule texts, made of the star schema: a document for each region, a chapter, an article for each nation,
a paragraph for each of its customers, which cites articles and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.sources.tables import table

LINES_A_PAGE = 50


def legal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, line_no, page, text)."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), F.col("r_regionkey") + 1)
    head = region.select(F.col("r_regionkey").alias("r"), F.lit(-1).alias("n"), F.posexplode(F.array(F.lit("kata pengantar"), F.concat(F.lit("BAB "), roman), F.col("r_name"))).alias("k", "text"))
    article = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.lit(-1).alias("k"), F.concat(F.lit("Pasal "), (F.col("n_nationkey") + 1).cast("string")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    said = F.concat(F.lit("("), nth.cast("string"), F.lit(") "), F.col("c_name"), F.lit(" sebagaimana dimaksud dalam Pasal "), (F.col("c_nationkey") + 1).cast("string"), F.lit(" Undang-Undang Nomor "), (F.col("n_regionkey") + 1).cast("string"), F.lit(" Tahun 2000"))
    paragraph = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r"), F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"), said.alias("text"))
    rows = head.unionByName(article).unionByName(paragraph)
    line = F.row_number().over(Window.partitionBy("r").orderBy("n", "k")) - 1
    rows = rows.withColumn("line_no", line)
    return rows.select(F.concat(F.lit("UU_"), (F.col("r") + 1).cast("string"), F.lit("_2000")).alias("document_id"), "line_no", (F.floor(F.col("line_no") / LINES_A_PAGE) + 1).cast("int").alias("page"), "text")


LEGAL_SQL = """
legal0 AS (
  SELECT r_regionkey AS r, -1 AS n, unnest([0, 1, 2]) AS k, unnest(['kata pengantar', concat('BAB ', ['I', 'II', 'III', 'IV', 'V'][r_regionkey + 1]), r_name]) AS text FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, concat('Pasal ', n_nationkey + 1) FROM nation
  UNION ALL SELECT n_regionkey, c_nationkey, c_custkey, concat('(', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), ') ', c_name, ' sebagaimana dimaksud dalam Pasal ', c_nationkey + 1, ' Undang-Undang Nomor ', n_regionkey + 1, ' Tahun 2000') FROM customer JOIN nation ON c_nationkey = n_nationkey),
legal1 AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n, k) - 1 AS line_no FROM legal0),
legal AS (SELECT concat('UU_', r + 1, '_2000') AS document_id, line_no, line_no // 50 + 1 AS page, text, n, k FROM legal1),
par AS (SELECT document_id, n, k, line_no, page, regexp_extract(text, '^\\((\\d+)\\) (.*)$', 1) AS number, regexp_extract(text, '^\\((\\d+)\\) (.*)$', 2) AS content FROM legal WHERE n >= 0 AND k >= 0),
parid AS (SELECT *, row_number() OVER (PARTITION BY document_id, number ORDER BY line_no) AS nth FROM par),
comp AS (
  SELECT document_id, 'BAB' AS component_type, regexp_extract(text, 'BAB (.*)', 1) AS number, concat(document_id, '__BAB_', regexp_extract(text, 'BAB (.*)', 1)) AS component_id, NULL AS parent_id, '' AS content, line_no, page FROM legal WHERE n = -1 AND k = 1
  UNION ALL SELECT document_id, 'PASAL', (n + 1)::VARCHAR, concat(document_id, '__PASAL_', n + 1), concat(document_id, '__BAB_', (SELECT regexp_extract(b.text, 'BAB (.*)', 1) FROM legal b WHERE b.document_id = legal.document_id AND b.n = -1 AND b.k = 1)), '', line_no, page FROM legal WHERE n >= 0 AND k = -1
  UNION ALL SELECT document_id, 'AYAT', number, concat(document_id, '__AYAT_', number, CASE WHEN nth > 1 THEN concat('__PASAL_', n + 1) ELSE '' END), concat(document_id, '__PASAL_', n + 1), content, line_no, page FROM parid)"""
