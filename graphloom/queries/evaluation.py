"""Data sets and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.functions import text as T
from graphloom.operators import evaluation as E
from graphloom.registry import query
from graphloom.sources.legal_text import LEGAL_SQL, legal_lines
from graphloom.sources.star_graph import GRAPH_SQL, star_graph
from graphloom.sources.tables import table

G, L = "WITH" + GRAPH_SQL, "WITH" + LEGAL_SQL
Spark = SparkSession


@query(G + """, f AS (SELECT label, row_number() OVER (ORDER BY label) AS rn FROM nodes WHERE type = 'Nation') SELECT concat('Apa isi ', label, '?') AS question, concat('MATCH (n {label: ''', label, '''}) RETURN n.id') AS query, 'hierarki' AS category FROM f WHERE rn <= 10""")
def template_fill(spark: Spark, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([("Nation", "Apa isi {label}?", "MATCH (n {label: '{label}'}) RETURN n.id", "hierarki")], "type string, question string, query string, category string")
    return E.filled_templates(templates, star_graph(spark, sf_dir).nodes.select("type", "label"), 10)


@query(G + """, d AS (SELECT DISTINCT type, label FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY label) AS rn FROM d) SELECT type, label FROM r WHERE rn <= 10""")
def entity_sampling(spark: Spark, sf_dir: str) -> DataFrame:
    rows = star_graph(spark, sf_dir).nodes.select("type", "label").distinct()
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy("label"))).where("rn <= 10").drop("rn")


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS part FROM h""")
def train_val_split(spark: Spark, sf_dir: str) -> DataFrame:
    return E.split_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""WITH c AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents WHERE length(text) > 100) SELECT source, i // 5 AS batch, substring(string_agg(text, chr(10) ORDER BY i), 1, 8000) AS text FROM c GROUP BY ALL""")
def samples_from_chunks(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 100).select("source", "doc_id", "text")
    rows = rows.select("doc_id", "text").join(E.ranked_ids(rows, "source", "doc_id"), "doc_id")
    items = F.array_sort(F.collect_list(F.struct("i", "text")))
    return rows.groupBy("source", F.floor(F.col("i") / 5).alias("batch")).agg(F.substring(F.array_join(F.transform(items, lambda x: x["text"]), "\n"), 1, 8000).alias("text"))


@query("SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'not found' ELSE 'found' END AS answer FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) USING (doc_id)")
def samples_from_results(spark: Spark, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(found, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("answer", F.when(F.col("n") == 0, "not found").otherwise("found"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality = 1, true) AND NOT coalesce(l.toxic = 1, false)")
def verify_samples(spark: Spark, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"), (F.col("toxic") == 1).alias("hallucination"))
    return E.kept_samples(table(spark, sf_dir, "documents").select("doc_id"), verdicts, "doc_id").select("doc_id")


@query(L + "SELECT document_id, line_no, n >= 0 AS cites FROM legal")
def has_legal_ref(spark: Spark, sf_dir: str) -> DataFrame:
    return legal_lines(spark, sf_dir).select("document_id", F.col("line_no").cast("long"), T.has_legal_mark("text").alias("cites"))


@query("SELECT source AS category, count(*) AS n, round(avg((lang = 'en')::INT), 6) AS share FROM documents GROUP BY 1")
def category_counts(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("share"))


@query(r"SELECT event_id, regexp_replace(regexp_replace(lower(trim(props)), '\s+', ' ', 'g'), '\s*([{}()\[\],:])\s*', '\1', 'g') AS q FROM events")
def normalize_query(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.normalize_query("props").alias("q"))


@query("SELECT doc_id, regexp_matches(lower(trim(text, E' \\t\\n\\r\\x0b\\x0c')), '^(match|return|call|with)') AS ok FROM documents")
def syntax_check(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.syntax_ok("text").alias("ok"))


@query("SELECT false AS equal")
def result_equal(spark: Spark, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return E.same_rows(nation, nation.where("n_regionkey > 0"))


@query("SELECT true AS equal")
def result_equal_reordered(spark: Spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return E.same_rows(lines, lines.orderBy(F.desc("l_quantity")))


def _rates_sql(flags: str, means: str) -> str:
    return f"SELECT coalesce(source, 'TOTAL') AS category, count(*) AS n, {flags}, {means} FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (source))"


@query(_rates_sql("round(avg(quality), 6) AS syntax_valid, round(avg(1 - toxic), 6) AS result_correct", "round(avg(n_chars), 6) AS n_chars"))
def query_eval_metrics(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select(F.col("source").alias("category"), (F.col("quality") == 1).alias("syntax_valid"), (F.col("toxic") == 0).alias("result_correct"), "n_chars")
    return E.rates(rows, ["syntax_valid", "result_correct"], ["n_chars"])


@query(_rates_sql("round(avg(toxic), 6) AS is_hallucination", "round(avg(2 * quality), 6) AS judge"))
def answer_eval_metrics(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return E.rates(rows.select(F.col("source").alias("category"), (F.col("toxic") == 1).alias("is_hallucination"), (2 * F.col("quality")).alias("judge")), ["is_hallucination"], ["judge"])


_CASES = """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'NOT_EMPTY' WHEN 'MACHINERY' THEN 'COUNT_MIN' ELSE 'CONTAINS_ALL' END AS kind FROM customer)
SELECT c.k, kind, round(CASE kind WHEN 'NOT_EMPTY' THEN CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END WHEN 'COUNT_MIN' THEN least(1.0, coalesce(n, 0) / 20.0) ELSE coalesce(n, 0) / 40.0 END::DOUBLE, 6) AS score FROM c LEFT JOIN a USING (k)"""


@query(_CASES)
def kg_eval_case(spark: Spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "NOT_EMPTY").when(F.col("c_mktsegment") == "MACHINERY", "COUNT_MIN").otherwise("CONTAINS_ALL")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), kind.alias("kind")).join(n, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("k", "kind", F.round(E.case_score("kind", F.col("n"), F.col("n"), F.lit(20), F.col("n"), F.lit(40)), 6).alias("score"))


@query("""WITH e AS (SELECT l_suppkey AS k, l_partkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_suppkey AS k, l_partkey FROM lineitem WHERE l_linestatus = 'O'),
h AS (SELECT k, count(*) AS hit FROM e WHERE EXISTS (SELECT 1 FROM a WHERE a.k = e.k AND a.l_partkey = e.l_partkey) GROUP BY k),
s AS (SELECT coalesce(x.k, y.k) AS k, e, a FROM (SELECT k, count(*) AS e FROM e GROUP BY k) x FULL JOIN (SELECT k, count(*) AS a FROM a GROUP BY k) y ON x.k = y.k),
p AS (SELECT s.k, coalesce(coalesce(hit, 0) / e::DOUBLE, 0) AS r, coalesce(coalesce(hit, 0) / a::DOUBLE, 0) AS p FROM s LEFT JOIN h USING (k))
SELECT k, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1 FROM p""")
def result_f1(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_partkey", "l_returnflag", "l_linestatus")
    return E.result_f1(rows.where("l_linestatus = 'O'").select("k", "l_partkey"), rows.where("l_returnflag = 'R'").select("k", "l_partkey"), "k")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS text FROM documents")
def truncate_fields(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated("text").alias("text"))


@query("SELECT coalesce(lang, 'TOTAL') AS category, count(*) AS n, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, round(avg(quality), 6) AS score FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def eval_summary(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    out = rows.rollup("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.round(F.avg("quality"), 6).alias("score"))
    return out.select(F.coalesce("lang", F.lit("TOTAL")).alias("category"), "n", "passed", "failed", "score")


@query("SELECT 'quality' AS metric, round(avg(quality), 6) AS value, 0.8::DOUBLE AS target, CASE WHEN round(avg(quality), 6) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS result FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 6), 0.1::DOUBLE, CASE WHEN round(avg(toxic), 6) <= 0.1 THEN 'PASS' ELSE 'FAIL' END FROM labels")
def target_check(spark: Spark, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "labels").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic")).unpivot([], ["quality", "toxic"], "metric", "value")
    return E.against_targets(metrics, spark.createDataFrame([("quality", 0.8, True), ("toxic", 0.1, False)], "metric string, target double, at_least boolean"))


@query(G + "SELECT type, count(*) AS n FROM edges GROUP BY 1 ORDER BY 2 DESC, 1")
def type_histogram(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).edges.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@query("SELECT conv_id, turn, concat('### Instruction:', chr(10), role, chr(10), chr(10), '### Input:', chr(10), turn, chr(10), chr(10), '### Output:', chr(10), text) AS prompt FROM conversations")
def format_sft_prompt(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sft_prompt("role", F.col("turn").cast("string"), "text").alias("prompt"))
