"""Questions to queries, prompts and recorded answers; whole documents through all steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import answering
from graphloom.operators.graph import upsert_edges
from graphloom.plans.documents import DRY_RUN_STEP, document_stages, loaded_nodes, truncate
from graphloom.plans.scratch import scratch_dir
from graphloom.plans.stages import Runner
from graphloom.registry import query
from graphloom.sources.adapters import replayed
from graphloom.sources.cases import RULE_BOOK, case_sql, case_text
from graphloom.sources.star_graph import star_graph
from graphloom.sources.tables import table

Spark = SparkSession

#: Questions, the form that fits each, and what it looks for.
_ASKED = (
    ("Apa yang diatur dalam Pasal 27?", "regulated", "pasal 27"), ("Berapa denda untuk pelanggaran Pasal 30?", "article_sanction", "pasal 30"), ("Apa sanksi untuk pencemaran nama baik?", "sanction", "pencemaran nama baik"),
    ("Pasal apa saja di Bab XI?", "chapter_articles", "bab xi"), ("Apa definisi Informasi Elektronik?", "definition", "informasi elektronik"), ("Pasal 45 berlaku untuk siapa?", "applies_to", "pasal 45"),
    ("Pasal apa yang merujuk ke Pasal 27?", "referring", "pasal 27"), ("Pasal 27 ayat berapa saja?", "paragraphs", "pasal 27"), ("Pasal 3 ada di bab berapa?", "chapter_of", "pasal 3"), ("Apa bunyi Pasal 1?", "content", "pasal 1"),
    ("Apa saja perbuatan yang dilarang?", "prohibited", "perbuatan yang dilarang"), ("Informasi tentang transaksi", "keyword", "informasi"), ("?", None, None),
)
_QUERY_OF = {name: q for name, _, _, q in answering.FORMS} | {"keyword": answering.KEYWORD}
_QUERIES = tuple(None if form is None else _QUERY_OF[form].replace("{}", word) for _, form, word in _ASKED)


@query(f"SELECT p_partkey, {case_sql(tuple(f for _, f, _ in _ASKED))} AS form, {case_sql(_QUERIES)} AS query, CASE p_partkey % {len(_ASKED)} WHEN {len(_ASKED) - 1} THEN 'no query' ELSE 'ok' END AS status FROM part")
def nl_to_query(spark: Spark, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select("p_partkey", case_text(tuple(q for q, _, _ in _ASKED)).alias("question"))
    return answering.nl_to_query(asked).select("p_partkey", "form", "query", "status")


@query("""SELECT p_partkey, sha256(concat('Question: ', p_name, '?', chr(10), chr(10), 'Knowledge Graph Data:', chr(10), p_type, chr(10), chr(10), 'Answer the question based on the KG data above. Respond in formal Indonesian (Bahasa Indonesia).')) AS prompt,
CASE WHEN p_size > 25 THEN concat('Menurut ', p_brand) ELSE '' END AS answer, CASE WHEN p_size > 25 THEN 'ok' ELSE 'error' END AS status FROM part""")
def answer_generate(spark: Spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = answering.answer_prompts(part.select("p_partkey", F.concat("p_name", F.lit("?")).alias("question"), F.col("p_type").alias("context")))
    recorded = part.where("p_size > 25").select("p_partkey", F.concat(F.lit(" Menurut "), F.col("p_brand"), F.lit("\n")).alias("answer"))
    return answering.answered_from(rows, recorded, "p_partkey").select("p_partkey", F.sha2("prompt", 256).alias("prompt"), "answer", "status")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS answer, CASE WHEN turn % 2 <> 0 OR text IS NULL THEN 'no recorded answer' END AS error FROM conversations")
def llm_call(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), "text")
    recorded = rows.where("turn % 2 = 0").select("key", F.col("text").alias("answer"))
    return replayed(rows.select("conv_id", "turn", "key"), recorded, "key").select("conv_id", "turn", "answer", "error")


@query("""SELECT p_name AS question, 'MATCH (p:Part) RETURN p.label AS label' AS query, min(p_brand) AS category FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name""")
def llm_augment(spark: Spark, sf_dir: str) -> DataFrame:
    sample = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" "), F.col("p_name")).alias("question"), F.lit("MATCH (p:Part) RETURN p.label AS label").alias("cypher"), F.col("p_brand").alias("category")), F.struct(F.lit("").alias("question"), F.lit("x").alias("cypher"), F.lit("x").alias("category"))).alias("samples")))
    answers = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, "no JSON { here").otherwise(F.concat(F.lit("Here: "), sample)).alias("answer"))
    return answering.augmented(answers)


_JUDGED = ('{"score": 2, "is_hallucination": false}', 'It is: {"score": 1} so', '{"score": 7, "is_hallucination": true}', "nothing", '{"score": 2}')


@query(f"SELECT p_partkey, ({case_sql(('2', '1', '2', '0', '0'))})::INT AS score, ({case_sql(('false', 'false', 'true', 'false', 'true'))})::BOOLEAN AS is_hallucination FROM part")
def llm_judge(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", case_text(_JUDGED).alias("answer"), F.when(F.col("p_partkey") % 5 == 4, "[ERROR] x").otherwise(F.col("p_name")).alias("predicted"))
    return answering.judged_answers(rows).select("p_partkey", "score", "is_hallucination")


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(concat(p_name, ' ', p_type)), ' ')[2:] AS b FROM part),
s AS (SELECT p_partkey, len(list_filter(b, lambda x: list_contains(a, x))) / len(b) AS p, len(list_filter(a, lambda x: list_contains(b, x))) / len(a) AS r FROM w)
SELECT p_partkey, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""")
def bert_score(spark: Spark, sf_dir: str) -> DataFrame:
    predicted = F.array_join(F.slice(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), 2, 1000), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(answering.soft_overlap(F.col("p_name"), predicted)["f1"], 6).alias("f1"))


@query("""SELECT 1 AS nth, 'TYPES: own text; x' AS prompt UNION ALL SELECT 2, 'TYPES: of the sheet; x' UNION ALL SELECT 3, 'edge'""")
def build_prompt(spark: Spark, sf_dir: str) -> DataFrame:
    """The schema given, that of a sheet, and the closed world's own: the third is told by the head of its table."""
    sheet = spark.createDataFrame([("S1", "of the sheet"), ("S2", "other")], "SCHEMA_ID string, SCHEMA_TEXT string")
    template = "TYPES: {kg_schema}; {more}"
    made = [answering.schema_prompt(template, "own text", sheet, "S1", more="x"), answering.schema_prompt(template, None, sheet, "S1", more="x"), answering.schema_prompt("{kg_schema}").split("|")[1].strip()]
    return spark.createDataFrame(list(enumerate(made, 1)), "nth int, prompt string")


def _book_run(spark: Spark, sf_dir: str) -> tuple[Runner, DataFrame]:
    """A runner of all steps over the rule book of each nation, one without text among them, with an answer for each chunk."""
    nation = table(spark, sf_dir, "nation")
    pages = nation.select(F.concat(F.lit("RB_"), F.col("n_nationkey").cast("string")).alias("document_id"), F.lit(1).alias("page_number"), F.when(F.col("n_nationkey") == 7, " ").otherwise("\n".join(RULE_BOOK)).alias("text"))
    doc = F.concat(F.lit("RB_"), F.col("n_nationkey").cast("string"))
    said = F.to_json(F.struct(
        F.array(*(F.struct(i.alias("id"), F.lit(t).alias("type"), label.alias("label")) for i, t, label in (
            (doc, "Regulasi", F.col("n_name")), (F.concat(doc, F.lit("#1")), "Pasal", F.lit("Pasal 1")), (F.concat(doc, F.lit("#a")), "KonsepHukum", F.lit("Nama Sama")), (F.concat(doc, F.lit("#b")), "KonsepHukum", F.lit("nama  sama")), (F.concat(doc, F.lit("#x")), "Unknown", F.lit("gone"))))).alias("nodes"),
        F.array(*(F.struct(a.alias("source_id"), b.alias("target_id"), F.lit(t).alias("type")) for a, b, t in (
            (F.concat(doc, F.lit("#1")), F.concat(doc, F.lit("#a")), "MENDEFINISIKAN"), (F.concat(doc, F.lit("#1")), F.concat(doc, F.lit("#b")), "MENDEFINISIKAN"), (doc, F.concat(doc, F.lit("#x")), "MEMUAT")))).alias("edges"),
    ))
    recorded = nation.select(F.concat(doc, F.lit("__chunk_000")).alias("chunk_id"), said.alias("answer"))
    return Runner(spark, f"{scratch_dir(spark)}/documents-{uuid.uuid4().hex}", document_stages(recorded)), pages


@query("SELECT concat('RB_', n_nationkey) AS document_id, CASE n_nationkey WHEN 7 THEN 0 ELSE 9 END AS step, CASE n_nationkey WHEN 7 THEN 'none' ELSE 'load_graph' END AS step_name, CASE n_nationkey WHEN 7 THEN 'error' ELSE 'complete' END AS status FROM nation")
def process_document(spark: Spark, sf_dir: str) -> DataFrame:
    runner, pages = _book_run(spark, sf_dir)
    return runner.run(pages)


@query("""SELECT concat('RB_', n_nationkey, x.i) AS id, x.type, x.kind, CASE x.i WHEN '' THEN n_name ELSE x.label END AS label, CASE WHEN x.kind = 'edge' THEN concat('RB_', n_nationkey, '#1') END AS src FROM nation,
(VALUES ('', 'Regulasi', 'node', ''), ('#1', 'Pasal', 'node', 'Pasal 1'), ('#b', 'KonsepHukum', 'node', 'nama  sama'), ('#b', 'MENDEFINISIKAN', 'edge', NULL)) AS x(i, type, kind, label) WHERE n_nationkey <> 7 AND n_nationkey < 3""")
def process_document_graph(spark: Spark, sf_dir: str) -> DataFrame:
    """What the steps load for three documents, taken by their ids; edges stand with the id that they point to."""
    runner, pages = _book_run(spark, sf_dir)
    runner.run(pages, only=["RB_0", "RB_1", "RB_2"])
    rows = loaded_nodes(runner).select("id", "type", F.lit("node").alias("kind"), "label", F.lit(None).cast("string").alias("src"))
    edges = runner.table("load_graph").where("kind = 'edge'").select(F.col("dst").alias("id"), "type", "kind", F.lit(None).cast("string").alias("label"), "src")
    return rows.unionByName(edges)


@query("SELECT concat('RB_', n_nationkey) AS document_id, CASE n_nationkey WHEN 7 THEN 0 ELSE 4 END AS step, CASE n_nationkey WHEN 7 THEN 'error' ELSE 'running' END AS status FROM nation")
def dry_run(spark: Spark, sf_dir: str) -> DataFrame:
    runner, pages = _book_run(spark, sf_dir)
    return runner.run(pages, upto=DRY_RUN_STEP).select("document_id", "step", "status")


@query("SELECT DISTINCT concat('supplier:', l_suppkey) AS src, concat('AMENDED_', l_returnflag) AS type, concat('customer:', o_custkey) AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def edges_only(spark: Spark, sf_dir: str) -> DataFrame:
    """The registry's edges alone, loaded twice: the nodes are those that are there, and no edge is doubled."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    relations = rows.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("AMENDED_"), F.col("l_returnflag")).alias("type"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("dst"))
    nowhere = spark.createDataFrame([("supplier:none", "AMENDED_R", "customer:1")], "src string, type string, dst string")
    twice = relations.unionByName(relations).unionByName(nowhere).withColumn("at", F.lit(1))
    return upsert_edges(twice, star_graph(spark, sf_dir).nodes, "at").select("src", "type", "dst")


@query("SELECT * FROM (VALUES ('nodes', 0::BIGINT, 'id,type,label,content,doc,labels'), ('edges', 0::BIGINT, 'src,type,dst')) AS t(name, n, columns)")
def truncate_graph(spark: Spark, sf_dir: str) -> DataFrame:
    store, folder = star_graph(spark, sf_dir), f"{scratch_dir(spark)}/graph-{uuid.uuid4().hex}"
    store.nodes.write.parquet(f"{folder}/nodes")
    store.edges.write.parquet(f"{folder}/edges")
    truncate(spark, folder)
    left = {name: spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges")}
    return spark.createDataFrame([(name, rows.count(), ",".join(rows.columns)) for name, rows in left.items()], "name string, n long, columns string")
