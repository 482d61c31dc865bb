"""Search terms, searches, contexts, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as T
from graphloom.operators import retrieval
from graphloom.operators.graph import GraphStore
from graphloom.registry import query
from graphloom.sources.cases import case_sql, case_text
from graphloom.sources.legal_text import LEGAL_SQL, legal_lines
from graphloom.sources.star_graph import GRAPH_SQL, star_graph
from graphloom.sources.tables import table

G, L = "WITH" + GRAPH_SQL, "WITH" + LEGAL_SQL
Spark = SparkSession
_STOP = "|".join(T.STOP_WORDS)
_W = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"


@query(f"""SELECT conv_id, turn, array_to_string(list_filter({_W.format("regexp_replace(lower(text), '\\b(" + _STOP + ")\\b', ' ', 'g')")}, lambda w: length(w) > 2)[1:5], ' ') AS keywords FROM conversations""")
def keyword_extract(spark: Spark, sf_dir: str) -> DataFrame:
    # Word borders are those of ASCII letters on both engines.
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.keywords("text"), " ").alias("keywords"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter({_W.format('text')}, lambda w: length(w) > 2) AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])), '|') AS pairs FROM w""")
def bigrams(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.bigrams("text"), "|").alias("pairs"))


def _questions(spark: Spark, sf_dir: str) -> DataFrame:
    """(question_id, question): one for each brand and type."""
    asked = F.concat(F.lit("apa itu "), F.lower("p_type"))
    return table(spark, sf_dir, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("question_id"), asked.alias("question")).distinct()


@query(G + f""", q AS (SELECT DISTINCT concat(p_brand, '|', p_type) AS qid, concat('apa itu ', lower(p_type)) AS question FROM part),
w AS (SELECT qid, list_filter({_W.format("regexp_replace(question, '\\b(" + _STOP + ")\\b', ' ', 'g')")}, lambda w: length(w) > 2)[1:5] AS k, list_filter({_W.format('question')}, lambda w: length(w) > 2) AS v FROM q),
terms AS (SELECT qid, 1 AS s, unnest(range(0, len(k))) AS rank, unnest(k) AS t FROM w UNION ALL SELECT qid, 3, unnest(range(0, len(v) - 1)), unnest(list_transform(range(1, len(v)), lambda i: concat(v[i], ' ', v[i + 1]))) FROM w),
b AS (SELECT id, lower(concat_ws(chr(10), label, content)) AS body FROM nodes WHERE type = 'Part'),
h AS (SELECT t, id, row_number() OVER (PARTITION BY t ORDER BY id) AS n FROM (SELECT DISTINCT t FROM terms WHERE length(t) > 2) JOIN b ON contains(body, t)),
f AS (SELECT qid, s, id, s * 1000000 + rank * 100 + n AS place FROM terms JOIN h USING (t) WHERE n <= CASE s WHEN 1 THEN 5 ELSE 3 END),
sure AS (SELECT qid, count(DISTINCT id) AS c FROM f WHERE s < 3 GROUP BY 1),
best AS (SELECT f.qid, id, min(place) AS place FROM f LEFT JOIN sure USING (qid) WHERE s < 3 OR coalesce(c, 0) < 3 GROUP BY 1, 2)
SELECT qid AS question_id, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS nth FROM best) WHERE nth <= 10""")
def multi_strategy_search(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    return retrieval.multi_search(_questions(spark, sf_dir), GraphStore(store.nodes.where("type = 'Part'"), store.edges))


@query(G + """, i AS (SELECT id FROM nodes WHERE type IN ('Region', 'Nation')),
e AS (SELECT src AS id, '->' AS way, type, dst AS other FROM edges WHERE src IN (SELECT id FROM i) UNION ALL SELECT dst, '<-', type, src FROM edges WHERE dst IN (SELECT id FROM i)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY type, other) AS rn FROM e)
SELECT r.id, string_agg(concat_ws(' ', way, r.type, label), '; ' ORDER BY way, rn) AS relations FROM r JOIN nodes n ON n.id = other WHERE rn <= 8 GROUP BY r.id""")
def enrich_relations(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    return retrieval.relations(store, store.nodes.where(F.col("type").isin("Region", "Nation")).select("id"))


@query(G + """, h AS (SELECT n_name AS cell, min(id) AS id FROM nation JOIN nodes ON contains(lower(concat_ws(chr(10), label, content)), lower(n_name)) GROUP BY 1) SELECT src, type, dst FROM edges WHERE src IN (SELECT id FROM h UNION SELECT concat('region:', r_regionkey) FROM region) AND dst IN (SELECT id FROM h)""")
def graph_from_result(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    cells = table(spark, sf_dir, "nation").select(F.col("n_name").alias("question_id"), F.col("n_name").alias("term"))
    text = store.nodes.select("id", F.lower(F.concat_ws("\n", "label", "content")).alias("body"))
    hits = text.join(F.broadcast(cells), F.contains("body", F.lower("term"))).groupBy("term").agg(F.min("id").alias("id")).select("id")  # 25 cells at any scale
    regions = store.nodes.where("type = 'Region'").select("id")
    ends = hits.unionByName(regions).distinct()
    return store.edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(hits.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")


@query("""SELECT row_number() OVER (ORDER BY c_custkey) AS nth, concat(row_number() OVER (ORDER BY c_custkey), '. ', concat_ws(' | ', 'c_name: ' || c_name, 'c_mktsegment: ' || c_mktsegment)) AS line FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 20)""")
def format_context(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.context_lines(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "c_custkey").withColumn("nth", F.col("nth").cast("long"))


@query(L + "SELECT document_id, line_no, CASE WHEN n >= 0 THEN concat('Pasal ', n + 1) ELSE '' END AS cited FROM legal")
def extract_citations(spark: Spark, sf_dir: str) -> DataFrame:
    return legal_lines(spark, sf_dir).select("document_id", F.col("line_no").cast("long"), F.array_join(T.citations("text"), "|").alias("cited"))


_SHAPES = ("MATCH (n) RETURN n.{}", "match (n:`{}`)-[r]->(m) return m", "MATCH (n RETURN n", "MATCH (n)-[r->(m) RETURN r", "MATCH (n) WHERE n.label = '{}'", "RETURN", "")


@query(f"""SELECT -p_partkey AS page_id, ({case_sql(("true", "true", "false", "false", "false", "true", "false"))})::BOOLEAN AS ok FROM part
UNION ALL SELECT page_id, contains(upper(html), 'RETURN') AND length(html) - length(replace(html, '(', '')) = length(html) - length(replace(html, ')', '')) AND length(html) - length(replace(html, '[', '')) = length(html) - length(replace(html, ']', '')) AS ok FROM pages""")
def query_shape_check(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("page_id"), case_text(_SHAPES).alias("html")))
    return rows.select("page_id", T.query_shape("html").alias("ok"))


_FENCED = ("Sure:\n```cypher\n{}\n```\nDone", "```{}```", "```sql {} ```", "``` \n {}", "```cypher\n{}``", "  {}\n", "```plaintext\n\n{}\n\n``` and ```second```", "```{}")


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 7 THEN '' ELSE p_name END AS q FROM part")
def strip_code_fence(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.without_fence(case_text(_FENCED)).alias("q"))


@query("SELECT coalesce(source, 'Lainnya') AS name, count(*) AS n, CASE coalesce(source, 'Lainnya') WHEN 'src1' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END AS place FROM documents GROUP BY source")
def group_docs(spark: Spark, sf_dir: str) -> DataFrame:
    return retrieval.grouped_by_type(table(spark, sf_dir, "documents"), F.col("source"), {"src1": 0, "src0": 1})


@query("SELECT id FROM (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS docs FROM orders GROUP BY 1) WHERE len(list_filter(docs, lambda d: d NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) = 0 ORDER BY id LIMIT 3")
def subset_filter(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("docs"))
    return retrieval.within(rows, ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("id")
