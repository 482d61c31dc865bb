"""Graph reads, upserts and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import graph, vectors
from graphloom.registry import query
from graphloom.sources.star_graph import GRAPH_SQL, star_graph
from graphloom.sources.tables import table

G = "WITH RECURSIVE" + GRAPH_SQL
Spark = SparkSession


@query(G + """, l AS (SELECT type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'Entity', count(*) FROM nodes)
SELECT 'label' AS kind, name, n FROM l UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type
UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges""")
def graph_stats(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).stats()


@query(G + """, n AS (SELECT * FROM nodes WHERE doc = '1'), e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM n))
SELECT 'label' AS kind, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'label', 'Entity', count(*) FROM n
UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e""")
def graph_stats_document(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).stats(doc="1")


@query(G + """SELECT 'label' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type
UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges""")
def graph_stats_loader(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).stats(base_label=False)


@query(G + "SELECT type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM nodes)::DOUBLE, 1) AS pct FROM nodes GROUP BY type")
def type_share_pct(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).type_shares()


@query(G + """, f AS (SELECT * FROM nodes WHERE type IN ('Nation', 'Customer') AND doc IN ('1', '3')), e AS (SELECT * FROM edges WHERE type IN ('CONTAINS', 'PLACED') AND src IN (SELECT id FROM f))
SELECT 'node' AS kind, id AS a, type AS b, label AS c FROM nodes WHERE id IN (SELECT id FROM f UNION SELECT dst FROM e)
UNION ALL SELECT 'edge', src, type, dst FROM e""")
def subgraph_filter(spark: Spark, sf_dir: str) -> DataFrame:
    nodes, edges = star_graph(spark, sf_dir).subgraph(["Nation", "Customer"], ["1", "3"], ["CONTAINS", "PLACED"])
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b"), F.col("label").alias("c")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("type").alias("b"), F.col("dst").alias("c")))


@query(G + """, f AS (SELECT * FROM nodes WHERE type IN ('Supplier') ORDER BY id LIMIT 100), e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM f))
SELECT id, type, label FROM nodes WHERE id IN (SELECT id FROM f UNION SELECT dst FROM e)""")
def subgraph_limited(spark: Spark, sf_dir: str) -> DataFrame:
    nodes, _ = star_graph(spark, sf_dir).subgraph(["Supplier"], limit=100)
    return nodes.select("id", "type", "label")


@query(G + """SELECT DISTINCT 'out' AS direction, e.type, e.dst AS other, n.label FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'nation:3'
UNION ALL SELECT DISTINCT 'in', e.type, e.src, n.label FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst = 'nation:3'""")
def node_detail(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).detail("nation:3")


_BOTH = ", u AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)"
_HOPS = _BOTH + """, h1 AS (SELECT DISTINCT b AS id FROM u WHERE a = 'nation:3' AND b <> 'nation:3'),
h2 AS (SELECT DISTINCT b AS id FROM u WHERE a IN (SELECT id FROM h1) AND b <> 'nation:3' AND b NOT IN (SELECT id FROM h1)),
k AS (SELECT 'nation:3' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"""


def _start(spark: Spark) -> DataFrame:
    return spark.createDataFrame([("nation:3",)], "id string")


@query(G + _HOPS + "SELECT id, hop FROM k")
def khop_subgraph(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).khop(_start(spark), 2)[0]


# The steps are materialised and joined: as lists of subqueries DuckDB works them out again for each edge.
_HOP_EDGES = """, e AS MATERIALIZED (SELECT * FROM edges), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h1 AS MATERIALIZED (SELECT DISTINCT b AS id FROM u WHERE a = 'nation:3' AND b <> 'nation:3'),
h2 AS MATERIALIZED (SELECT DISTINCT u.b AS id FROM u JOIN h1 ON u.a = h1.id), k AS MATERIALIZED (SELECT 'nation:3' AS id UNION SELECT id FROM h1 UNION SELECT id FROM h2)
SELECT e.src, e.type, e.dst FROM e JOIN k x ON x.id = e.src JOIN k y ON y.id = e.dst"""


@query(G + _HOP_EDGES)
def khop_edges(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).khop(_start(spark), 2)[1]


@query(G + """, s AS (SELECT src, dst, concat(src, '>', type, '>', dst) AS e FROM edges WHERE type IN ('CONTAINS', 'LOCATED_IN')),
u AS (SELECT src AS a, dst AS b, e FROM s UNION ALL SELECT dst, src, e FROM s),
p(ids, used, here, length) AS (SELECT [a, b], [e], b, 1 FROM u WHERE a = 'region:0'
  UNION ALL SELECT list_append(p.ids, u.b), list_append(p.used, u.e), u.b, p.length + 1 FROM p JOIN u ON u.a = p.here AND NOT list_contains(p.used, u.e) WHERE p.length < 3)
SELECT array_to_string(ids, '>') AS path, length FROM p""")
def varlen_fallback(spark: Spark, sf_dir: str) -> DataFrame:
    paths = star_graph(spark, sf_dir).paths("region:0", 3, ["CONTAINS", "LOCATED_IN"])
    return paths.select(F.array_join("ids", ">").alias("path"), "length")


@query(G + "SELECT id, label, substring(coalesce(content, label), 1, 200) AS snippet FROM nodes WHERE contains(lower(label), 'urgent') OR contains(lower(coalesce(content, '')), 'auto')")
def keyword_search_any(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    return store.search("urgent").unionByName(store.search("auto")).distinct()


@query(G + "SELECT id, label, substring(coalesce(content, label), 1, 200) AS snippet FROM nodes WHERE contains(lower(label), 'nation') OR contains(lower(coalesce(content, '')), 'nation') OR contains(lower(label), '1') OR contains(lower(coalesce(content, '')), '1') ORDER BY id LIMIT 20")
def keyword_search(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    return store.search("1").unionByName(store.search("nation")).distinct().orderBy("id").limit(20)


_TOP = """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS score
FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 10"""


def _first_vector(spark: Spark, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


@query(_TOP)
def vector_topk(spark: Spark, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(_TOP.replace("LIMIT 10", "LIMIT 5"))
def semantic_search(spark: Spark, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS cos
FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.35""")
def embedding_pairs(spark: Spark, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), 0.35).select("a", "b", F.round("cos", 6).alias("cos"))


@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
f AS (SELECT label, vec_id AS id, r, vec_id AS leader, [{'id': vec_id, 'e': e}] AS leaders FROM v WHERE r = 1
  UNION ALL SELECT label, id, r, coalesce(near.id, id), CASE WHEN near IS NULL THEN list_append(leaders, {'id': id, 'e': e}) ELSE leaders END
  FROM (SELECT v.label, v.vec_id AS id, v.r, v.e, f.leaders, list_filter(f.leaders, lambda x: list_dot_product(x.e, v.e) >= 0.35)[1] AS near FROM f JOIN v ON v.label = f.label AND v.r = f.r + 1))
SELECT label AS type, id, leader FROM f""")
def dedup_embedding(spark: Spark, sf_dir: str) -> DataFrame:
    return vectors.leaders(table(spark, sf_dir, "embeddings"), 0.35)


_TREE = """, t AS (SELECT src AS parent, dst AS id FROM edges WHERE type = 'CONTAINS'),
h(id, level, parent) AS (SELECT id, 1, parent FROM t WHERE parent = 'region:2' UNION ALL SELECT t.id, h.level + 1, t.parent FROM h JOIN t ON t.parent = h.id WHERE h.level < 3)"""


@query(G + _TREE + "SELECT h.id, h.level, h.parent, n.label FROM h JOIN nodes n ON n.id = h.id")
def document_hierarchy(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    return store.hierarchy("region:2", "CONTAINS", 3).join(store.nodes.select("id", "label"), "id")


@query(G + """SELECT coalesce(doc, id) AS doc_id, label, coalesce(content, label) AS short_name, doc,
CASE WHEN starts_with(label, 'A') THEN 'A' WHEN starts_with(label, 'E') THEN 'E' ELSE 'other' END AS kind FROM nodes WHERE type = 'Region' ORDER BY label""")
def list_documents(spark: Spark, sf_dir: str) -> DataFrame:
    nodes = star_graph(spark, sf_dir).nodes.where("type = 'Region'")
    kind = F.when(F.startswith("label", F.lit("A")), "A").when(F.startswith("label", F.lit("E")), "E").otherwise("other")
    return nodes.select(F.coalesce("doc", "id").alias("doc_id"), "label", F.coalesce("content", "label").alias("short_name"), "doc", kind.alias("kind")).orderBy("label")


@query(G + """, e AS (SELECT e.src, e.type, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.type IN ('Region', 'Nation') AND b.type IN ('Region', 'Nation'))
SELECT id, label, 'node' AS kind FROM nodes WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e) UNION ALL SELECT concat(src, '>', dst), type, 'edge' FROM e""")
def regulation_graph(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    kinds = store.nodes.where(F.col("type").isin("Region", "Nation")).select("id", "label")
    edges = store.edges.join(kinds.select(F.col("id").alias("src")), "src", "left_semi").join(kinds.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return kinds.join(ends, "id", "left_semi").withColumn("kind", F.lit("node")).unionByName(edges.select(F.concat_ws(">", "src", "dst").alias("id"), F.col("type").alias("label"), F.lit("edge").alias("kind")))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)
SELECT a.o_custkey AS doc, a.version, a.o_orderkey AS id, b.o_orderkey AS successor FROM v a LEFT JOIN v b ON a.o_custkey = b.o_custkey AND b.version = a.version + 1""")
def amendment_chain(spark: Spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(order).cast("long")).withColumn("successor", F.lead("o_orderkey").over(order))
    return rows.select(F.col("o_custkey").alias("doc"), "version", F.col("o_orderkey").alias("id"), "successor")


@query(G + """, n AS (SELECT id FROM nodes WHERE type IN ('Nation', 'Supplier') AND doc IN ('0', '4')) SELECT src, type, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def induced_filter(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).induced(["Nation", "Supplier"], ["0", "4"])[1]


@query(G + _BOTH + "SELECT DISTINCT b AS id FROM u WHERE a = 'nation:3'")
def neighbors(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).neighbours(_start(spark))


@query(G + """SELECT id, type, label FROM nodes WHERE doc IN ('0', '1') OR type IN ('Nation')""")
def merge_graphs(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    parts = [store.nodes.where(F.col("doc").isin("0", "1")), store.nodes.where("type = 'Nation'")]
    return graph.merged_graphs([p.select("id", "type", "label") for p in parts], [store.edges])[0]


@query("""WITH w AS (SELECT DISTINCT p_name AS wanted FROM part), m AS (SELECT wanted, p_partkey, p_name FROM w JOIN part ON starts_with(lower(p_name), lower(wanted))),
r AS (SELECT wanted, concat('part:', p_partkey) AS id, row_number() OVER (PARTITION BY wanted ORDER BY length(p_name) - length(wanted), concat('part:', p_partkey)) AS rn FROM m) SELECT wanted, id FROM r WHERE rn = 1""")
def label_lookup(spark: Spark, sf_dir: str) -> DataFrame:
    store = star_graph(spark, sf_dir)
    parts = graph.GraphStore(store.nodes.where("type = 'Part'"), store.edges)
    return parts.lookup(parts.nodes.select(F.col("label").alias("wanted")).distinct())


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id AS id, event_id, event_type, value FROM s WHERE rn = 1""")
def sink_graph_nodes(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq"), "event_id", "event_type", "value")
    return graph.upsert_nodes(rows, "seq").drop("seq")


@query("""WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0), r AS (SELECT concat('customer:', o_custkey) AS src, concat('order:', o_orderkey) AS dst, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY o_totalprice DESC) AS rn FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k))
SELECT src, dst, 'PLACED' AS type, o_totalprice AS seq FROM r WHERE rn = 1""")
def sink_graph_edges(spark: Spark, sf_dir: str) -> DataFrame:
    from graphloom.sources.star_graph import key

    customers = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(key("customer", "c_custkey").alias("id"))
    orders = table(spark, sf_dir, "orders")
    nodes = customers.unionByName(orders.select(key("order", "o_orderkey").alias("id")))
    rows = orders.select(key("customer", "o_custkey").alias("src"), key("order", "o_orderkey").alias("dst"), F.lit("PLACED").alias("type"), F.col("o_totalprice").alias("seq"))
    return graph.upsert_edges(rows, nodes, "seq").select("src", "dst", "type", "seq")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def ddl_constraint(spark: Spark, sf_dir: str) -> DataFrame:
    return graph.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH t AS (SELECT p_partkey AS id, unnest(string_split_regex(lower(concat_ws(' ', p_name, p_type)), '[^\\p{L}\\p{N}]+')) AS token FROM part) SELECT token, id, count(*) AS n FROM t WHERE token <> '' GROUP BY ALL""")
def ddl_indexes(spark: Spark, sf_dir: str) -> DataFrame:
    return graph.inverted_index(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type")
