"""Batching, validation, deduplication, remapping, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom import model
from graphloom.functions import text as T
from graphloom.operators import triples
from graphloom.registry import query
from graphloom.sources.star_graph import GRAPH_SQL, star_graph
from graphloom.sources.tables import table

G = "WITH" + GRAPH_SQL
Spark = SparkSession


@query("""WITH c AS (SELECT conv_id::VARCHAR AS document_id, turn, concat(conv_id, '-', turn) AS chunk_id, text, role AS pages FROM conversations)
SELECT document_id, turn // 5 AS batch, string_agg(chunk_id, ',' ORDER BY turn) AS chunk_ids, string_agg(text, chr(10) || '---CHUNK---' || chr(10) ORDER BY turn) AS text, array_to_string(list_sort(list_distinct(list(pages))), ',') AS pages FROM c GROUP BY ALL""")
def llm_batching(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("chunk_index"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "text", F.col("role").alias("pages"))
    return triples.batches(rows, 5)


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def parse_llm_json(spark: Spark, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" ."))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(T.parsed_json(answer), "$.k", "long").alias("k"))


@query("SELECT p_partkey, 'KonsepHukum' AS type, concat('KonsepHukum_', trim(regexp_replace(regexp_replace(substring(trim(p_name), 1, 50), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS id FROM part")
def json_to_nodes_edges(spark: Spark, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("label"))).alias("nodes"))).alias("answer"))
    return triples.read_answers(answers, "p_partkey")[0].select("p_partkey", "type", "id")


@query("SELECT p_partkey, concat(p_brand, '_', trim(regexp_replace(regexp_replace(substring(trim(p_name), 1, 50), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS id FROM part")
def generate_id(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.generated_id("p_name", "p_brand").alias("id"))


_TYPES = ("Region", "Nation", "Customer", "Order")
_EDGES = {"CONTAINS": (("Region", "Nation"), ("Nation", "Customer")), "PLACED": (("Customer",), ("Part",)), "USES": (("Order",), ("Part",))}
_REJECT = G + """, n AS (SELECT *, CASE WHEN coalesce(id, '') = '' THEN 'missing id' WHEN type NOT IN ('Region', 'Nation', 'Customer', 'Order') THEN 'unknown type' WHEN length(label) < 2 THEN 'short label' END AS reject_reason FROM nodes),
c(type, a, b) AS (VALUES ('CONTAINS', 'Region', 'Nation'), ('CONTAINS', 'Region', 'Customer'), ('CONTAINS', 'Nation', 'Nation'), ('CONTAINS', 'Nation', 'Customer'), ('PLACED', 'Customer', 'Part'), ('USES', 'Order', 'Part')),
v AS (SELECT id, type FROM n WHERE reject_reason IS NULL),
e AS (SELECT e.*, s.type AS st, d.type AS dt FROM edges e LEFT JOIN v s ON s.id = e.src LEFT JOIN v d ON d.id = e.dst),
r AS (SELECT *, CASE WHEN type NOT IN (SELECT type FROM c) THEN 'unknown type' WHEN st IS NULL THEN 'source not found' WHEN dt IS NULL THEN 'target not found' WHEN strict AND NOT EXISTS (SELECT 1 FROM c WHERE c.type = e.type AND c.a = st AND c.b = dt) THEN 'constraint' END AS reject_reason FROM e, (SELECT {} AS strict))"""


def _nodes(spark: Spark, sf_dir: str) -> DataFrame:
    return triples.validated_nodes(star_graph(spark, sf_dir).nodes, model.node_types(spark, _TYPES))


def _edges(spark: Spark, sf_dir: str, strict: bool) -> DataFrame:
    edges = star_graph(spark, sf_dir).edges.select(F.col("src").alias("source_id"), "type", F.col("dst").alias("target_id"))
    return triples.validated_edges(edges, _nodes(spark, sf_dir).where("reject_reason is null"), model.edge_constraints(spark, _EDGES), strict)


@query(_REJECT.format("false") + "SELECT id, reject_reason FROM n")
def validate_nodes(spark: Spark, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("id", "reject_reason")


@query(_REJECT.format("false") + "SELECT src, type, dst, reject_reason FROM r")
def validate_edges(spark: Spark, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, False).select(F.col("source_id").alias("src"), "type", F.col("target_id").alias("dst"), "reject_reason")


@query(_REJECT.format("true") + "SELECT src, type, dst, reject_reason FROM r")
def validate_edges_strict(spark: Spark, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, True).select(F.col("source_id").alias("src"), "type", F.col("target_id").alias("dst"), "reject_reason")


@query(_REJECT.format("true") + "SELECT 'node' AS kind, coalesce(reject_reason, 'ok') AS reason, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', coalesce(reject_reason, 'ok'), count(*) FROM r GROUP BY ALL")
def validation_counts(spark: Spark, sf_dir: str) -> DataFrame:
    count = lambda rows, kind: rows.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "reason", "n")
    return count(_nodes(spark, sf_dir), "node").unionByName(count(_edges(spark, sf_dir, True), "edge"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN coalesce(nullif('', ''), role) ELSE 'x' END AS source_id FROM conversations")
def normalize_edge_keys(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "").otherwise("x").alias("source_id"), F.col("role").alias("source"), F.lit("y").alias("target_id"), F.lit(None).cast("string").alias("target"))
    return triples.edge_keys(rows).select("conv_id", "turn", "source_id")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), '^(pasal|ayat|bab|bagian)\\s+', '') AS label FROM part")
def normalize_label(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_label("p_name").alias("label"))


def _parts(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("label"), F.col("p_brand").alias("content"), F.col("p_brand").alias("doc"), F.concat_ws(",", "p_size", "p_brand").alias("chunks"), F.col("p_size").cast("string").alias("pages"))


_PARTS = """WITH p AS (SELECT lpad(p_partkey::VARCHAR, 12, '0') AS id, p_type AS type, p_name AS label, p_brand AS content, p_brand AS doc, concat_ws(',', p_size, p_brand) AS chunks, p_size::VARCHAR AS pages,
  concat_ws('|', 'label', regexp_replace(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), '^(pasal|ayat|bab|bagian)\\s+', ''), p_type) AS key FROM part),
r AS (SELECT *, row_number() OVER w AS rn, first(id) OVER w AS canonical FROM p WINDOW w AS (PARTITION BY key ORDER BY length(label) DESC, (upper(label) = label AND lower(label) <> label) DESC, length(content) DESC, id))"""


@query(_PARTS + "SELECT key, count(*) AS n FROM r GROUP BY key")
def dedup_group(spark: Spark, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).groupBy(triples.dedup_key().alias("key")).agg(F.count("*").alias("n"))


@query(_PARTS + "SELECT key, id, label FROM r WHERE rn = 1")
def dedup_canonical(spark: Spark, sf_dir: str) -> DataFrame:
    return triples.ranked(_parts(spark, sf_dir), triples.dedup_key()).where("rn = 1").select("key", "id", "label")


@query(_PARTS + """SELECT key, array_to_string(list_sort(list_distinct(list(doc))), ',') AS docs, array_to_string(list_sort(list_distinct(flatten(list(string_split(chunks, ','))))), ',') AS chunks, array_to_string(list_sort(list_distinct(list(pages))), ',') AS pages, count(*) AS merged_from FROM r GROUP BY key""")
def merge_provenance(spark: Spark, sf_dir: str) -> DataFrame:
    return triples.canonical_nodes(_parts(spark, sf_dir), triples.dedup_key()).select("key", "docs", "chunks", "pages", "merged_from")


@query(_PARTS + "SELECT id, canonical FROM r WHERE id <> canonical")
def merge_map(spark: Spark, sf_dir: str) -> DataFrame:
    return triples.merge_map(_parts(spark, sf_dir), triples.dedup_key())


@query(_PARTS + """, m AS (SELECT id, canonical FROM r), e AS (SELECT lpad(l_partkey::VARCHAR, 12, '0') AS a, lpad(l_suppkey::VARCHAR, 12, '0') AS b FROM lineitem),
x AS (SELECT coalesce(s.canonical, a) AS src, coalesce(d.canonical, b) AS dst FROM e LEFT JOIN m s ON s.id = a LEFT JOIN m d ON d.id = b) SELECT DISTINCT src, 'LINKS' AS type, dst FROM x WHERE src <> dst""")
def remap_edges(spark: Spark, sf_dir: str) -> DataFrame:
    id_ = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    edges = table(spark, sf_dir, "lineitem").select(id_("l_partkey").alias("src"), F.lit("LINKS").alias("type"), id_("l_suppkey").alias("dst"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    return triples.remapped(edges, triples.merge_map(_parts(spark, sf_dir), triples.dedup_key()), "at").select("src", "type", "dst")


@query(_PARTS + "SELECT count(*) AS before, count(DISTINCT key) AS after, count(*) - count(DISTINCT key) AS merged FROM r")
def dedup_counts(spark: Spark, sf_dir: str) -> DataFrame:
    groups = _parts(spark, sf_dir).groupBy(triples.dedup_key().alias("key")).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("before"), F.count("*").alias("after")).withColumn("merged", F.col("before") - F.col("after"))


@query("SELECT doc_id, concat(source, ': ', substring(text, 1, 500)) AS text FROM documents WHERE text <> '' UNION ALL SELECT doc_id, source FROM documents WHERE coalesce(text, '') = ''")
def embed_text(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.embed_text("source", "text").alias("text"))


@query("""WITH w AS (SELECT doc_id, md5(unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> ''))) AS h FROM documents),
c AS (SELECT doc_id, ('0x' || substring(h, 1, 8))::UBIGINT % 16 AS k, sum(CASE WHEN substring(h, 9, 1) >= '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL),
d AS (SELECT doc_id, k, coalesce(v, 0) AS v FROM (SELECT doc_id, unnest(range(0, 16))::UBIGINT AS k FROM documents) LEFT JOIN c USING (doc_id, k))
SELECT doc_id, list((CASE WHEN s > 0 THEN v / s ELSE 0 END)::FLOAT ORDER BY k) AS embedding FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS s FROM d) GROUP BY doc_id""")
def embed_batches(spark: Spark, sf_dir: str) -> DataFrame:
    from graphloom.operators.vectors import embedded
    from graphloom.sources.adapters import hashed_embedding

    return embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), hashed_embedding(16), 16).select("doc_id", "embedding")


@query("SELECT r_regionkey AS doc, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def registry_scan(spark: Spark, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("doc")).agg(F.collect_list("n_name").alias("relations"))
    return registry.select("doc", F.explode_outer("relations").alias("r")).groupBy("doc").agg(F.count("r").alias("n"))


_ACTIONS = """WITH a AS (SELECT DISTINCT o_custkey AS amender, l_suppkey AS amended, concat('Pasal ', p_size) AS article, CASE WHEN l_returnflag = 'R' THEN 'MENGUBAH' WHEN l_returnflag = 'A' THEN 'MENYISIPKAN' ELSE 'LAIN' END AS action FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def _actions(spark: Spark, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    action = F.when(F.col("l_returnflag") == "R", "MENGUBAH").when(F.col("l_returnflag") == "A", "MENYISIPKAN").otherwise("LAIN")
    return rows.select(F.col("o_custkey").alias("amender"), F.col("l_suppkey").alias("amended"), F.concat(F.lit("Pasal "), F.col("p_size").cast("string")).alias("article"), action.alias("action")).distinct()


@query(_ACTIONS + """SELECT amended AS doc, article, 1 AS version, 'diamandemen' AS status FROM a WHERE action = 'MENGUBAH' UNION ALL SELECT amender, article, 2, 'berlaku' FROM a WHERE action = 'MENGUBAH'
UNION ALL SELECT amender, article, 1, 'baru (disisipkan)' FROM a WHERE action = 'MENYISIPKAN'""")
def article_versions(spark: Spark, sf_dir: str) -> DataFrame:
    return triples.versions(_actions(spark, sf_dir))


_LABELS = """WITH n AS (SELECT p_brand AS doc, concat('part:', p_partkey) AS id, p_name AS label FROM part), w AS (SELECT DISTINCT p_brand AS doc, split_part(p_name, ' ', 1) AS article FROM part)"""


def _named(spark: Spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("doc"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label")), part.select(F.col("p_brand").alias("doc"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("article"))


_NAMED = _LABELS + "SELECT w.doc, article, id FROM w JOIN n ON n.doc = w.doc AND contains(concat(' ', lower(label), ' '), concat(' ', lower(article), ' '))"


@query(_NAMED)
def amended_article_edges(spark: Spark, sf_dir: str) -> DataFrame:
    return triples.labelled_in_document(*_named(spark, sf_dir))


_SECTIONS = """, s AS (SELECT DISTINCT doc, size, concat('Pasal ', size, ' ayat (', ln, ')') AS label, concat('node:', doc, ':', size, ':', ln) AS id FROM (
  SELECT l_suppkey AS doc, p_size AS size, l_linenumber AS ln FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 2 UNION ALL SELECT o_custkey, p_size, 9 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1))"""


@query(_ACTIONS + _SECTIONS + """, c AS (SELECT DISTINCT amender, amended, article, replace(article, ' ', '_') AS name FROM a WHERE action = 'MENGUBAH')
SELECT DISTINCT s.id AS src, 'MEMILIKI_VERSI' AS type, concat('VersiPasal_', amended, '__', name, '_v1') AS dst FROM c JOIN s ON s.doc = amended AND concat('Pasal ', s.size) = article
UNION SELECT s.id, 'MEMILIKI_VERSI', concat('VersiPasal_', amender, '__', name, '_v2') FROM c JOIN s ON s.doc = amender AND concat('Pasal ', s.size) = article
UNION SELECT concat('VersiPasal_', amended, '__', name, '_v1'), 'DIAMANDEMEN_MENJADI', concat('VersiPasal_', amender, '__', name, '_v2') FROM c""")
def link_versions(spark: Spark, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    of = lambda rows, doc, nth: rows.select(F.col(doc).alias("doc"), F.col("p_size").alias("size"), nth.alias("ln"))
    sections = of(lines.where("l_linenumber <= 2"), "l_suppkey", F.col("l_linenumber")).unionByName(of(lines.where("l_linenumber = 1").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", F.lit(9))).distinct()
    nodes = sections.select("doc", F.concat_ws(":", F.lit("node"), "doc", "size", "ln").alias("id"), F.concat(F.lit("Pasal "), F.col("size"), F.lit(" ayat ("), F.col("ln"), F.lit(")")).alias("label"))
    return triples.version_edges(_actions(spark, sf_dir), nodes)


@query("SELECT doc, article, id FROM (SELECT *, row_number() OVER (PARTITION BY doc, article ORDER BY id) AS rn FROM (" + _NAMED + ")) WHERE rn = 1")
def load_regex_refs(spark: Spark, sf_dir: str) -> DataFrame:
    found = triples.labelled_in_document(*_named(spark, sf_dir))
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("doc", "article").orderBy("id"))).where("rn = 1").drop("rn")


@query("SELECT concat('region:', r_regionkey) AS id, r_name AS label FROM region")
def registry_nodes(spark: Spark, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).nodes.where("type = 'Region'").select("id", "label")


@query("SELECT DISTINCT l_suppkey AS src, concat('AMENDED_', l_returnflag) AS type, o_custkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def amendment_kg(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("l_suppkey").alias("src"), F.concat(F.lit("AMENDED_"), F.col("l_returnflag")).alias("type"), F.col("o_custkey").alias("dst")).distinct()


@query("SELECT concat('region:', n_regionkey) AS src, 'CONTAINS' AS type, concat('nation:', n_nationkey) AS dst FROM nation")
def registry_edges(spark: Spark, sf_dir: str) -> DataFrame:
    from graphloom.sources.star_graph import key

    nation, nodes = table(spark, sf_dir, "nation"), star_graph(spark, sf_dir).nodes.select("id")
    lists = nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.lit("CONTAINS").alias("type"), key("nation", "n_nationkey").alias("dst"))).alias("relations"))
    edges = lists.select(key("region", "n_regionkey").alias("src"), F.inline("relations"))
    return edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")
