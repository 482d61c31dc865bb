"""Graph pattern queries, each compiled to joins; the questions that an application ships with, over the stand-in graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.plans.pattern import run_query
from graphloom.registry import query
from graphloom.sources.star_graph import GRAPH_SQL, star_graph

G = "WITH" + GRAPH_SQL

#: name -> (pattern, SQL over nodes and edges)
QUESTIONS = {
    "pattern_hop": ("MATCH (a:Order)-[:USES]->(p:Part) RETURN a.id AS a, p.id AS p", "SELECT src AS a, dst AS p FROM edges WHERE type = 'USES'"),
    "pattern_reverse": ("MATCH (n:Nation)<-[:CONTAINS]-(r:Region {label: 'ASIA'}) RETURN n.label AS n ORDER BY n", "SELECT n.label AS n FROM edges e JOIN nodes r ON r.id = e.src AND r.label = 'ASIA' JOIN nodes n ON n.id = e.dst WHERE r.type = 'Region'"),
    "pattern_two_hop": ("MATCH (r:Region)-[:CONTAINS]->(n:Nation)-[:CONTAINS]->(c:Customer) RETURN r.label AS r, count(c) AS n", "SELECT r.label AS r, count(*) AS n FROM edges e JOIN nodes r ON r.id = e.src AND r.type = 'Region' JOIN edges f ON f.src = e.dst AND f.type = 'CONTAINS' GROUP BY 1"),
    "pattern_alternation": ("MATCH (a)-[e:APPLIES_TO|LOCATED_IN]->(b) RETURN type(e) AS t, count(*) AS n ORDER BY n DESC", "SELECT type AS t, count(*) AS n FROM edges WHERE type IN ('APPLIES_TO', 'LOCATED_IN') GROUP BY 1"),
    "pattern_untyped": ("MATCH (s:Supplier)-[e]->(x) RETURN DISTINCT type(e) AS t, x.type AS x", "SELECT DISTINCT e.type AS t, x.type AS x FROM edges e JOIN nodes s ON s.id = e.src AND s.type = 'Supplier' JOIN nodes x ON x.id = e.dst"),
    "pattern_star": ("MATCH (p:Part)-[:APPLIES_TO]->(s:Supplier), (s)-[:LOCATED_IN]->(n:Nation) WHERE p.label CONTAINS 'red' RETURN n.label AS n, count(DISTINCT p.id) AS parts", "SELECT n.label AS n, count(DISTINCT p.id) AS parts FROM nodes p JOIN edges e ON e.src = p.id AND e.type = 'APPLIES_TO' JOIN edges f ON f.src = e.dst AND f.type = 'LOCATED_IN' JOIN nodes n ON n.id = f.dst WHERE p.type = 'Part' AND contains(p.label, 'red') GROUP BY 1"),
    "pattern_same_target": ("MATCH (a:Supplier)-[:LOCATED_IN]->(n:Nation)<-[:LOCATED_IN]-(b:Supplier) WHERE a.id < b.id RETURN a.id AS a, b.id AS b", "SELECT e.src AS a, f.src AS b FROM edges e JOIN edges f ON e.dst = f.dst AND e.type = 'LOCATED_IN' AND f.type = 'LOCATED_IN' AND e.src < f.src"),
    "pattern_optional": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.label STARTS WITH '1' RETURN c.id AS c, count(o) AS n", "SELECT c.id AS c, count(o.id) AS n FROM nodes c LEFT JOIN (SELECT e.src, o.id FROM edges e JOIN nodes o ON o.id = e.dst WHERE e.type = 'PLACED' AND starts_with(o.label, '1')) o ON o.src = c.id WHERE c.type = 'Customer' GROUP BY 1"),
    "pattern_var_length": ("MATCH (r:Region {label: 'EUROPE'})-[:CONTAINS*1..2]->(x) RETURN x.type AS t, count(*) AS n", "SELECT t, sum(n)::BIGINT AS n FROM (SELECT 'Nation' AS t, count(*) AS n FROM edges e JOIN nodes r ON r.id = e.src AND r.label = 'EUROPE' UNION ALL SELECT 'Customer', count(*) FROM edges e JOIN nodes r ON r.id = e.src AND r.label = 'EUROPE' JOIN edges f ON f.src = e.dst AND f.type = 'CONTAINS') GROUP BY 1"),
    "pattern_successive_match": ("MATCH (o:Order)-[:USES]->(p:Part) MATCH (p)-[:APPLIES_TO]->(s:Supplier) WHERE s.label IN ['Supplier#000000001', 'Supplier#1'] RETURN count(*) AS n", "SELECT count(*) AS n FROM edges e JOIN edges f ON f.src = e.dst AND f.type = 'APPLIES_TO' JOIN nodes s ON s.id = f.dst WHERE e.type = 'USES' AND s.label IN ('Supplier#000000001', 'Supplier#1')"),
    "pattern_collect": ("MATCH (r:Region)-[:CONTAINS]->(n:Nation) RETURN r.label AS r, size(collect(DISTINCT n.label)) AS n, head(collect(n.label)) AS first", "SELECT r.label AS r, count(DISTINCT n.label)::INT AS n, min(n.label) AS first FROM edges e JOIN nodes r ON r.id = e.src AND r.type = 'Region' JOIN nodes n ON n.id = e.dst GROUP BY 1"),
    "pattern_where": ("MATCH (c:Customer) WHERE (c.content = 'BUILDING' OR toLower(c.label) CONTAINS '7') AND c.doc IS NOT NULL AND NOT c.doc = '0' RETURN c.id AS id, coalesce(c.content, '-') AS segment, substring(c.label, 0, 8) AS short", "SELECT id, coalesce(content, '-') AS segment, substring(label, 1, 8) AS short FROM nodes WHERE type = 'Customer' AND (content = 'BUILDING' OR contains(lower(label), '7')) AND doc IS NOT NULL AND doc <> '0'"),
    "pattern_top": ("MATCH (n:Nation)-[:CONTAINS]->(c:Customer) RETURN n.label AS n, count(*) AS k ORDER BY k DESC, n LIMIT 5", "SELECT n.label AS n, count(*) AS k FROM edges e JOIN nodes n ON n.id = e.src AND n.type = 'Nation' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "pattern_label_or": ("MATCH (n) WHERE (n:Region OR n:Nation) AND n.label STARTS WITH 'A' RETURN n.label AS label, labels(n) AS labels", "SELECT label, ['Entity', type] AS labels FROM nodes WHERE type IN ('Region', 'Nation') AND starts_with(label, 'A')"),
    "pattern_label_counts": ("MATCH (n) WITH labels(n) AS names, count(n) AS k UNWIND names AS name RETURN name AS label, sum(k) AS n ORDER BY n DESC", "SELECT label, sum(n)::BIGINT AS n FROM (SELECT type AS label, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'Entity', count(*) FROM nodes) GROUP BY 1"),
    "pattern_with_limit": ("MATCH (n:Nation) WITH n ORDER BY n.label LIMIT 7 OPTIONAL MATCH (n)-[:CONTAINS]->(c:Customer) WHERE c.content = 'BUILDING' WITH n, count(c) AS k, collect(DISTINCT {segment: c.content, doc: c.source_document_id}) AS found RETURN n.label AS n, k, [m IN found | m.segment] AS segments, [m IN found | m.doc] AS docs", "SELECT n.label AS n, count(c.id) AS k, [CASE WHEN count(c.id) > 0 THEN 'BUILDING' END] AS segments, [any_value(c.doc)] AS docs FROM (SELECT * FROM nodes WHERE type = 'Nation' ORDER BY label LIMIT 7) n LEFT JOIN edges e ON e.src = n.id AND e.type = 'CONTAINS' LEFT JOIN nodes c ON c.id = e.dst AND c.content = 'BUILDING' GROUP BY 1"),
    "pattern_case": ("MATCH (c:Customer) RETURN c.id AS id, CASE WHEN c.content STARTS WITH 'AUTO' THEN 'car' WHEN c.content = 'BUILDING' THEN 'house' ELSE coalesce(c.short_name, 'else') END AS kind, CASE c.node_type WHEN 'Customer' THEN 'yes' END AS sure, c.status AS status", "SELECT id, CASE WHEN starts_with(content, 'AUTO') THEN 'car' WHEN content = 'BUILDING' THEN 'house' ELSE 'else' END AS kind, 'yes' AS sure, NULL::VARCHAR AS status FROM nodes WHERE type = 'Customer'"),
    "pattern_list_concat": ("MATCH (r:Region) OPTIONAL MATCH (r)-[:CONTAINS]->(n:Nation) OPTIONAL MATCH (n)<-[:LOCATED_IN]-(s:Supplier) WITH r, collect(DISTINCT n) + collect(DISTINCT s) AS found UNWIND found AS x WITH r, x WHERE x.label CONTAINS '1' OR x:Nation RETURN r.label AS r, x.label AS x, x.id AS id", "SELECT r.label AS r, n.label AS x, n.id FROM nodes r JOIN edges e ON e.src = r.id AND e.type = 'CONTAINS' JOIN nodes n ON n.id = e.dst WHERE r.type = 'Region' UNION SELECT r.label, s.label, s.id FROM nodes r JOIN edges e ON e.src = r.id AND e.type = 'CONTAINS' JOIN edges f ON f.dst = e.dst AND f.type = 'LOCATED_IN' JOIN nodes s ON s.id = f.src WHERE r.type = 'Region' AND contains(s.label, '1')"),
    "pattern_path": ("MATCH p = (r:Region {label: 'ASIA'})-[:CONTAINS*1..2]->(x) WHERE length(p) = 1 OR x.content = 'BUILDING' RETURN [n IN nodes(p) | n.label] AS labels, [e IN relationships(p) | type(e)] AS types, [n IN nodes(p) WHERE n.content IS NOT NULL | n.content] AS contents", "SELECT [r.label, n.label] AS labels, ['CONTAINS'] AS types, []::VARCHAR[] AS contents FROM nodes r JOIN edges e ON e.src = r.id AND e.type = 'CONTAINS' JOIN nodes n ON n.id = e.dst WHERE r.label = 'ASIA' UNION ALL SELECT [r.label, n.label, c.label], ['CONTAINS', 'CONTAINS'], [c.content] FROM nodes r JOIN edges e ON e.src = r.id AND e.type = 'CONTAINS' JOIN nodes n ON n.id = e.dst JOIN edges f ON f.src = n.id AND f.type = 'CONTAINS' JOIN nodes c ON c.id = f.dst AND c.content = 'BUILDING' WHERE r.label = 'ASIA'"),
    "pattern_edge_ends": ("MATCH (a:Supplier)-[e:LOCATED_IN]->(b) WHERE b.label <> 'WITH } MATCH' RETURN elementId(startNode(e)) AS a, endNode(e).id AS b, [a.label, b.label] AS both", "SELECT e.src AS a, e.dst AS b, [s.label, n.label] AS both FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes n ON n.id = e.dst WHERE e.type = 'LOCATED_IN'"),
    "run_query_text": ("MATCH (n:Region) RETURN n.label AS label ORDER BY label", "SELECT label FROM nodes WHERE type = 'Region'"),
}


def _register(name: str, pattern: str, sql: str) -> None:
    @query(G + sql, name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_query(star_graph(spark, sf_dir), pattern)


for _name, (_pattern, _sql) in QUESTIONS.items():
    _register(_name, _pattern, " " + _sql)


_BROKEN = ("MATCH (n RETURN n", "RETURN", "MATCH (n) RETURN n.nothing AS x")
_VALUES = ", ".join("('{}', {})".format(t.replace("'", "''"), ok) for texts, ok in (([p for p, _ in QUESTIONS.values()], "true"), (_BROKEN, "false")) for t in texts)


@query(f"SELECT * FROM (VALUES {_VALUES}) AS t(query, valid)")
def query_validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, valid) for the shipped questions and some broken ones; nothing is run."""
    from graphloom.plans.pattern import is_valid

    store = star_graph(spark, sf_dir)
    texts = [p for p, _ in QUESTIONS.values()] + list(_BROKEN)
    return spark.createDataFrame([(t, is_valid(store, t)) for t in texts], "query string, valid boolean").select("query", F.col("valid"))
