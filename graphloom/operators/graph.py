"""A property graph as two tables, and the reads that an application makes of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.plans.scratch import written
from graphloom.plans.sizes import broadcast_if_small


@dataclass(frozen=True)
class GraphStore:
    """nodes: id, type, label, content, doc, labels; edges: src, type, dst. Embeddings belong in a table of their own."""

    nodes: DataFrame
    edges: DataFrame

    def stats(self, doc: str | None = None, base_label: bool = True) -> DataFrame:
        """(kind, name, n): nodes by label, edges by type, and totals; of one document, edges count by their source."""
        nodes, edges = self.nodes, self.edges
        if doc is not None:
            nodes = nodes.where(F.col("doc") == doc)
            edges = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        # All rows of a type have the same labels: counts come first, labels are exploded after.
        by_type = nodes.groupBy("labels").agg(F.count("*").alias("n"))
        labels = by_type.select(F.explode("labels").alias("name"), "n")
        if not base_label:
            labels = labels.where(F.col("name") != "Entity")
        by_edge = edges.groupBy("type").agg(F.count("*").alias("n"))
        count = F.sum("n").cast("long").alias("n")
        parts = [
            labels.groupBy("name").agg(count).select(F.lit("label").alias("kind"), "name", "n"),
            by_edge.select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n"),
            by_type.agg(F.coalesce(count, F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("nodes").alias("name"), "n"),
            by_edge.agg(F.coalesce(count, F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("edges").alias("name"), "n"),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def type_shares(self) -> DataFrame:
        """(type, n, pct): nodes by type and their share of all in per cent, with one decimal."""
        counts = self.nodes.groupBy("type").agg(F.count("*").alias("n"))
        return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))

    def subgraph(self, labels: list[str] | None = None, docs: list[str] | None = None, edge_types: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes of any of the labels and documents, the least ids first up to the limit, their outgoing edges, and the targets."""
        first = self.nodes
        if labels:
            first = first.where(F.arrays_overlap("labels", F.lit(labels)))
        if docs:
            first = first.where(F.col("doc").isin(docs))
        if limit is not None:
            first = first.orderBy("id").limit(limit)
        edges = self.edges.where(F.col("type").isin(edge_types)) if edge_types else self.edges
        edges = edges.join(first.select(F.col("id").alias("src")), "src", "left_semi")
        ids = first.select("id").unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        return self.nodes.join(ids, "id", "left_semi"), edges

    def detail(self, node_id: str) -> DataFrame:
        """(direction, type, other, label) of a node: its outgoing and incoming edges, each side on its own, then the ends' labels."""
        out = self.edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
        into = self.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
        ends = out.unionByName(into).distinct()
        return ends.join(self.nodes.select(F.col("id").alias("other"), "label"), "other").select("direction", "type", "other", "label")

    def neighbours(self, ids: DataFrame) -> DataFrame:
        """(id): the nodes one undirected step away from the nodes (id)."""
        ids = broadcast_if_small(ids.select(F.col("id").alias("__id")))
        out = self.edges.join(ids, F.col("src") == F.col("__id"), "left_semi").select(F.col("dst").alias("id"))
        into = self.edges.join(ids, F.col("dst") == F.col("__id"), "left_semi").select(F.col("src").alias("id"))
        return out.unionByName(into).distinct()

    def khop(self, start: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        """(nodes with hop, induced edges) around the nodes (id), up to three undirected steps. A node without edges is found, too.

        The edges are written once, as each step reads them in both directions.
        """
        own = GraphStore(self.nodes, written(self.edges.select("src", "type", "dst"), "edges"))
        seen = start.select("id").distinct().withColumn("hop", F.lit(0))
        front = seen.select("id")
        for hop in range(1, min(depth, 3) + 1):
            # Written, as three later plans read it; else each hop would run again within them.
            front = written(own.neighbours(front).join(seen.select("id"), "id", "left_anti"), "front")
            seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
        ids = seen.select("id")
        edges = own.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return seen, edges.select("src", "type", "dst")

    def induced(self, types: list[str], docs: list[str]) -> tuple[DataFrame, DataFrame]:
        """The nodes of both the types and the documents, and the edges that keep both ends."""
        nodes = self.nodes.where(F.col("type").isin(types) & F.col("doc").isin(docs))
        edges = self.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        return nodes, edges.select("src", "type", "dst")

    def search(self, term: str, limit: int | None = None) -> DataFrame:
        """(id, label, snippet) of nodes whose label or content holds the term in any case, by id."""
        hit = F.contains(F.lower("label"), F.lit(term.lower())) | F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(term.lower()))
        found = self.nodes.where(hit).select("id", "label", F.substring(F.coalesce("content", "label"), 1, 200).alias("snippet"))
        return found.orderBy("id").limit(limit) if limit is not None else found

    def lookup(self, labels: DataFrame) -> DataFrame:
        """(wanted, id): for each wanted label the node whose label equals it or begins with it, in any case; equal first, then by id."""
        # A label gives one key for each length that is wanted: an equi-join that gives nothing but matches, whatever labels share.
        wanted = labels.where("wanted is not null").select("wanted", F.lower("wanted").alias("key")).distinct()
        lengths = sorted(r[0] for r in wanted.select(F.length("key")).distinct().collect())
        low = self.nodes.select("id", F.lower("label").alias("l"))
        keys = low.select("id", F.length("l").alias("n"), F.explode(F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda k: k <= F.length("l")), lambda k: F.col("l").substr(F.lit(1), k))).alias("key"))
        best = keys.join(wanted, "key").groupBy("wanted").agg(F.min(F.struct((F.col("n") - F.length("key")).alias("rest"), "id")).alias("m"))
        return best.select("wanted", F.col("m.id").alias("id"))

    def hierarchy(self, root: str, edge_type: str, depth: int) -> DataFrame:
        """(id, level, parent) below a node along one edge type; each level a join, cycles end with the depth."""
        tree = self.edges.where(F.col("type") == edge_type).select(F.col("src").alias("parent"), F.col("dst").alias("id"))
        level = tree.where(F.col("parent") == root).select("id", F.lit(1).alias("level"), "parent")
        found = level
        for k in range(2, depth + 1):
            level = tree.join(level.select(F.col("id").alias("parent")), "parent").select("id", F.lit(k).alias("level"), "parent")
            found = found.unionByName(level)
        return found

    def paths(self, start: str, depth: int, edge_types: list[str] | None = None) -> DataFrame:
        """(ids, length) of the undirected paths of 1 to ``depth`` edges from a node, none of them with an edge twice."""
        edges = self.edges.where(F.col("type").isin(edge_types)) if edge_types else self.edges
        both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(">", "src", "type", "dst").alias("e"))
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        step = both.where(F.col("a") == start).select(F.array("a", "b").alias("ids"), F.array("e").alias("used"), F.col("b").alias("at"))
        found = step
        for _ in range(1, depth):
            step = step.join(both, (F.col("at") == F.col("a")) & ~F.array_contains("used", F.col("e")))
            step = step.select(F.array_append("ids", F.col("b")).alias("ids"), F.array_append("used", F.col("e")).alias("used"), F.col("b").alias("at"))
            found = found.unionByName(step)
        return found.select("ids", F.size("used").alias("length"))


def upsert_nodes(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The last row of each key, by ``order`` and then all other columns; embeddings of zeros alone become null."""
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c not in (key, order) and not rows.schema[c].dataType.typeName().startswith(("map", "variant"))]
    out = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), *rest))).where("__rn = 1").drop("__rn")
    if "embedding" in rows.columns:
        out = out.withColumn("embedding", F.when(F.exists("embedding", lambda x: x != 0), F.col("embedding")))
    return out


def upsert_edges(rows: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """The last row of each (src, type, dst) of which both ends are nodes."""
    for end in ("src", "dst"):
        rows = rows.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy("src", "type", "dst").orderBy(F.col(order).desc()))).where("__rn = 1").drop("__rn")


def merged_graphs(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """First-seen union: the node of the earliest graph stays for each id, edges are distinct by (src, type, dst)."""
    numbered = [n.withColumn("__g", F.lit(k)) for k, n in enumerate(nodes)]
    every = numbered[0]
    for n in numbered[1:]:
        every = every.unionByName(n, allowMissingColumns=True)
    first = every.withColumn("__rn", F.row_number().over(Window.partitionBy("id").orderBy("__g"))).where("__rn = 1").drop("__rn", "__g")
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    return first, all_edges.select("src", "type", "dst").distinct()


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that rows share; a uniqueness constraint holds if there are none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def inverted_index(rows: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(token, id, n): the lower-case words of the texts, the table behind a full-text search."""
    words = F.split(F.lower(F.concat_ws(" ", *text_cols)), r"[^\p{L}\p{N}]+")
    return rows.select(F.col(id_col).alias("id"), F.explode(words).alias("token")).where("token <> ''").groupBy("token", "id").agg(F.count("*").alias("n"))
