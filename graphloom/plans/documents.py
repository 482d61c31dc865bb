"""The nine steps from a document's pages to the graph, as stages over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom import model
from graphloom.functions import text as T
from graphloom.operators import chunking, references, structure, triples
from graphloom.operators.graph import upsert_nodes
from graphloom.operators.vectors import embedded
from graphloom.plans.stages import Runner, Stage
from graphloom.sources.adapters import hashed_embedding, replayed

#: The last step that needs no model: a dry run ends there.
DRY_RUN_STEP = "create_chunks"
_PART = ["document_id", "kind", "id", "type", "label", "content", "src", "dst"]


def _extracted(chunks: DataFrame, recorded: DataFrame) -> DataFrame:
    """(document_id, kind, id, type, label, content, src, dst): the nodes and edges of the chunks' recorded answers."""
    answers = replayed(chunks.select("document_id", "chunk_id"), recorded, "chunk_id").withColumn("key", F.struct("document_id", "chunk_id"))
    nodes, edges = triples.read_answers(answers, "key")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    nodes = nodes.select("key.document_id", F.lit("node").alias("kind"), "id", "type", "label", "content", *none("src", "dst"))
    return nodes.unionByName(edges.select("key.document_id", F.lit("edge").alias("kind"), *none("id"), "type", *none("label", "content"), F.col("source_id").alias("src"), F.col("target_id").alias("dst")))


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'node'").select("document_id", "id", "type", "label", "content")


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'edge'").select("document_id", F.col("src").alias("source_id"), "type", F.col("dst").alias("target_id"))


def _parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    some = nodes.select("document_id", F.lit("node").alias("kind"), "id", "type", "label", "content")
    return some.unionByName(edges.select("document_id", F.lit("edge").alias("kind"), "type", F.col("source_id").alias("src"), F.col("target_id").alias("dst")), allowMissingColumns=True).select(_PART)


def _validated(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    nodes = triples.validated_nodes(_nodes(rows), model.node_types(spark)).where("reject_reason is null")
    edges = triples.validated_edges(_edges(rows), nodes, model.edge_constraints(spark)).where("reject_reason is null")
    return _parts(nodes, edges)


def _deduplicated(rows: DataFrame) -> DataFrame:
    """One node of each key within its document, and the edges between those that stay."""
    nodes = _nodes(rows).withColumn("doc", F.col("document_id"))
    ranked = triples.ranked(nodes, F.concat_ws("|", "document_id", triples.dedup_key()))
    edges = _edges(rows)
    moved = ranked.where("id <> canonical").select("document_id", "id", "canonical").distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(moved.withColumnRenamed("id", end), ["document_id", end], "left").withColumn(end, F.coalesce("canonical", end)).drop("canonical")
    return _parts(ranked.where("rn = 1"), edges.where("source_id <> target_id").distinct())


def document_stages(recorded: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 16) -> list[Stage]:
    """The steps over pages (document_id, page_number, text).

    recorded: (chunk_id, answer) of the model that extracts nodes and edges; embed: texts to vectors. Documents without
    any text are rejected by the first step.
    """
    embed = embed or hashed_embedding(dim)

    def empty(pages: DataFrame) -> DataFrame:
        texts = pages.groupBy("document_id").agg(F.max(F.length(T.stripped(F.coalesce("text", F.lit(""))))).alias("n"))
        return texts.where("n = 0").select("document_id", F.lit("no text").alias("reason"))

    cleaned = lambda pages: pages.select("document_id", "page_number", T.clean_page("text", F.lit(None).cast("string"), F.lit(False)).alias("text"))
    embed_nodes = lambda rows: embedded(rows.withColumn("text", F.when(F.col("kind") == "node", T.embed_text("label", "content")).otherwise("")), embed, dim).drop("text")
    return [
        Stage("extract_pdf", cleaned, empty),
        Stage("parse_structure", lambda pages: structure.components(structure.page_lines(pages))),
        Stage("detect_references", lambda rows: references.detected(rows, text_col="content"), source="parse_structure"),
        Stage("create_chunks", lambda rows: chunking.sliding(structure.segments(rows)), source="parse_structure"),
        Stage("extract_triples", lambda chunks: _extracted(chunks, recorded), source="create_chunks"),
        Stage("validate_triples", _validated),
        Stage("deduplicate", _deduplicated),
        Stage("embed_nodes", embed_nodes),
        Stage("load_graph", lambda rows: rows.select(*_PART, "embedding")),
    ]


def loaded_nodes(runner: Runner) -> DataFrame:
    """The graph's nodes: of each id the last document's."""
    rows = runner.table("load_graph").where("kind = 'node'").select("id", "type", "label", "content", "document_id", "embedding")
    return upsert_nodes(rows, "document_id")


def truncate(spark: SparkSession, folder: str) -> None:
    """Empties the tables nodes and edges of a folder; their columns stay."""
    for name in ("nodes", "edges"):
        path = f"{folder.rstrip('/')}/{name}"
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
