"""Extracted nodes and edges: batching of chunks, reading of answers, validation, deduplication, remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text as T


def joined_list(c: Column | str, by: str = ",") -> Column:
    """The sorted distinct parts of all comma-joined lists of a group."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(c, ","))))), by)


def batches(chunks: DataFrame, size: int) -> DataFrame:
    """(document_id, batch, chunk_ids, text, pages): ``size`` consecutive chunks each, for one call of a model.

    chunks: document_id, chunk_index, chunk_id, text, pages (comma-joined).
    """
    items = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text")))
    return chunks.withColumn("batch", F.floor(F.col("chunk_index") / size)).groupBy("document_id", "batch").agg(
        F.array_join(F.transform(items, lambda x: x["chunk_id"]), ",").alias("chunk_ids"),
        F.array_join(F.transform(items, lambda x: x["text"]), "\n---CHUNK---\n").alias("text"),
        joined_list("pages").alias("pages"),
    )


_NODE = "array<struct<id:string,type:string,label:string,content:string>>"
_EDGE = "array<struct<source_id:string,source:string,target_id:string,target:string,type:string>>"


def read_answers(answers: DataFrame, key: str = "batch_id", text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON answers; answers that hold no JSON have none. Missing types and ids get defaults."""
    body = answers.select(F.col(key), F.from_json(F.to_json(T.parsed_json(text)), f"struct<nodes:{_NODE},edges:{_EDGE}>").alias("b"))
    nodes = body.select(key, F.inline("b.nodes")).withColumn("type", F.coalesce("type", F.lit("KonsepHukum")))
    nodes = nodes.withColumn("id", F.coalesce("id", T.generated_id(F.coalesce("label", F.lit("")), "type")))
    return nodes, edge_keys(body.select(key, F.inline("b.edges"))).withColumn("type", F.coalesce("type", F.lit("MERUJUK")))


def edge_keys(edges: DataFrame) -> DataFrame:
    """source_id and target_id from either spelling; an empty one counts as missing."""
    out = edges
    for new, old in (("source_id", "source"), ("target_id", "target")):
        out = out.withColumn(new, F.coalesce(F.nullif(new, F.lit("")), F.col(old), F.lit("")))
    return out.drop("source", "target")


def validated_nodes(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """With ``reject_reason``: the first rule that a node breaks, null if none. Nulls are handled as missing."""
    known = nodes.join(F.broadcast(types.select("type").distinct().withColumn("__known", F.lit(True))), "type", "left")
    reason = F.when(F.coalesce("id", F.lit("")) == "", "missing id").when(F.col("__known").isNull(), "unknown type").when(F.length(T.stripped(F.coalesce("label", F.lit("")))) < 2, "short label")
    return known.withColumn("reject_reason", reason).drop("__known")


def validated_edges(edges: DataFrame, nodes: DataFrame, constraints: DataFrame, strict: bool = False) -> DataFrame:
    """With ``reject_reason`` for edges (source_id, type, target_id): unknown type, missing ends, and if strict, ends of types that the ontology doesn't allow.

    The types of edges and their constraints are few at any scale and are broadcast; nodes are joined by id.
    """
    ids = nodes.groupBy("id").agg(F.max("type").alias("t"))
    kinds = F.broadcast(constraints.select("type").distinct().withColumn("__known", F.lit(True)))
    out = edges.join(kinds, "type", "left").join(ids.select(F.col("id").alias("source_id"), F.col("t").alias("src_type")), "source_id", "left").join(ids.select(F.col("id").alias("target_id"), F.col("t").alias("dst_type")), "target_id", "left")
    out = out.join(F.broadcast(constraints.withColumn("__allowed", F.lit(True))), ["type", "src_type", "dst_type"], "left")
    reason = F.when(F.col("__known").isNull(), "unknown type").when(F.col("src_type").isNull(), "source not found").when(F.col("dst_type").isNull(), "target not found")
    if strict:
        reason = reason.when(F.col("__allowed").isNull(), "constraint")
    return out.withColumn("reject_reason", reason).drop("__known", "__allowed")


def dedup_key(type_col: Column | str = "type") -> Column:
    """Regulations are one per document, other structural nodes one per id, the rest one per label and type."""
    kind = F.col(type_col) if isinstance(type_col, str) else type_col
    return F.when(kind == "Regulasi", F.concat_ws("|", F.lit("doc"), "doc")).when(kind.isin("Bab", "Bagian", "Pasal", "Ayat"), F.concat_ws("|", F.lit("id"), "id")).otherwise(F.concat_ws("|", F.lit("label"), T.normalize_label("label"), kind))


def ranked(nodes: DataFrame, key: Column) -> DataFrame:
    """With key, rn (1: canonical) and canonical: the longest label, then one in capitals, then the longest content, then the first id."""
    label, content = F.coalesce("label", F.lit("")), F.coalesce("content", F.lit(""))
    capital = (F.upper(label) == label) & (F.lower(label) != label)
    w = Window.partitionBy("key").orderBy(F.length(label).desc(), capital.desc(), F.length(content).desc(), "id")
    rows = nodes.withColumn("key", key)
    return rows.withColumns({"rn": F.row_number().over(w), "canonical": F.first("id").over(w)})


def canonical_nodes(nodes: DataFrame, key: Column) -> DataFrame:
    """The canonical node of each key with the provenance of all: docs, chunk ids, pages, and how many were merged."""
    rows = ranked(nodes, key)
    merged = rows.groupBy("key").agg(joined_list("doc").alias("docs"), joined_list("chunks").alias("chunks"), joined_list("pages").alias("pages"), F.count("*").alias("merged_from"))
    return rows.where("rn = 1").select("key", "id", "type", "label", "content").join(merged, "key")


def merge_map(nodes: DataFrame, key: Column) -> DataFrame:
    """(id, canonical) of the nodes that another one stands for; chains are followed to their end."""
    pairs = ranked(nodes, key).where("id <> canonical").groupBy("id").agg(F.min("canonical").alias("canonical"))
    for _ in range(2):
        onward = pairs.select(F.col("id").alias("canonical"), F.col("canonical").alias("__next"))
        pairs = pairs.join(onward, "canonical", "left").select("id", F.coalesce("__next", "canonical").alias("canonical"))
    return pairs.where("id <> canonical")


def remapped(edges: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """(src, type, dst) with canonical ends; loops go, and of equal edges the first by ``order`` stays."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(mapping.select(F.col("id").alias(end), F.col("canonical").alias(f"__{end}")), end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    out = out.where("src <> dst")
    first = Window.partitionBy("src", "type", "dst").orderBy(order)
    return out.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def versions(actions: DataFrame) -> DataFrame:
    """(doc, article, version, status) of amendments (amender, amended, article, action): a changed article has an old and a new version, an inserted one only a new."""
    changed = F.array(F.struct(F.col("amended").alias("doc"), F.lit(1).alias("version"), F.lit("diamandemen").alias("status")), F.struct(F.col("amender").alias("doc"), F.lit(2).alias("version"), F.lit("berlaku").alias("status")))
    added = F.array(F.struct(F.col("amender").alias("doc"), F.lit(1).alias("version"), F.lit("baru (disisipkan)").alias("status")))
    return actions.select("article", F.explode(F.when(F.col("action") == "MENGUBAH", changed).when(F.col("action") == "MENYISIPKAN", added)).alias("v")).select("v.doc", "article", "v.version", "v.status")


def labelled_in_document(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, article, id): nodes of the document whose label names the article as whole words, in any case.

    Labels give a row for each run of as many words as some article has, and meet articles by document and words.
    """
    articles = wanted.select("doc", "article").distinct().withColumn("words", F.lower("article"))
    lengths = sorted(r[0] for r in articles.select(F.size(F.split("words", " "))).distinct().collect())
    if not lengths:
        return articles.select("doc", "article", F.lit(None).cast("string").alias("id"))
    words = nodes.where("label is not null").select("doc", "id", F.split(F.lower("label"), " ").alias("w"))
    runs = lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    phrases = words.select("doc", "id", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("words"))
    return articles.join(phrases, ["doc", "words"]).select("doc", "article", "id")


def version_id(doc: Column, article: Column, version: Column) -> Column:
    return F.concat(F.lit("VersiPasal_"), doc.cast("string"), F.lit("__"), F.replace(article, F.lit(" "), F.lit("_")), F.lit("_v"), version.cast("string"))


def version_edges(actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, type, dst): from the nodes that name a changed article, in the amended and in the amending document, to the
    version of it there, and from the old version to the new one."""
    changed = actions.where(F.col("action") == "MENGUBAH").select("amender", "amended", "article").distinct()
    old, new = (version_id(F.col(doc), F.col("article"), F.lit(k)) for doc, k in (("amended", 1), ("amender", 2)))
    there = versions(changed.withColumn("action", F.lit("MENGUBAH"))).distinct()
    named = labelled_in_document(nodes, there).join(there, ["doc", "article"])
    links = named.select(F.col("id").alias("src"), F.lit("MEMILIKI_VERSI").alias("type"), version_id(F.col("doc"), F.col("article"), F.col("version")).alias("dst"))
    return links.unionByName(changed.select(old.alias("src"), F.lit("DIAMANDEMEN_MENJADI").alias("type"), new.alias("dst"))).distinct()
