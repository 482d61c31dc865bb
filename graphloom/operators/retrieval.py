"""Search in several ways, context for answers, relations of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text as T
from graphloom.operators.graph import GraphStore
from graphloom.plans.scratch import written
from graphloom.plans.sizes import broadcast_if_small


def search_terms(questions: DataFrame) -> DataFrame:
    """(question_id, strategy, rank, term): keywords, then article names, then pairs of words."""
    articles = F.regexp_extract_all("question", F.lit(r"[Pp]asal\s+\d+"), F.lit(0))
    parts = [(1, T.keywords("question")), (2, articles), (3, T.bigrams("question"))]
    rows = [questions.select("question_id", F.lit(k).alias("strategy"), F.posexplode(c).alias("rank", "term")) for k, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def multi_search(questions: DataFrame, store: GraphStore, most: int = 10) -> DataFrame:
    """(question_id, id, nth): what the terms find, each node once, by strategy and rank; pairs of words count only where
    the other strategies found less than three. The 5 (keywords) or 3 nodes of the least id are taken of each term.

    A text that holds a term holds the term's three-letter parts, so terms meet nodes by the part that the fewest nodes have,
    and are then looked for as a whole: a join by key, whatever the number of questions. The parts that terms have are
    sent to the nodes where they are few, so that no other part of a text is shuffled.
    """
    terms = search_terms(questions).where(F.length("term") > 2)
    of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.col(c).substr(i, F.lit(3))))
    asked = written(terms.select(F.lower("term").alias("t")).distinct().select("t", F.explode(of("t")).alias("part")), "term-parts")
    text = store.nodes.select("id", F.lower(F.concat_ws("\n", "label", "content")).alias("body")).where(F.length("body") > 2)
    parts = text.withColumn("part", F.explode(of("body")))
    counts = parts.select("part").join(broadcast_if_small(asked.select("part").distinct()), "part").groupBy("part").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "part").groupBy("t").agg(F.min(F.struct("n", "part"))["part"].alias("part"))
    # A part of a term that no text has leaves the term without a match: such terms are not looked for.
    missing = asked.join(counts, "part", "left_anti").select("t").distinct()
    rarest = written(rarest.join(missing, "t", "left_anti"), "rarest-parts")
    hits = parts.join(broadcast_if_small(rarest), "part").where(F.contains("body", "t"))
    first = Window.partitionBy("t").orderBy("id")
    hits = hits.withColumn("n", F.row_number().over(first)).where("n <= 5").select("t", "id", "n")
    found = terms.withColumn("t", F.lower("term")).join(hits, "t").where((F.col("strategy") == 1) | (F.col("n") <= 3))
    sure = found.where("strategy < 3").groupBy("question_id").agg(F.count_distinct("id").alias("sure"))
    found = found.join(sure, "question_id", "left").where((F.col("strategy") < 3) | (F.coalesce("sure", F.lit(0)) < 3))
    best = found.groupBy("question_id", "id").agg(F.min(F.struct("strategy", "rank", "n")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("at", "id"))
    return best.withColumn("nth", nth).where(F.col("nth") <= most).select("question_id", "id", "nth")


def relations(store: GraphStore, ids: DataFrame, most: int = 8) -> DataFrame:
    """(id, relations): up to ``most`` outgoing and incoming edges of each node as one text, by type and the other end."""
    label = store.nodes.select(F.col("id").alias("other"), "label")
    out = store.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.lit("->").alias("way"), "type", F.col("dst").alias("other"))
    into = store.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit("<-").alias("way"), "type", F.col("src").alias("other"))
    rows = out.unionByName(into).withColumn("rn", F.row_number().over(Window.partitionBy("id", "way").orderBy("type", "other"))).where(F.col("rn") <= most)
    rows = rows.join(label, "other").withColumn("said", F.concat_ws(" ", "way", "type", "label"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("way", "rn", "said"))), lambda x: x["said"]), "; ").alias("relations"))


def context_lines(rows: DataFrame, columns: list[str], order: str, most: int = 20, cut: int | None = None) -> DataFrame:
    """(nth, line): the first rows as "n. name: value | ...", without nulls and errors."""
    shown = lambda c: T.truncated(F.col(c).cast("string"), cut) if cut else F.col(c).cast("string")
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), shown(c))) for c in columns if c != "error"]
    first = rows.orderBy(order).limit(most).withColumn("nth", F.row_number().over(Window.orderBy(order)))
    return first.select("nth", F.concat(F.col("nth").cast("string"), F.lit(". "), F.concat_ws(" | ", *parts)).alias("line"))


def grouped_by_type(rows: DataFrame, group: Column, order: dict[str, int]) -> DataFrame:
    """(name, place, n): counts by group in a fixed order; null is a group of its own, others come last."""
    name = F.coalesce(group.cast("string"), F.lit("Lainnya"))
    places = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    counts = rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.coalesce(F.try_element_at(places, F.col("name")), F.lit(len(order))))


def within(templates: DataFrame, wanted: list[str], most: int = 3) -> DataFrame:
    """The first templates whose documents (array ``docs``) are all among the wanted ones."""
    return templates.where(F.size(F.array_except("docs", F.lit(wanted))) == 0).orderBy("id").limit(most)
