"""From lines to a hierarchy of components: windows over line numbers in place of a parser's loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text as T
from graphloom.plans.scratch import written

#: Levels of the hierarchy, outermost first.
LEVELS = {"BAB": 1, "BAGIAN": 2, "PARAGRAF": 3, "PASAL": 4, "AYAT": 5, "HURUF": 6, "ANGKA": 7}
# Fixed value: the line that begins the explanations, as scans spell it.
EXPLANATION = r"(?i)^\s*PENJ[EI.,]*L?[AE.,]*S[AE.,]*N\s*$"


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, line_no, page, text) of pages (document_id, page_number, text), lines counted from 0 within a document."""
    rows = pages.select("document_id", F.col("page_number").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "pos")) - 1).select("document_id", "line_no", "page", "text")


def explanation_start(lines: DataFrame) -> DataFrame:
    """(document_id, start): the first line that begins the explanations and is followed, within three lines, by what they explain."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    ahead = F.concat_ws(" ", *(F.lead("text", k).over(w) for k in (1, 2, 3)))
    marked = lines.withColumn("ahead", F.upper(ahead)).where(F.col("text").rlike(EXPLANATION) & F.col("ahead").rlike("ATAS|UNDANG|PERATURAN"))
    return marked.groupBy("document_id").agg(F.min("line_no").alias("start"))


def classified(lines: DataFrame) -> DataFrame:
    """The lines with kind (null: plain), number, rest, and whether they are the title of a header above."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    rows = lines.withColumn("kind", T.line_type("text"))
    rows = rows.withColumns({"number": T.line_part("text", "kind", 1), "rest": T.line_part("text", "kind", 2), "plain": F.col("kind").isNull() & (T.stripped("text") != "")})
    head = lambda k: F.coalesce(F.lag("kind", k).over(w).isin("BAB", "BAGIAN"), F.lit(False))
    return rows.withColumn("is_title", F.col("plain") & (head(1) | (head(2) & F.coalesce(F.lag("plain", 1).over(w), F.lit(False))))).drop("plain")


def components(lines: DataFrame) -> DataFrame:
    """(document_id, ord, component_type, number, title, content, page_start, page_end, component_id, parent_id, is_explanation).

    What stands before the first header is left out. A component id that occurs again gets the last part of its parent's id,
    and an ordinal if that occurs again, too.
    """
    rows = classified(lines)
    w = Window.partitionBy("document_id").orderBy("line_no")
    rows = rows.withColumn("ord", F.sum(F.col("kind").isNotNull().cast("int")).over(w)).where("ord > 0")
    text = F.when(F.col("kind").isNotNull(), F.col("rest")).when(~F.col("is_title") & (T.stripped("text") != ""), T.stripped("text"))
    items = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("line_no", text.alias("t")))))
    titles = F.array_sort(F.collect_list(F.when(F.col("is_title"), F.struct("line_no", T.stripped("text").alias("t")))))
    join = lambda c, by: F.array_join(F.transform(c, lambda x: x["t"]), by)
    body = F.col("kind").isNull() & ~F.col("is_title") & (T.stripped("text") != "")
    head = F.col("kind").isNotNull()
    out = rows.groupBy("document_id", "ord").agg(
        F.max(F.when(head, F.col("kind"))).alias("component_type"), F.max(F.when(head, F.col("number"))).alias("number"),
        F.nullif(join(titles, " "), F.lit("")).alias("title"), T.stripped(join(items, "\n")).alias("content"),
        F.max(F.when(head, F.col("page"))).alias("page_start"), F.max(F.when(head | body, F.col("page"))).alias("page_end"), F.min("line_no").alias("line_no"),
    )
    out = out.join(explanation_start(lines), "document_id", "left").withColumn("is_explanation", F.coalesce(F.col("line_no") >= F.col("start"), F.lit(False))).drop("start", "line_no")
    # Two stage tables: each of the seven levels of ids reads the rows and the level above it again.
    return written(identified(written(parented(out), "sections")), "components")


def _level(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for kind, level in LEVELS.items():
        out = F.when(c == kind, level).otherwise(out)
    return out


def parented(rows: DataFrame) -> DataFrame:
    """With ``parent_ord``: the nearest component before of a lower level, one running value for each level."""
    before = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    level = _level(F.col("component_type"))
    nearest = {f"__p{k}": F.last(F.when(F.col("level") < k, F.col("ord")), ignorenulls=True).over(before) for k in range(2, 8)}
    parent = F.lit(None).cast("long")
    for k in range(2, 8):
        parent = F.when(F.col("level") == k, F.col(f"__p{k}")).otherwise(parent)
    return rows.withColumn("level", level).withColumns(nearest).withColumn("parent_ord", parent).drop(*nearest)


def identified(rows: DataFrame) -> DataFrame:
    """With component_id and parent_id. An id needs its parent's, so ids are settled level by level."""
    base = F.concat(F.col("document_id"), F.lit("__"), F.col("component_type"), F.lit("_"), F.regexp_replace("number", "[^a-zA-Z0-9]", ""))
    rows = rows.withColumn("base", base).withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "base").orderBy("ord")))
    rows = written(rows, "numbered-sections")
    done = rows.where("level = 1").withColumns({"component_id": F.col("base"), "parent_id": F.lit(None).cast("string")})
    for level in range(2, 8):
        above = done.select("document_id", F.col("ord").alias("parent_ord"), F.col("component_id").alias("parent_id"))
        here = rows.where(F.col("level") == level).join(above, ["document_id", "parent_ord"], "left")
        part = F.element_at(F.split("parent_id", "__"), -1)
        here = here.withColumn("component_id", F.when((F.col("nth") == 1) | F.col("parent_id").isNull(), F.col("base")).otherwise(F.concat_ws("__", "base", part)))
        done = done.unionByName(written(here, "level"))
    again = F.row_number().over(Window.partitionBy("document_id", "component_id").orderBy("ord"))
    return done.withColumn("component_id", F.when(again > 1, F.concat_ws("__", "component_id", again.cast("string"))).otherwise(F.col("component_id"))).drop("base", "nth", "level", "parent_ord")


def children(rows: DataFrame) -> DataFrame:
    """(document_id, parent_id, children): ids in order, joined by commas."""
    kids = F.array_sort(F.collect_list(F.struct("ord", "component_id")))
    return rows.where("parent_id is not null").groupBy("document_id", "parent_id").agg(F.array_join(F.transform(kids, lambda x: x["component_id"]), ",").alias("children"))


def descendants(rows: DataFrame) -> DataFrame:
    """(document_id, root, component_id, depth): every component below each other one; at most six joins."""
    tree = rows.select("document_id", "parent_id", "component_id").where("parent_id is not null")
    step = tree.select("document_id", F.col("parent_id").alias("root"), "component_id", F.lit(1).alias("depth"))
    found = step
    for depth in range(2, 7):
        step = step.select("document_id", "root", F.col("component_id").alias("parent_id")).join(tree, ["document_id", "parent_id"]).select("document_id", "root", "component_id", F.lit(depth).alias("depth"))
        found = found.unionByName(step)
    return found


def tree_lines(rows: DataFrame, depth: int = 3, preview: int = 60) -> DataFrame:
    """(document_id, ord, line): the components down to a depth, indented, with the beginning of their content."""
    levels = _level(F.col("component_type"))
    return rows.where(levels <= depth).select("document_id", "ord", F.concat(F.repeat(F.lit("  "), levels - 1), F.concat_ws(" ", "component_type", "number", F.substring("content", 1, preview))).alias("line"))


def segments(rows: DataFrame) -> DataFrame:
    """(document_id, ord, component_id, component_type, page_start, page_end, text) of components with content, under a header by type."""
    head = (
        F.when(F.col("component_type").isin("BAB", "BAGIAN", "PARAGRAF"), F.concat(F.col("component_type"), F.lit(" "), F.col("number"), F.coalesce(F.concat(F.lit(" - "), F.col("title")), F.lit(""))))
        .when(F.col("component_type") == "PASAL", F.concat(F.lit("Pasal "), F.col("number")))
        .when(F.col("component_type") == "AYAT", F.concat(F.lit("Ayat ("), F.col("number"), F.lit(")")))
    )
    return rows.where("content <> ''").select("document_id", "ord", "component_id", "component_type", "page_start", "page_end", F.concat_ws("\n", head, "content").alias("text"))


def article_texts(rows: DataFrame) -> DataFrame:
    """(document_id, component_id, text): each article's header, content and direct children."""
    kid = F.when(F.col("component_type") == "AYAT", F.concat(F.lit("("), F.col("number"), F.lit(") "), F.col("content"))).when(F.col("component_type").isin("HURUF", "ANGKA"), F.concat(F.col("number"), F.lit(". "), F.col("content"))).otherwise(F.col("content"))
    kids = rows.groupBy("document_id", F.col("parent_id").alias("component_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", kid.alias("t")))), lambda x: x["t"]), "\n").alias("kids"))
    articles = rows.where("component_type = 'PASAL'").join(kids, ["document_id", "component_id"], "left")
    return articles.select("document_id", "component_id", "ord", F.concat_ws("\n", F.concat(F.lit("Pasal "), F.col("number")), F.nullif("content", F.lit("")), "kids").alias("text"))


def by_section(rows: DataFrame) -> DataFrame:
    """(document_id, component_id, section): articles with the section right above them; the others are in no section."""
    sections = rows.where("component_type = 'BAGIAN'").select("document_id", F.col("component_id").alias("parent_id"), F.concat_ws(" ", "number", "title").alias("section"))
    return rows.where("component_type = 'PASAL'").join(sections, ["document_id", "parent_id"], "left").select("document_id", "component_id", F.coalesce("section", F.lit("")).alias("section"))
