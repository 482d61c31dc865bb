"""Line dedup by a log-template tree, in DataFrame functions.

A line goes down a tree of fixed depth: by its number of words, then by its leading words, words with a digit being
variable. Where a leaf holds lines of many documents, each further place of a line keeps its word if enough documents of
the leaf have it there; else it becomes variable, too. Lines whose masked text, or whose template in a leaf, recurs in
enough documents are dropped from all but the document with the least id, so that no content is lost altogether. Lines
with too small a share of words without a digit, as rows of numbers, say nothing by their masked text: they recur only
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm._joins import join_common
from graphloom.llm.quality_rules import BLANKS, let
from graphloom.plans.scratch import written
from graphloom.plans.sizes import broadcast_if_small

#: A template recurs if as many documents have it; leading words in a leaf; least share of fixed words in a template.
MIN_DOCS, DEPTH, SIMILARITY = 10, 3, 0.8


def _plain(line: Column, odd: Column) -> Column:
    """The line with single blanks; empty without words. Only lines of texts with ``odd`` blanks need their blanks replaced."""
    return F.trim(F.when(odd, F.regexp_replace(line, BLANKS, " ")).otherwise(line))


def _masked(plain: Column) -> Column:
    return F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", "<*>")


def masked(line: Column, odd: Column) -> Column:
    """The line with single blanks, and with <*> for words that hold a digit."""
    return let(_plain(line, odd), lambda x: F.when(x.rlike("[0-9]"), _masked(x)).otherwise(x))


def _told(line: Column, odd: Column, similarity: float) -> Column:
    """(line, own): the masked line, and the line as it is if its share of words without a digit is less than ``similarity``."""
    def of_masked(plain: Column, line: Column) -> Column:
        words = F.split(line, " ")
        n_fixed = F.size(F.filter(words, lambda w: w != "<*>"))
        return F.struct(line.alias("line"), F.when(n_fixed / F.size(words) < similarity, plain).alias("own"))

    none = F.lit(None).cast("string")
    return let(_plain(line, odd), lambda x: F.when(x.rlike("[0-9]"), let(_masked(x), lambda m: of_masked(x, m))).otherwise(F.struct(x.alias("line"), none.alias("own"))))


def _odd(text: Column) -> Column:
    """Whether a text holds blanks other than single spaces and line feeds."""
    found = text.contains("  ")
    for blank in "\t\x0b\x0c\r":
        found = found | text.contains(blank)
    return found


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(df: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(id, row, pos, line, leaf, key) for each line with a word; row tells repeated ids apart by their texts."""
    # Masked before they are exploded: the result of a generator is computed once, whatever uses it.
    lines = let(_odd(F.col("text")), lambda odd: F.transform(F.split("text", "\n"), lambda x: _told(x, odd, similarity)))
    rows = df.select("id", F.xxhash64("text").alias("row"), F.posexplode(lines).alias("pos", "told")).select("id", "row", "pos", "told.*").where(F.col("line") != "")
    keys = {"leaf": F.xxhash64(_n_words(F.col("line")), F.substring_index("line", " ", depth)), "key": F.xxhash64(F.coalesce("own", "line"))}
    return rows.withColumns(keys).drop("own")


def _recurring(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    """(key, first, n): the keys of at least ``min_docs`` documents, the least id and the number of rows. A very common key is
    counted by (key, id) first."""
    by_id = rows.where("id is not null").groupBy(key, "id").agg(F.count("*").alias("n"))
    return by_id.groupBy(key).agg(F.count("*").alias("n_docs"), F.min("id").alias("first"), F.sum("n").alias("n")).where(F.col("n_docs") >= min_docs).drop("n_docs")


def _met(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The rows with the columns of a written table of recurring keys: by a broadcast if it is small, else common keys apart."""
    small = broadcast_if_small(table)
    return rows.join(small, key, how) if small is not table else join_common(rows, table, key, "n", how)


def recurring_lines(df: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, row, pos) of the lines to drop, for a table (id, text) without null texts."""
    keyed = written(_lines(df, depth, similarity).drop("line"), "line-keys")
    whole = written(_recurring(keyed, "key", min_docs), "line-templates")
    told = _met(keyed, whole, "key", "left")
    dropped = told.where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).select("id", "row", "pos")
    # What is left, in leaves of many documents, is looked at word by word.
    rest = told.where(F.col("first").isNull()).select(keyed.columns)
    leaves = written(_recurring(rest, "leaf", min_docs).select("leaf", "n"), "line-leaves")
    chosen = written(_met(rest, leaves, "leaf").select("id", "row", "pos", "leaf"), "leaf-places")
    by_text = broadcast_if_small(chosen.groupBy("id", "row").agg(F.collect_set(F.struct("pos", "leaf")).alias("places")).select(F.col("id").alias("c_id"), F.col("row").alias("c_row"), "places"), chosen)
    texts = df.withColumn("row", F.xxhash64("text")).join(by_text, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row")))
    found = let(_odd(F.col("text")), lambda odd: let(F.split("text", "\n"), lambda x: F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), p["leaf"].alias("leaf"), masked(F.get(x, p["pos"]), odd).alias("line")))))
    lines = texts.select("id", "row", F.inline(found))
    parts = lines.select("id", "row", "pos", "leaf", F.posexplode(F.split("line", " ")).alias("place", "word"))
    parts = parts.withColumn("at", F.struct("leaf", "place", "word"))
    by_id = parts.where((F.col("place") >= depth) & (F.col("word") != "<*>") & F.col("id").isNotNull()).groupBy("at", "id").agg(F.count("*").alias("n"))
    fixed = by_id.groupBy("at").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).where(F.col("n_docs") >= min_docs).select("at", "n", F.lit(True).alias("fixed"))
    told = _met(parts, written(fixed, "fixed-words"), "at", "left").withColumn("fixed", F.col("fixed").isNotNull() | ((F.col("place") < depth) & (F.col("word") != "<*>")))
    made = told.groupBy("id", "row", "pos", "leaf").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("word")).otherwise("<*>").alias("word")))), lambda x: x["word"]), " ").alias("template"),
        F.avg(F.col("fixed").cast("int")).alias("share"),
    )
    made = made.where(F.col("share") >= similarity).withColumn("template", F.xxhash64("leaf", "template"))
    made = written(made.select("id", "row", "pos", "template"), "leaf-templates")
    more = _met(made, written(_recurring(made, "template", min_docs), "recurring-templates"), "template").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "row", "pos")
    return dropped.unionByName(more)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_lines, n_dropped) for every row: the text without the lines of recurring templates.

    A template recurs from ``min_docs`` documents on, whatever its length; what fewer have stays.
    Lines without a word stay. A null text stays null with no lines; an empty one has none with a word. Documents are told
    apart by id: rows of the same id count as one document, those with a null id count for none and keep only what doesn't recur
    elsewhere. Equal rows get equal results. An empty table gives no rows. ``also`` names further columns to pass on, as one struct.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drops = recurring_lines(rows, min_docs, depth, similarity).groupBy("id", "row").agg(F.collect_set("pos").alias("drops"))
    drops = drops.select(F.col("id").alias("d_id"), F.col("row").alias("d_row"), "drops")
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("raw"), *([F.struct(*(F.col(f"`{c}`") for c in also)).alias("also")] if also else []))
    kept = kept.withColumn("row", F.xxhash64(F.coalesce("raw", F.lit(""))))
    joined = kept.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("row") == F.col("d_row")), "left")
    left = let(F.split("raw", "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops")), lambda i: F.get(lines, i)), "\n"))
    n_lines = F.size(F.filter(F.split("raw", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("drops").isNull(), F.col("raw")).otherwise(left).alias("text"),
        F.when(F.col("raw").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        *([F.col("also")] if also else []),
    )


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents with the deduplicated texts in their text column, other columns as they are, but for documents of
    which every line with a word was dropped: each of them recurs elsewhere, so they go. An empty table stays empty."""
    out = line_dedup(docs, id_col, text_col, also=tuple(docs.columns), **params).where((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"also.`{c}`").alias(c) for c in docs.columns))
