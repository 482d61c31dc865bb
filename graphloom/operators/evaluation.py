"""Data sets for question answering, and how results are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def split_by_hash(rows: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """With ``part``: the first floor(share n) rows by the hash of the key are "train", the rest "val".

    The place of a row comes from the counts of hash prefixes and its rank within its prefix, so no task orders all rows.
    """
    h = F.md5(F.col(key).cast("string"))
    rows = rows.withColumn("__h", h).withColumn("__p", F.substring("__h", 1, 3))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))  # 4096 prefixes at most
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).withColumn("__total", F.sum("__n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key))
    out = rows.join(F.broadcast(counts), "__p").withColumn("part", F.when(F.col("__before") + rank <= F.floor(F.col("__total") * share), "train").otherwise("val"))
    return out.drop("__h", "__p", "__n", "__before", "__total")


def ranked_ids(rows: DataFrame, group: str, key: str, span: int = 4096) -> DataFrame:
    """(group, key, i): the place of each row's whole number ``key`` within its group, from 0.

    It is the count of the spans of numbers before and the rank within the span: no task orders a whole group.
    """
    ids = rows.select(group, key, F.floor(F.col(key) / span).alias("__s"))
    counts = ids.groupBy(group, "__s").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("__g"), F.col("__s").alias("__t"), before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy(group, "__s").orderBy(key)) - 1
    placed = ids.withColumn("__rank", rank).join(counts, F.col(group).eqNullSafe(F.col("__g")) & F.col("__s").eqNullSafe(F.col("__t")))
    return placed.select(group, key, (F.col("__before") + F.col("__rank")).alias("i"))


def filled_templates(templates: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(question, query, category) for templates (type, question, query, category) with {label} and the first labels of their type."""
    first = entities.withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy("label"))).where(F.col("rn") <= most)
    fill = lambda c: F.replace(F.col(c), F.lit("{label}"), F.col("label"))
    return first.join(F.broadcast(templates), "type").where("label is not null").select(fill("question").alias("question"), fill("query").alias("query"), "category")


def kept_samples(samples: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Samples that were judged valid and not made up; those without a verdict stay."""
    joined = samples.join(verdicts, key, "left")
    return joined.where(F.coalesce("valid", F.lit(True)) & ~F.coalesce("hallucination", F.lit(False)))


def rates(rows: DataFrame, flags: list[str], means: list[str], category: str = "category") -> DataFrame:
    """(category, n, rate of each flag, mean of each number): overall (category TOTAL) and by category, in one pass."""
    aggs = [F.count("*").alias("n"), *(F.round(F.avg(F.col(f).cast("int")), 6).alias(f) for f in flags), *(F.round(F.avg(m), 6).alias(m) for m in means)]
    out = rows.withColumn("category", F.coalesce(F.col(category).cast("string"), F.lit("none"))).rollup("category").agg(*aggs)
    return out.withColumn("category", F.coalesce("category", F.lit("TOTAL")))


def same_rows(left: DataFrame, right: DataFrame) -> Column | DataFrame:
    """(equal): whether two results hold the same rows, each as often; one aggregated comparison, no order."""
    cols = left.columns
    both = left.groupBy(*cols).agg(F.count("*").alias("__n")).withColumn("__side", F.lit(1)).unionByName(right.select(*cols).groupBy(*cols).agg(F.count("*").alias("__n")).withColumn("__side", F.lit(-1)))
    odd = both.groupBy(*cols).agg(F.sum(F.col("__n") * F.col("__side")).alias("__d")).where("__d <> 0")
    return odd.agg((F.count("*") == 0).alias("equal"))


def result_f1(actual: DataFrame, expected: DataFrame, group: str, cut: int = 200) -> DataFrame:
    """(group, recall, precision, f1) of rows that agree on the common columns, texts cut to ``cut`` characters."""
    common = [c for c in expected.columns if c in actual.columns and c != group]
    text = lambda df: df.select(group, *(F.substring(F.col(c).cast("string"), 1, cut).alias(c) for c in common))
    found = text(expected).join(text(actual).distinct(), [group, *common], "left_semi").groupBy(group).agg(F.count("*").alias("hit"))
    sizes = expected.groupBy(group).agg(F.count("*").alias("e")).join(actual.groupBy(group).agg(F.count("*").alias("a")), group, "full")
    out = sizes.join(found, group, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    recall, precision = F.coalesce(F.try_divide("hit", "e"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "a"), F.lit(0.0))
    return out.select(group, F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)), 6).alias("f1"))


def case_score(kind: str | Column, actual_rows: Column, actual_value: Column, expected_value: Column, found: Column, expected_rows: Column) -> Column:
    """The score of a test case by its kind of comparison."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind == "NOT_EMPTY", F.when(actual_rows > 0, 1.0).otherwise(0.0))
        .when(kind == "COUNT_MIN", F.when(expected_value > 0, F.least(F.lit(1.0), F.try_divide(actual_value, expected_value))).otherwise(0.0))
        .when(kind == "CONTAINS_ALL", F.when(expected_rows == 0, 1.0).otherwise(F.try_divide(found, expected_rows)))
        .otherwise(0.0)
    )


def against_targets(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value, target, result) for metrics and targets (metric, target, at_least)."""
    met = F.when(F.col("at_least"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return metrics.join(F.broadcast(targets), "metric").select("metric", "value", "target", F.when(met, "PASS").otherwise("FAIL").alias("result"))
