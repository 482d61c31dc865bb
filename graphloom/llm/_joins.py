"""Joins whose very common keys are met without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is very common from so many rows on, and from this share of all rows on; so there are HOT_KEYS such keys at most.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_common(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and, as ``weight``, the number of rows that have it.

    Very common keys come by a broadcast of HOT_KEYS rows at most, and their rows are dealt out by what else they hold; the
    other keys are shuffled. ``table`` should be written, as it is read three times. how: inner or left; ``rows`` keep their columns.
    """
    limit = max(HOT_ROWS, (table.agg(F.sum(weight)).first()[0] or 0) // HOT_KEYS)
    hot, names = table.where(F.col(weight) > limit), [c for c in table.columns if c != key]
    if hot.isEmpty():
        return rows.join(table, key, how)
    packed = lambda part, name: part.select(key, F.struct(*names).alias(name))
    met = rows.join(F.broadcast(packed(hot, "__hot")), key, "left")
    met = met.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(4096)).cast("int")))
    rest = packed(table.where(F.col(weight) <= limit), "__cold").withColumn("__salt", F.lit(0))
    met = met.join(rest, [key, "__salt"], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    if how == "inner":
        met = met.where(F.col("__found").isNotNull())
    return met.select(*rows.columns, *(F.col(f"__found.{c}").alias(c) for c in names))
