"""Cosine search, similar pairs within types, and leader clustering, with functions of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from graphloom.plans.scratch import written
from graphloom.plans.sizes import broadcast_if_small

#: Vectors of a type in a tile, about.
TILE = 2_000


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k vectors of the greatest cosine with the query, ties by id. Null and zero vectors have no score."""
    length = float(np.linalg.norm(query)) or 1.0
    score = F.try_divide(dot(vec_col, F.lit([float(x) for x in query])), norm(vec_col) * length)
    return vectors.select(F.col(id_col).alias("id"), score.alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", type_col: str = "label", tile: int = TILE) -> DataFrame:
    """(type, a, b, cos): pairs of a type with a < b and a cosine of the threshold or more.

    A type is cut into tiles of about ``tile`` vectors by a hash of the id; each two tiles meet in a task as a product of
    matrices, so no task holds more than two of them, whatever the type's size, and no pair below the threshold leaves it.
    Null and zero vectors are like none, vectors of other lengths than the most of theirs neither.
    """
    kind = vectors.schema[type_col].dataType.simpleString()
    base = vectors.select(F.col(type_col).alias("t"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null and id is not null")
    base = base.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    tiles = base.groupBy("t").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).select(F.col("t").alias("k"), "tiles")
    rows = base.join(broadcast_if_small(tiles), F.col("t").eqNullSafe(F.col("k"))).drop("k").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("t", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        sides = [group[group["own"] == k] for k in (i, j)]
        (ids, left), (others, right) = ((x["id"].to_numpy(), x["v"].tolist()) for x in sides)
        out = []
        for size in {len(v) for v in left} & {len(v) for v in right}:
            at, to = (np.array([k for k, v in enumerate(x) if len(v) == size]) for x in (left, right))
            a, b = (np.array([x[k] for k in places], dtype=np.float64) for x, places in ((left, at), (right, to)))
            cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
            x, y = np.nonzero(cos >= threshold)
            u, v, c = ids[at[x]], others[to[y]], cos[x, y]
            keep = (u < v) if i == j else (u != v)
            out.append(pd.DataFrame({"a": np.minimum(u, v)[keep], "b": np.maximum(u, v)[keep], "cos": c[keep]}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cos": []})
        found.insert(0, "type", [group["t"].iloc[0]] * len(found))
        return found

    return rows.groupBy("t", "i", "j").applyInPandas(meet, f"type {kind}, a long, b long, cos double")


def leaders(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", type_col: str = "label") -> DataFrame:
    """(type, id, leader): in the order of ids, a vector joins the first leader of its type that it is similar enough to, or
    leads itself. Null and zero vectors lead themselves; a repeated id is one.

    Found in rounds over the written pairs: who has no undecided vector before it that is like it leads, and what is like a
    leader follows. There are as many rounds as the longest run of vectors that wait for each other.
    """
    rows = written(vectors.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(type_col).alias("type")), "vectors")
    pairs = written(similar_pairs(vectors, threshold, id_col, vec_col, type_col).select("a", "b").distinct(), "pairs")
    leading, left = None, pairs
    while not left.isEmpty():
        waiting = left.select(F.col("b").alias("a")).distinct()
        free = written(left.select("a").distinct().join(waiting, "a", "left_anti"), "leaders")
        leading = free if leading is None else leading.unionByName(free)
        gone = free.unionByName(left.join(free, "a", "left_semi").select(F.col("b").alias("a"))).distinct()
        gone = written(gone, "decided")
        left = written(left.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "undecided")
    # Who is in no undecided pair any more and follows nobody leads as well: only pairs with a leader tell.
    followed = pairs.groupBy("b").agg(F.lit(1).alias("one")).select("b")
    if leading is None:
        return rows.select("type", "id", F.col("id").alias("leader"))
    following = pairs.join(leading, "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    freed = followed.join(following, "b", "left_anti").join(leading.select(F.col("a").alias("b")), "b", "left_anti")
    if not freed.isEmpty():
        more = pairs.join(freed.select(F.col("b").alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
        following = following.unionByName(more).groupBy("b").agg(F.min("leader").alias("leader"))
    out = rows.join(following.withColumnRenamed("b", "id"), "id", "left")
    return out.select("type", "id", F.coalesce("leader", "id").alias("leader"))


def embedded(rows: DataFrame, embed, dim: int, text_col: str = "text", batch: int = 100) -> DataFrame:
    """The rows with ``embedding`` from ``embed`` (list of texts -> list of vectors), called in batches; a failed batch gets zeros."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list[list[float]] = []
            for at in range(0, len(part), batch):
                texts = part[text_col].iloc[at : at + batch].fillna("").tolist()
                try:
                    vectors += [list(map(float, v)) for v in embed(texts)]
                except Exception:  # the service's failure is data here: zeros mark it
                    vectors += [[0.0] * dim for _ in texts]
            yield part.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)
