"""A reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

Row numbers follow the order of (id, size, checksum), so they don't depend on how files are split. The permuted number p
of a row tells its place: shard p mod n, slot p div n. So the counts of shards differ by one at most, slots have no
gaps, and any row's place can be computed, and undone, from its number alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.plans.scratch import written

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A permutation of 0 .. n - 1 that a seed fixes."""

    def __init__(self, n: int, seed: int) -> None:
        self.n, self.bits = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.keys = [seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1342543DE82EF95 for r in range(ROUNDS)]

    def _rounds(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        a, b = x >> bits, x & mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                a, b = b ^ (_mixed(a, key) & mask), a
            else:
                a, b = b, a ^ (_mixed(b, key) & mask)
        return a << bits | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        """The square of 2^bits holds less than four times the rows, so a walk back into them takes few steps."""
        if not len(x):
            return x.astype(np.int64)
        with np.errstate(over="ignore"):
            out = self._rounds(x.astype(np.uint64), back)
            while (astray := np.flatnonzero(out >= self.n)).size:
                out[astray] = self._rounds(out[astray], back)
        return out.astype(np.int64)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def number(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, True)


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_no") -> tuple[DataFrame, int]:
    """``df`` with the rows' numbers from 0 in a total order, and their count. No task holds more than a range of the order;
    rows that tie in it are told apart by where they are read, so that very many of them are cut by ranges, too.

    The ranges are written first, as their borders come from a sample and may differ when computed again. One row for
    each range goes to the driver.
    """
    part, at, tie = "__part", "__at", "__tie"
    order = [*order, tie]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop(tie).withColumn("__mono", F.monotonically_increasing_id())
    kept = written(ranged.withColumns({part: F.shiftright("__mono", 33), at: F.col("__mono").bitwiseAND((1 << 33) - 1)}).drop("__mono"), "numbered")
    counts = sorted((r[0], r[1]) for r in kept.groupBy(part).agg(F.max(at) + 1).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], f"{part} long, __before long")
    out = kept.join(F.broadcast(offsets), part)
    return out.withColumn(name, F.col("__before") + F.col(at)).drop(part, at, "__before"), total


def shards(df: DataFrame, n_shards: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_no, law, shard, slot, grown_shard): the place of every row under the law of equal counts.

    The size is the text's bytes in UTF-8 and 8; a null text has none. Equal rows get numbers of their own, null ids come
    first. Only ids, sizes and checksums are shuffled. An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("__id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, n = numbered(rows, ["__id", "size", "text_crc32"])
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series(permutation.place(x.to_numpy()))

    at = rows.withColumn("__place", place("row_no"))
    return at.select(
        F.col("__id").alias(id_col), "size", "text_crc32", "row_no", F.lit("rows").alias("law"),
        F.pmod("__place", F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"__place div {int(n_shards)}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
