"""Quality rules: countable rules, and the log-likelihood ratio of hashed n-grams between trusted and raw texts.

All of it is DataFrame functions. Word and word-pair hashes fall into a fixed number of buckets; two multinomials over
them, one of trusted documents and one of all, give each bucket the logarithm of its ratio. A document's score is the
mean over its n-grams; it passes if the score reaches a low quantile of the trusted documents' own scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.plans.scratch import written
from graphloom.plans.sizes import broadcast_if_small

BUCKETS = 8192
#: Trusted ids are sent as bitmaps of 4 KB for 32,768 neighbouring ids each, up to this number of bitmaps.
MAX_BITMAPS = 4096
#: The threshold is this quantile of the trusted scores, less this many of the scores' standard deviations.
QUANTILE, MARGIN = 0.001, 0.25
BLANKS = r"[\x20\x09-\x0D]+"


class Model(NamedTuple):
    """The buckets' log ratios and the least score that passes; without trusted documents none is asked for."""

    ratios: tuple[float, ...]
    threshold: float | None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where body uses it within a function of each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " "))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def _heads(x: Column, n: int) -> Column:
    """The elements that start a window of n."""
    return F.slice(x, 1, F.greatest(F.size(x) - (n - 1), F.lit(0)))


def _buckets(hashes: Column) -> Column:
    """The buckets of the words and word pairs, by the words' hashes."""
    one = F.transform(hashes, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.transform(_heads(hashes, 2), lambda x, i: F.pmod(F.xxhash64(x, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def _repeat_words(hashes: Column) -> Column:
    """The number of words in windows of three that occur twice or more.

    Windows are told apart by 64-bit hashes. They are sorted with their places, so a long text costs n log n.
    """
    triples = F.transform(_heads(hashes, 3), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def covered(starts: Column) -> Column:
        steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def repeated(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        held = F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1)))
        return let(F.array_sort(F.transform(held, lambda x: x["i"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    return let(triples, counted)


def _score(hashes: Column, ratios: Column) -> Column:
    """The mean log ratio; null without words."""
    return let(_buckets(hashes), lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda total, x: total + F.get(ratios, x)) / F.size(b)))


def _literal(ratios: tuple[float, ...]) -> Column:
    """The ratios as one constant, which the optimiser makes of their spelling."""
    return F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def measures(text: Column, model: Model) -> dict[str, Column]:
    """The rule columns of a text column: counts, base_failed, score and kept."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    joined = F.length(F.regexp_replace(text, BLANKS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(_hashes(text), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).cast("long").alias("n_repeat_words"), _score(h, _literal(model.ratios)).alias("score")))
    return {
        "__w": of_words,
        "word_chars": joined.cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judged(df: DataFrame, model: Model, id_col: str, text_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns ``also`` and the rule columns; each row gives a row."""
    first = df.select(F.col(id_col).alias("__id"), F.struct(*also).alias("__also") if also else F.lit(0).alias("__also"), *(c.alias(k) for k, c in measures(F.col(text_col), model).items()))
    second = first.select("__id", "__also", "__w.*", "word_chars", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = F.lit(True) if model.threshold is None else F.coalesce(F.col("score") >= model.threshold, F.lit(False))
    out = second.withColumns({"base_failed": failed, "kept": ~failed & passed})
    return out.select(F.col("__id").alias(id_col), *([F.col("__also")] if also else []), *_OUT)


def _marked(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """The texts with ``__trusted``: 1 for an id among the trusted, else null.

    Ids in few ranges come as bitmaps, so that the texts stay where they are. Other ids are sent as they are if they are few
    enough for a broadcast; else the texts are shuffled.
    """
    bits = trusted.groupBy(F.bitmap_bucket_number("__id").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__id")).alias("__bits"))
    if trusted.select(F.bitmap_bucket_number("__id")).distinct().limit(MAX_BITMAPS + 1).count() > MAX_BITMAPS:
        return texts.join(broadcast_if_small(trusted.distinct().withColumn("__trusted", F.lit(1))), "__id", "left")
    at = F.bitmap_bit_position("__id")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = texts.withColumn("__bucket", F.bitmap_bucket_number("__id")).join(F.broadcast(bits), "__bucket", "left")
    return found.select(*texts.columns, F.when(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, 1).alias("__trusted"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The ratios from the n-grams of all documents and of the trusted ones, and the threshold.

    Trusted are all documents labelled of quality and not toxic. The driver gets one row for each bucket. Null ids and
    texts take no part in trust and counts.
    """
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null")
    marked = _marked(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")), trusted)
    grams = marked.select("__trusted", F.explode(let(_hashes(F.col("__text")), _buckets)).alias("bucket"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for b, n, t in grams.groupBy("bucket").agg(F.count("*"), F.count("__trusted")).collect():
        raw[b], target[b] = n, t
    total, trusted_total = sum(raw), sum(target)
    if not trusted_total:
        return Model((0.0,) * BUCKETS, None)
    ratios = tuple(round(math.log((t + 1) / (trusted_total + BUCKETS)) - math.log((n + 1) / (total + BUCKETS)), 6) for n, t in zip(raw, target, strict=True))
    scores = marked.where("__trusted = 1").select(let(_hashes(F.col("__text")), lambda h: F.when(F.size(h) >= 50, _score(h, _literal(ratios)))).alias("score"))
    scores = written(scores, "scores").where("score is not null")
    # The deviation comes from whole numbers, millionths, whose sums don't depend on the order of tasks.
    parts = F.round(F.col("score") * 1_000_000).cast("decimal(19,0)")
    n, held, squares = scores.agg(F.count("score"), F.sum(parts), F.sum((parts * parts).cast("decimal(38,0)"))).first()
    if not n:
        return Model(ratios, None)
    spread = math.sqrt(max(0, n * int(squares) - int(held) ** 2)) / n / 1_000_000
    # Only the scores up to the quantile are gathered, a thousandth of all.
    at = (n - 1) * QUANTILE
    least = [r["score"] for r in scores.orderBy("score").limit(math.ceil(at) + 1).collect()]
    below = least[math.floor(at)]
    low = below + (at - math.floor(at)) * (least[-1] - below)
    return Model(ratios, round(low - MARGIN * spread, 6))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row.

    Null and empty texts have no words: they fail the base rules and have no score. Repeated rows are judged alike; an
    empty table gives no rows; without trusted documents the base rules alone decide.
    """
    return judged(docs, fit(docs, labels, id_col, text_col), id_col, text_col)


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. The rows are judged where they are, without a shuffle.
    An empty table stays empty."""
    out = judged(docs, fit(docs, labels, id_col, text_col), id_col, text_col, tuple(f"`{c}`" for c in docs.columns))
    return out.where("kept").select("__also.*")
