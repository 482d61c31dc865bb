"""Outside services behind interfaces: page text, scans, language models, embeddings, sheets. Each has an offline form."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.functions.text import stripped


def html_text(c: str) -> Column:
    """The text of a page of markup: without scripts, styles and tags, entities for the usual signs replaced, single blanks."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n"), r"<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return stripped(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), " ?\n[ \n]*", "\n"))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, content) of the files that a pattern names."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def pages_of(rows: DataFrame, read_pages: Callable[[bytes], list[str]], recognise: Callable[[bytes, int], str] | None = None, threshold: int = 50) -> DataFrame:
    """(path, page_number, selectable_text, ocr_text, is_scanned) by a reader of page texts; pages of less text go to the recogniser, if there is one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                for k, text in enumerate(read_pages(bytes(content)), 1):
                    scanned = len((text or "").strip()) < threshold
                    out.append((path, k, text, recognise(bytes(content), k) if scanned and recognise else None, scanned))
            yield pd.DataFrame(out, columns=["path", "page_number", "selectable_text", "ocr_text", "is_scanned"])

    return rows.select("path", "content").mapInPandas(run, "path string, page_number int, selectable_text string, ocr_text string, is_scanned boolean")


def with_retries(call: Callable[[str], str], attempts: int = 3, wait: float = 2.0, exponential: bool = False) -> Callable[[str], tuple[str | None, str | None]]:
    """(answer, error) of a call that is tried again after growing pauses; the last error is returned, not raised."""

    def run(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for k in range(1, attempts + 1):
            try:
                return call(prompt), None
            except Exception as e:  # a service's failure is a result here
                error = f"{type(e).__name__}: {e}"
                if k < attempts:
                    time.sleep(wait * (2 ** (k - 1) + random.random() if exponential else k))
        return None, error

    return run


def answered(rows: DataFrame, call: Callable[[str], str], prompt_col: str = "prompt", attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """The rows with (answer, error). Tasks may run twice, so calls must bear to be repeated."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = with_retries(call, attempts, wait)
        for part in parts:
            both = [tried(p) for p in part[prompt_col]]
            yield part.assign(answer=[a for a, _ in both], error=[e for _, e in both])

    schema = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])
    return rows.mapInPandas(run, schema)


def replayed(rows: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """The rows with (answer, error) from recorded answers (key, answer): the offline form of ``answered``."""
    out = rows.join(recorded.select(key, "answer"), key, "left")
    return out.withColumn("error", F.when(F.col("answer").isNull(), "no recorded answer"))


def hashed_embedding(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """Vectors from hashes of words: the offline form of an embedding service, equal for equal texts."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for w in text.lower().split():
                h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                v[int(h[:8], 16) % dim] += 1.0 if h[8] >= "8" else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out

    return embed


def sheet_table(rows: DataFrame, types: dict[str, str], missing: tuple[str, ...] = ("", "NA", "N/A")) -> DataFrame:
    """A sheet's strings with types: missing marks become null, what can't be cast becomes null, times are parsed."""
    out = rows
    for name in rows.columns:
        value = F.when(~F.col(name).isin(*missing), F.col(name))
        kind = types.get(name, "string")
        out = out.withColumn(name, F.try_to_timestamp(value) if kind == "timestamp" else value.try_cast(kind))
    return out


def sheet_rows(rows: DataFrame, append: Callable[[list[list]], None], batch: int = 100, attempts: int = 5, wait: float = 1.0) -> DataFrame:
    """(sent, failed) by task: the rows go out in batches, each tried again with growing pauses."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = failed = 0
        for part in parts:
            values = part.astype(object).where(part.notna(), None).values.tolist()
            for at in range(0, len(values), batch):
                some = values[at : at + batch]
                _, error = with_retries(lambda _, some=some: append(some) or "", attempts, wait, exponential=True)("")
                sent, failed = sent + len(some) * (error is None), failed + len(some) * (error is not None)
        yield pd.DataFrame({"sent": [sent], "failed": [failed]})

    return rows.mapInPandas(run, "sent long, failed long").agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed"))


def prompt(rows: DataFrame, prompt_id: str) -> str:
    """The text of the first row of a prompt's id; KeyError names the ids that there are."""
    found = rows.where(F.col("PROMPT_ID") == prompt_id).limit(1).collect()
    if not found:
        raise KeyError(f"{prompt_id}: known are {sorted(r[0] for r in rows.select('PROMPT_ID').distinct().limit(100).collect())}")
    return found[0]["PROMPT_TEXT"]


def filled_prompt(template: str, **values: str) -> str:
    """A template with {name} replaced; other braces stay."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template
