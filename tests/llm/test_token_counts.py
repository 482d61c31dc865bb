"""The prefix tables of token counts against the library, for every prefix of odd and random texts."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from graphloom.llm import token_counts

PATH = P.path("byte_bpe_50k.json")
PIECES = [" ", " ", "  ", "\n", "\t", "\r", "'", "'s", "'re", "'ve", "'ll", "'LL", "r", "e", "ve", "ll", "word", "Hello", "é", "漢字", "½", "²", "12", "3", "!", "...", "<|endoftext|>", "<|endof", "text|>", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "😀", "\u0301", "_", "\x00"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda t: len(own.encode(t, add_special_tokens=False).ids)


def test_every_prefix(library):
    rng = np.random.default_rng(11)
    counter = token_counts.PrefixCounter(PATH)
    texts = ["".join(PIECES[k] for k in rng.integers(0, len(PIECES), rng.integers(0, 40))) for _ in range(150)]
    for text, table in zip(texts, counter.tables_of(texts), strict=True):
        assert table.tolist() == [library(text[:k]) for k in range(len(text) + 1)], text


def test_answers_are_those_of_the_table(spark, library):
    rng = np.random.default_rng(12)
    texts = ["".join(PIECES[k] for k in rng.integers(0, len(PIECES), 30)) for _ in range(40)] + [None, "", " ", "<|endoftext|>", "x" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (1, texts[1])], "doc_id long, text string")
    got = token_counts.token_counts(rows, PATH, 9).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else "no id") or ""
        table = [library(text[:k]) for k in range(len(text) + 1)]
        assert (r["n_tokens"], r["over_limit"]) == (table[-1], table[-1] > 9)
        assert r["cut_chars"] == max(k for k, n in enumerate(table) if n <= 9)
        assert r["prefix_crc32"] == zlib.crc32(np.array(table, dtype="<i4").tobytes())


def test_a_full_store_starts_anew(monkeypatch, library):
    monkeypatch.setattr(token_counts, "STORE_BYTES", 5000)
    counter = token_counts.PrefixCounter(PATH)
    for k in range(30):
        text = " ".join(f"word{k}x{j}" for j in range(40))
        assert counter.count(text) == library(text)
    assert len(counter.numbers) < 400
