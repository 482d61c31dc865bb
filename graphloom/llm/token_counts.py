"""Token counts of all prefixes of a text under a byte-level BPE, by dynamic programming.

The library's split gives words that are encoded on their own. Within a word, the encoding of a prefix is that of a
shorter prefix and one more token: of the tokens that end at a place, exactly one follows its predecessor in a way that
the merges leave apart. So one pass over a word gives the last token and the count at each of its places. The count of a
text's prefix is then that of the whole words before plus that of the last, partial word. Every distinct word's table is
kept; a text's table is joined from them, and its count, limit and cut are read from it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from graphloom.llm._arrow import RaggedStore, bounds, text_slices

#: The split of byte-level BPE; it is fixed by the vocabularies that use it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words and their tables that a worker keeps, and pairs of tokens; beyond it they start anew.
STORE_BYTES, CACHED_PAIRS = 160 << 20, 2_000_000
#: Bytes of texts, or one longer text, whose tables are joined at once.
SLICE_BYTES = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take more than their string are not supported")
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.split, self.blanks = regex.compile(SPLIT), regex.compile(r"\s+")
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.specials}
        self.longest = max(map(len, self.ids))
        size = max(self.ids.values()) + 1
        #: Of each token: the merge that made it, and its two parts; -1 for bytes.
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[i << 32 | j] = rank
            if self.made[k] < 0:
                self.made[k], self.left[k], self.right[k] = rank, i, j
        self.pairs: dict[int, bool] = {}
        # A token that its own merges don't give as one never comes out of an encoding.
        for token in [t for t in self.ids if len(t) > 1 and not self._whole(t)]:
            del self.ids[token]
        self._reset()

    def _whole(self, token: bytes) -> bool:
        k = self.ids[token]
        return self.made[k] >= 0 and self.apart(self.left[k], self.right[k], self.made[k])

    def apart(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether the merges leave the tokens a and b, as neighbours, apart (before the merge ``limit`` if given).

        It goes back in time: from whole tokens to what stood at the border before the later of the two was made.
        Of equal merges the left one goes first.
        """
        until_a = until_b = limit if limit is not None else len(self.merges) + 1
        merges, made = self.merges, self.made
        while True:
            rank = merges.get(a << 32 | b)
            if rank is not None and rank < until_a and (rank <= until_b if limit is None or until_b != limit else rank < until_b):
                return False
            if made[a] > made[b]:
                until_a, a = made[a], self.right[a]
            elif made[b] >= 0:
                until_b, b = made[b], self.left[b]
            else:
                return True

    def word(self, text: str) -> tuple[int, ...]:
        """The token counts of the prefixes of 1, 2, ... characters of one word."""
        raw = text.encode()
        last: list[int] = [-1] * (len(raw) + 1)
        count = [0] * (len(raw) + 1)
        ids, pairs, longest = self.ids, self.pairs, self.longest
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(raw[start:end])
                if token is None:
                    continue
                if start:
                    key = last[start] << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.apart(last[start], token)
                    if not fits:
                        continue
                last[end], count[end] = token, count[start] + 1
                break
        if len(raw) == len(text):
            return tuple(count[1:])
        return tuple(count[k] for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80)

    def _reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.tables = RaggedStore(np.int32)
        self.key_bytes = 0
        #: Of each kept word: whether it is a run of blanks, and whether it begins with a blank.
        self.blank, self.led = bytearray(), bytearray()

    def _number(self, words: list[str]) -> np.ndarray:
        """The numbers of words in the store; new ones get their tables."""
        numbers = self.numbers
        for w in {w for w in words if w not in numbers}:
            self._keep(w)
        return np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))

    def _keep(self, w: str) -> int:
        table = np.array(self.word(w), dtype=np.int32)
        if len(w) == 3 and w[0] == "'" and self.split.fullmatch(w) and not self.split.fullmatch(w[:2]):
            table[1] = self.word(w[0])[-1] + self.word(w[1])[-1]  # a contraction cut short is an apostrophe and a letter
        number = self.numbers[w] = len(self.numbers)
        self.tables.append(table, np.array([len(w)]))
        self.blank.append(self.blanks.fullmatch(w) is not None)
        self.led.append(self.blanks.match(w) is not None)
        self.key_bytes += 200 + 4 * len(w)
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        return number

    def tables_of(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text: the token counts of the prefixes of 0, 1, ..., all characters, each as if encoded alone."""
        if self.key_bytes + self.tables.nbytes > STORE_BYTES:
            self._reset()
        plain = [t for t in texts if not self._special(t)]
        made = iter(self._joined(plain))
        return [self._with_specials(t) if self._special(t) else next(made) for t in texts]

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        counts = []
        for text in texts:
            found = self.split.findall(text)
            words += found
            counts.append(len(found))
        if not words:
            return [np.zeros(1, np.int32) for _ in texts]
        number = self._number(words)
        table, n = self.tables.take(number)
        ends = np.cumsum(n)
        first = bounds(np.array(counts, dtype=np.int64))
        before = bounds(table[ends - 1])
        base = before[:-1] - np.repeat(before[first[:-1]], counts)
        # A prefix that ends with the last blank of a run, which the split gives to the next word, holds the run as one word.
        after_run = np.flatnonzero(np.frombuffer(bytes(self.led), dtype=np.uint8)[number[1:]] & np.frombuffer(bytes(self.blank), dtype=np.uint8)[number[:-1]]) + 1
        after_run = np.setdiff1d(after_run, first)
        runs = self._number([words[k - 1] + words[k][0] for k in after_run.tolist()])
        table = table + np.repeat(base, n)
        table[ends[after_run] - n[after_run]] = base[after_run - 1] + self.tables.flat[self.tables.edges[runs + 1] - 1]
        at = bounds(n)[first]
        zero = np.zeros(1, np.int32)
        return [np.concatenate([zero, table[a:b]], dtype=np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]

    def _with_specials(self, text: str) -> np.ndarray:
        """The table of a text with special strings: each counts as one token as a whole; within one, the prefix is ordinary
        text together with the text since the special string before."""
        out, before, plain = [np.zeros(1, np.int32)], 0, ""
        for k, piece in enumerate(self.special_split.split(text)):
            if k % 2 == 0:
                plain = piece
                out.append(before + self._joined([piece])[0][1:])
                continue
            upto = before + int(self._joined([plain])[0][-1])
            out.append(before + self._joined([plain + piece])[0][len(plain) + 1 : -1])
            out.append(np.array([upto + 1], dtype=np.int32))
            before = upto + 1
        return np.concatenate(out, dtype=np.int32)

    def count(self, text: str) -> int:
        return int(self.prefixes(text)[-1])

    def prefixes(self, text: str) -> np.ndarray:
        return self.tables_of([text])[0]


def longest_within(table: np.ndarray, budget: int) -> int:
    """The length of the longest prefix with at most ``budget`` tokens; counts may fall from a prefix to a longer one."""
    return int(np.flatnonzero(table <= budget)[-1]) if table[-1] > budget else len(table) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, tokenizer_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_chars, prefix_crc32), read from the prefix table of every whole text: the exact
    count, the length of the longest prefix within the budget, and the checksum of the table's counts as little-endian 32-bit
    integers. Null texts count as empty: 0 tokens. Each row gives a row, also repeated ones; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for ids, texts in text_slices(batches, SLICE_BYTES):
            tables = own.tables_of(texts)
            n = [int(t[-1]) for t in tables]
            columns = ([len(t.encode()) for t in texts], n, [k > budget for k in n], [longest_within(t, budget) for t in tables], [zlib.crc32(t.astype("<i4").tobytes()) for t in tables])
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_tokens", "over_limit", "cut_chars", "prefix_crc32"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long, prefix_crc32 long")
    return out.withColumnRenamed("id", id_col)


def prefix_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_tokens): the table itself, the token count of the prefixes of 0, 1, ... characters, as an array.

    The count may fall from one prefix to a longer one. Null texts have the table of the empty text, [0].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for ids, texts in text_slices(batches, SLICE_BYTES):
            tables = own.tables_of(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tables, pa.list_(pa.int32()))], names=["id", "prefix_tokens"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, prefix_tokens array<int>")
    return out.withColumnRenamed("id", id_col)
