"""Packing token sequences: linear grouping for large pieces, best fit for small ones.

Which piece goes where depends on lengths alone, and there are no more lengths than the capacity. So the driver gets the
count of each length, plans sequences as blocks (lengths in a sequence, number of such sequences), and each piece finds
its place by the rank it has among the pieces of its length. Ranks come from the counts of tasks and lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.llm._arrow import RaggedStore, bounds, give_back, hashed_words, text_slices
from graphloom.plans.scratch import written

#: Bytes of chunks' hashes and ids that a worker keeps; beyond it the store starts anew.
STORE_BYTES = 64 << 20
#: Bytes of texts, or one longer text, whose chunks are hashed at once: the arrays take some thirty times that.
SLICE_BYTES = 1 << 19
#: Numbers of groups that the planner tries.
GROUPS = (8, 32, 128, 512)


class Block(NamedTuple):
    lengths: tuple[tuple[int, int], ...]  # (length, copies) in the order in a sequence
    sequences: int


def plan(counts: dict[int, int], capacity: int, groups: int = 64, small: int | None = None) -> list[Block]:
    """Blocks that hold just the pieces that ``counts`` (length -> pieces) has, each sequence within the capacity.

    Large pieces, over ``small`` tokens, are ranked by length and cut into groups of equal cardinality; within a group all
    count as its longest. Configurations of these few sizes are taken one after the other: the largest size left, and what
    fills the sequence best beside it. The places of a configuration are given to the actual pieces, and the room that
    rounding and configurations leave goes to the small pieces, longest first, each into the fullest sequence that has room.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    small = capacity // 8 if small is None else small
    blocks = [((n, 1),) for n in counts if n == capacity]
    room: dict[int, list[Block]] = {0: [Block(b, counts[b[0][0]]) for b in blocks]}
    for lengths, k in _configured(sorted(((n, k) for n, k in counts.items() if small < n < capacity), reverse=True), capacity, groups):
        room.setdefault(capacity - sum(lengths), []).append(Block(tuple((n, 1) for n in lengths), k))
    rooms = sorted(room)
    for n in sorted((n for n in counts if n <= small), reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                size, block = capacity, Block((), left)
            else:
                size = rooms[at]
                block = room[size].pop()
                if not room[size]:
                    del room[size], rooms[at]
            copies = min(size // n, left)
            filled = min(block.sequences, left // copies)
            left -= filled * copies
            for made, rest in ((Block((*block.lengths, (n, copies)), filled), size - copies * n), (Block(block.lengths, block.sequences - filled), size)):
                if made.sequences and made.lengths:
                    if rest not in room:
                        room[rest] = []
                        insort(rooms, rest)
                    room[rest].append(made)
    return [b for size in sorted(room) for b in room[size]]


def fewest(counts: dict[int, int], capacity: int, groups: tuple[int, ...]) -> list[Block]:
    """The plan with the fewest sequences among numbers of groups and bounds of small pieces; each takes milliseconds."""
    tried = [plan(counts, capacity, g, capacity * eighths // 8) for g in groups for eighths in (1, 2, 3, 4)]
    return min(tried, key=lambda blocks: sum(b.sequences for b in blocks))


def _configured(pieces: list[tuple[int, int]], capacity: int, groups: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(actual lengths in a sequence, number of such sequences) for pieces as (length, count), the longest first."""
    total = sum(k for _, k in pieces)
    if not total:
        return
    share = -(-total // groups)
    runs: list[list[list[int]]] = [[]]
    held = 0
    for n, k in pieces:
        while k:
            if held == share:
                runs.append([])
                held = 0
            take = min(k, share - held)
            runs[-1].append([n, take])
            held += take
            k -= take
    sizes, left = [g[0][0] for g in runs], [sum(k for _, k in g) for g in runs]
    while any(left):
        first = next(g for g, k in enumerate(left) if k)
        use = _fullest(sizes, left, first, capacity)
        times = min(left[g] // k for g, k in use)
        places = [g for g, k in use for _ in range(k)]
        slots = [_taken(runs[g], times) for g in places]
        for g, k in use:
            left[g] -= k * times
        done = 0
        while done < times:  # parts within which no place changes its length
            step = min(s[0][1] for s in slots)
            yield tuple(s[0][0] for s in slots), step
            for s in slots:
                s[0][1] -= step
                if not s[0][1]:
                    s.pop(0)
            done += step


def _taken(runs: list[list[int]], n: int) -> list[list[int]]:
    """The next n pieces of a group as runs, taken away from it."""
    out = []
    while n:
        take = min(n, runs[0][1])
        out.append([runs[0][0], take])
        runs[0][1] -= take
        n -= take
        if not runs[0][1]:
            runs.pop(0)
    return out


def _fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> list[tuple[int, int]]:
    """Groups and copies with the greatest sum within the capacity that hold a piece of the group ``first``; larger sizes go first."""
    cap, mask = capacity - sizes[first], (1 << (capacity - sizes[first] + 1)) - 1
    reach, steps = 1, []
    for g in range(first, len(sizes)):
        most = min(left[g] - (g == first), cap // sizes[g])
        steps.append((g, reach, most))
        layer = reach
        for _ in range(most):
            layer = (layer << sizes[g]) & mask
            if not layer:
                break
            reach |= layer
    at, use = reach.bit_length() - 1, {first: 1}
    for g, before, most in reversed(steps):
        k = next(k for k in range(most + 1) if at >= k * sizes[g] and before >> (at - k * sizes[g]) & 1)
        if k:
            use[g] = use.get(g, 0) + k
            at -= k * sizes[g]
    return sorted(use.items())


def segments(blocks: list[Block]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by ranges of their ranks: sorted by length and first rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in blocks:
        offset = 0
        for length, copies in lengths:
            start = rank.get(length, 0)
            rows.append((length, start, copies, sequence, offset))
            rank[length] = start + n * copies
            offset += length * copies
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T.copy(), strict=True))


#: The only split that is taken: words are runs of letters, single digits, runs of signs, and contractions; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _lowers(spec: dict) -> bool:
    """Whether a tokenizer file's normaliser makes letters small; ValueError if its words might reach over blanks."""
    steps = lambda part: [] if part is None else [y for x in part.get("normalizers", part.get("pretokenizers", [])) for y in steps(x)] if part["type"] == "Sequence" else [part]
    splits, made = steps(spec["pre_tokenizer"]), steps(spec["normalizer"])
    fits = [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": SPLIT} and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
    fits = fits and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
    fits = fits and all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and (x["pattern"], x["content"]) == ({"Regex": r"\s+"}, " ")) for x in made)
    if not fits or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("only tokenizers that drop blanks and split words at signs are supported")
    return any(x["type"] == "Lowercase" for x in made)


class _Tokens:
    """Ids of texts, by the chunks between blanks: the tokenizer's words never reach over a blank, and others are refused."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            #: Whether A-Z are as a-z to the tokenizer.
            self.lower = _lowers(json.load(f))
        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.mark = next(iter(self.special), None)
        self.mark_id = self.own.token_to_id(self.mark) if self.mark else -1
        self._reset()

    def _reset(self) -> None:
        #: The hashes of the chunks met so far, sorted, and under which number each one's ids are.
        self.hashes, self.number, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), RaggedStore(np.int32)

    def _spell(self, chunks: list[str]) -> None:
        parts = self._encoded(chunks)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.ids.append(np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(sizes.sum())), sizes)

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        parts: list[list[int]] = []
        for at in range(0, len(chunks), 500):
            some = chunks[at : at + 500]
            joined = self.mark.join(some) if self.mark else None
            if joined is not None and joined.count(self.mark) == len(some) - 1 and not any(s in joined for s in self.special[1:]):
                ids = np.array(self.own.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
                cut = np.flatnonzero(ids == self.mark_id)
                if len(cut) == len(some) - 1:
                    flat, edges = ids.tolist(), [-1, *cut.tolist(), len(ids)]
                    parts += [flat[a + 1 : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    continue
            parts += [e.ids for e in self.own.encode_batch_fast(some, add_special_tokens=False)]
        return parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Chunks are told apart by 64-bit hashes.

        Unless a special string may be there, A-Z count as a-z if they do to the tokenizer, and signs after a letter are chunks of their own, as they are to the tokenizer.
        """
        if 16 * len(self.hashes) + self.ids.nbytes > STORE_BYTES:
            self._reset()
        plain = not any(s[:2] in t for s in self.special for t in texts)
        found = hashed_words(texts, fold=plain and self.lower, apart=plain)
        unique, at, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), dtype=bool)
        known[place < len(self.hashes)] = self.hashes[place[place < len(self.hashes)]] == unique[place < len(self.hashes)]
        if not known.all():
            raw, places, before = found.raw, at[~known], self.ids.n
            self._spell([raw[a:b].decode() for a, b in zip(found.start[places].tolist(), found.end[places].tolist(), strict=True)])
            self.hashes = np.insert(self.hashes, place[~known], unique[~known])
            self.number = np.insert(self.number, place[~known], np.arange(before, self.ids.n))
        number = self.number[np.searchsorted(self.hashes, unique)]
        flat, n = self.ids.take(number[inverse])
        cut = bounds(n)[found.cut]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def tokens(path: str) -> _Tokens:
    return _Tokens(path)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth[, ids]): the pieces of each document's ids and the end id.

    Documents longer than the capacity are cut into pieces of it, the last may be shorter. A null or empty text is the end
    id alone. ``nth`` counts the pieces of a length within the task that made them. Repeated rows and rows without an id make
    pieces of their own; an empty table makes none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = tokens(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for ids, texts in text_slices(batches, SLICE_BYTES):
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for i, found in zip(ids, own.encode(texts), strict=True):
                packed = np.r_[found, end_id].astype("<u4")
                for k, start in enumerate(range(0, len(packed), capacity)):
                    part = packed[start : start + capacity]
                    for column, value in zip(rows, (i, k, start, len(part), zlib.crc32(part.tobytes()), int(seen[len(part)]), part.tobytes()), strict=True):
                        column.append(value)
                    seen[len(part)] += 1
            made = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)]
            made.insert(5, pa.array([task] * len(rows[0]), pa.int64()))
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
            yield pa.RecordBatch.from_arrays(made if with_ids else made[:-1], names=names if with_ids else names[:-1])
        give_back()

    schema = "id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids binary" * with_ids
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack(made: DataFrame, capacity: int, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """The written ``pieces`` with sequence_id and offset: the plan's place for each piece.

    The driver gets a row for each length, ``capacity`` at most; the plan's ranges, which each executor gets, are bounded
    by the lengths and groups too. Equal lengths are told apart by rank: by task, then by place in it. No pieces, no rows.
    """
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = segments(fewest(counts, capacity, groups))
    shared = made.sparkSession.sparkContext.broadcast(table | {"key": (table["length"] << 40) | table["rank"]})
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    names = [f.name for f in made.schema.fields if f.name not in ("task", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(k).to_numpy() for k in (batch.num_columns - 2, batch.num_columns - 1))
            at = np.searchsorted(plan_of["key"], length << 40 | rank, side="right") - 1
            k, copies = rank - plan_of["rank"][at], plan_of["copies"][at]
            sequence, offset = plan_of["sequence"][at] + k // copies, plan_of["offset"][at] + k % copies * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(names))), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields if f.name in names) + ", sequence_id long, offset long"
    ranked = made.join(before, ["task", "length"]).select(*names, F.col("length").alias("__length"), (F.col("before") + F.col("nth")).alias("__rank"))
    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, groups: tuple[int, ...] = GROUPS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces and their places. The pieces are written first, as ranks must not change when a task is run again."""
    return pack(written(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity, groups)
