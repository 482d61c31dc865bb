"""N-gram Jaccard join over a prefix tree, and the components of its links.

1. Each text's set of word shingles gets a digest; texts of equal sets are one class from here on.
2. A set can only link if enough of its shingles occur in a second set. Shingles are told apart by ranges of their hashes:
   each slice of texts sends its distinct shingles to a bounded number of ranges, packed; where that many are too few,
   the texts are read in several passes, each over its part of the hashes, so that only one part lies on disk at a time;
   where passes are too few as well, ranges are split again in further rounds. A shingle that is met twice is counted for
   its sets and goes on as one, so a very common one stays small. Only counts come back, for sets that share anything. What remains is a small part.
3. Shingles have one global order: by how common they are, in powers of two, then by hash. Linked sets share a shingle among
   the rarest size - ceil(0.75 size) + 1. Of the few sets that share a rare one of these, two are joined only if as many
   are shared as a link needs; those of a more common one are joined to the least set that has it. So all links lie within
   the components of this graph, and chance shingles, which grow with the square of the table, don't tie them together.
4. A component goes to one task, as ordered sets in a tree: common shingles first, paths shared. Each set walks down the
   tree with the overlap so far; a subtree is left when the lengths that remain can't reach the overlap asked for, or
   when all its sets already belong to the walker's component.
5. Components above a bounded size are dealt out, with some sets in all parts; afterwards, in each block of a shingle that
   still holds several components, all but the largest of them meet those sets of the block whose sizes allow a link, in
   bounded runs; of rare shingles, the joined pairs that are still apart meet, once each. So every link lies in some task,
   whatever the group's size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm._arrow import bounds, give_back, text_slices
from graphloom.llm._joins import join_common
from graphloom.plans.scratch import drop_written, written
from graphloom.plans.sizes import BROADCAST_ROWS, broadcast_if_small

WORDS, PERCENT = 5, 75
#: Shingles in a counting range, about; sets and shingles that one task joins in a tree.
BUCKET_TOKENS, UNIT_SETS, UNIT_TOKENS = 1_000_000, 2_000, 4_000_000
#: Bits of the hash by which a round splits ranges; shingles that a task holds to split them.
ROUND_BITS, HELD_TOKENS = 9, 1_000_000
#: Bits of the hash that passes over the texts tell apart, at most.
PASS_BITS = 2
#: Shingles of sets that may link which a pass puts in order, about, and the bits by which such passes part the hashes, at most.
PASS_ENTRIES, ORDER_BITS = 16_000_000, 3
#: Sets whose counts are summed in one group; each may have an entry for each of its shingles.
SETS_A_RANGE = 20_000
#: The places of a token's power of two in its key of the global order.
ORDER_SHIFT = 58
#: Characters of texts whose words are hashed at once.
ARRAY_CHARS = 1_000_000
#: Shingles, or sets of mixed blocks, of small units that share a task, about.
BIN_TOKENS, BIN_SETS = 200_000, 400
#: Sets that share a rare shingle, at most; they are compared as pairs, (PAIR_MEMBERS - 1) / 2 for each of a set's rarest shingles at most.
PAIR_MEMBERS = 16
#: Edges that a task of the components takes.
ROWS_A_TASK = 250_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles: A-Z in lower case, words between blanks.

    A text with fewer words has its whole sequence as one shingle, a text without words none. About a megabyte of texts,
    or one longer text, is worked on at a time: its arrays take some fifty times that.
    """
    out: list[np.ndarray] = []
    start = held = 0
    for k, text in enumerate(texts):
        if k > start and held + len(text) > ARRAY_CHARS:
            out += _shingle_sets(texts[start:k], words)
            start, held = k, 0
        held += len(text)
    return out + _shingle_sets(texts[start:], words)


def _shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    at = bounds(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    flat = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    kept = np.flatnonzero(~blank)
    low = flat[kept].astype(np.uint64)
    low += np.uint64(32) * ((low >= 65) & (low <= 90))
    size = end - start
    place = (np.arange(len(kept)) - np.repeat(bounds(size)[:-1], size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        of_word = _mix(np.add.reduceat(_mix(place * np.uint64(256) + low + np.uint64(0x9E3779B97F4A7C15)), bounds(size)[:-1]) + size.astype(np.uint64))
        factors = _mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        n = len(of_word)
        runs = np.zeros(max(n - words + 1, 0), dtype=np.uint64)
        for k in range(words):
            runs += of_word[k : k + len(runs)] * factors[k]
        runs = _mix(runs)
        doc = np.searchsorted(start, at)  # words before each text
        out = []
        for a, b in zip(doc[:-1].tolist(), doc[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(runs[a : b - words + 1]))
            elif b > a:
                out.append(_mix((of_word[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    """64 bits of a digest, by which shared shingles are counted."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, set_id, key) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            sets = shingle_sets(texts, words)
            digests = [_digest(s) for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([_key(d) for d in digests], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "set_id", "key"])
        give_back()

    return docs.mapInArrow(run, "id long, n long, set_id binary, key long")


def _met(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and the numbers of the sets that have them -> how many tokens of each set are met twice; (tokens, owner) that go
    on: each token once, without an owner (0) if its owners are counted."""
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    same = tokens[1:] == tokens[:-1]
    again = np.concatenate([[False], same])[: len(tokens)]
    twice = again | np.concatenate([same, [False]])[: len(tokens)]
    return np.bincount(owner[twice]), tokens[~again], np.where(twice, 0, owner)[~again]


_PACKED = "range long, tokens binary, owners binary, counts binary, told boolean"


def _rows(tokens: np.ndarray, owner: np.ndarray, keys: np.ndarray, bits: int, narrow: bool) -> list[tuple]:
    """Rows (range, tokens, owners, counts, told): the tokens that go on, by their first bits, then by owner, and what is
    counted, which goes along to some range. owner: places in keys, of which the first is no set."""
    if not len(tokens):
        return []
    told, tokens, owner = _met(tokens, owner)
    place = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(place << 32 | owner)
    tokens, owner, place = tokens[order], owner[order], place[order]
    if narrow:  # the range and 32 more bits tell the token
        tokens = (tokens >> np.uint64(32 - bits)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])[: len(place)])
    own, n = keys[owner[first]], np.diff(np.append(first, len(place))).astype(np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    ends, at = np.append(cut[1:], len(place)).tolist(), np.append(np.searchsorted(first, cut), len(first)).tolist()
    out = [(int(place[a]), tokens[a:b].tobytes(), own[at[k] : at[k + 1]].tobytes(), n[at[k] : at[k + 1]].tobytes(), False) for k, (a, b) in enumerate(zip(cut.tolist(), ends, strict=True))]
    told[:1] = 0
    sets = np.flatnonzero(told)
    if len(sets):
        out.append((int(keys[sets[0]]) & ((1 << bits) - 1), b"", keys[sets].tobytes(), told[sets].astype(np.uint32).tobytes(), True))
    return out


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kind = {"range": pa.int64(), "told": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind.get(n, pa.binary())) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


def _unpacked(tokens: list[bytes], owners: list[bytes], counts: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the place of each one's set in keys, keys)."""
    keys, place = np.unique(np.frombuffer(b"".join([bytes(8), *owners]), dtype=np.int64), return_inverse=True)
    if keys[0] != 0:  # no set comes first
        none = int(np.flatnonzero(keys == 0)[0])
        keys = np.concatenate([keys[none : none + 1], keys[:none], keys[none + 1 :]])
        place = np.where(place == none, 0, np.where(place < none, place + 1, place))
    return np.frombuffer(b"".join(tokens), dtype=kind), np.repeat(place[1:], np.frombuffer(b"".join(counts), dtype=np.uint32)), keys


def _split(rows: DataFrame, out: Callable[[list[tuple]], list[tuple]], held: int, through: bool) -> DataFrame:
    """The packed rows of each range, joined as far as ``held`` entries, and what ``out`` makes of them.

    The ranges of ``rows`` are dealt out in parts of about 64 MB. through: rows that are told go on as they are.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, size = None, [], 0
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if through and row[-1]:
                    made.append(row)
                    continue
                if waiting and (row[0] != now or size >= held):
                    made += out(waiting)
                    waiting, size = [], 0
                now, size = row[0], size + len(row[1]) // 8
                waiting.append(row)
            if made:
                yield _batch(made, names)
        if waiting and (made := out(waiting)):
            yield _batch(made, names)

    return rows.sortWithinPartitions("range").mapInArrow(run, rows.schema)


def _rounds(bits: int, round_bits: int) -> list[int]:
    """How many bits tell a range after each round."""
    n = -(-bits // round_bits)
    return [bits * (k + 1) // n for k in range(n)]


def _bits(n: int, each: int) -> int:
    """How many bits tell apart ranges of about ``each`` of ``n``; 1 at least."""
    return max(1, math.ceil(math.log2(max(2, -(-n // each)))))


def _pass_bits(total: int, bucket_tokens: int, round_bits: int) -> int:
    """The bits by which passes part the hashes: those that one round has not, as far as PASS_BITS."""
    return min(max(0, _bits(total, bucket_tokens) - round_bits), PASS_BITS)


def _ranges(docs: DataFrame, words: int, total: int, bucket_tokens: int, round_bits: int, held: int = HELD_TOKENS, slice_bytes: int = 2 << 20, part: tuple[int, int] = (0, 0)) -> tuple[list[DataFrame], bool]:
    """Each round's rows of packed shingles by range, and whether the last ones are narrow.

    part: (bits, number) of the pass; only shingles whose hashes begin with it are taken, without these bits. total: of the pass.

    A slice makes one row a range, 2^round_bits at most, in each round, and rows are joined before they are split again: so
    bytes and rows stay in proportion to the texts, at a few dozen bytes a shingle and round.
    """
    upto = _rounds(_bits(total, bucket_tokens), round_bits)
    narrow = len(upto) == 1 and upto[0] <= 32

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, slice_bytes):
            sets = {_digest(s): s for s in shingle_sets(texts, words) if len(s)}
            if sets:
                keys = np.array([0, *map(_key, sets)], dtype=np.int64)
                tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(1, len(keys)), [len(s) for s in sets.values()])
                if part[0]:
                    taken = tokens >> np.uint64(64 - part[0]) == part[1]
                    tokens, owner = tokens[taken] << np.uint64(part[0]), owner[taken]
                if len(tokens):
                    yield _batch(_rows(tokens, owner, keys, upto[0], narrow), ["range", "tokens", "owners", "counts", "told"])
        give_back()

    made = [docs.mapInArrow(first, _PACKED)]
    for k in range(1, len(upto)):
        dealt = made[-1].repartition("range", F.pmod(F.xxhash64("tokens"), F.lit(max(1, (total * 20 >> upto[k - 1]) >> 26))))
        joined = lambda rows, bits=upto[k]: _rows(*_unpacked(*list(zip(*rows, strict=True))[1:4], np.uint64), bits, False)
        made.append(_split(dealt, joined, held, True))
    return made, narrow


def _by_set(sets: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    """Rows (range, owners, counts): the sums of each set, by the first bits of its key."""
    if not len(sets):
        return []
    sets, place = np.unique(sets.view(np.uint64), return_inverse=True)
    counts, part = np.bincount(place, counts, len(sets)).astype(np.uint32), (sets >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    return [(int(part[a]), sets[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cut.tolist(), np.append(cut[1:], len(part)).tolist(), strict=True)]


def _shared(docs: DataFrame, words: int, total: int, n_sets: int, bucket_tokens: int = BUCKET_TOKENS, round_bits: int = ROUND_BITS, sets_a_range: int = SETS_A_RANGE, **bounds_of_slices: int) -> DataFrame:
    """(key, shared): how many shingles of a set occur in a second set, as far as the bits sent tell; sets that share none have no row.

    Of several passes, each is written before the next one begins.
    """
    bits = _pass_bits(total, bucket_tokens, round_bits)
    passes = [_shared_of_part(docs, words, -(-total >> bits), n_sets, bucket_tokens, round_bits, sets_a_range, (bits, k), **bounds_of_slices) for k in range(1 << bits)]
    if not bits:
        return passes[0]
    return reduce(DataFrame.unionByName, [written(x, "shared") for x in passes]).groupBy("key").agg(F.sum("shared").alias("shared"))


def _shared_of_part(docs: DataFrame, words: int, total: int, n_sets: int, bucket_tokens: int, round_bits: int, sets_a_range: int, part: tuple[int, int], **bounds_of_slices: int) -> DataFrame:
    """(key, shared) as far as the shingles of the pass go.

    The counts of a range come back packed by ranges of sets, which are split in rounds and summed likewise.
    """
    made, narrow = _ranges(docs, words, total, bucket_tokens, round_bits, **bounds_of_slices, part=part)
    upto = _rounds(_bits(n_sets, sets_a_range), round_bits)
    packed = lambda owners, counts: (np.frombuffer(b"".join(owners), dtype=np.int64), np.frombuffer(b"".join(counts), dtype=np.uint32))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        told, rest = rows[rows["told"]], rows[~rows["told"]]
        tokens, owner, keys = _unpacked(list(rest["tokens"]), list(rest["owners"]), list(rest["counts"]), np.uint32 if narrow else np.uint64)
        found = _met(tokens, owner)[0]
        found[:1] = 0
        sets, counts = packed(told["owners"], told["counts"])
        some = np.flatnonzero(found)
        del rest, tokens, owner
        give_back()
        return pd.DataFrame(_by_set(np.concatenate([sets, keys[some]]), np.concatenate([counts, found[some]]), upto[0]), columns=["range", "owners", "counts"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        sets, place = np.unique((both := packed(rows["owners"], rows["counts"]))[0], return_inverse=True)
        return pd.DataFrame({"key": sets, "shared": np.bincount(place, both[1], len(sets)).astype(np.int64)})

    sums = made[-1].groupBy("range").applyInPandas(count, "range long, owners binary, counts binary")
    for k in range(1, len(upto)):
        dealt = sums.repartition("range", F.pmod(F.xxhash64("owners"), F.lit(max(1, (total * 12 >> upto[k - 1]) >> 26))))
        sums = _split(dealt, lambda rows, bits=upto[k]: _by_set(*packed(*list(zip(*rows, strict=True))[1:]), bits), bounds_of_slices.get("held", HELD_TOKENS), False)
    return sums.groupBy("range").applyInPandas(summed, "key long, shared long")


def _token_sets(docs: DataFrame, words: int) -> DataFrame:
    """(set_id, n, tokens): the packed sets of every row with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            sets = [s for s in shingle_sets(texts, words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "n", "tokens"])
        give_back()

    return docs.mapInArrow(run, "set_id binary, n long, tokens binary")


def _entries(sets: DataFrame, part: tuple[int, int] = (0, 0)) -> DataFrame:
    """(token, node) for each shingle of each set; part: (bits, number) of the pass, whose shingles' hashes begin with it."""
    bits, number = part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = [np.frombuffer(x, dtype=np.int64) for x in part.column(1).to_pylist()]
                nodes, tokens = np.repeat(part.column(0).to_numpy(), [len(t) for t in tokens]), np.concatenate(tokens)
                if bits:
                    taken = tokens.view(np.uint64) >> np.uint64(64 - bits) == number
                    tokens, nodes = tokens[taken], nodes[taken]
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(nodes)], names=["token", "node"])

    return sets.select("node", "tokens").mapInArrow(run, "token long, node long")


def least_of_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that are not the least of their component of the edges (u, v)."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label[label], label):
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges with each task's components, of a bounded number of its edges at a time, made stars around their least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros((2, 0), np.int64)
        for batch in batches:
            u, v = np.r_[u, batch.column(0).to_numpy()], np.r_[v, batch.column(1).to_numpy()]
            if len(u) >= ROWS_A_TASK:
                u, v = least_of_components(u, v)
                if 2 * len(u) >= ROWS_A_TASK:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    u, v = np.zeros((2, 0), np.int64)
        u, v = least_of_components(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component of the edges (u, v), by alternating large and small stars.

    Each task first contracts its own edges; when all that remain are disjoint stars, they are the components. Otherwise,
    in each round every node is tied to the least of its neighbours; a node of many neighbours is met by combined minima
    and a join, never as a list. Each round is written, which keeps the plan short.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = edges.count()
    tasks, small = max(1, -(-n // ROWS_A_TASK)), n <= BROADCAST_ROWS

    def star(pairs: DataFrame) -> DataFrame:
        return written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(tasks), "star")

    def tied(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(least) if small else least, "u")

    def settled(pairs: DataFrame) -> bool:
        ends = pairs.groupBy("u").agg(F.count("*").alias("n")).unionByName(pairs.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1)))
        return ends.coalesce(tasks).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()

    now = written(_contracted(edges.coalesce(tasks)).coalesce(tasks), "star")
    for _ in range(max_rounds):
        if settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = star(tied(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        near = tied(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = star(near)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Tree:
    """A radix tree of ordered sets: nodes hold runs of shingles, their subtrees ranges of the sorted sets."""

    def __init__(self, sets: list[np.ndarray], size: np.ndarray) -> None:
        """``sets``: the shingles that other sets have, too, as small numbers, each set in the order of the tree and sorted as
        sequences; ``size``: the sizes of the whole sets."""
        self.sets, self.size, self.length = sets, size, [len(s) for s in sets]
        #: (run, first set, last set + 1, depth before the run, least size, largest size, children)
        self.roots = self._build(0, len(sets), 0)

    def _build(self, low: int, high: int, depth: int) -> list[tuple]:
        stack_out: list[tuple] = []
        work = [(low, high, depth, stack_out)]
        while work:
            a, b, d, out = work.pop()
            while a < b and self.length[a] == d:  # sets that end here are leaves without a run
                out.append((np.zeros(0, np.int64), a, a + 1, d, int(self.size[a]), int(self.size[a]), []))
                a += 1
            while a < b:
                first, e = self.sets[a][d], a + 1
                while e < b and self.sets[e][d] == first:
                    e += 1
                left, right = self.sets[a], self.sets[e - 1]  # what first and last share, all between them share
                n = min(len(left), len(right))
                differ = np.flatnonzero(left[d:n] != right[d:n])
                stop = d + int(differ[0]) if len(differ) else n
                children: list[tuple] = []
                out.append((left[d:stop], a, e, d, int(self.size[a:e].min()), int(self.size[a:e].max()), children))
                if e - a > 1 or self.length[a] > stop:
                    work.append((a, e, stop, children))
                a = e
        return stack_out

    def components(self, percent: int, n_tokens: int, known: np.ndarray, walks: np.ndarray) -> np.ndarray:
        """The least place of each set's component under the links of the sets of which at least one walks.

        known: the least place of each set's component so far.
        """
        label, has = known.copy(), np.zeros(n_tokens, dtype=bool)
        changes = np.cumsum(np.r_[0, label[1:] != label[:-1]])
        walkers = bounds(walks.astype(np.int64)).tolist()
        for x in np.flatnonzero(walks).tolist():
            own = self.sets[x]
            has[own] = True
            size, length, found = int(self.size[x]), len(own), []
            # An overlap is enough if (100 + percent) overlap >= percent (size + other size).
            work = [(node, 0, 0) for node in self.roots]
            while work:
                (run, a, b, depth, least, most, children), overlap, gone = work.pop()
                if 100 * most < percent * size or percent * least > 100 * size:
                    continue  # too short or too long
                if b <= x and walkers[b] - walkers[a] == b - a:
                    continue  # they have all walked before
                if changes[b - 1] == changes[a] and label[a] == label[x]:
                    continue
                if len(run):
                    overlap += int(has[run].sum())
                    gone = int(np.searchsorted(own, run[-1], side="right"))
                passed = depth + len(run)
                if not children:
                    if (100 + percent) * overlap >= percent * (size + least):
                        found.append(a)
                    continue
                # At best, what remains of the walker is all shared, and the other side has no more than that left.
                other = min(max(passed + length - gone, least), most)
                if (100 + percent) * (overlap + min(length - gone, other - passed)) >= percent * (size + other):
                    work.extend((c, overlap, gone) for c in children)
            has[own] = False
            linked = {int(label[y]) for y in found} | {int(label[x])}
            if len(linked) > 1:
                label[np.isin(label, list(linked))] = min(linked)
                changes = np.cumsum(np.r_[0, label[1:] != label[:-1]])
        return label


def _join_unit(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(u, v): the least set of each known part in the unit and the least set of its component, if it is not itself."""
    nodes, part, walks, size = (rows[c].to_numpy() for c in ("node", "part", "walks", "n"))
    sets = list(rows["keys"])
    keys, place = np.unique(np.concatenate(sets), return_inverse=True)
    ordered = np.split(place, np.cumsum([len(s) for s in sets])[:-1])
    rank = sorted(range(len(ordered)), key=lambda k: (ordered[k].astype(">i8").tobytes(), nodes[k]))
    _, first, place_of = np.unique(part[rank], return_index=True, return_inverse=True)
    known = first[place_of]
    label = Tree([ordered[k] for k in rank], size[rank]).components(percent, len(keys), known, walks[rank])
    members = nodes[rank]
    own, least = np.full((2, len(members)), np.iinfo(np.int64).max)
    np.minimum.at(own, known, members)
    np.minimum.at(least, label, members)
    own, root = own[first], least[label[first]]
    return pd.DataFrame({"u": own[root != own], "v": root[root != own]})


def _joined(units: DataFrame, sets: DataFrame, percent: int, bins: int, unit_sets: int) -> DataFrame:
    """Links (u, v) that tie the parts in units (unit, node, part, walks) bounded in size.

    part: what is known to be one component; walks: whether a set walks down the tree, as one of each pair must. Small units
    share a task by a hash; one of over an eighth of the bound is dealt on its own.
    """

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        links = pd.concat([_join_unit(x, percent) for _, x in rows.groupby("unit")])
        give_back()
        return links

    large = units.groupBy("unit").agg(F.count("*").alias("members")).where(F.col("members") > unit_sets // 8).select("unit", F.lit(True).alias("alone"))
    dealt = units.join(broadcast_if_small(written(large, "large-units")), "unit", "left")
    dealt = dealt.withColumn("bin", F.when(F.col("alone"), F.xxhash64("unit")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(bins)))).drop("alone")
    rows = dealt.join(sets, "node")
    return written(rows.groupBy("bin").applyInPandas(join, "u long, v long"), "links")


def _keys(sets: DataFrame, part: tuple[int, int] = (0, 0)) -> tuple[DataFrame, DataFrame]:
    """(node, keys) of each set with shingles of the pass that a second set has, and the written table of these shingles."""
    entries = _entries(sets, part)
    common = written(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "common")
    power = F.least(F.floor(F.log2("df")).cast("long"), F.lit(31))
    shared = join_common(entries, common, "token", "df").select("node", F.shiftleft(31 - power, ORDER_SHIFT).bitwiseOR(F.shiftrightunsigned("token", 64 - ORDER_SHIFT)).alias("key"))
    return shared.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys")), common


def _ordered(sets: DataFrame, named: DataFrame) -> DataFrame:
    """(node, n, keys): of each set the keys of the shingles that a second set has, ascending: common ones first.

    A key holds the power of two of the shingle's number of sets, and 58 bits of its hash. Many shingles are ordered in
    passes over parts of their hashes, so that rows of one shingle each lie on disk for one part at a time. ``sets``, a
    written table, is removed as soon as all have keys; ``named`` has (node, n) of its rows.
    """
    total = named.agg(F.sum("n")).first()[0] or 0
    bits = min(max(0, math.ceil(math.log2(max(1, total / PASS_ENTRIES)))), ORDER_BITS)
    parts = []
    for k in range(1 << bits):
        per_set, common = _keys(sets, (bits, k))
        if not bits:
            break
        parts.append(written(per_set, "keys"))
        drop_written(common)
    else:
        drop_written(sets)
        per_set = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("keys"))).alias("keys"))
    out = written(named.select("node", "n").join(per_set, "node"), "ordered")
    for table in parts or [sets, common]:
        drop_written(table)
    return out


def _size_class(n: Column, percent: int) -> Column:
    """Sets link only if their sizes are of the same class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else n.cast("int")


def _pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs of sets that may link by the number of rare shingles (node, n, token) they share.

    All that linked sets share beyond their prefixes lies in the rest of the one whose prefix ends first. So what they share
    within the prefixes and the larger rest must reach the overlap asked for. What a pair shares of shingles that aren't
    rare isn't counted here: such a pair meets by those.
    """
    one = prefix.select("token", F.col("node").alias("u"), F.col("n").alias("n"))
    two = prefix.select("token", F.col("node").alias("v"), F.col("n").alias("m"))
    both = one.join(two, "token").where((F.col("u") < F.col("v")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    shared = both.groupBy("u", "v", "n", "m").agg(F.count("*").alias("shared"))
    rest = F.ceil(F.greatest("n", "m") * percent / F.lit(100)) - 1
    return shared.where((100 + percent) * (F.col("shared") + rest) >= percent * (F.col("n") + F.col("m"))).select("u", "v")


def _links(sets: DataFrame, percent: int, unit_sets: int, unit_tokens: int) -> DataFrame:
    """(u, v): edges whose components are those of all links between the ordered sets (node, n, keys)."""
    # Of a set's rarest shingles, those that only it has come first and need no entry.
    length = F.greatest(F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - (F.col("n") - F.size("keys")), F.lit(0)).cast("int")
    prefix = sets.select("node", "n", F.explode(F.slice("keys", F.size("keys") - length + 1, length)).alias("token"))
    prefix = written(prefix, "prefixes")
    least = prefix.groupBy("token").agg(F.min("node").alias("first"), F.count("*").alias("members"))
    least = written(least.where("members > 1"), "least")
    prefix = written(join_common(prefix, least, "token", "members"), "shared-prefixes")
    pairs = written(_pairs(prefix.where(F.col("members") <= PAIR_MEMBERS), percent), "pairs")
    prefix = prefix.where(F.col("members") > PAIR_MEMBERS)
    group = written(components(pairs.unionByName(prefix.select(F.col("node").alias("u"), F.col("first").alias("v")))), "candidates")
    sized = group.join(sets.select("node", F.size("keys").alias("held")), "node")
    total = sized.groupBy("root").agg(F.count("*").alias("members"), F.sum("held").alias("held")).where("members > 1")
    parts = F.greatest(F.ceil(F.col("members") / unit_sets), F.ceil(F.col("held") / unit_tokens)).cast("int")
    total = written(total.select("root", "members", parts.alias("parts")), "candidate-sizes")
    bins = max(4 * sets.sparkSession.sparkContext.defaultParallelism, -(-(sets.agg(F.sum(F.size("keys"))).first()[0] or 0) // BIN_TOKENS))
    # Large groups are dealt out by hash; the sets of the least hashes are in each part, so that copies in different parts meet.
    keyed = join_common(group, total, "root", "members").withColumn("h", F.xxhash64("node"))
    in_part = keyed.where("parts = 1").select(F.col("root").cast("string").alias("unit"), "node")
    large = keyed.where("parts > 1")
    name = lambda part: F.concat_ws("-", F.col("root").cast("string"), part.cast("string"))
    dealt = large.select(name(F.pmod("h", F.col("parts"))).alias("unit"), "node")
    order = Window.partitionBy("root", F.pmod("h", F.lit(64))).orderBy("h", "node")
    anchors = large.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("root", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    anchors = anchors.select(name(F.col("part")).alias("unit"), "node")
    units = written(in_part.unionByName(dealt).unionByName(anchors).distinct(), "units")
    links = _joined(units.withColumn("part", F.col("node")).withColumn("walks", F.lit(True)), sets, percent, bins, unit_sets)
    if total.where("parts > 1").isEmpty():
        return links
    # What a large group still leaves apart: pairs, and blocks of one common shingle that hold several components so far.
    # Within a block, all that is not of its largest component meets what of the block has a fitting size, in bounded runs;
    # the largest component is one already and doesn't walk.
    so_far = written(components(links), "so-far").select("node", F.col("root").alias("part"))
    parted = written(large.select("node").join(so_far, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts-so-far")
    part_of = lambda end: parted.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}"))
    apart = pairs.join(part_of("u"), "u").join(part_of("v"), "v").where("part_u <> part_v").withColumn("unit", F.concat_ws("-", F.lit("p"), "u", "v"))
    ends = (apart.select("unit", F.col(end).alias("node"), F.col(f"part_{end}").alias("part"), F.lit(True).alias("walks")) for end in ("u", "v"))
    rows = prefix.join(parted, "node")
    rows = written(rows.select("token", "node", "part", _size_class(F.col("n"), percent).alias("c")), "large-prefixes")
    counts = rows.groupBy("token", "part").agg(F.count("*").alias("members")).groupBy("token").agg(F.max(F.struct("members", "part")).alias("m"), F.sum("members").alias("members"))
    main = written(counts.where(F.col("m.members") < F.col("members")).select("token", F.col("m.part").alias("main"), "members"), "mixed-blocks")
    rows = written(join_common(rows, main, "token", "members").select("token", "node", "part", "c", (F.col("part") == F.col("main")).alias("of_main"), F.xxhash64("node").alias("h")), "mixed")
    # How many runs each block has of each size class, of its largest component and of the rest.
    runs = rows.groupBy("token", "c").agg(F.sum(F.col("of_main").cast("long")).alias("m"), F.sum((~F.col("of_main")).cast("long")).alias("r"), F.count("*").alias("members"))
    n_runs = lambda n: F.ceil(F.col(n) / (unit_sets // 2)).cast("int")
    runs = written(runs.select(F.struct("token", "c").alias("block"), n_runs("m").alias("m"), n_runs("r").alias("r"), "members"), "runs")
    near = rows.select("*", F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1)))).alias("d")).withColumn("block", F.struct("token", F.col("c").alias("c")))
    own = join_common(near, runs, "block", "members").withColumnsRenamed({"m": "own_m", "r": "own_r"}).drop("members")
    both = join_common(own.withColumn("block", F.struct("token", (F.col("c") + F.col("d")).alias("c"))), runs, "block", "members")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit = lambda kind, *of: F.concat_ws("-", F.lit(kind), F.col("token").cast("string"), *(x.cast("string") for x in of)).alias("unit")
    c, d, run, other = F.col("c"), F.col("d"), F.col("run"), F.col("other")
    rest, most = both.where("not of_main").withColumn("run", F.pmod("h", F.col("own_r"))), both.where("of_main").withColumn("run", F.pmod("h", F.col("own_m")))
    with_main = rest.where("m > 0").withColumn("other", upto("m")).select(unit("m", c, c + d, run, other), "node", "part", F.lit(True).alias("walks"))
    of_main = most.where("r > 0").withColumn("other", upto("r")).select(unit("m", c + d, c, other, run), "node", "part", F.lit(False).alias("walks"))
    # The rest among itself: runs of one class, each pair once, and those of a class with those of the next.
    among = rest.where("r > 0").withColumn("other", upto("r"))
    lower = F.when(d == 0, F.least(run, other)).when(d > 0, run).otherwise(other)
    upper = F.when(d == 0, F.greatest(run, other)).when(d > 0, other).otherwise(run)
    among = among.select(unit("r", F.least(c, c + d), F.abs(d), lower, upper), "node", "part", F.lit(True).alias("walks"))
    units = written(reduce(DataFrame.unionByName, [of_main, among, *ends], with_main).distinct(), "blocks")
    return links.unionByName(_joined(units, sets, percent, max(bins, units.count() // BIN_SETS), unit_sets))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, unit_sets: int = UNIT_SETS, unit_tokens: int = UNIT_TOKENS, bucket_tokens: int = BUCKET_TOKENS, round_bits: int = ROUND_BITS) -> DataFrame:
    """(id, n_shingles, component_id, class_id): for every row, its set's size and the least id that links reach from it.

    Texts link if their sets' intersection is at least ``percent`` hundredths of the union. Null and empty texts, and
    those without words, have no shingles and link with nothing: their component is their own id. Rows of equal sets,
    also repeated rows, are one class (class_id: the digest). Null ids count as no id: a component of them alone has a null id.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(_classes(texts, words), "classes")
    filled = rows.where("n > 0")
    classes = written(filled.groupBy("set_id").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("key").alias("key"), F.count("*").alias("members")), "sets-of-rows")
    total, n_sets = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.hex("set_id").alias("class_id"))
    # One text of each class is enough; others are skipped where that costs no shuffle of all texts.
    several = classes.where("members > 1").select("set_id", "first", "members")
    copies = join_common(filled.select("id", "set_id"), several, "set_id", "members").where("id > first").select("id").distinct()
    copies = copies.join(classes.select(F.col("first").alias("id")), "id", "left_anti")
    copies = written(copies, "copies")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    once = texts.join(F.broadcast(copies) if few else copies, "id", "left_anti")
    if not few:  # each pass reads the texts
        once = written(once, "once")
    shared = _shared(once, words, total, n_sets, bucket_tokens, round_bits)
    wanted = classes.join(shared, "key").where(100 * F.col("shared") >= percent * F.col("n")).select(F.col("first").alias("wanted")).distinct()
    wanted = broadcast_if_small(written(wanted, "wanted"))
    if not few:
        drop_written(once)
    sets = _token_sets(texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi"), words).dropDuplicates(["set_id"])
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    named = written(sets.select("set_id", "node", "n"), "nodes")
    ordered = _ordered(sets, named)
    links = written(components(_links(ordered, percent, unit_sets, unit_tokens)), "components")
    drop_written(ordered)
    of_class = written(named.drop("n").join(links, "node").join(classes.select("set_id", "first"), "set_id").select("set_id", "root", "first"), "linked")
    least = written(of_class.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("sets")), "least-ids")
    of_class = join_common(of_class, least, "root", "sets").select("set_id", "component")
    # A row that is alone in its class and its component is its own; only the others need a join.
    told = classes.join(of_class, "set_id", "left").select("set_id", F.coalesce("component", "first").alias("component"), "first", "members")
    told = written(told.where("members > 1 or not component <=> first").select("set_id", "component", "members"), "told")
    out = join_common(filled.select("id", "n", "set_id"), told.withColumn("found", F.lit(True)), "set_id", "members", "left")
    out = out.select("id", "n", "set_id", F.when(F.col("found"), F.col("component")).otherwise(F.col("id")).alias("component"))
    out = out.unionByName(rows.where("n = 0").select("id", "n", "set_id", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.hex("set_id").alias("class_id"))


def _free(name: str, columns: list[str]) -> str:
    """The name, with underscores before it as long as a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents that stay, with all their columns: all without shingles, and exactly one row of each component.

    It is the row with the least id, nulls last; of several such rows the one with the least 64-bit hash of its columns
    (maps aside), and of equal ones any. So rows of one id in several components are judged apart. An empty table stays empty.
    """
    columns, row = docs.columns, _free("__row", docs.columns)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumn(row, F.xxhash64(*hashed))
    # Joined by the rows' hashes: they are never null and, unlike ids, of one text each.
    found = ngram_components(marked.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text", **params)
    found = written(found.where("n_shingles > 0").select("row", F.col("component_id").alias("part")), "rows")
    many = written(found.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"), "parts")
    copies = join_common(found, many, "part", "n").groupBy("part", "row").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    ids = marked.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id")).distinct()
    copies = written(copies.join(ids, "row"), "copies-of-parts")
    first = copies.groupBy("part").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first"), F.max("n").alias("n"))
    told = join_common(copies.drop("n"), written(first, "first-of-parts"), "part", "n")
    gone = broadcast_if_small(written(told.where("row <> first").select(F.col("row").alias(row)), "gone"))
    again = written(told.where("row = first and times > 1").select(F.col("row").alias(row)), "again")
    kept = [F.col(f"`{c}`") for c in [*columns, row]]
    left = marked.join(gone, row, "left_anti").select(*kept)
    if again.isEmpty():
        return left.drop(row)
    again = broadcast_if_small(again)
    once = left.join(again, row, "left_semi").select(*kept).dropDuplicates([row])
    return left.join(again, row, "left_anti").select(*kept).unionByName(once).drop(row)
