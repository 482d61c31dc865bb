"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a slice of texts are merged together: a flat array of symbols, the rank of each adjacent pair, the least
rank of each word by a segmented minimum, simultaneous leftmost merges in all words, and compaction of the words that
have no pair left. A word is a run of space marks and what follows up to the next one; pieces never reach over such a
border, so words can be encoded on their own and their ids be kept for the words met again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm._arrow import RaggedStore, bounds, ragged_take, row_slices, text_slices

MARK = "▁"
_NONE = np.int32(2**31 - 1)
_WORD = re.compile(rb" *[^ ]+| +")
#: Bytes of words and ids that a worker keeps; beyond it the store starts anew.
STORE_BYTES = 96 << 20
#: Bytes of texts or of ids that are worked on at once.
SLICE_BYTES = 1 << 20


class BpeModel:
    """The tables of a SentencePiece BPE model with identity normalisation and byte fallback; others are refused."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and without normalisation are supported")
        kinds = [p.type for p in proto.pieces]
        if {4, 5} & set(kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.dummy_prefix, self.size = norm.add_dummy_prefix, len(kinds)
        self.bos, self.eos = kinds_index(proto, trainer.bos_piece, 1), kinds_index(proto, trainer.eos_piece, 2)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in piece.lstrip(MARK) for piece in normal):
            raise ValueError("a piece holds a space mark inside")
        self.unknown = kinds.index(2)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        surfaces: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                surfaces.append(bytes([int(p.piece[3:5], 16)]))
            else:
                surfaces.append(p.piece.replace(MARK, " ").encode() if p.type == 1 else " ⁇ ".encode() if p.type == 2 else b"")
        self.is_byte = np.array([k == 6 for k in kinds])
        self.surface = np.frombuffer(b"".join(surfaces), dtype=np.uint8)
        self.surface_len = np.array([len(s) for s in surfaces], dtype=np.int64)
        self.surface_at = bounds(self.surface_len)[:-1]
        # Symbols: a piece's id; size stands for characters without piece, ids above it for those that occur in pieces.
        extra = sorted({c for piece in normal for c in piece if c not in normal})
        symbol = normal | {c: self.size + 1 + k for k, c in enumerate(extra)}
        self.of_char = np.full(0x110000, self.size, dtype=np.int32)
        for piece, i in symbol.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        self.rank = np.full(self.size + 1 + len(extra), _NONE, dtype=np.int32)
        for i in normal.values():
            self.rank[i] = order[proto.pieces[i].score]
        self.base = np.int64(len(self.rank))
        pairs = {symbol[p[:k]] * int(self.base) + symbol[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols make together, and its rank; the rank is the greatest number if they make nothing."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        made = self.pair_ids[at]
        return made, np.where(self.pair_keys[at] == key, self.rank[made], _NONE)

    def merge(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given as joined code points, joined, and their number by word.

        Equal to merging the best pair (highest score, then leftmost) again and again: in each round every word merges
        the occurrences of its best rank from the left, up to the first one that makes a pair of that rank or a better.
        """
        n_words = len(lengths)
        sym, at = self.of_char[chars].astype(np.int64), np.arange(len(chars))
        word = np.repeat(np.arange(n_words), lengths)
        made = np.zeros(len(sym), dtype=np.int32)
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        if len(sym) > 1:
            made[:-1], rank[:-1] = self.pair(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least, held = np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)])
            if not (alive := least < _NONE).all():
                keep = np.repeat(alive, held)
                done.append((sym[~keep], word[~keep], at[~keep]))
                sym, word, at, made, rank = sym[keep], word[keep], at[keep], made[keep], rank[keep]
                least, held = least[alive], held[alive]
                if not len(sym):
                    break
            best = np.repeat(least, held)
            found = np.flatnonzero(rank == best)
            k = np.arange(len(found))
            run = np.maximum.accumulate(np.where(np.r_[True, found[1:] != found[:-1] + 1], k, 0))
            take = found[(k - run) % 2 == 0]
            # The pairs that a merge makes with its left neighbour, already merged, and its right one, not yet merged.
            new, merged_end = made[take].astype(np.int64), np.zeros(len(sym) + 3, dtype=bool)
            merged_end[take + 1] = True
            before = np.where((take > 0) & merged_end[take - 1], made[take - 2], sym[take - 1])
            has_left = (take > 0) & (word[take - 1] == word[take])
            after = np.minimum(take + 2, len(sym) - 1)
            has_right = (take + 2 < len(sym)) & (word[after] == word[take])
            early = has_left & (self.pair(before.astype(np.int64), new)[1] <= best[take])
            early |= has_right & (self.pair(new, sym[after])[1] <= best[take])
            if early.any():
                passed, of = np.cumsum(early) - early, word[take]
                first = np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]], np.arange(len(of)), 0))
                take = take[passed == passed[first]]
            sym[take] = made[take]
            keep = np.ones(len(sym), dtype=bool)
            keep[take + 1] = False
            moved = (np.cumsum(keep) - 1)[take]
            sym, word, at, made, rank = sym[keep], word[keep], at[keep], made[keep], rank[keep]
            touched = np.unique(np.r_[moved, moved[moved > 0] - 1])
            right = np.minimum(touched + 1, len(sym) - 1)
            made[touched], ranks = self.pair(sym[touched], sym[right])
            ranks[(touched + 1 >= len(sym)) | (word[right] != word[touched])] = _NONE
            rank[touched] = ranks
        if not done:
            return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
        sym, word, at = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at, kind="stable")
        sym, word, at = sym[order], word[order], at[order]
        ids, n = sym.astype(np.int32), np.bincount(word, minlength=n_words)
        if (odd := np.flatnonzero(sym >= self.size)).size:  # characters without piece: their bytes
            spelled = [self.byte_ids[list(chr(c).encode())] for c in chars[at[odd]].tolist()]
            count = np.ones(len(sym), dtype=np.int64)
            count[odd] = [len(s) for s in spelled]
            ids, spread = np.repeat(ids, count), bounds(count)
            ids[np.concatenate([np.arange(spread[o], spread[o] + len(s)) for o, s in zip(odd, spelled, strict=True)])] = np.concatenate(spelled)
            n = np.bincount(np.repeat(word, count), minlength=n_words)
        return ids, n


def kinds_index(proto, piece: str, default: int) -> int:
    return next((i for i, p in enumerate(proto.pieces) if p.type == 3 and p.piece == piece), default)


class _Store(dict):
    """Word -> number; a new word gets the next number and waits for its ids."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []
        self.ids, self.key_bytes = RaggedStore(np.int32), 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.waiting.append(word)
        self.key_bytes += 170 + len(word)
        return number


class Codec:
    def __init__(self, path: str) -> None:
        self.model, self.store = BpeModel(path), _Store()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, begin and end ids included."""
        model = self.model
        if self.store.key_bytes + self.store.ids.nbytes > STORE_BYTES:
            self.store = _Store()
        store, words, counts = self.store, [], []
        for text in texts:
            raw = text.replace(MARK, " ").encode()
            found = _WORD.findall(b" " + raw if model.dummy_prefix and raw else raw)
            words += found
            counts.append(len(found))
        index = np.fromiter(map(store.__getitem__, words), dtype=np.int64, count=len(words))
        if store.waiting:
            spelled = [w.decode().replace(" ", MARK) for w in store.waiting]
            chars = np.frombuffer("".join(spelled).encode("utf-32-le"), dtype=np.uint32)
            store.ids.append(*model.merge(chars, np.array([len(w) for w in spelled], dtype=np.int64)))
            store.waiting = []
        flat, n = store.ids.take(index)
        cut = bounds(n)[bounds(np.array(counts, dtype=np.int64))]
        begin, end = np.array([model.bos], dtype="<u4"), np.array([model.eos], dtype="<u4")
        flat = flat.astype("<u4")
        return [np.concatenate((begin, flat[a:b], end)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The text of each list of ids in UTF-8; bytes that make no character become U+FFFD each."""
        model = self.model
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
        joined, n = ragged_take(model.surface, model.surface_at, model.surface_len, flat)
        cut, raw, out = bounds(n)[bounds(lengths)], joined.tobytes(), []
        control = bounds(n == 0)[bounds(lengths)]
        for k, own in enumerate(ids):
            text = raw[cut[k] : cut[k + 1]]
            inside = control[k + 1] - control[k] - (len(own) > 0 and model.surface_len[own[0]] == 0) - (len(own) > 1 and model.surface_len[own[-1]] == 0)
            try:  # pieces are whole characters: without control ids between bytes, the whole is valid only if each run is
                text.decode()
                whole = not inside
            except UnicodeDecodeError:
                whole = False
            if not whole:
                text = self._by_runs(np.asarray(own, dtype=np.int64))
            out.append(text[1:] if model.dummy_prefix and text[:1] == b" " and self._starts_marked(own) else text)
        return out

    def _starts_marked(self, ids: np.ndarray) -> bool:
        first = next((i for i in ids if self.model.surface_len[i]), None)
        return first is not None and first != self.model.unknown and not self.model.is_byte[first]

    def _by_runs(self, ids: np.ndarray) -> bytes:
        model, out, at = self.model, [], 0
        while at < len(ids):
            run = at
            while run < len(ids) and model.is_byte[ids[run]] == model.is_byte[ids[at]]:
                run += 1
            flat, _ = ragged_take(model.surface, model.surface_at, model.surface_len, ids[at:run])
            out.append(_repaired(flat.tobytes()) if model.is_byte[ids[at]] else flat.tobytes())
            at = run
        return b"".join(out)


def _repaired(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    raw[at : at + n].decode()
                except UnicodeDecodeError:
                    continue
                out.append(raw[at : at + n])
                at += len(out[-1])
                break
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids): the ids of every whole text as little-endian unsigned 32-bit integers, with begin and end ids.

    Null and empty texts have only the begin and end ids. Each row gives a row, also repeated ones; an empty table gives none.
    Memory is bounded by a slice of SLICE_BYTES of texts, or one longer text, and by STORE_BYTES and a slice's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in codec(model_path).encode(texts)], pa.binary())], names=["id", "token_ids"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, token_ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, token_ids, decoded): the text of packed ids as the library's decode() gives it; null ids are an empty list.
    Each row gives a row; an empty table gives none. A slice of SLICE_BYTES of ids, or one longer list, is decoded at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in row_slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, n)
                packed = [np.frombuffer(x or b"", dtype="<u4") for x in part.column(1).to_pylist()]
                decoded = pa.array(codec(model_path).decode(packed), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoded], names=["id", "token_ids", "decoded"])

    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("token_ids")).mapInArrow(run, "id long, token_ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded): ``encode``, and ``decode`` of its ids, in the same worker, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for ids, texts in text_slices(batches, SLICE_BYTES):
            packed = [x.tobytes() for x in own.encode(texts)]
            decoded = own.decode([np.frombuffer(x, dtype="<u4") for x in packed])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], names=["id", "token_ids", "decoded"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, token_ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
