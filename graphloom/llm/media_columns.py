"""Lossless PNG columns: written and read chunk by chunk, and hashed by the low frequencies of a cosine transform."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm._arrow import row_slices, text_slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
ROW = 3 * WIDTH
#: Bytes of the largest picture that is read.
MAX_BYTES = 1 << 30
#: Bytes of texts or pictures that are worked on at once.
SLICE_BYTES = 1 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def padded(raw: bytes) -> bytes:
    """``raw`` with blanks up to a positive multiple of a row's 192 bytes."""
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def write_png(payload: bytes, level: int = 6) -> bytes:
    """The payload as an 8-bit RGB picture, 64 pixels wide. Each row takes the filter, none or left, that leaves the smaller sum of differences."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    left = rows.copy()
    left[:, 3:] -= rows[:, :-3]
    cost = lambda x: np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1)
    use = cost(left) < cost(rows)
    lines = np.empty((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 0], lines[:, 1:] = use, np.where(use[:, None], left, rows)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, channels, samples by row) of an 8-bit picture without interlace; ValueError for anything broken.

    Every chunk's checksum is tested, and the data must fill the picture exactly.
    """
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("the header's length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, packing, filtering, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or packing or filtering or interlace:
        raise ValueError("only 8-bit grey and colour pictures without interlace")
    size = height * (width * channels + 1)
    if not 0 < size <= MAX_BYTES:
        raise ValueError("a picture without samples or of too many")
    # No more is unpacked than the header tells, whatever the data would give.
    stream = zlib.decompressobj()
    try:
        lines = stream.decompress(b"".join(data), size + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(lines) != size or not stream.eof:
        raise ValueError("the data don't fill the picture")
    return width, height, channels, unfilter(np.frombuffer(lines, dtype=np.uint8).reshape(height, -1), channels)


def unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """The samples of filtered lines (first byte: the filter's number). Rows of the filters none and left are done at once."""
    kind, out = lines[:, 0], lines[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown filter")
    height, width = out.shape
    left = np.flatnonzero(kind == 1)
    if len(left):
        out[left] = np.cumsum(out[left].reshape(len(left), -1, channels), axis=1, dtype=np.uint8).reshape(len(left), width)
    for y in np.flatnonzero(kind >= 2):
        above = out[y - 1] if y else np.zeros(width, dtype=np.uint8)
        if kind[y] == 2:
            out[y] += above
            continue
        row, up = out[y].reshape(-1, channels).astype(np.int32), above.reshape(-1, channels).astype(np.int32)
        before, corner = np.zeros(channels, np.int32), np.zeros(channels, np.int32)
        for x in range(len(row)):
            if kind[y] == 3:
                guess = (before + up[x]) // 2
            else:
                p = before + up[x] - corner
                a, b, c = np.abs(p - before), np.abs(p - up[x]), np.abs(p - corner)
                guess = np.where((a <= b) & (a <= c), before, np.where(b <= c, up[x], corner))
            row[x] = before = (row[x] + guess) & 255
            corner = up[x]
        out[y] = row.reshape(-1).astype(np.uint8)
    return out


_FREQUENCIES = np.cos(np.pi / 32 * np.outer(np.arange(8), np.arange(32) + 0.5))


def _resized(grey: np.ndarray, n: int) -> np.ndarray:
    """Means over n equal spans along the first axis; spans may cut samples."""
    sums = np.concatenate([np.zeros((1, grey.shape[1])), np.cumsum(grey, axis=0)])
    at = np.arange(n + 1) * (len(grey) / n)
    low = np.minimum(at.astype(np.int64), len(grey) - 1)
    edge = sums[low] + (at - low)[:, None] * grey[low]
    return np.diff(edge, axis=0) * (n / len(grey))


def cosine_hash(width: int, height: int, channels: int, samples: np.ndarray) -> str:
    """16 hex digits: of the 8 by 8 lowest frequencies of the picture at 32 by 32 grey pixels, which exceed their median."""
    grey = samples.reshape(height, width, channels).mean(axis=2)
    small = _resized(_resized(grey, 32).T, 32).T
    low = np.round(_FREQUENCIES @ small @ _FREQUENCIES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_png(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """(id, n_bytes, media): every whole text in UTF-8, padded with blanks to whole rows, as a picture.

    Null and empty texts are one row of blanks with n_bytes 0. Each row gives a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, SLICE_BYTES):
            raw = [t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_png(padded(x), level) for x in raw], pa.binary())], names=["id", "n_bytes", "media"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


_READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"


def read_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns ``keep``, the media and what is read back from them: size and digest of the samples, the checksum of
    their last 16, the cosine hash. Broken and null media, and pictures of more than MAX_BYTES, give nulls and say why in
    ``error``; the other rows go on. Each row gives a row, also a repeated one; an empty table gives none.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), _READ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in row_slices(batch.column(len(keep)), SLICE_BYTES, 512):
                part, rows = batch.slice(start, n), []
                for media in part.column(len(keep)).to_pylist():
                    try:
                        width, height, channels, samples = read_png(media or b"")
                        raw = samples.tobytes()
                        rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), cosine_hash(width, height, channels, samples) if raw else None, None))
                    except ValueError as e:
                        rows.append((None, None, None, None, str(e)))
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep) + 1)), *made], names=[*keep, "media", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "error"])

    return df.select(*keep, F.col(media_col).alias("media")).mapInArrow(run, schema)
