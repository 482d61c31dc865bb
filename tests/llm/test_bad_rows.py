"""No row ends a job: odd JSON records, broken and swollen pictures, tokenizers that an operator can't take, full stores."""

import json
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import best_fit_packing, chat_format, media_columns, sentencepiece_codec


def test_odd_json_records(spark):
    half = '"\\ud800 x"'
    records = [
        '{"messages": ' + "[" * 100_000 + "]" * 100_000 + "}",
        '{"turn": "first", "role": "user", "text": "q"}', '{"turn": 1e400, "role": "user", "text": "q"}', '{"turn": 99999999999999999999, "role": "user", "text": "q"}', '{"turn": 1.5, "role": "user", "text": "q"}', '{"turn": true, "role": "user", "text": "q"}',
        '{"prompt": ' + half + ', "completion": "a"}', '{"turn": "2", "role": "user", "text": "q"}', '{"turn": 3.0, "role": "assistant", "text": 5}', '{"messages": []}', '{"turn": ' + "9" * 5000 + ', "role": "user", "text": "q"}', "[1]", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(records)) + [(None, records[7])], "id long, record string")
    rows = chat_format.canonical_json_turns(df, "id", "record").collect()
    good = {(r["conv_id"], r["seq"], r["role"], r["text"]) for r in rows if r["error"] is None}
    assert good == {(6, 0, "user", "\ufffd\ufffd\ufffd x"), (6, 1, "assistant", "a"), (7, 2, "user", "q"), (8, 3, "assistant", "5"), (None, 2, "user", "q")}
    assert sorted(r["conv_id"] for r in rows if r["error"]) == [0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13]
    assert chat_format.canonical_json_turns(df.limit(0), "id", "record").count() == 0


def test_conversations_with_repeated_rows_and_null_ids(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", "x"), (None, 0, "user", "y"), (2, None, None, None)]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.read_back(chat_format.formatted_turns(turns)).collect()}
    assert got == {1: (3, 0), None: (2, 1), 2: (1, 0)}


def _png(head, lines):
    return media_columns.SIGNATURE + media_columns._chunk(b"IHDR", head) + media_columns._chunk(b"IDAT", lines) + media_columns._chunk(b"IEND", b"")


def test_broken_and_swollen_pictures(spark):
    good = media_columns.write_png(media_columns.padded(b"abc"))
    head = lambda w, h: struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    bomb = zlib.compress(bytes(50_000_000))
    media = [
        good, _png(b"", b""), _png(b"x" * 20, b""), _png(head(0, 0), zlib.compress(b"")), _png(head(64, 1), bomb), _png(head(2**31 - 1, 2**31 - 1), bomb),
        _png(head(64, 1), zlib.compress(bytes(193))[:-4]), _png(head(64, 1), b"no zlib"), good[:20], b"", None, media_columns.SIGNATURE, _png(head(64, 1), zlib.compress(bytes([9]) + bytes(192))), good,
    ]
    df = spark.createDataFrame([(i, 3, m and bytearray(m)) for i, m in enumerate(media)], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in media_columns.read_media(df).collect()}
    assert len(rows) == len(media) and {i for i, r in rows.items() if r["error"] is None} == {0, 13}
    assert rows[0]["payload_bytes"] == 192 and rows[1]["payload_sha256"] is None
    assert media_columns.read_media(df.limit(0)).count() == 0


def _plain_feature(payload):
    """The cosine hash by sums over every pixel: grey means of 32 by 32 spans of the picture, then 8 by 8 cosine sums."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(float).mean(axis=2)
    height = len(grey)

    def weights(n, k):  # the share of each sample that lies in span k of 32
        low, high = k * n / 32, (k + 1) * n / 32
        return [max(0.0, min(i + 1, high) - max(i, low)) * 32 / n for i in range(n)]

    rows = [[sum(w * g for w, g in zip(weights(height, a), grey[:, x])) for x in range(64)] for a in range(32)]
    small = [[sum(w * v for w, v in zip(weights(64, b), row)) for b in range(32)] for row in rows]
    cos = [[np.cos(np.pi * u * (2 * x + 1) / 64) for x in range(32)] for u in range(8)]
    low = [sum(small[y][x] * cos[u][y] * cos[v][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(round(x, 6) for x in low[1:])[31]
    return low, middle


def test_feature_is_the_plain_cosine_transform():
    rng = np.random.default_rng(6)
    for n in (1, 5, 40):
        payload = bytes(rng.integers(32, 127, 192 * n, dtype=np.uint8))
        low, middle = _plain_feature(payload)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(media_columns.cosine_hash(*media_columns.read_png(media_columns.write_png(payload)))), np.uint8))
        assert len(bits) == 64
        assert all(bool(b) == (x > middle) for b, x in zip(bits, low) if abs(x - middle) > 1e-3)


def test_packing_refuses_other_tokenizers(spark):
    with pytest.raises(ValueError):
        best_fit_packing._Tokens(P.path("byte_bpe_50k.json"))


def test_packing_of_repeated_rows_and_null_ids(spark):
    text = "some words that stand twice " * 5
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "")], "doc_id long, text string")
    got = best_fit_packing.pack_documents(rows, P.path("word_bpe_49k.json"), 16).collect()
    n = len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in got) == 3 * n + 2
    assert sum(r["length"] for r in got if r["doc_id"] is None) == n + 1
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 16


def test_lower_case_is_read_from_the_file(tmp_path):
    spec = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    path = str(tmp_path / "cased.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    texts = ["Hello HELLO hello It's  A.B", "<|startoftext|>Ab c"]
    want = Tokenizer.from_file(path)
    got = best_fit_packing._Tokens(path).encode(texts)
    assert [x.tolist() for x in got] == [want.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_stores_start_anew(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "STORE_BYTES", 5000)
    monkeypatch.setattr(best_fit_packing, "STORE_BYTES", 5000)
    path = P.path("piece_bpe_32k.model")
    codec, library = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    tokens, other = best_fit_packing._Tokens(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [r[0] or "" for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for t in [*texts, "y" * 50_000]:
        assert codec.encode([t])[0].tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert tokens.encode([t])[0].tolist() == other.encode(t, add_special_tokens=False).ids
    assert len(codec.store) < 2000
