"""The registered query's way through the codec against the library, on whole tables and odd rows."""

import hashlib
import struct

import public_tokenizers as P
import sentencepiece

from graphloom.llm import sentencepiece_codec
from graphloom.llm.queries import op1_sentencepiece
from tests.llm.test_operators import TEXTS

PATH = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def test_query_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op1_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_is_decode_of_encode(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "no id"), (1, "")], "doc_id long, text string")
    twice = sentencepiece_codec.decode(sentencepiece_codec.encode(rows, PATH), PATH)
    assert sorted(map(repr, sentencepiece_codec.round_trip(rows, PATH).collect())) == sorted(map(repr, twice.collect()))
    assert sentencepiece_codec.round_trip(rows.limit(0), PATH).count() == 0
