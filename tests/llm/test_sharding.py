"""Places of rows against plain Python, and very many equal rows."""

import zlib
from collections import defaultdict

import numpy as np

from graphloom.llm import sharding
from graphloom.llm.queries import op10_sharding

SF = "/root/testdata/sf0.001"


def _plain_place(x, n, seed):
    """The Feistel rounds on whole numbers, walked until the number is one of the rows'."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, full = (1 << bits) - 1, (1 << 64) - 1

    def mixed(v, key):
        v = (v + key) & full
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = ((v ^ (v >> shift)) * factor) & full
        return v ^ (v >> 31)

    while True:
        a, b = x >> bits, x & mask
        for r in range(sharding.ROUNDS):
            a, b = b, a ^ (mixed(b, (seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1342543DE82EF95) & full) & mask)
        x = a << bits | b
        if x < n:
            return x


def test_permutation_is_the_plain_one_and_has_an_inverse():
    for n in (1, 2, 3, 17, 1000, 4097):
        own = sharding.Permutation(n, 7)
        places = own.place(np.arange(n))
        assert places.tolist() == [_plain_place(x, n, 7) for x in range(n)]
        assert sorted(places.tolist()) == list(range(n)) and own.number(places).tolist() == list(range(n))


def test_query_against_plain_rows(spark):
    from graphloom.llm.queries import SEED, SHARDS

    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ordered = sorted((i, len(t) + 8, zlib.crc32(t)) for i, t in docs)
    want = []
    for k, (i, size, crc) in enumerate(ordered):
        place = _plain_place(k, len(docs), SEED)
        want.append((i, size, crc, place % SHARDS, place // SHARDS))
    got = op10_sharding(spark, SF).collect()
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == sorted(want)


def test_very_many_equal_rows_are_cut_by_ranges(spark):
    docs = spark.range(5000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "1 as size")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small ranges would be joined again
    try:
        ranged, n = sharding.numbered(docs, ["doc_id", "text"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == 5000 and sorted(r["row_no"] for r in ranged.collect()) == list(range(5000))
    assert len({f for f in ranged.inputFiles() if "part-" in f}) > 1
    places = defaultdict(list)
    for r in sharding.shards(docs, 24, 7).collect():
        places[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in places.values()) and sum(map(len, places.values())) == 5000
