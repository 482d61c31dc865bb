"""Pairs and leaders of vectors against plain loops, in many tiles and rounds, and odd vectors."""

import numpy as np
import pytest

from graphloom.operators import vectors


def _plain(rows, threshold):
    good = [(i, v, t) for i, v, t in rows if v is not None and any(v) and all(x is not None for x in v)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in good}
    pairs = {(a, b) for a, u, s in good for b, v, t in good if a < b and s == t and len(u) == len(v) and unit[a] @ unit[b] >= threshold}
    leader = {}
    for i, _, t in sorted(rows, key=lambda r: r[0]):
        first = [j for j in sorted(leader) if leader[j] == j and (j, i) in pairs]
        leader[i] = first[0] if first else i
    return pairs, leader


@pytest.mark.parametrize("tile", [2000, 7])
def test_pairs_and_leaders(spark, monkeypatch, tile):
    rng = np.random.default_rng(tile)
    rows = [(k, [float(x) for x in rng.normal(size=4)], None if k % 7 == 0 else k % 2) for k in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 4, 1), (202, [1.0, None, 0.0, 0.0], 1), (203, [1.0, 2.0], 1), (204, [2.0, 4.0], 1), (205, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    pairs, leader = _plain(rows, 0.6)
    assert len(pairs) > 100
    assert {(r["a"], r["b"]) for r in vectors.similar_pairs(df, 0.6, tile=tile).collect()} == pairs
    monkeypatch.setattr(vectors.similar_pairs, "__defaults__", (*vectors.similar_pairs.__defaults__[:-1], tile))
    assert {r["id"]: r["leader"] for r in vectors.leaders(df, 0.6).collect()} == leader
    assert vectors.leaders(df.limit(0), 0.6).count() == 0
