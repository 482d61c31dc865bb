"""The n-gram join's counting rounds, blocks and common keys on small tables, and what they make as tables grow."""

import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import _joins, ngram_join
from graphloom.plans import scratch
from tests.llm.test_operators import _components


def _texts(rng, n, words=60, hot=True):
    """Texts of their own, near copies of some, and a passage that a third has."""
    passage = " ".join(f"shared{k}" for k in range(20))
    out = []
    for i in range(n):
        own = [f"w{rng.integers(10**9)}" for _ in range(words)]
        if i % 5 == 4:
            own = out[-1].split()
            own[int(rng.integers(len(own)))] = "changed"
        out.append(" ".join(own) + (f" {passage}" if hot and i % 3 == 0 else ""))
    return out


@pytest.mark.parametrize("round_bits", [8, 3, 1])
def test_shared_shingles_are_counted_in_any_number_of_rounds(spark, round_bits):
    texts = _texts(np.random.default_rng(1), 150) + [None, "", "few words"]
    texts += texts[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(6)
    sets = {ngram_join._key(ngram_join._digest(s)): s for s in ngram_join.shingle_sets([t or "" for t in texts]) if len(s)}
    often = Counter(x for s in sets.values() for x in s.tolist())
    want = {k: n for k, s in sets.items() if (n := sum(often[x] > 1 for x in s.tolist()))}
    bounds = {"held": 50, "slice_bytes": 2000}
    got = {r["key"]: r["shared"] for r in ngram_join._shared(docs.where("id < 153"), 5, 10_000, 150, 300, round_bits, 20, **bounds).collect()}
    assert got == want


def test_rounds_make_rows_and_bytes_in_proportion(spark):
    """At fixed slices, four and sixteen times the texts make about four and sixteen times the rows and bytes, in every round."""
    made = defaultdict(list)
    for times in (1, 4, 16):
        texts = _texts(np.random.default_rng(times), 60 * times)
        docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
        rounds, _ = ngram_join._ranges(docs, 5, 4000 * times, 40, 4, held=2000, slice_bytes=8000)
        size = F.length("tokens") + F.length("owners") + F.length("counts")
        for k, rows in enumerate(rounds):
            made[k].append((times, *rows.agg(F.count("*"), F.sum(size)).first()))
    for k, found in made.items():
        for times, rows, held in found:
            first = found[0]
            assert held <= 1.6 * first[2] * times / first[0], (k, found)
            assert rows <= 60 * times * 80, (k, found)
    # The passage that a third of all texts has goes on once for each slice, not once for each text.
    assert len(made) == 3


@pytest.mark.parametrize("round_bits", [5, 4, 2])
def test_passes_part_what_lies_on_disk(spark, round_bits):
    """What one pass sends is in proportion to its part of the shingles, and the passes together count as one."""
    texts = _texts(np.random.default_rng(2), 200, hot=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    total, size = 13_000, F.length("tokens") + F.length("owners") + F.length("counts")
    bits = ngram_join._pass_bits(total, 400, round_bits)
    assert bits == {5: 1, 4: 2, 2: 2}[round_bits]  # 6 bits tell the ranges
    sent = lambda n, part: sum(rows.agg(F.sum(size)).first()[0] for rows in ngram_join._ranges(docs, 5, n, 400, round_bits, part=part)[0])
    whole, parts = sent(total, (0, 0)), [sent(total >> bits, (bits, k)) for k in range(1 << bits)]
    assert max(parts) < 1.3 * whole / (1 << bits)
    sets = {ngram_join._key(ngram_join._digest(s)): s for s in ngram_join.shingle_sets(texts)}
    often = Counter(x for s in sets.values() for x in s.tolist())
    want = {k: n for k, s in sets.items() if (n := sum(often[x] > 1 for x in s.tolist()))}
    assert {r["key"]: r["shared"] for r in ngram_join._shared(docs, 5, total, 200, 400, round_bits).collect()} == want


def test_copies_that_are_too_many_to_broadcast(spark, monkeypatch):
    """The texts without copies are written once, and all passes read them."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 3)
    texts = _texts(np.random.default_rng(3), 40)
    rows = list(enumerate(texts + texts[:20] + [None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, bucket_tokens=100, round_bits=2).collect()}
    assert got == _components(rows)


def test_one_of_each_in_passes(spark, monkeypatch):
    """The pipeline's stage counts in passes as well, and keeps one row of each component."""
    names, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: names.append(name) or write(df, name))
    texts = _texts(np.random.default_rng(4), 40)
    rows = list(enumerate(texts + texts[:20] + [None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in ngram_join.one_of_each(docs, bucket_tokens=100, round_bits=2).collect())
    assert names.count("shared") == 4
    assert got == sorted({c for _, c in _components(rows).values()})


def test_sets_are_put_in_order_in_passes(spark, monkeypatch):
    """No pass makes a row of each shingle for more than its part of them; the results are those of one pass."""
    made, entries = [], ngram_join._entries

    def counted(*args):
        out = entries(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_entries", counted)
    monkeypatch.setattr(ngram_join, "PASS_ENTRIES", 1000, raising=False)
    texts = _texts(np.random.default_rng(9), 200)
    rows = list(enumerate([*texts, *texts[:20], None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == _components(rows)
    assert max(made) < 0.4 * sum(made), made


def test_shuffle_files_go_when_a_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    rows = spark.range(20_000).repartition(3).groupBy(F.col("id") % 5000).agg(F.count("*").alias("n"))
    before, setting = files(), spark.conf.get(scratch.CLEANUP, None)
    table = scratch.written(rows, "freed")
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(scratch.CLEANUP, None) == setting
    assert table.agg(F.sum("n")).first()[0] == 20_000 and rows.count() == 5000


@pytest.mark.parametrize("unit_sets", [2000, 8])
def test_blocks_of_many_sizes(spark, unit_sets):
    """Chains of texts that grow, so that links go between neighbouring sizes only, all in one group by a common passage."""
    passage, rows = [f"p{k}" for k in range(30)], []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(150)]
        for n in range(10, 150, 9):
            rows.append((len(rows), " ".join(passage + words[:n])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, unit_sets=unit_sets, bucket_tokens=500, round_bits=2).collect()}
    assert got == _components(rows)


def _chance(rng, pairs):
    """Near copies in pairs, whose texts share four single shingles with texts of other pairs, as in large tables by chance."""
    ends = iter(rng.permutation(8 * pairs) // 2)
    out = []
    for _ in range(pairs):
        own = [f"w{rng.integers(10**9)}" for _ in range(200)]
        for _ in range(2):
            out.append(" ".join([*own, *(f"chance{c}x{j}" for c in [next(ends) for _ in range(4)] for j in range(5))]))
    return out


def test_chance_shingles_do_not_tie_near_copies(spark, monkeypatch):
    """The rows in units stay in proportion to the sets."""
    seen, write = Counter(), ngram_join.written

    def counted(df, name):
        out = write(df, name)
        seen[name] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    rows = list(enumerate(_chance(np.random.default_rng(6), 100)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, unit_sets=8).collect()}
    assert got == _components(rows)
    assert len({c for _, c in got.values()}) == 100
    assert seen["units"] + seen["blocks"] <= 200


def test_one_of_each_of_a_group_tied_by_a_passage(spark):
    """Near copies that a common passage ties to all others, in a group too large for one unit, meet as pairs in the pipeline's stage."""
    rng, texts = np.random.default_rng(8), []
    for _ in range(40):
        own = [f"w{rng.integers(10**9)}" for _ in range(30)]
        texts += [" ".join([*own, *(f"shared{k}" for k in range(150)), f"last{k}"]) for k in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs, unit_sets=8).collect()) == list(range(0, 80, 2))


def test_pairs_that_may_link_are_all_kept(spark):
    """The pairs by rare shingles are held against all pairs, for sets of many sizes and overlaps."""
    rng = np.random.default_rng(7)
    sets = [set(range(1000 * k, 1000 * k + 40)) for k in range(6)]
    for k in range(24):
        base = sorted(sets[k % 6])
        own = set(rng.choice(base, int(rng.integers(26, 41)), replace=False).tolist())
        sets.append(own | set(range(10**6 + 100 * k, 10**6 + 100 * k + int(rng.integers(0, 12)))))
    often = Counter(x for s in sets for x in s)
    rows = []
    for node, s in enumerate(sets):
        order = sorted(s, key=lambda x: (often[x], x))
        rows += [(node, len(s), x) for x in order[: len(s) - -(-75 * len(s) // 100) + 1]]
    prefix = spark.createDataFrame(rows, "node long, n long, token long")
    got = {(r["u"], r["v"]) for r in ngram_join._pairs(prefix, 75).collect()}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_common_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(_joins, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(k % 40 if k % 3 else -1, k) for k in range(600)], "key long, v long")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("key <> 5")
    for how in ("inner", "left"):
        want = rows.join(table, "key", how).select("key", "v", "n", "least").collect()
        assert sorted(map(repr, _joins.join_common(rows, table, "key", "n", how).collect())) == sorted(map(repr, want))


def test_columns_with_the_names_of_helpers(spark):
    text = " ".join(f"x{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, 1, 2, "a"), (2, text, 3, 4, "b"), (3, "", 5, 6, "c")], "doc_id long, text string, __row long, row long, `a.b` string")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
