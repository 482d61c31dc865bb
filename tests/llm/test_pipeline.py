"""Each stage of the corpus pipeline against a brute-force version on its own input, and the operators' SQL."""

import math
import re
import statistics
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality_rules
from graphloom.llm.queries import llm_oracles, llm_queries
from graphloom.plans.sizes import broadcast_if_small
from tests.llm.test_operators import WORDS, _components

SF = "/root/testdata/sf0.001"


def _planted(texts):
    """Rows for what a small table lacks: lines of ten and more documents, near copies, nulls, a long text."""
    long = [t for t in texts if t and len(WORDS.findall(t)) >= 120][:14]
    passage = " ".join(f"passage{k}" for k in range(60))
    out = [f"{t}\n{passage}\nserved to host{k} at 10:{k} by the same old machine" for k, t in enumerate(long[:12])]
    out += [long[12], f"{long[12]} tail", f"{long[12]} other tail", long[13] * 40, None, "", " \n", "short"]
    return out + [passage + f"\nserved to host{k} at 9:{k} by the same old machine" for k in range(2)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with planted documents and one more column, whose name a result has."""
    out = tmp_path_factory.mktemp("corpus")
    docs = pq.read_table(f"{SF}/documents.parquet")
    texts = _planted(docs["text"].to_pylist())
    n = max(docs["doc_id"].to_pylist()) + 1
    more = {"doc_id": range(n, n + len(texts)), "text": texts, "lang": None, "source": None, "n_chars": None}
    more = pa.table({f.name: pa.array(list(more[f.name]) if more.get(f.name) is not None else [None] * len(texts), f.type) for f in docs.schema})
    docs = pa.concat_tables([docs, more])
    pq.write_table(docs.append_column("score", pa.array(["x"] * len(docs))), out / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), out / "labels.parquet")
    return str(out)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(input, result) rows of each stage, each result written and read again."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage-{k}")
        after = spark.read.parquet(f"{folder}/stage-{k}")
        if k < 3:
            assert after.columns == docs.columns
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return out


def _long_hash(x, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", x), seed)


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _grams(text):
    words = WORDS.findall(text or "")
    h = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    pairs = [_signed(_long_hash(b, _long_hash(a, 42))) for a, b in zip(h, h[1:])]
    return words, [x % quality_rules.BUCKETS for x in h + pairs]


def _kept_by_rules(rows, labels):
    """(ids kept, ids too near the threshold to tell)."""
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]}
    grams = {r["doc_id"]: _grams(r["text"]) for r in rows}
    raw = Counter(b for _, g in grams.values() for b in g)
    target = Counter(b for i, (_, g) in grams.items() if i in trusted for b in g)
    size, all_raw, all_target = quality_rules.BUCKETS, sum(raw.values()), sum(target.values())
    ratio = [math.log((target[b] + 1) / (all_target + size)) - math.log((raw[b] + 1) / (all_raw + size)) for b in range(size)]
    score = {i: math.fsum(ratio[b] for b in g) / len(g) for i, (_, g) in grams.items() if g}
    good = sorted(score[i] for i, (w, _) in grams.items() if i in trusted and len(w) >= 50)
    at = (len(good) - 1) * quality_rules.QUANTILE
    low = good[int(at)] + (at - int(at)) * (good[min(int(at) + 1, len(good) - 1)] - good[int(at)])
    threshold = low - quality_rules.MARGIN * statistics.pstdev(good)
    kept, unsure = set(), set()
    for i, (w, _) in grams.items():
        triples = list(zip(w, w[1:], w[2:]))
        often = Counter(triples)
        repeated = {k + d for k, t in enumerate(triples) if often[t] > 1 for d in range(3)}
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w):
            if abs(score[i] - threshold) < 1e-5:
                unsure.add(i)
            elif score[i] >= threshold:
                kept.add(i)
    return kept, unsure


def test_quality_stage(stages, folder):
    before, after = stages[0]
    kept, unsure = _kept_by_rules(before, pq.read_table(f"{folder}/labels.parquet").to_pylist())
    got = Counter(r["doc_id"] for r in after)
    assert max(got.values()) == 1
    assert set(got) - unsure == kept - unsure and len(unsure) <= 1
    texts = {r["doc_id"]: r for r in before}
    assert 0 < len(after) < len(before) and all(r == texts[r["doc_id"]] for r in after)


def test_all_labelled_documents_are_trusted(spark):
    """Trusted documents count however many labels there are, whatever their ids' hashes."""
    labels = spark.range(100_100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    last = labels.orderBy(F.xxhash64("doc_id").desc()).limit(20).select("doc_id")
    docs = last.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), F.col("doc_id") % 7 + k))))
    assert quality_rules.fit(docs, labels).threshold is not None


@pytest.mark.parametrize(("bitmaps", "ids"), [(4096, 1_000_000), (0, 1_000_000), (0, 3)])
def test_trusted_ids_by_bitmaps_broadcast_and_shuffle(spark, monkeypatch, bitmaps, ids):
    monkeypatch.setattr(quality_rules, "MAX_BITMAPS", bitmaps)
    monkeypatch.setattr(quality_rules, "broadcast_if_small", lambda df: broadcast_if_small(df, limit=ids))
    trusted = [-40_000, -32_768, -3, 0, 1, 7, 8, 32_768, 32_769, 70_000, 2**62, 2**63 - 1, -(2**63) + 1, 7, 8]
    near = sorted({x + d for x in trusted for d in (-1, 0, 1) if -(2**63) < x + d < 2**63})
    texts = spark.createDataFrame([(x, "a") for x in [*near, None, 7]], "__id long, __text string").repartition(3)
    got = quality_rules._marked(texts, spark.createDataFrame([(x,) for x in trusted], "__id long")).collect()
    assert len(got) == len(near) + 2
    assert all((r["__trusted"] == 1) == (r["__id"] in trusted) for r in got)


def _without_lines(rows, min_docs=10, depth=3):
    """The texts that line dedup leaves, by id."""
    def mask(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in WORDS.findall(line))

    lines = {(r["doc_id"], k): mask(x) for r in rows for k, x in enumerate((r["text"] or "").split("\n")) if WORDS.search(x)}

    def recurring(keys):
        ids = defaultdict(set)
        for (i, _), key in keys.items():
            ids[key].add(i)
        return {key: min(found) for key, found in ids.items() if len(found) >= min_docs}

    whole = recurring(lines)
    drops = {at for at, x in lines.items() if x in whole and at[0] != whole[x]}
    leaf = {at: (len(x), x[:depth]) for at, x in lines.items() if x not in whole}
    common = recurring(leaf)
    at_place = defaultdict(set)
    for at, key in leaf.items():
        for place, word in enumerate(lines[at]):
            at_place[key, place, word].add(at[0])
    templates = {}
    for at, key in leaf.items():
        if key in common:
            fixed = [w != "<*>" and (p < depth or len(at_place[key, p, w]) >= min_docs) for p, w in enumerate(lines[at])]
            if sum(fixed) / len(fixed) >= 0.8:
                templates[at] = key, tuple(w if f else "<*>" for w, f in zip(lines[at], fixed, strict=True))
    again = recurring(templates)
    drops |= {at for at, t in templates.items() if t in again and at[0] != again[t]}
    out = {}
    for r in rows:
        own = {k for i, k in lines if i == r["doc_id"]}
        gone = {k for i, k in drops if i == r["doc_id"]}
        if not own or gone < own:
            out[r["doc_id"]] = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone)
    return out


def test_line_stage(stages):
    before, after = stages[1]
    assert {r["doc_id"]: r["text"] for r in after} == _without_lines(before)
    assert len({r["doc_id"] for r in after}) == len(after)
    assert any(a != b for a, b in zip(sorted(r["text"] for r in before), sorted(r["text"] for r in after)))


def test_near_duplicate_stage(stages):
    before, after = stages[2]
    label = _components([(r["doc_id"], r["text"]) for r in before])
    want = {i for i, (n, root) in label.items() if i == root or not n}
    texts = {r["doc_id"]: r for r in before}
    assert sorted(r["doc_id"] for r in after) == sorted(want) and len(after) < len(before)
    assert all(r == texts[r["doc_id"]] for r in after)


def test_packing_stage(stages):
    before, after = stages[3]
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for r in before:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[r["doc_id"], k] = start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in after} == want
    assert len(after) == len(want)
    bins = defaultdict(list)
    for r in after:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    free: list[int] = []  # plain best fit, longest first
    for n in sorted((x[1] for x in want.values()), reverse=True):
        fits = [k for k, room in enumerate(free) if room >= n]
        best = min(fits, key=free.__getitem__) if fits else len(free)
        free[best : best + 1] = [(free[best] if fits else 2048) - n]
    assert len(bins) <= len(free)


def test_run_gives_the_last_stage(spark, folder, stages):
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, stages[3][1]))


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm_queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(llm_oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
