"""Each operator against the library it must equal or a brute-force version, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import best_fit_packing, chat_format, license_scan, line_dedup, media_columns, ngram_join, quality_rules, sentencepiece_codec, sharding, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997} Ünïcode, tail" for i in range(20_000))
TEXTS = [None, "", " ", "\n\n", "a", "two words", "Hello  world\tagain\n", "▁x ▁", "漢字かな交じり文", "😀\x00é", "x" * 3000, "<|endoftext|> it's 'tis", "the same line\n" * 4, "one two three four five six", "ONE two three four five six", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, ties, and columns with the names of results."""
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(5, "two words", 7, "x"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, kept string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(15, 1, 0), (13, 1, None), (99, 1, 0), (None, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")


def test_sentencepiece(odd, empty):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, path), path).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(TEXTS):
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(by_id[i]["token_ids"], "<u4").tolist() == ids
        assert by_id[i]["decoded"] == sp.decode(ids)
    assert sentencepiece_codec.encode(empty, path).count() == 0


def test_quality_rules(odd, empty, labels):
    rows = quality_rules.quality_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id") or ""
        w = WORDS.findall(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.fit(odd, labels.limit(0)).threshold is None
    assert quality_rules.kept_documents(odd, labels).columns == odd.columns


def _components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("unit_sets", [2000, 4])
def test_ngram_join(spark, unit_sets):
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate(TEXTS[:-1])]
    for base in range(4):  # groups of near copies, some further from the first than from each other
        words = [f"g{base}w{k}" for k in range(60)]
        for _ in range(12):
            copy = list(words)
            for k in rng.integers(0, 60, rng.integers(0, 3)):
                copy[k] = f"e{rng.integers(1_000_000)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, unit_sets=unit_sets).collect()}
    assert got == _components(rows)


def test_ngram_join_odd_rows(odd, empty):
    rows = ngram_join.ngram_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (13, 14)} == {13}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert ngram_join.ngram_components(empty).count() == 0
    assert ngram_join.one_of_each(odd).columns == odd.columns


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, null ids and ids with several texts: one row of each component, the least id's, nulls last."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "x"), (None, a, "x"), (None, b, "x"), (None, b, "x"), (None, f"{b} tail", "x"), (5, c, "y"), (5, c, "z"), (5, d, "x"), (3, d, "x"), (None, c, "x"), (7, "", "x"), (7, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = [tuple(r) for r in ngram_join.one_of_each(docs).collect()]
    first = lambda text: text[:2] if text else text
    assert sorted(((i, first(t)) for i, t, _ in got), key=str) == sorted([(1, "a0"), (None, "b0"), (5, "c0"), (3, "d0"), (7, ""), (7, ""), (None, None)], key=str)
    assert set(got) <= set(rows) and ngram_join.one_of_each(docs).columns == docs.columns
    assert sorted(got, key=str) == sorted(map(tuple, ngram_join.one_of_each(docs.repartition(5)).collect()), key=str)
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_license_scan(spark, odd, empty):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(1, "x\nLicensed under CC BY-NC 4.0.\ny"), (2, "prefix words " + mit.replace("charge", "cost") + " suffix"), (3, "the software is free to use"), (4, None), (5, "MIT License text " * 3)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["best_license"], got[1]["best_coverage"]) == ("CC-BY-NC-4.0-notice", 1.0)
    assert got[2]["best_license"] == "MIT" and 0.9 < got[2]["best_coverage"] < 1
    assert got[3]["n_hits"] == got[4]["n_hits"] == 0 and got[4]["best_license"] is None
    assert license_scan.license_scan(odd).count() == odd.count() and license_scan.license_scan(empty).count() == 0


def _longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        for j, (y, diagonal) in enumerate(zip(b, row[:-1])):
            row[j + 1] = max(row[j] if y != x else 0, row[j + 1], diagonal + (x == y))
    return row[-1]


def test_gaps_without_anchors_are_aligned_whatever_their_size():
    rng = np.random.default_rng(2)
    for n, m in ((5, 7), (130, 90), (300, 90)):
        a, b = (rng.integers(0, 6, k).tolist() for k in (n, m))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(set(pairs)) == len(pairs)
        assert len(license_scan._common(a, b, 0, n, 0, m)) == _longest_common(a, b)
        assert len(license_scan.patience([7, *a, 8], [9, *b, 10])) == _longest_common(a, b)


@pytest.mark.parametrize("changed", [(0,), (0, 9), (43,), (85,), (5, 80)])
def test_close_copies_of_a_license_are_all_hits(changed):
    words = license_scan.TEMPLATES["MIT"].split()
    for k in changed:
        words[k] = "changed"
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    for n in (1, 2, 3, 5, 8):
        hits = scanner.scan(" and then comes ".join([" ".join(words)] * n))
        assert [h[0] for h in hits] == ["MIT"] * n


def test_patience_is_a_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 8, rng.integers(0, 30)).tolist() for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))


def test_token_counts(odd, empty):
    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    n = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    for r in token_counts.token_counts(odd, path, 50).collect():
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id") or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n(text), n(text) > 50)
        assert n(text[: r["cut_chars"]]) <= 50
    counter = token_counts.counter(path)
    for text in ("it's we're 'll  \n x<|endoftext|>y", "  a\t\tb ", "漢字 ½²", TEXTS[6]):
        assert counter.prefixes(text).tolist() == [n(text[:k]) for k in range(len(text) + 1)]
    assert token_counts.token_counts(empty, path, 50).count() == 0


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"own line number {'abcdefghij'[i]} here\nshared boiler plate line\nuser u{i} logged in from host today") for i in range(10)] + [(10, "shared boiler plate line"), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, min_docs=5).collect()}
    assert got[0]["n_dropped"] == 0 and got[0]["text"] == rows[0][1]
    assert all("shared" not in got[i]["text"] and "logged" not in got[i]["text"] for i in range(1, 10))
    assert got[10]["text"] == "" and got[11]["text"] is None and got[12]["text"] == ""
    left = {r["doc_id"] for r in line_dedup.without_recurring_lines(docs, min_docs=5).collect()}
    assert 10 not in left and {11, 12} <= left
    assert line_dedup.line_dedup(odd).count() == odd.count() and line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_keeps_lines_of_other_numbers(spark):
    """Lines of numbers alone recur if they are equal, and not by their number of words; fixed words tell a template."""
    rows = [(i, f"{i} {7 * i} {i * i}\n2024-01-{i + 10}, {i}\n3 1999  88\nserved to host{i} by the old machine") for i in range(12)] + [(12 + i, f"{i + 500} {i} 9") for i in range(12)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[i]["text"] == "\n".join(rows[i][1].split("\n")[:2]) and got[i]["n_dropped"] == 2 for i in range(1, 12))
    assert all(got[i]["text"] == rows[i][1] for i in range(12, 24))
    left = line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left.count() == 24


def test_media(odd, empty):
    rows = media_columns.read_media(media_columns.to_png(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = ((TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id") or "").encode()
        payload = media_columns.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["error"]) == (len(raw), len(payload), None) and len(payload) % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert media_columns.to_png(empty).count() == 0
    png = bytearray(media_columns.write_png(media_columns.padded(b"abc")))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media_columns.read_png(bytes(png))


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_unfilter(channels):
    rng = np.random.default_rng(channels)
    plain = rng.integers(0, 256, (10, 7 * channels), dtype=np.uint8)
    lines = np.zeros((10, 7 * channels + 1), dtype=np.uint8)
    for y in range(10):
        kind = lines[y, 0] = y % 5
        for x in range(7 * channels):
            a = int(plain[y, x - channels]) if x >= channels else 0
            b = int(plain[y - 1, x]) if y else 0
            c = int(plain[y - 1, x - channels]) if y and x >= channels else 0
            p = a + b - c
            nearest = min((a, b, c), key=lambda v: abs(p - v))
            lines[y, x + 1] = (int(plain[y, x]) - (0, a, b, (a + b) // 2, nearest)[kind]) % 256
    assert (media_columns.unfilter(lines, channels) == plain).all()


def test_packing(odd, empty):
    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = best_fit_packing.pack_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), path, 64, with_ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for i, text in enumerate(TEXTS):
        ids = [x for *_, part in sorted(docs[i]) for x in part]
        assert ids == [*own.encode(text or "", add_special_tokens=False).ids, 0]
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert best_fit_packing.pack_documents(empty, path).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    counts = Counter(int(x) for x in rng.integers(1, 2049, 20_000))
    blocks = best_fit_packing.fewest(counts, 2048, best_fit_packing.GROUPS)
    used = Counter()
    for lengths, n in blocks:
        assert sum(k * c for k, c in lengths) <= 2048
        for k, c in lengths:
            used[k] += c * n
    assert used == counts
    assert sum(b.sequences for b in blocks) <= 1.03 * sum(k * v for k, v in counts.items()) / 2048


def test_chat(spark):
    hard = "\\### Assistant: </turn> ok\n#:\\"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, None, None), (2, 0, "a: b#", "x"), (None, 0, "assistant", "é😀")]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as extra"), "conv_id")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted_turns(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{hard}\nassistant\n{hard}\n\n\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(hard), sha(hard))
    assert got[2]["turns_sha256"] == sha("a: b#\nx\n") and got[None]["loss_chars"] == 2
    assert chat_format.read_back(chat_format.formatted_turns(turns.limit(0))).count() == 0


def test_chat_layouts(spark):
    records = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "score": 1}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"instruction": "q", "input": null, "output": "a"}', '{"prompt": "q", "completion": "a"}', '{"question": "q", "answer": "a"}', '{"other": 1}', "broken", None]
    rows = chat_format.canonical_json_turns(spark.createDataFrame(list(enumerate(records)), "id long, record string"), "id", "record").collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["seq"] or 0)):
        by[r["conv_id"]].append((r["role"], r["text"]) if r["error"] is None else None)
    assert [by[i] for i in range(8)] == [[("user", "q"), ("assistant", "a")]] * 5 + [[None]] * 3


def test_sharding(odd, empty, spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('é', cast(id % 50 as int)) as text").unionByName(odd.select("doc_id", "text"))
    rows = sharding.shards(docs, 24, 7).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count() and set(places) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in places.values())
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.shards(docs.repartition(7), 24, 7).collect()), key=str)
    assert sharding.shards(empty, 24, 7).count() == 0
