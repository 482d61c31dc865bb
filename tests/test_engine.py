"""The graph engine's operators on small rows, and every registered query against its SQL."""

import duckdb
import pytest

from graphloom.functions import text as T
from graphloom.operators import chunking, retrieval
from graphloom.operators.graph import GraphStore
from graphloom.plans.pattern import is_valid, run_query
from graphloom.queries.retrieval import _questions
from graphloom.registry import core_oracles, core_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, duck, name):
    df = core_queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in core_oracles():
        found = duck.execute(core_oracles()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_fold_keeps_words_and_bounds():
    parts = [(" ".join(f"w{i}_{k}" for k in range(n)), f"c{i}", "PASAL", [i]) for i, n in enumerate((10, 400, 300, 5, 900, 2))]
    out = chunking.fold(parts)
    assert {w for t, *_ in out for w in t.split()} == {w for t, *_ in parts for w in t.split()}
    assert chunking.fold([]) == []


def test_isolated_node_and_bad_query(spark):
    nodes = spark.createDataFrame([("a", "T", "x", None, "1", ["Entity", "T"])], "id string, type string, label string, content string, doc string, labels array<string>")
    store = GraphStore(nodes, spark.createDataFrame([], "src string, type string, dst string"))
    assert [r["id"] for r in store.khop(nodes.select("id"), 3)[0].collect()] == ["a"]
    assert run_query(store, "MATCH (n:T) RETURN n.label AS l").collect()[0]["l"] == "x"
    assert "error" in run_query(store, "MATCH (n RETURN n").columns
    assert not is_valid(store, "MATCH (n) RETURN n.none AS x")


def test_text_functions(spark):
    rows = spark.createDataFrame([("PP Nomor 71 Tahun 2019", "2Ol2", "Pasal 5 ayat (2) dan UU No. 11 Tahun 2008")], "name string, raw string, said string")
    r = rows.select(*(c.alias(k) for k, c in T.file_metadata("name").items()), T.clean_ocr_number("raw").alias("digits"), T.citations("said").alias("cited")).first()
    assert (r["document_id"], r["number"], r["year"], r["digits"]) == ("PP_71_2019", "71/2019", 2019, "2012")
    assert r["cited"] == ["Pasal 5 ayat (2)", "UU No. 11 Tahun 2008"]


def test_every_question_is_asked(spark, duck):
    want = duck.execute("select distinct concat(p_brand, '|', p_type), concat('apa itu ', lower(p_type)) from part").fetchall()
    assert sorted(map(tuple, _questions(spark, SF).collect())) == sorted(want)


def test_search_finds_what_brute_force_does(spark):
    parts = ["small brass plate", "large brass pin", "steel plate", "small steel pin", "brass", "copper small brass", "brass ring", "old brass"]
    nodes = [(f"n{k}", "Part", x, None, "1", ["Part"]) for k, x in enumerate(parts)]
    store = GraphStore(spark.createDataFrame(nodes, "id string, type string, label string, content string, doc string, labels array<string>"), None)
    asked = spark.createDataFrame([("a", "apa itu small brass"), ("b", "apa itu steel"), ("c", "apa itu large copper")], "question_id string, question string")
    terms, found = retrieval.search_terms(asked).collect(), {}
    for strategy in (1, 2, 3):
        for r in sorted((r for r in terms if r["strategy"] == strategy and len(r["term"]) > 2), key=lambda r: r["rank"]):
            hits = sorted(i for i, _, x, *_ in nodes if r["term"].lower() in x)[: 5 if strategy == 1 else 3]
            found.setdefault((r["question_id"], strategy), []).extend(hits)
    want = set()
    for q in "abc":
        sure = list(dict.fromkeys(found.get((q, 1), []) + found.get((q, 2), [])))
        every = list(dict.fromkeys(sure + (found.get((q, 3), []) if len(sure) < 3 else [])))
        want |= {(q, i, n) for n, i in enumerate(every[:10], 1)}
    assert want and {(r["question_id"], r["id"], r["nth"]) for r in retrieval.multi_search(asked, store).collect()} == want
