"""Stages that resume, that die between two writes, and that reject; whole documents; adapters; streams."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import answering, triples
from graphloom.operators.graph import GraphStore
from graphloom.plans import documents
from graphloom.plans.pattern import run_query
from graphloom.plans.stages import Runner, Stage
from graphloom.sources import adapters
from graphloom.sources.cases import RULE_BOOK
from graphloom.streaming import incremental


def _stages():
    short = lambda rows: rows.where("length(text) < 3").select("document_id", F.lit("too short").alias("reason"))
    return [
        Stage("lines", lambda x: x.select("document_id", F.explode(F.split("text", "\n")).alias("line")), short),
        Stage("long", lambda x: x.where("length(line) > 4")),
        Stage("counts", lambda x: x.groupBy("document_id").agg(F.count("*").alias("n")), source="lines"),
    ]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("a", "one line\nother line"), ("b", "x"), ("c", "abc\nd"), ("d", "")], "document_id string, text string")


def test_resume_does_nothing_again(spark, docs, tmp_path):
    runner = Runner(spark, str(tmp_path), _stages())
    first = {r["document_id"]: (r["step"], r["status"]) for r in runner.run(docs.where("document_id <> 'c'")).collect()}
    assert first == {"a": (3, "complete"), "b": (0, "error"), "d": (0, "error")}
    files = {p: set(os.listdir(tmp_path / p)) for p in ("lines", "counts")}
    status = {r["document_id"]: (r["step"], r["status"]) for r in runner.run(docs).collect()}
    # A document without rows in a stage has passed it all the same, and is not taken again.
    assert status == first | {"c": (3, "complete")}
    assert {r["document_id"]: r["n"] for r in runner.table("counts").collect()} == {"a": 2, "c": 2}
    assert [r["line"] for r in runner.table("long").orderBy("line").collect()] == ["one line", "other line"]
    assert all(files[p] < set(os.listdir(tmp_path / p)) for p in files)
    marks = spark.read.parquet(str(tmp_path / "_done" / "lines"))
    assert marks.count() == 4 and marks.where("reason is not null").count() == 2
    runner.run(docs)
    assert spark.read.parquet(str(tmp_path / "_done" / "lines")).count() == 4


def test_a_run_that_died_between_two_writes_leaves_nothing(spark, docs, tmp_path):
    runner = Runner(spark, str(tmp_path), _stages())
    half = spark.createDataFrame([("a", "half a line", "dead")], "document_id string, line string, batch string")
    half.write.parquet(runner.path("lines"))
    assert runner.table("lines").count() == 0
    runner.run(docs)
    assert sorted(r["line"] for r in runner.table("lines").where("document_id = 'a'").collect()) == ["one line", "other line"]
    assert {r["document_id"]: r["n"] for r in runner.table("counts").collect()} == {"a": 2, "c": 2}


def test_selection_and_dry_run(spark, docs, tmp_path):
    runner = Runner(spark, str(tmp_path), _stages())
    with pytest.raises(ValueError, match="unknown documents"):
        runner.run(docs, only=["a", "zzz"])
    status = runner.run(docs, only=["a"], upto="lines").collect()
    assert [(r["document_id"], r["step"], r["status"]) for r in status] == [("a", 1, "running")]
    assert runner.table("counts") is None
    assert runner.run(docs.limit(0)).count() == 0


def test_documents_without_answers_pass_all_steps(spark, tmp_path):
    pages = spark.createDataFrame([("x", 1, "\n".join(RULE_BOOK)), ("y", 1, None), ("z", 1, "no header at all")], "document_id string, page_number int, text string")
    recorded = spark.createDataFrame([], "chunk_id string, answer string")
    runner = Runner(spark, str(tmp_path), documents.document_stages(recorded))
    status = {r["document_id"]: (r["step"], r["status"]) for r in runner.run(pages).collect()}
    assert status == {"x": (9, "complete"), "y": (0, "error"), "z": (9, "complete")}
    assert runner.table("load_graph").count() == 0 and runner.table("create_chunks").count() == 1


def test_pages_and_recognition(spark, tmp_path):
    for name, text in (("a.txt", "page one has enough of text to be read as it is, surely\fx"), ("b.txt", "\f"), ("c.bin", "left out")):
        (tmp_path / name).write_text(text)
    rows = adapters.files(spark, str(tmp_path), "*.txt")
    read = lambda raw: raw.decode().split("\f")
    got = {(r["path"][-5:], r["page_number"]): (r["ocr_text"], r["is_scanned"]) for r in adapters.pages_of(rows, read, lambda raw, k: f"scan {k}").collect()}
    assert got == {("a.txt", 1): (None, False), ("a.txt", 2): ("scan 2", True), ("b.txt", 1): ("scan 1", True), ("b.txt", 2): ("scan 2", True)}
    assert all(r["ocr_text"] is None for r in adapters.pages_of(rows, read).collect())


def test_sheets_and_prompts(spark):
    sheet = spark.createDataFrame([("1", "2.5", "2024-01-02 03:04:05", "x"), ("NA", "no number", "", "N/A"), (None, None, None, None)], "n string, v string, at string, t string")
    rows = adapters.sheet_table(sheet, {"n": "int", "v": "double", "at": "timestamp"}).collect()
    assert [(r["n"], r["v"], r["t"]) for r in rows] == [(1, 2.5, "x"), (None, None, None), (None, None, None)]
    assert str(rows[0]["at"]) == "2024-01-02 03:04:05" and rows[1]["at"] is None
    assert tuple(adapters.sheet_rows(sheet, lambda values: None, batch=2, wait=0).first()) == (3, 0)

    def refuse(values):
        raise OSError("no service")

    assert tuple(adapters.sheet_rows(sheet, refuse, batch=2, attempts=2, wait=0).first()) == (0, 3)
    prompts = spark.createDataFrame([("P1", "Read {text}"), ("P2", "x")], "PROMPT_ID string, PROMPT_TEXT string")
    assert adapters.filled_prompt(adapters.prompt(prompts, "P1"), text="{this}") == "Read {this}"
    with pytest.raises(KeyError, match="P2"):
        adapters.prompt(prompts, "P3")


def test_calls_are_tried_again(spark):
    tries = []

    def call(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise ValueError("not yet")
        return prompt.upper()

    assert adapters.with_retries(call, 3, 0)("a") == ("A", None)
    tries.clear()
    assert adapters.with_retries(call, 2, 0)("a") == (None, "ValueError: not yet")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert sorted((r["id"], r["answer"], r["error"]) for r in adapters.answered(rows, str.upper).collect()) == [(1, "A", None), (2, "B", None)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 4}", f"2024-01-01 0{k}:10:00", k) for k in range(8)], "doc string, at string, v int").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    incremental.by_batch(stream(), lambda b: b.groupBy("doc").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert {r["doc"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {f"d{k}": 2 for k in range(4)}
    for name, made, mode in (("seen", incremental.first_seen(stream(), ["doc"], "at"), "append"), ("counts", incremental.tumbling_counts(stream(), "at", "doc", "2 hours"), "complete")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["doc"] for r in spark.table("seen").collect()) == ["d0", "d1", "d2", "d3"]
    assert sum(r["n"] for r in spark.table("counts").collect()) == 8 and spark.table("counts").count() == 8


@pytest.fixture(scope="module")
def law(spark):
    nodes = [("b1", "Bab", "BAB XI", None), ("g1", "Bagian", "Bagian Kesatu", None), ("p27", "Pasal", "Pasal 27", "isi 27"), ("p3", "Pasal", "Pasal 3", "isi 3"), ("p30", "Pasal", "Pasal 30", None), ("y1", "Ayat", "Pasal 27 ayat (1)", "isi ayat"), ("p45", "Pasal", "Pasal 45", None), ("s1", "Sanksi", "penjara 6 tahun", None), ("h1", "PerbuatanHukum", "Pencemaran nama baik", None), ("k1", "KonsepHukum", "Informasi Elektronik", "satu data"), ("e1", "EntitasHukum", "Setiap Orang", None)]
    rows = [(i, t, label, content, "UU_11_2008", ["Entity", t]) for i, t, label, content in nodes]
    edges = [("b1", "MEMUAT", "p3"), ("b1", "MEMUAT", "g1"), ("g1", "MEMUAT", "p27"), ("p27", "MEMILIKI_AYAT", "y1"), ("p27", "MENGATUR", "h1"), ("p45", "MERUJUK", "p27"), ("p45", "MENETAPKAN_SANKSI", "s1"), ("p3", "MENDEFINISIKAN", "k1"), ("p45", "BERLAKU_UNTUK", "e1")]
    return GraphStore(spark.createDataFrame(rows, "id string, type string, label string, content string, doc string, labels array<string>"), spark.createDataFrame(edges, "src string, type string, dst string"))


@pytest.mark.parametrize(("asked", "want"), [
    ("Apa sanksi pencemaran nama baik?", [("Pasal 45", "Pasal 27", "penjara 6 tahun")]), ("Berapa denda untuk Pasal 27?", [("Pasal 45", "Pasal 27", "penjara 6 tahun")]), ("Pasal apa saja di Bab XI?", [("BAB XI", "Pasal 27", "isi 27"), ("BAB XI", "Pasal 3", "isi 3")]),
    ("Apa definisi informasi elektronik?", [("Pasal 3", "Informasi Elektronik", "satu data")]), ("Pasal 45 berlaku untuk siapa?", [("Pasal 45", "Setiap Orang")]), ("Pasal apa yang merujuk ke Pasal 27?", [("Pasal 45", "Pasal 27")]),
    ("Pasal 27 ayat berapa saja?", [("Pasal 27", "Pasal 27 ayat (1)", "isi ayat")]), ("Pasal 3 ada di bab berapa?", [("BAB XI", "Pasal 3")]), ("Apa yang diatur dalam Pasal 27?", [("Pasal 27", "Pencemaran nama baik", None)]),
    ("Apa bunyi Pasal 3?", [("Pasal 3", "isi 3")]), ("Apa saja perbuatan yang dilarang?", [("Pasal 27", "Pencemaran nama baik")]), ("Siapa itu Orang?", [(["Entity", "EntitasHukum"], "Setiap Orang", None)]),
])
def test_questions_find_their_answers(spark, law, asked, want):
    rows = spark.createDataFrame([(1, asked)], "id long, question string")
    for docs in (None, ["UU_11_2008", "it's \\ odd"], ["UU_1_1"]):
        r = answering.nl_to_query(rows, docs).first()
        assert r["status"] == "ok"
        assert [tuple(x) for x in run_query(law, r["query"]).collect()] == ([] if docs == ["UU_1_1"] else want), r["query"]


def test_articles_meet_labels_by_whole_words(spark):
    labels = ["Pasal 2", "Pasal 27", "lihat pasal 2 ayat", "", None, "Pasal  2", "x Pasal 2"]
    nodes = spark.createDataFrame([("d", f"n{k}", x) for k, x in enumerate(labels)] + [("e", "other", "Pasal 2")], "doc string, id string, label string")
    wanted = spark.createDataFrame([("d", "Pasal 2"), ("d", "Pasal 2"), ("d", "ayat"), ("f", "Pasal 2")], "doc string, article string")
    got = sorted(tuple(r) for r in triples.labelled_in_document(nodes, wanted).collect())
    assert got == sorted(("d", a, f"n{k}") for a in ("Pasal 2", "ayat") for k, x in enumerate(labels) if x is not None and f" {a.lower()} " in f" {x.lower()} ")
    assert triples.labelled_in_document(nodes, wanted.limit(0)).count() == 0
