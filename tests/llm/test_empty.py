"""Every stage and the whole pipeline over empty tables and over rows without ids and texts; line dedup's rows without ids."""

import pytest

import corpus_pipeline
from graphloom.llm import line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{out}/labels.parquet")
    return str(out)


@pytest.mark.parametrize("k", range(4))
def test_stages_over_empty_tables(spark, folder, k):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    assert out.count() == 0 and (k == 3 or out.columns == docs.columns)


def test_run_over_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_over_rows_without_ids_and_texts(spark, folder):
    rows = spark.createDataFrame([(None, None, None, None, None, "x"), (None, "", None, None, None, "x"), (1, None, None, None, None, None)], DOCS)
    counts = [stage(spark, rows, folder).count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [0, 3, 3, 3]


def test_line_dedup_of_rows_without_ids_and_repeated_ids(spark):
    line = "a line that very many documents have"
    rows = [(i, f"{line}\nown {'abcdefghijkl'[i]} line") for i in range(12)] + [(None, f"{line}\nnobody else has this"), (None, "only here"), (None, "only here"), (3, f"{line}\nanother text of three")]
    got = [tuple(r) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_dropped").collect()]
    assert sorted(got, key=str) == sorted(
        [(0, rows[0][1], 0), *((i, rows[i][1].split("\n")[1], 1) for i in range(1, 12)), (None, "nobody else has this", 1), (None, "only here", 0), (None, "only here", 0), (3, "another text of three", 1)], key=str)
