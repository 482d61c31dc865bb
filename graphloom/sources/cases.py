"""Made texts that meet every rule, in Spark and in SQL alike: one for each part, chosen in turn, and a small rule book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.sources.tables import table


def case_text(texts: tuple[str, ...], turn: str = "p_partkey", name: str = "p_name") -> Column:
    """The text whose turn it is, with the row's name in place of {}."""
    return F.replace(F.get(F.array(*map(F.lit, texts)), F.pmod(F.col(turn), F.lit(len(texts))).cast("int")), F.lit("{}"), F.col(name).cast("string"))


def case_sql(texts: tuple[str | None, ...], turn: str = "p_partkey", name: str = "p_name") -> str:
    """The same choice as an SQL expression; None is null."""
    quoted = lambda t: "NULL" if t is None else "replace('{}', '{{}}', {}::VARCHAR)".format(t.replace("'", "''"), name)
    return f"CASE {turn} % {len(texts)} " + " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in enumerate(texts)) + " END"


#: A document with every kind of component, an id that occurs twice, a section without a title and explanations.
RULE_BOOK = (
    "pembukaan", "BAB I", "KETENTUAN UMUM", "Bagian Kesatu", "Umum", "Pasal 1", "(1) kata pertama", "a. butir satu", "lanjutan butir", "1. angka satu", "(2) kata kedua",
    "Bagian Kedua", "Paragraf 1", "Pasal 2", "isi pasal dua", "BAB II", "PENUTUP", "Pasal 3", "(1) akhir", "PENJELASAN", "ATAS", "UNDANG-UNDANG", "Pasal 1", "cukup jelas",
)
#: What it holds: (type, number, title, id, parent, content, explanation), ids without the document's.
RULE_BOOK_COMPONENTS = (
    ("BAB", "I", "KETENTUAN UMUM", "BAB_I", None, "", False),
    ("BAGIAN", "Kesatu", "Umum", "BAGIAN_Kesatu", "BAB_I", "", False),
    ("PASAL", "1", None, "PASAL_1", "BAGIAN_Kesatu", "", False),
    ("AYAT", "1", None, "AYAT_1", "PASAL_1", "kata pertama", False),
    ("HURUF", "a", None, "HURUF_a", "AYAT_1", "butir satu\nlanjutan butir", False),
    ("ANGKA", "1", None, "ANGKA_1", "HURUF_a", "angka satu", False),
    ("AYAT", "2", None, "AYAT_2", "PASAL_1", "kata kedua", False),
    ("BAGIAN", "Kedua", None, "BAGIAN_Kedua", "BAB_I", "", False),
    ("PARAGRAF", "1", None, "PARAGRAF_1", "BAGIAN_Kedua", "", False),
    ("PASAL", "2", None, "PASAL_2", "PARAGRAF_1", "isi pasal dua", False),
    ("BAB", "II", "PENUTUP", "BAB_II", None, "", False),
    ("PASAL", "3", None, "PASAL_3", "BAB_II", "", False),
    ("AYAT", "1", None, "AYAT_1__PASAL_3", "PASAL_3", "akhir\nPENJELASAN\nATAS\nUNDANG-UNDANG", False),
    ("PASAL", "1", None, "PASAL_1__BAB_II", "BAB_II", "cukup jelas", True),
)


def rule_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, line_no, page, text): the rule book, once for each nation."""
    lines = F.posexplode(F.array(*map(F.lit, RULE_BOOK))).alias("line_no", "text")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("RB_"), F.col("n_nationkey").cast("string")).alias("document_id"), lines)
    return rows.select("document_id", "line_no", F.lit(1).alias("page"), "text")


def _quoted(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else "'{}'".format(str(value).replace("'", "''"))


RULE_BOOK_SQL = f"""book AS (SELECT concat('RB_', n_nationkey) AS document_id, v.* FROM nation, (VALUES {", ".join("(" + ", ".join([str(k), *map(_quoted, row)]) + ")" for k, row in enumerate(RULE_BOOK_COMPONENTS, 1))}) AS v(ord, component_type, number, title, id, parent, content, is_explanation))"""
