"""References that texts make to documents and articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphloom.functions import text as T

# Name, pattern (any case), type, prefix of the document meant.
PATTERNS = (
    ("UU_REF", r"Undang[_\-\s]?Undang\s+(?:Nomor|No\.?)\s*(\S+)\s+Tahun\s+(\d{4})", "MERUJUK_DOKUMEN", "UU"),
    ("PP_REF", r"Peraturan\s+Pemerintah\s+(?:Nomor|No\.?)\s*(\S+)\s+Tahun\s+(\d{4})", "MERUJUK_DOKUMEN", "PP"),
    ("PERPRES_REF", r"Peraturan\s+Presiden\s+(?:Nomor|No\.?)\s*(\S+)\s+Tahun\s+(\d{4})", "MERUJUK_DOKUMEN", "Perpres"),
    ("PERMEN_REF", r"Peraturan\s+Menteri\s+\w+\s+(?:Nomor|No\.?)\s*(\S+)\s+Tahun\s+(\d{4})", "MERUJUK_DOKUMEN", "Permen"),
    ("AMEND_UBAH", r"(?:Ketentuan\s+)?Pasal\s+(\d+[A-Z]?)\s+(?:diubah|tetap\s+dengan\s+perubahan)", "MENGUBAH_PASAL", None),
    ("AMEND_SISIP", r"[Dd]i\s*antara\s+(?:Pasal|ayat|angka)\s+(\S+)\s+dan\s+(?:Pasal|ayat|angka)\s+(\S+)\s+disisipkan", "MENYISIPKAN_PASAL", None),
    ("AMEND_HAPUS", r"Pasal\s+(\d+[A-Z]?)\s+dihapus", "MENGHAPUS_PASAL", None),
    ("INTERNAL_PASAL_REF", r"sebagaimana\s+dimaksud\s+(?:dalam|pada)\s+Pasal\s+(\d+[A-Z]?)", "MERUJUK_PASAL", None),
)


def resolved(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """With ``target_doc_id`` and ``is_known``: prefix, number and year as a document's id; a ministry's rule goes by its full prefix if that is known."""
    plain = F.concat_ws("_", "prefix", T.clean_ocr_number("number"), T.clean_ocr_number("year"))
    full = F.concat_ws("_", F.lit("Permen_Kominfo"), T.clean_ocr_number("number"), T.clean_ocr_number("year"))
    known = registry.select(F.col("doc_id").alias("__k")).distinct()
    rows = rows.withColumns({"__plain": plain, "__full": F.when(F.col("prefix") == "Permen", full)})
    rows = rows.join(known.withColumnRenamed("__k", "__plain").withColumn("__kp", F.lit(True)), "__plain", "left").join(known.withColumnRenamed("__k", "__full").withColumn("__kf", F.lit(True)), "__full", "left")
    target = F.when(F.col("__kp"), F.col("__plain")).otherwise(F.coalesce("__full", "__plain"))
    whole = (T.clean_ocr_number("number") != "") & (T.clean_ocr_number("year") != "")
    return rows.withColumns({"target_doc_id": F.when(F.col("prefix").isNotNull() & whole, target), "is_known": F.coalesce("__kp", "__kf", F.lit(False))}).drop("__plain", "__full", "__kp", "__kf")


def detected(rows: DataFrame, doc_col: str = "document_id", id_col: str = "component_id", text_col: str = "text") -> DataFrame:
    """(document_id, component_id, type, pattern, prefix, number, year, source_text): every match of every pattern, by functions of columns."""
    parts = []
    for name, pattern, kind, prefix in PATTERNS:
        rule = "(?i)" + pattern
        found = rows.where(F.col(text_col).rlike(rule)).select(F.col(doc_col).alias("document_id"), F.col(id_col).alias("component_id"), F.explode(F.regexp_extract_all(text_col, F.lit(rule), F.lit(0))).alias("m"))
        two = pattern.count("(") - pattern.count("(?:") == 2
        parts.append(found.select("document_id", "component_id", F.lit(kind).alias("type"), F.lit(name).alias("pattern"), F.lit(prefix).cast("string").alias("prefix"), F.regexp_extract("m", rule, 1).alias("number"), (F.regexp_extract("m", rule, 2) if two else F.lit(None).cast("string")).alias("year"), F.substring("m", 1, 200).alias("source_text")))
    return reduce(DataFrame.unionByName, parts)


def positions(rows: DataFrame, doc_col: str = "document_id", id_col: str = "component_id", text_col: str = "text") -> DataFrame:
    """(document_id, component_id, pattern, match_position): where the matches begin, as the lengths of the pieces between
    matches and of the matches before add up."""
    parts = []
    for name, pattern, _, _ in PATTERNS:
        rule = "(?i)" + pattern
        found = rows.where(F.col(text_col).rlike(rule)).select(F.col(doc_col).alias("document_id"), F.col(id_col).alias("component_id"), F.split(text_col, rule).alias("p"), F.regexp_extract_all(text_col, F.lit(rule), F.lit(0)).alias("m"))
        upto = lambda column, n: F.length(F.array_join(F.slice(column, F.lit(1), n), ""))
        places = F.transform("m", lambda _, i: upto("p", i + 1) + upto("m", i))
        parts.append(found.select("document_id", "component_id", F.lit(name).alias("pattern"), F.explode(places).alias("match_position")))
    return reduce(DataFrame.unionByName, parts)


def summary(refs: DataFrame) -> DataFrame:
    return refs.groupBy("type").agg(F.count("*").alias("n"))
