"""The closed world of node and edge types, as tables that are small at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Node types, and edge types with the types that their ends may have.
NODE_TYPES = ("Regulasi", "Bab", "Bagian", "Pasal", "Ayat", "EntitasHukum", "PerbuatanHukum", "Sanksi", "KonsepHukum")
EDGE_TYPES = {
    "MEMUAT": (("Regulasi", "Bab", "Bagian"), ("Bab", "Bagian", "Pasal")),
    "MEMILIKI_AYAT": (("Pasal",), ("Ayat",)),
    "MENGATUR": (("Pasal", "Ayat"), ("PerbuatanHukum",)),
    "MENETAPKAN_SANKSI": (("Pasal", "Ayat"), ("Sanksi",)),
    "BERLAKU_UNTUK": (("Pasal", "Ayat", "Regulasi"), ("EntitasHukum",)),
    "MERUJUK": (("Pasal", "Ayat"), ("Pasal", "Ayat", "Regulasi")),
    "MENDEFINISIKAN": (("Pasal", "Ayat"), ("KonsepHukum",)),
}


def node_types(spark: SparkSession, types: tuple[str, ...] = NODE_TYPES) -> DataFrame:
    return spark.createDataFrame([(t,) for t in types], "type string")


def edge_constraints(spark: SparkSession, types: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = EDGE_TYPES) -> DataFrame:
    """(type, src_type, dst_type): every allowed combination."""
    return spark.createDataFrame([(t, a, b) for t, (sources, targets) in types.items() for a in sources for b in targets], "type string, src_type string, dst_type string")


def ontology_markdown(types: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = EDGE_TYPES) -> str:
    rows = [f"| {t} | {', '.join(a)} | {', '.join(b)} |" for t, (a, b) in types.items()]
    return "\n".join(["| edge | from | to |", "|---|---|---|", *rows])
