"""Status, resume and selection of documents, formats that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.plans import stages
from graphloom.plans.scratch import scratch_dir, written
from graphloom.registry import query
from graphloom.sources.tables import table

Spark = SparkSession


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def sink_status(spark: Spark, sf_dir: str) -> DataFrame:
    return stages.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_skip(spark: Spark, sf_dir: str) -> DataFrame:
    docs, done = (table(spark, sf_dir, t).select(F.col("doc_id").alias("document_id")) for t in ("documents", "labels"))
    return stages.pending(docs, done)


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def doc_filter(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id::VARCHAR AS document_id, CASE WHEN n_chars < 20 THEN 0 ELSE 2 END AS step, CASE WHEN n_chars < 20 THEN 'error' ELSE 'complete' END AS status FROM documents")
def run_batch(spark: Spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", "n_chars")
    short = lambda rows: rows.where("n_chars < 20").select("document_id", F.lit("too short").alias("reason"))
    steps = [stages.Stage("lines", lambda x: x.select("document_id", F.explode(F.split("text", "\n")).alias("line")), short), stages.Stage("counts", lambda x: x.groupBy("document_id").agg(F.count("*").alias("n")))]
    return stages.Runner(spark, f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}", steps).run(docs).select("document_id", "step", "status")


@query("SELECT event_id, event_type, value FROM events")
def src_json(spark: Spark, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), f"{scratch_dir(spark)}/json-{uuid.uuid4().hex}"
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def src_csv(spark: Spark, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("SELECT conv_id, turn, text FROM conversations")
def sink_json(spark: Spark, sf_dir: str) -> DataFrame:
    return written(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "sink")
