"""Documents through named stages: one job a stage over all documents, stage tables, resume, status, rejects."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Stage:
    """A step from a stage's table, the one before if none is named; ``rejects`` tells which document ids must be left out, and why."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    rejects: Callable[[DataFrame], DataFrame] | None = None
    source: str | None = None


_DONE = "document_id string, batch string, reason string"


class Runner:
    """Stages over a folder of tables, each with a column ``document_id``. What a stage has done isn't done again.

    A run of a stage writes its rows as a batch and then which documents the batch has done. Only rows of documents so
    marked with that batch count: a run that dies between the two writes, or within one, leaves nothing that is read.
    Rejected documents and those without rows are marked as well, so that neither is taken again.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: list[Stage]) -> None:
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def done(self, name: str) -> DataFrame:
        """(document_id, batch, reason) of the documents that a stage has done; of several marks the least counts."""
        if not self._there(f"_done/{name}"):
            return self.spark.createDataFrame([], _DONE)
        rows = self.spark.read.schema(_DONE).parquet(self.path(f"_done/{name}"))
        return rows.groupBy("document_id").agg(F.min(F.struct("batch", "reason")).alias("m")).select("document_id", "m.batch", "m.reason")

    def table(self, name: str) -> DataFrame | None:
        if not self._there(name):
            return None
        return self.spark.read.parquet(self.path(name)).join(self.done(name).where("reason is null").select("document_id", "batch"), ["document_id", "batch"], "left_semi").drop("batch")

    def run(self, documents: DataFrame, only: list[str] | None = None, upto: str | None = None) -> DataFrame:
        """The status rows of this run. only: ids to take (unknown ones are an error); upto: the last stage, for a dry run."""
        if only is not None:
            wanted = self.spark.createDataFrame([(i,) for i in only], "document_id string")
            unknown = [r[0] for r in wanted.join(documents, "document_id", "left_anti").limit(20).collect()]
            if unknown:
                raise ValueError(f"unknown documents: {unknown}")
            documents = documents.join(wanted, "document_id", "left_semi")
        source = documents
        ids = documents.select("document_id").distinct()
        for stage in self.stages:
            ids = self._stage(stage, source if stage.source is None else self.table(stage.source), ids)
            source = self.table(stage.name)
            if stage.name == upto:
                break
        return self.status(documents)

    def _stage(self, stage: Stage, source: DataFrame, ids: DataFrame) -> DataFrame:
        """Does what is left for the documents of ``ids``, and returns those that no stage so far has rejected."""
        batch = uuid.uuid4().hex
        todo_ids = pending(ids, self.done(stage.name))
        todo = source.join(todo_ids, "document_id", "left_semi")
        bad = self.spark.createDataFrame([], "document_id string, reason string")
        if stage.rejects is not None:
            found = stage.rejects(todo).groupBy("document_id").agg(F.min(F.coalesce("reason", F.lit("rejected"))).alias("reason"))
            found.write.parquet(self.path(f"_rejected/{stage.name}/{batch}"))  # judged once, and read by both writes below
            bad = self.spark.read.schema("document_id string, reason string").parquet(self.path(f"_rejected/{stage.name}/{batch}"))
        stage.run(todo.join(bad, "document_id", "left_anti")).withColumn("batch", F.lit(batch)).write.mode("append").parquet(self.path(stage.name))
        marks = todo_ids.select(F.col("document_id").cast("string").alias("document_id"), F.lit(batch).alias("batch")).join(bad, "document_id", "left")
        marks.write.mode("append").parquet(self.path(f"_done/{stage.name}"))
        return ids.join(self.done(stage.name).where("reason is not null"), "document_id", "left_anti")

    def status(self, documents: DataFrame) -> DataFrame:
        """(document_id, step, step_name, status): the last stage that each document has passed, "error" where one rejected it."""
        out = documents.select("document_id").distinct().withColumns({"step": F.lit(0), "step_name": F.lit("none"), "bad": F.lit(False)})
        for k, stage in enumerate(self.stages, 1):
            here = self.done(stage.name).select("document_id", F.col("reason").isNull().alias("passed"))
            out = out.join(here, "document_id", "left").withColumns({
                "step": F.when(F.col("passed"), k).otherwise(F.col("step")), "step_name": F.when(F.col("passed"), stage.name).otherwise(F.col("step_name")),
                "bad": F.col("bad") | F.coalesce(~F.col("passed"), F.lit(False)),
            }).drop("passed")
        state = F.when(F.col("step") == len(self.stages), "complete").when(F.col("bad"), "error").when(F.col("step") > 0, "running").otherwise("pending")
        return out.withColumn("status", state).drop("bad")


def pending(source: DataFrame, done: DataFrame | None) -> DataFrame:
    """The rows whose document a stage table doesn't hold yet."""
    return source if done is None else source.join(done.select("document_id").distinct(), "document_id", "left_anti")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
