"""Outside services in their offline forms: files by a pattern, pages with a recogniser, sheets, prompts; dates and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.plans.scratch import scratch_dir
from graphloom.registry import query
from graphloom.sources import adapters
from graphloom.sources.cases import case_sql, case_text
from graphloom.sources.tables import table

Spark = SparkSession


@query("SELECT n_name AS text, length(n_name)::BIGINT + 1 AS length FROM nation WHERE n_nationkey % 2 = 0")
def src_glob(spark: Spark, sf_dir: str) -> DataFrame:
    """The files of even nations, by a pattern of folders and one of names, with a table's files of another kind beside them."""
    folder, nation = f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}", table(spark, sf_dir, "nation")
    nation.select("n_name", (F.col("n_nationkey") % 2).alias("odd"), "n_nationkey").write.partitionBy("odd", "n_nationkey").text(folder)
    nation.write.mode("append").parquet(f"{folder}/odd=0/n_nationkey=other")
    return adapters.files(spark, f"{folder}/odd=0/*", "part-*.txt").select(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")).alias("text"), "length")


@query("""WITH p AS (SELECT p_partkey, 1 AS page, p_name AS t FROM part UNION ALL SELECT p_partkey, 2, repeat(concat(p_type, ' '), 5) FROM part)
SELECT p_partkey, page AS page_number, length(trim(t)) < 50 AS is_scanned, CASE WHEN length(trim(t)) < 50 THEN concat('scan of page ', page) ELSE t END AS text FROM p""")
def ocr_fallback(spark: Spark, sf_dir: str) -> DataFrame:
    """Pages of too little text take the recogniser's."""
    content = F.concat("p_name", F.lit("\f"), F.repeat(F.concat("p_type", F.lit(" ")), F.lit(5))).cast("binary")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    pages = adapters.pages_of(rows, lambda raw: raw.decode().split("\f"), lambda raw, k: f"scan of page {k}")
    return pages.select(F.col("path").cast("long").alias("p_partkey"), "page_number", "is_scanned", F.when(F.col("is_scanned"), F.col("ocr_text")).otherwise(F.col("selectable_text")).alias("text"))


_CELLS = ("{}", "NA", "", "N/A", "12", "1.5")


@query(f"SELECT p_partkey, ({case_sql((None, None, None, None, '12', None))})::INT AS whole, ({case_sql((None, None, None, None, '12', '1.5'))})::DOUBLE AS number, {case_sql(('{}', None, None, None, '12', '1.5'))} AS text FROM part")
def src_sheet(spark: Spark, sf_dir: str) -> DataFrame:
    cell = case_text(_CELLS)
    sheet = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), cell.alias("whole"), cell.alias("number"), cell.alias("text"))
    return adapters.sheet_table(sheet, {"p_partkey": "long", "whole": "int", "number": "double"})


@query("SELECT count(*) FILTER (p_partkey % 50 <> 0) AS sent, count(*) FILTER (p_partkey % 50 = 0) AS failed FROM part")
def sink_sheet(spark: Spark, sf_dir: str) -> DataFrame:
    """Rows sent one by one to a sheet that refuses some keys."""

    def append(values: list[list]) -> None:
        if any(row[0] % 50 == 0 for row in values):
            raise ValueError("refused")

    return adapters.sheet_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), append, batch=1, attempts=1, wait=0)


@query("SELECT concat('prompt of ', r_name, ': {text}') AS prompt, concat('prompt of ', r_name, ': ASIA {x}') AS filled FROM region WHERE r_regionkey = 2")
def lookup_prompt(spark: Spark, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "region").select(F.concat(F.lit("P"), F.col("r_regionkey").cast("string")).alias("PROMPT_ID"), F.concat(F.lit("prompt of "), "r_name", F.lit(": {text}")).alias("PROMPT_TEXT"))
    found = adapters.prompt(sheet, "P2")
    return spark.createDataFrame([(found, adapters.filled_prompt(found, text="ASIA {x}"))], "prompt string, filled string")


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE value > 50 EXCEPT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND event_type = 'purchase'")
def set_operations(spark: Spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    users = lambda where: events.where(where).select("user_id")
    return users("event_type = 'click'").intersect(users("value > 50")).exceptAll(users("ts >= timestamp_ntz'2024-01-29' and event_type = 'purchase'").distinct())


@query("SELECT strftime(ts, '%Y-%m') AS month, date_part('isodow', ts)::INT AS weekday, count(*) AS n, max(date_diff('day', TIMESTAMP '2024-01-01', ts))::INT AS last_day FROM events GROUP BY 1, 2")
def calendar_counts(spark: Spark, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    rows = table(spark, sf_dir, "events").select(F.date_format(ts, "yyyy-MM").alias("month"), (F.weekday(ts) + 1).cast("int").alias("weekday"), F.date_diff(ts.cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
    return rows.groupBy("month", "weekday").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 6 HOUR""")
def range_join(spark: Spark, sf_dir: str) -> DataFrame:
    """What a user does within six hours: hours in spans of six make the range a join by key, each row meeting two spans."""
    events = table(spark, sf_dir, "events").withColumn("span", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (6 * 3600)))
    first = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("at"), F.explode(F.array("span", F.col("span") + 1)).alias("span"))
    later = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), "ts", "span")
    return first.join(later, ["user_id", "span"]).where("ts >= at and ts < at + interval 6 hours").select("a", "b")
