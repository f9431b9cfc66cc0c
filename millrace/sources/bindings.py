"""The driver's tables as traces, quality data, matrices and run intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT = ["recipe", "stage", "recipe_step_num"]
TRACE_SIGNALS = ["value", "k"]
LINE_SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: one sample a row, signals ``value`` and ``k``; a run is a quarter of a day."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    stage = F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string"))
    return e.select(
        ts.alias("processed_time"),
        F.date_format(ts, "yyyyMMdd").alias("lot"),
        F.col("event_type").alias("recipe"),
        stage.alias("stage"),
        F.floor(F.hour(ts) / 6).cast("string").alias("wafer_no"),
        stage.alias("system_label"),
        F.lit(1).alias("recipe_step_num"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def line_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: several signals, days for times."""
    x = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp")
    return x.select(ts.alias("processed_time"), F.col("l_suppkey").cast("string").alias("lot"), F.col("l_returnflag").alias("recipe"), F.col("l_linestatus").alias("stage"), F.year(ts).cast("string").alias("wafer_no"), F.col("l_linestatus").alias("system_label"), F.col("l_linenumber").cast("int").alias("recipe_step_num"), *LINE_SIGNALS)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    keys = [F.col("l_suppkey").cast("string").alias("lot"), F.year(F.col("l_shipdate").cast("timestamp")).cast("string").alias("wafer_no")]
    return x.groupBy(*keys).agg((100.0 * F.avg((~returned).cast("double"))).alias("yield_pct"), F.count_if(returned).cast("double").alias("defect_count"), F.lit(None).cast("string").alias("bin"))


def user_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of activity of each user and day, as (machine, start_ms, end_ms)."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("machine"), "user_id", F.to_date(ts).alias("day"))
    return e.agg(F.unix_millis(F.min(ts)).alias("start_ms"), F.unix_millis(F.max(ts)).alias("end_ms")).select("machine", "start_ms", "end_ms")
