"""Over-representation of anomalies among lots, chambers, recipes and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.signals import context_key
from millrace.functions.stats import finite, pearson, two_proportion_z

DIMENSIONS = ["recipe", "stage", "step", "chamber", "lot", "date"]
MIN_GROUP = 4


def commonality_rows(indicators: DataFrame, signal: str | None, indicator: str, recipe: str | None = None) -> DataFrame:
    """The values of a signal's indicator with the dimensions of each, keys kept on the row.

    Without a signal, those of all signals; each is a context of its own then.
    """
    df = indicators.where(finite(F.col(indicator)))
    if signal is not None:
        df = df.where(F.col("signal") == signal)
    if recipe is not None:
        df = df.where(F.col("recipe") == recipe)
    return df.select(
        context_key(F.col("recipe"), F.col("stage"), F.col("recipe_step_num"), F.col("signal") if signal is None else None).alias("context"), F.col(indicator).alias("value"), "lot", "wafer_no", "start_time",
        "recipe", "stage", F.col("recipe_step_num").cast("string").alias("step"), F.col("system_label").alias("chamber"), F.date_format("start_time", "yyyy-MM-dd").alias("date"),
    )


def mark_anomalies(rows: DataFrame, k: float = 3.5) -> DataFrame:
    """Robust z scores by context: from the median absolute deviation, else the quartiles, else the standard deviation.

    Contexts of fewer than four rows, or without spread, have no anomalies.
    """
    by = Window.partitionBy("context")
    v = F.col("value")
    quart = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(by)
    df = rows.withColumns({"q": quart, "size": F.count("*").over(by), "sd": F.coalesce(F.stddev_samp(v).over(by), F.lit(0.0))})
    df = df.withColumn("median", F.col("q")[1])
    mad = F.percentile(F.abs(v - F.col("median")), 0.5).over(by) / 0.6745
    df = df.withColumn("mad", mad)
    iqr = (F.col("q")[2] - F.col("q")[0]) / 1.349
    sigma = F.when(F.col("mad") > 0, F.col("mad")).when(iqr > 0, iqr).otherwise(F.col("sd"))
    sigma = F.when(sigma > 1e-9 * (F.abs("median") + 1), sigma).otherwise(0.0)
    df = df.withColumn("robust_sigma", sigma)
    z = F.when((F.col("size") >= MIN_GROUP) & (F.col("robust_sigma") > 0), (v - F.col("median")) / F.nullif(F.col("robust_sigma"), F.lit(0.0))).otherwise(0.0)
    return df.withColumn("z", z).withColumn("is_bad", F.abs("z") > k).drop("q", "size", "sd", "mad")


def findings(marked: DataFrame, dimensions: list[str] | None = None, min_support: int = 3) -> DataFrame:
    """Each value of each dimension: its shares of bad and good rows, their gap and its significance."""
    dims = dimensions or DIMENSIONS
    totals = marked.agg(F.count_if("is_bad").alias("n_bad"), F.count_if(~F.col("is_bad")).alias("n_good"))
    long = marked.select("is_bad", *dims).unpivot(["is_bad"], dims, "dimension", "value").where(F.col("value").isNotNull())
    df = long.groupBy("dimension", "value").agg(F.count_if("is_bad").alias("bad_count"), F.count_if(~F.col("is_bad")).alias("good_count"))
    df = df.where(F.col("bad_count") + F.col("good_count") >= min_support).join(F.broadcast(totals))  # one row
    bad = F.coalesce(F.try_divide("bad_count", "n_bad"), F.lit(0.0))
    good = F.coalesce(F.try_divide("good_count", "n_good"), F.lit(0.0))
    z = two_proportion_z(F.col("bad_count"), F.nullif(F.col("n_bad"), F.lit(0)), F.col("good_count"), F.nullif(F.col("n_good"), F.lit(0)))
    df = df.withColumns({"bad_ratio": bad, "good_ratio": good, "ratio_gap": bad - good, "z": F.coalesce(z, F.lit(0.0)), "support": F.col("bad_count") + F.col("good_count")})
    return df.withColumn("significant", F.abs("z") >= 1.96).drop("n_bad", "n_good").orderBy(F.desc("ratio_gap"), F.desc(F.abs("z")), "dimension", "value")


def top_findings(found: DataFrame, n: int = 15) -> DataFrame:
    """The values with the largest surplus among bad rows."""
    return found.where(F.col("ratio_gap") > 0).orderBy(F.desc("ratio_gap"), F.desc(F.abs("z")), "dimension", "value").limit(n)


def top_anomalies(marked: DataFrame, n: int = 50) -> DataFrame:
    return marked.where("is_bad").orderBy(F.desc(F.abs("z")), "context", "lot", "wafer_no").limit(n)


def yield_pairs(points: DataFrame, quality: DataFrame, response: str) -> DataFrame:
    """Runs with a quality record: (keys, value, response)."""
    assert_response(response)
    return points.join(quality.select("lot", "wafer_no", F.col(response).alias("response")), ["lot", "wafer_no"]).where(F.col("response").isNotNull())


def yield_correlations(points: DataFrame, quality: DataFrame, response: str, least: int = 5) -> DataFrame:
    """Pearson's r between each signal's values and a quality response, in each context; strongest first."""
    keys = ["recipe", "stage", "recipe_step_num", "signal"]
    x, y = F.col("value"), F.col("response")
    df = yield_pairs(points, quality, response).where(finite(x)).groupBy(*keys).agg(pearson(x, y).alias("r"), F.count("*").alias("n"))
    return df.where(F.col("n") >= least).orderBy(F.desc_nulls_last(F.abs("r")), *keys)


RESPONSES = ["yield_pct", "defect_count"]


def assert_response(name: str) -> str:
    if name not in RESPONSES:
        raise ValueError(f"unknown quality response: {name}")
    return name
