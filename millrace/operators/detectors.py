"""A seeded benchmark of detection methods: series are made once, then all methods and series run as one Spark job."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import spc

# fixed values: the methods, the preset faults as (type, start, magnitude), the distance of seeds
METHODS = ["static3sigma", "frozenImr", "ewma", "cusum", "residual"]
SCENARIOS = [("shift", 60, 1.0), ("shift", 60, 3.0), ("drift", 60, 0.1), ("spike", 60, 4.0)]
SEED_STEP = 7919


def uniform(seed: int) -> Iterator[float]:
    """A linear congruential generator modulo 2**32 (seed 0 counts as 1)."""
    # fixed values: factor and increment
    s = seed % 2**32 or 1
    while True:
        s = (1664525 * s + 1013904223) % 2**32
        yield s / 2**32


def normal_series(n: int, mu: float, sigma: float, seed: int) -> list[float]:
    """Normal values by the polar method; both of each pair are used."""
    u, out = uniform(seed), []
    while len(out) < n:
        a, b = 2 * next(u) - 1, 2 * next(u) - 1
        s = a * a + b * b
        if 0 < s < 1:
            m = math.sqrt(-2 * math.log(s) / s)
            out += [mu + sigma * a * m, mu + sigma * b * m]
    return out[:n]


def inject(series: DataFrame, kind: str, start: int, magnitude: float, sigma: float = 1.0) -> DataFrame:
    """series: key columns, idx, value. Adds ``is_faulty`` and the fault; ``variance`` widens about the series' mean."""
    from pyspark.sql import Window

    keys = [c for c in series.columns if c not in ("idx", "value")]
    at, v = F.col("idx"), F.col("value")
    hit = at == start if kind == "spike" else at >= start
    change = {"shift": F.lit(magnitude * sigma), "spike": F.lit(magnitude * sigma), "drift": magnitude * sigma * (at - start + 1), "variance": (v - F.avg(v).over(Window.partitionBy(*keys))) * (magnitude - 1)}[kind]
    return series.withColumns({"value": F.when(hit, v + change).otherwise(v), "is_faulty": hit})


def _points(series: DataFrame) -> DataFrame:
    """series: recipe, signal, idx, value as chart points."""
    return series.select("recipe", F.lit("").alias("stage"), F.lit(0).alias("recipe_step_num"), "signal", F.col("idx").alias("time"), F.lit("").alias("lot"), F.lit("").alias("wafer_no"), "value")


def alarms(series: DataFrame, baseline: int = 30) -> DataFrame:
    """(recipe, signal, idx, method) of every alarm of every method; frozen limits come from the first points."""
    points = _points(series)
    frozen, own = spc.with_frozen_baseline(points, baseline), spc.with_own_limits(points)
    beyond = lambda d: (F.col("sigma") > 0) & (F.abs(F.col("x") - F.col("center_line")) > 3 * F.col("sigma"))
    found = {
        "static3sigma": own.where(beyond(own)),
        "frozenImr": frozen.where(beyond(frozen)),
        "ewma": spc.ewma_chart(frozen).where("alarm"),
        "cusum": spc.cusum_chart(frozen).where("alarm"),
        "residual": spc.residual_chart(points).where("alarm"),
    }
    return reduce(DataFrame.unionByName, (d.select("recipe", "signal", "idx", F.lit(m).alias("method")) for m, d in found.items()))


def detection_metrics(series: DataFrame, found: DataFrame, start: int | Column) -> DataFrame:
    """Precision, recall, F1, delay and false-alarm rate of each recipe, signal and method.

    series: recipe, signal, idx, is_faulty (and what ``start`` needs). found: as from alarms(). Methods without an alarm get
    a row as well.
    """
    start = F.lit(start) if isinstance(start, int) else start
    methods = F.explode(F.array(*map(F.lit, METHODS))).alias("method")
    all_points = series.select("recipe", "signal", "idx", "is_faulty", start.alias("start"), methods)
    df = all_points.join(found.withColumn("alarm", F.lit(True)), ["recipe", "signal", "idx", "method"], "left").withColumn("alarm", F.coalesce("alarm", F.lit(False)))
    bad, hit = F.col("is_faulty"), F.col("alarm")
    df = df.groupBy("recipe", "signal", "method").agg(F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad).alias("normal"), F.min(F.when(hit & (F.col("idx") >= F.col("start")), F.col("idx") - F.col("start"))).alias("delay"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    df = df.withColumns({"precision": share(tp, tp + F.col("fp")), "recall": share(tp, tp + F.col("fn")), "far": share(F.col("fp"), F.col("normal"))})
    return df.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("normal")


def _frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "recipe string, signal string, idx int, value double")


def scenario_series(spark: SparkSession, scenarios=None, n: int = 120, seed: int = 4242) -> DataFrame:
    """(recipe, signal, idx, value, is_faulty, start) of every fault, all over the same normal values."""
    base = normal_series(n, 0.0, 1.0, seed)
    made = (inject(_frame(spark, [(f"{kind} {magnitude:g}", "s", i, v) for i, v in enumerate(base)]), kind, start, magnitude).withColumn("start", F.lit(start)) for kind, start, magnitude in scenarios or SCENARIOS)
    return reduce(DataFrame.unionByName, made)


def run_scenarios(spark: SparkSession, scenarios=None, n: int = 120, baseline: int = 30, seed: int = 4242) -> DataFrame:
    """Detection quality of every method under every fault: all faults are one job."""
    series = scenario_series(spark, scenarios, n, seed)
    return detection_metrics(series, alarms(series, baseline), F.col("start")).withColumnRenamed("recipe", "scenario").drop("signal")


def run_lengths(spark: SparkSession, delta: float | list[float] = 0.0, *, length: int = 200, runs: int = 60, seed: int = 4242, baseline: int = 30, mode: str = "reference") -> DataFrame:
    """The average run length of each method and the share of runs without an alarm (those count with ``length``).

    With several deltas, one row for each of them and each method. mode ``reference`` shifts whole series, the baseline
    with them, so a shift can't show; ``shifted`` keeps the baseline and counts from the shift on.
    """
    shift_from = 0 if mode == "reference" else baseline
    deltas = delta if isinstance(delta, list) else [delta]

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf["id"]:
                x = normal_series(length, 0.0, 1.0, seed + int(r) * SEED_STEP)
                for d in deltas:
                    yield pd.DataFrame({"recipe": f"{d:g}", "signal": str(r), "idx": range(length), "value": [v + d * (i >= shift_from) for i, v in enumerate(x)]})

    series = spark.range(runs).mapInPandas(make, "recipe string, signal string, idx int, value double")
    found = alarms(series, baseline).where(F.col("idx") >= shift_from).groupBy("recipe", "signal", "method").agg((F.min("idx") + 1 - shift_from).alias("first"))
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    every = spark.range(runs).select(F.col("id").cast("string").alias("signal"), each(METHODS, "method")).select("*", each([f"{d:g}" for d in deltas], "recipe"))
    df = every.join(found, ["recipe", "signal", "method"], "left")
    df = df.groupBy("recipe", "method").agg(F.avg(F.coalesce("first", F.lit(length - shift_from))).alias("arl"), F.avg(F.col("first").isNull().cast("double")).alias("censored"))
    return df.withColumn("delta", F.col("recipe").cast("double")).drop("recipe") if isinstance(delta, list) else df.drop("recipe")


def report(spark: SparkSession, scenarios=None, mode: str = "reference", seed: int = 4242) -> DataFrame:
    """Graded detection quality with arl0, arl1 and the shares of runs without an alarm, for each scenario and method."""
    scenarios = scenarios or SCENARIOS
    quiet = run_lengths(spark, seed=seed).select("method", F.col("arl").alias("arl0"), F.col("censored").alias("censored0"))
    shifted = run_lengths(spark, sorted({float(m) for _, _, m in scenarios}), seed=seed + 1, mode=mode)
    shifted = shifted.select("method", F.col("delta").alias("magnitude"), F.col("arl").alias("arl1"), F.col("censored").alias("censored1"))
    found = grade(run_scenarios(spark, scenarios, seed=seed)).withColumn("magnitude", F.split("scenario", " ")[1].cast("double"))
    return found.join(F.broadcast(quiet), "method").join(F.broadcast(shifted), ["method", "magnitude"]).drop("magnitude")


def grade(metrics: DataFrame) -> DataFrame:
    of = lambda c: F.when(F.col(c) >= 0.8, "good").when(F.col(c) >= 0.4, "fair").otherwise("poor")
    far = F.when(F.col("far") <= 0.02, "good").when(F.col("far") <= 0.1, "fair").otherwise("poor")
    return metrics.withColumns({"recall_grade": of("recall"), "f1_grade": of("f1"), "far_grade": far})
