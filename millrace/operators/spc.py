"""Univariate control charts, for all contexts and signals at once.

Every operator takes ``points`` (a context and signal in ``KEYS``, a run, its time and value) and orders the points of
a key by time, lot and wafer. All windows of a key share one sort; limits come from window aggregates over the key, so
no join leads back to the points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import explain
from millrace.functions.stats import D2, sample_std, skewness
from millrace.operators.aggregates import run_points

KEYS = ["recipe", "stage", "recipe_step_num", "signal"]
ORDER = ["time", "lot", "wafer_no"]
BASELINE = 8


def whole():
    return Window.partitionBy(*KEYS)


def running():
    return whole().orderBy(*ORDER)


def _frame(back: int):
    return running().rowsBetween(-back, 0)


def _ordered(points: DataFrame) -> DataFrame:
    """With idx (from 0), n, x (the value) and mr (the moving range, null at first)."""
    x = F.col("value").cast("double")
    return points.withColumns({"idx": F.row_number().over(running()) - 1, "n": F.count("*").over(whole()), "x": x, "mr": F.abs(x - F.lag(x).over(running()))})


def _sigma(mr: Column) -> Column:
    return F.coalesce(mr, F.lit(0.0)) / F.lit(D2)


def control_limits(points: DataFrame) -> DataFrame:
    """Limits from all points of a key: mean and moving-range sigma."""
    df = _ordered(points).groupBy(*KEYS).agg(F.avg("x").alias("center_line"), _sigma(F.avg("mr")).alias("sigma"), F.count("*").alias("n"))
    return with_limits(df).withColumn("insufficient", F.col("n") < BASELINE)


def with_limits(df: DataFrame) -> DataFrame:
    c, s = F.col("center_line"), F.col("sigma")
    return df.withColumns({"ucl": c + 3 * s, "lcl": c - 3 * s, "zone_upper1": c + s, "zone_upper2": c + 2 * s, "zone_lower1": c - s, "zone_lower2": c - 2 * s})


def with_frozen_baseline(points: DataFrame, first: int | None = None) -> DataFrame:
    """Points with idx, n, center_line and sigma of the frozen baseline.

    The baseline is the window of eight points with the least mean moving range (the earliest of equals), or all points
    where there are fewer; with ``first``, it is the first so many points instead.
    """
    df = _ordered(points)
    if first is not None:
        df = df.withColumns({"base_start": F.lit(0), "base_end": F.least(F.lit(first), F.col("n")) - 1})
    else:
        quiet = F.when(F.col("idx") >= BASELINE - 1, F.avg("mr").over(_frame(BASELINE - 2)))
        df = df.withColumn("quiet", F.when(quiet.isNotNull(), F.struct(quiet.alias("mr"), F.col("idx").alias("idx"))))
        best = F.min("quiet").over(whole())
        df = df.withColumn("base_end", F.when(F.col("n") < BASELINE, F.col("n") - 1).otherwise(best["idx"])).drop("quiet")
        df = df.withColumn("base_start", F.when(F.col("n") < BASELINE, 0).otherwise(F.col("base_end") - BASELINE + 1))
    inside = F.col("idx").between(F.col("base_start"), F.col("base_end"))
    mr = F.when(inside & (F.col("idx") > F.col("base_start")), F.col("mr"))
    return df.withColumns({"center_line": F.avg(F.when(inside, F.col("x"))).over(whole()), "sigma": _sigma(F.avg(mr).over(whole()))})


def with_own_limits(points: DataFrame) -> DataFrame:
    """Points with idx, n, center_line and sigma of all points of the key."""
    return _ordered(points).withColumns({"center_line": F.avg("x").over(whole()), "sigma": _sigma(F.avg("mr").over(whole()))})


def baseline_limits(points: DataFrame) -> DataFrame:
    df = with_frozen_baseline(points).groupBy(*KEYS).agg(*(F.first(c).alias(c) for c in ("center_line", "sigma", "base_start", "base_end")), F.count("*").alias("points"))
    df = df.withColumn("n", F.col("base_end") - F.col("base_start") + 1)
    return with_limits(df).withColumn("insufficient", F.col("n") < BASELINE)


# fixed values: names of the zone rules, in order
RULES = ["beyond_3sigma", "two_of_three_2sigma", "four_of_five_1sigma", "eight_in_row_side"]


def _runs_rule(z: Column, limit: float, span: int, least: int, itself: bool = True) -> Column:
    def side(sign: int) -> Column:
        hit = sign * z > limit
        found = F.sum(hit.cast("int")).over(_frame(span - 1)) >= least
        return found & hit if itself else found

    return (F.col("idx") >= span - 1) & (side(1) | side(-1))


def with_rules(limited: DataFrame) -> DataFrame:
    """A boolean column for each of the four zone rules; all false without spread."""
    z = F.when(F.col("sigma") > 0, (F.col("x") - F.col("center_line")) / F.col("sigma"))
    limited = limited.withColumn("z", z)
    z = F.col("z")
    tests = [F.abs(z) > 3, _runs_rule(z, 2, 3, 2), _runs_rule(z, 1, 5, 4), _runs_rule(z, 0, 8, 8, False)]
    return limited.withColumns({r: F.coalesce(t, F.lit(False)) for r, t in zip(RULES, tests)})


def severity(rule: Column) -> Column:
    return F.when(rule == RULES[0], "alarm").otherwise("warn")


def violations(limited: DataFrame) -> DataFrame:
    """One row for each point and rule that it breaks, from points with center_line and sigma."""
    named = F.array(*(F.when(F.col(r), F.lit(r)) for r in RULES))
    rows = with_rules(limited).select(*KEYS, "lot", "wafer_no", "time", "idx", "x", "center_line", "sigma", F.posexplode(F.array_compact(named)).alias("nth", "rule"))
    return rows.withColumn("severity", severity(F.col("rule"))).withColumnRenamed("x", "value").drop("nth")


def chart_status(limited: DataFrame) -> DataFrame:
    """Alarms, warnings and the overall status of each key."""
    df = with_rules(limited)
    warns = sum((F.col(r).cast("int") for r in RULES[1:]), F.lit(0))
    df = df.groupBy(*KEYS).agg(F.count("*").alias("points"), F.count_if(F.col(RULES[0])).alias("alarms"), F.sum(warns).cast("long").alias("warns"))
    return df.withColumn("status", F.when(F.col("alarms") > 0, "violation").when(F.col("warns") > 0, "warning").otherwise("in_control"))


# fixed values: weight and limit width of the EWMA chart, slack and limit of the CUSUM chart
LAMBDA, EWMA_L, CUSUM_K, CUSUM_H = 0.2, 3.0, 0.5, 5.0


def ewma_chart(limited: DataFrame, lam: float = LAMBDA, width: float = EWMA_L) -> DataFrame:
    """Exponentially weighted means with their time-varying limits.

    z_t = (1-l)^(t+1) CL + l * sum of (1-l)^(t-i) x_i. Points are cut into blocks of ``reach``, over which a weight falls
    below 1e-17: the sum is a prefix sum of scaled values within the block and what the block before leaves, so each point
    costs the same whatever the series' length.
    """
    keep = 1.0 - lam
    reach = max(1, math.ceil(math.log(1e-17) / math.log(keep)))
    x, c, t = F.col("x"), F.col("center_line"), F.col("idx")
    at = t % reach
    in_block = Window.partitionBy(*KEYS, F.floor(t / reach)).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum((x - c) * lam * F.pow(F.lit(keep), -at)).over(in_block)
    df = limited.withColumn("own", F.pow(F.lit(keep), at) * scaled)
    before = F.last(F.when(at == reach - 1, F.col("own")), ignorenulls=True).over(whole().orderBy(t).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("weighted", F.col("own") + F.pow(F.lit(keep), at + 1) * F.coalesce(before, F.lit(0.0)))
    width_t = width * F.col("sigma") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(keep), 2 * (t + 1))))
    out = df.select(*KEYS, "lot", "wafer_no", "time", "idx", "sigma", "center_line", (c + F.col("weighted")).alias("statistic"), (c + width_t).alias("ucl"), (c - width_t).alias("lcl"))
    beyond = (F.col("statistic") > F.col("ucl")) | (F.col("statistic") < F.col("lcl"))
    return out.withColumn("alarm", (F.col("sigma") > 0) & beyond).drop("sigma")


def cusum_chart(limited: DataFrame, k: float = CUSUM_K, h: float = CUSUM_H) -> DataFrame:
    """Both one-sided sums. max(0, C + z - k) unrolls to S - min(0, least S so far), so two windows give it without a fold."""
    z = F.when(F.col("sigma") > 0, (F.col("x") - F.col("center_line")) / F.col("sigma")).otherwise(0.0)
    df = limited.withColumn("z", z).withColumns({"up": F.sum(F.col("z") - k).over(running().rowsBetween(Window.unboundedPreceding, 0)), "down": F.sum(-F.col("z") - k).over(running().rowsBetween(Window.unboundedPreceding, 0))})
    floor = lambda c: F.least(F.lit(0.0), F.min(c).over(running().rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"statistic": F.col("up") - floor("up"), "statistic_low": F.col("down") - floor("down")})
    alarm = (F.col("sigma") > 0) & ((F.col("statistic") > h) | (F.col("statistic_low") > h))
    return df.select(*KEYS, "lot", "wafer_no", "time", "idx", "statistic", "statistic_low", F.lit(h).alias("ucl"), F.lit(0.0).alias("lcl"), alarm.alias("alarm"))


def _autocorrelation(df: DataFrame) -> DataFrame:
    """Adds mean and rho (lag 1, over the whole series; 0 for fewer than three points or without variance)."""
    df = df.withColumn("mean", F.avg("x").over(whole()))
    d, before = F.col("x") - F.col("mean"), F.lag("x").over(running()) - F.col("mean")
    df = df.withColumns({"lagged": d * before, "squared": d * d})
    rho = F.try_divide(F.sum("lagged").over(whole()), F.sum("squared").over(whole()))
    return df.withColumn("rho", F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce(rho, F.lit(0.0)))).drop("lagged", "squared")


def residual_chart(points: DataFrame) -> DataFrame:
    """Residuals of a first-order autoregression with limits from their own moving ranges; the first is 0 and never flagged."""
    df = _autocorrelation(_ordered(points))
    phi = F.col("rho")
    e = F.when(F.col("idx") > 0, F.when(F.col("n") < 3, 0.0).otherwise(F.col("x") - F.col("mean") * (1 - phi) - phi * F.lag("x").over(running()))).otherwise(0.0)
    df = df.withColumn("statistic", e)
    mr = F.when(F.col("idx") > 1, F.abs(F.col("statistic") - F.lag("statistic").over(running())))
    df = df.withColumn("mr", mr).withColumn("sigma", _sigma(F.avg("mr").over(whole())))
    limit = 3 * F.col("sigma")
    alarm = (F.col("sigma") > 0) & (F.col("idx") > 0) & (F.abs("statistic") > limit)
    return df.select(*KEYS, "lot", "wafer_no", "time", "idx", F.col("rho").alias("phi"), "statistic", limit.alias("ucl"), (-limit).alias("lcl"), alarm.alias("alarm"))


def imr_chart(points: DataFrame) -> DataFrame:
    """Points against the frozen baseline's limits, with the zone rules."""
    return with_limits(with_rules(with_frozen_baseline(points)))


def diagnosis(points: DataFrame) -> DataFrame:
    """Trust score, autocorrelation, skewness, change point and the chart these recommend, one row for each key."""
    df = _autocorrelation(_ordered(points))
    d = F.col("x") - F.col("mean")
    df = df.withColumn("cum", F.abs(F.sum(d).over(running().rowsBetween(Window.unboundedPreceding, 0))))
    top = F.max_by("idx", F.struct(F.col("cum"), -F.col("idx")))
    out = df.groupBy(*KEYS).agg(
        F.count("*").alias("n"), _sigma(F.avg("mr")).alias("sigma_within"), sample_std(F.col("x")).alias("sigma_total"), F.first("rho").alias("lag1"),
        F.sum(d * d).alias("m2"), F.sum(d * d * d).alias("m3"), F.max("cum").alias("top"), top.alias("at"),
    )
    within, total, n = F.col("sigma_within"), F.col("sigma_total"), F.col("n")
    ratio = F.when(within > 0, total / within).when(total > 0, F.lit(float("inf"))).otherwise(1.0)
    out = out.withColumns({
        "ratio": ratio,
        "autocorr_significant": F.abs("lag1") > 2 / F.sqrt(n),
        "skewness": skewness(F.col("m2"), F.col("m3"), n),
        "change_point": F.when((n >= 4) & (total > 0) & (F.col("top") >= total), F.col("at")),
    })
    grade = F.when((F.col("ratio") == float("inf")) | (F.col("ratio") < 1.5), "high").when(F.col("ratio") < 3, "medium").otherwise("low")
    out = out.withColumn("trust", grade)
    recommended = F.when(F.col("autocorr_significant") | (F.col("trust") == "low"), "residual").when(F.col("change_point").isNotNull(), "cusum").otherwise("ewma")
    every = F.array(*map(F.lit, ("imr", "ewma", "cusum", "residual")))
    out = out.withColumn("recommended", recommended).withColumn("alternatives", F.array_except(every, F.array("recommended")))
    out = out.withColumn("reason", explain.recommendation(F.col("autocorr_significant"), F.col("lag1"), F.col("trust"), F.col("ratio"), F.col("change_point")))
    return out.drop("m2", "m3", "top", "at")


def linear_fit(points: DataFrame) -> DataFrame:
    """Slope and intercept over the index, and the size of residuals."""
    df = _ordered(points)
    out = df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.regr_slope("x", "idx").alias("slope"), F.avg("x").alias("mean"), F.avg("idx").alias("mid"), F.var_pop("x").alias("v"), F.var_pop("idx").alias("w"))
    slope = F.coalesce("slope", F.lit(0.0))
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("v") - slope * slope * F.col("w")))
    return out.select(*KEYS, "n", slope.alias("slope"), (F.col("mean") - slope * F.col("mid")).alias("intercept"), residual.alias("residual_rms"))


TOLERANCE = 0.05


def spec_from_setpoint(setpoints: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Target and limits of each context from its setpoint signal's run means."""
    keys = KEYS[:3]
    out = setpoints.groupBy(*keys).agg(F.avg("value").alias("target"))
    return out.select(*keys, "target", (F.col("target") + tolerance * F.abs("target")).alias("usl"), (F.col("target") - tolerance * F.abs("target")).alias("lsl"))


def manual_spec(df: DataFrame, target: float | None, usl: float | None, lsl: float | None) -> DataFrame:
    return df.withColumns({k: F.lit(v).cast("double") for k, v in (("target", target), ("usl", usl), ("lsl", lsl))})


def capability(points: DataFrame, spec: DataFrame | tuple[float | None, float | None, float | None]) -> DataFrame:
    """Cp, Cpk (within-run sigma), Pp, Ppk (overall sigma); null where a limit that is needed or all spread is missing."""
    df = _ordered(points).groupBy(*KEYS).agg(F.avg("x").alias("mean"), _sigma(F.avg("mr")).alias("sigma_within"), sample_std(F.col("x")).alias("sigma_total"))
    df = manual_spec(df, *spec) if isinstance(spec, tuple) else df.join(spec, KEYS[:3], "left")
    usl, lsl, m = F.col("usl"), F.col("lsl"), F.col("mean")

    def pair(s: Column) -> tuple[Column, Column]:
        s = F.when(s > 0, s)
        return (usl - lsl) / (6 * s), F.least((usl - m) / (3 * s), (m - lsl) / (3 * s))

    (cp, cpk), (pp, ppk) = pair(F.col("sigma_within")), pair(F.col("sigma_total"))
    df = df.withColumns({"cp": cp, "cpk": cpk, "pp": pp, "ppk": ppk})
    grade = F.when(F.col("cpk").isNull(), "unknown").when(F.col("cpk") >= 1.33, "capable").when(F.col("cpk") >= 1.0, "marginal").otherwise("incapable")
    return df.withColumn("grade", grade)


def chosen_contexts(contexts: DataFrame, top: int) -> DataFrame:
    """The ``top`` contexts by runs (wafer_runs, as from list_contexts)."""
    return contexts.orderBy(F.desc("wafer_runs"), *KEYS[:3]).limit(top).select(*KEYS[:3])


def scanned_charts(trace: DataFrame, signals: list[str], contexts: DataFrame, top: int = 8) -> DataFrame:
    """Status of every chart of the ``top`` contexts (by runs) and ``signals``, one job for all of them.

    The chosen contexts are few and bounded; the trace is cut down to them before it is aggregated.
    """
    part = trace.join(F.broadcast(chosen_contexts(contexts, top)), KEYS[:3], "left_semi")
    return chart_status(with_own_limits(run_points(part, signals))).withColumn("insufficient", F.col("points") < BASELINE)


def risk_scan(trace: DataFrame, signals: list[str], contexts: DataFrame, top: int = 8) -> DataFrame:
    """The scanned charts with broken rules, most alarms first."""
    status = scanned_charts(trace, signals, contexts, top)
    return status.where((F.col("alarms") > 0) | (F.col("warns") > 0)).orderBy(F.desc("alarms"), F.desc("warns"), *KEYS)


def risk_summary(trace: DataFrame, signals: list[str], contexts: DataFrame, top: int = 8) -> DataFrame:
    """One row: charts scanned (those without points included), with broken rules, with too few points; all alarms and warnings."""
    status = scanned_charts(trace, signals, contexts, top)
    sums = status.agg(F.count_if((F.col("alarms") > 0) | (F.col("warns") > 0)).alias("charts"), F.count_if("insufficient").alias("insufficient"), F.coalesce(F.sum("alarms"), F.lit(0)).alias("total_alarms"), F.coalesce(F.sum("warns"), F.lit(0)).alias("total_warns"))
    scanned = chosen_contexts(contexts, top).agg((F.count("*") * len(signals)).alias("scanned"))
    return sums.join(F.broadcast(scanned))  # one row each


def adaptive(points: DataFrame) -> DataFrame:
    """The whole adaptive chart in one row for each key: frozen limits, diagnosis and broken rules."""
    status = chart_status(with_frozen_baseline(points)).drop("points")
    return baseline_limits(points).drop("n").join(diagnosis(points), KEYS).join(status, KEYS)
