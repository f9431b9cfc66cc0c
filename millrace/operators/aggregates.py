"""Aggregates over traces: contexts, run points, indicators, signal statistics, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.signals import assert_known
from millrace.functions.stats import finite, sample_std

CONTEXT = ["recipe", "stage", "recipe_step_num"]
RUN = ["lot", "wafer_no"]


def millis(t: Column) -> Column:
    return F.unix_millis(t.cast("timestamp"))


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def slice_context(df: DataFrame, recipe: str | None = None, stage: str | None = None, step: int | None = None) -> DataFrame:
    """Rows of a context; a part that is None isn't asked for."""
    for column, value in zip(CONTEXT, (recipe, stage, step)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def long_signals(trace: DataFrame, signals: list[str]) -> DataFrame:
    """One row for each sample and signal with a value: a single scan, whatever the number of signals."""
    keys = [*CONTEXT, *RUN, "system_label", "processed_time"]
    return trace.select(*keys, *(F.col(s).cast("double").alias(s) for s in signals)).unpivot(keys, signals, "signal", "v").where(F.col("v").isNotNull())


def list_contexts(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*CONTEXT).agg(F.count_distinct(F.struct(*RUN)).alias("wafer_runs"), F.count("*").alias("samples"))


def per_signal(trace: DataFrame, keys: list[str], signals: list[str], measures: Callable[[Column, Column], dict[str, Column]], count: str, at_once: int = 24) -> DataFrame:
    """(keys, signal, measures) of each group and signal that has a value there.

    measures: from a signal's values and the times of those to aggregates by name; ``count`` names the number of values.
    Signals are aggregated side by side, ``at_once`` in a scan of their columns, so a sample is one row up to the
    aggregate, whatever the number of signals; only the aggregates become a row for each signal.
    """
    out = None
    for lo in range(0, len(signals), at_once):
        some = signals[lo : lo + at_once]
        of = {s: F.col(s).cast("double") for s in some}
        sums = trace.groupBy(*keys).agg(*(F.struct(*(c.alias(n) for n, c in measures(v, F.when(v.isNotNull(), F.col("processed_time"))).items())).alias(s) for s, v in of.items()))
        entries = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("m")) for s in some))
        rows = sums.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.signal", "e.m.*").where(F.col(count) > 0)
        out = rows if out is None else out.unionByName(rows)
    return out


def run_points(trace: DataFrame, signals: list[str]) -> DataFrame:
    """A chart point for each context, signal and run: first time, mean, spread and number of samples."""
    measures = lambda v, t: {"time": F.min(t), "value": F.avg(v), "std": sample_std(v), "min": F.min(v), "max": F.max(v), "samples": F.count(v)}
    return per_signal(trace, [*CONTEXT, *RUN], signals, measures, "samples").select(*CONTEXT, "signal", *RUN, "time", "value", "std", "min", "max", "samples")


def run_matrix(trace: DataFrame, signals: list[str]) -> DataFrame:
    """Means of several signals for each context and run, and the run's first time."""
    return trace.groupBy(*CONTEXT, *RUN).agg(F.min("processed_time").alias("time"), *(F.avg(s).alias(s) for s in signals))


def wafer_steps(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*RUN, *CONTEXT).agg(F.count("*").alias("samples"), F.min("processed_time").alias("start_time"))


def dataset_summary(trace: DataFrame) -> DataFrame:
    distinct = lambda *c: F.count_distinct(F.struct(*c))
    return trace.agg(F.count("*").alias("samples"), distinct("lot").alias("lots"), distinct(*RUN).alias("wafers"), distinct("recipe").alias("recipes"), distinct("stage").alias("stages"), distinct("system_label").alias("chambers"))


def signal_stats(trace: DataFrame, signals: list[str], exact: bool = False) -> DataFrame:
    """Of each signal: values, range, distinct values, and whether it is a flag (at most two values, all of them 0 or 1).

    Distinct values are estimated (one pass, no shuffle of values; small numbers come out exact) unless ``exact``. A signal
    without a value has no row.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    measures = lambda v, t: {"non_null": F.count(v), "min_val": F.min(v), "max_val": F.max(v), "distinct_vals": distinct(v)}
    stats = per_signal(trace, [], signals, measures, "non_null")
    flag = (F.col("distinct_vals") <= 2) & (F.col("min_val") >= 0) & (F.col("max_val") <= 1)
    return stats.withColumn("is_flag", F.coalesce(flag, F.lit(False)))


def analog_signals(stats: DataFrame) -> DataFrame:
    return stats.where(~F.col("is_flag") & (F.col("non_null") > 0))


def _indicators(v: Column, t: Column) -> dict[str, Column]:
    """The catalog of indicators, by id; ``q`` holds the five quantiles once."""
    seconds = (millis(F.max(t)) - millis(F.min(t))).cast("double") / F.lit(1000.0).cast("double")
    first, last = F.min_by(v, t), F.max_by(v, t)
    exact = F.unix_micros(t.cast("timestamp")).cast("double") / F.lit(1e6).cast("double")
    return {
        "start_time": F.min(t), "q": F.percentile(v, F.array(*(F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)))),
        "mean": F.avg(v), "start_val": first, "end_val": last, "std": sample_std(v), "min_val": F.min(v), "max_val": F.max(v), "range_val": F.max(v) - F.min(v),
        "rms": F.sqrt(F.avg(v * v)), "slope": F.coalesce(F.regr_slope(v, exact), F.lit(0.0)), "area": F.sum(v), "overshoot": F.max(v) - F.avg(v), "undershoot": F.avg(v) - F.min(v),
        "rate_of_change": F.try_divide(last - first, F.nullif(seconds, F.lit(0.0).cast("double"))), "n_samples": F.count(v), "step_duration_s": seconds,
    }


INDICATORS = ["mean", "median", "start_val", "end_val", "std", "robust_std", "min_val", "max_val", "range_val", "p05", "p95", "rms", "slope", "area", "overshoot", "undershoot", "rate_of_change", "n_samples", "step_duration_s"]
CHARTABLE = [i for i in INDICATORS if i != "n_samples"]
DEFAULT_INDICATOR = "mean"


def assert_indicator(name: str) -> str:
    return assert_known(name, CHARTABLE, "indicator")


def indicators(trace: DataFrame, signals: list[str]) -> DataFrame:
    """All indicators for each run, context, chamber and signal: signals are aggregated side by side."""
    keys = [*RUN, *CONTEXT, "system_label"]
    out = per_signal(trace, keys, signals, _indicators, "n_samples", 8)
    at = lambda i: F.col("q")[i]
    out = out.withColumns({"p05": at(0), "median": at(2), "p95": at(4), "robust_std": F.coalesce((at(3) - at(1)) / F.lit(1.349), F.lit(0.0))})
    return out.select(*keys, "signal", "start_time", *INDICATORS)


def indicator_points(table: DataFrame, indicator: str = DEFAULT_INDICATOR) -> DataFrame:
    """The indicator table as chart points of one indicator; values that aren't finite are left out."""
    value = F.col(assert_indicator(indicator))
    return table.where(finite(value)).select(*CONTEXT, "signal", *RUN, "system_label", F.col("start_time").alias("time"), value.alias("value"), F.col("std"), F.col("min_val").alias("min"), F.col("max_val").alias("max"), F.col("n_samples").alias("samples"))


def indicator_counts(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("rows"), F.count_distinct("signal").alias("signals"), F.count_distinct(F.struct(*RUN, *CONTEXT, "system_label")).alias("wafer_steps"))


def signal_trace(trace: DataFrame, lot: str, wafer_no: str, step: int, signals: list[str]) -> DataFrame:
    """The ordered samples of a run's step, for at most six signals."""
    if not 1 <= len(signals) <= 6:
        raise ValueError("one to six signals")
    found = trace.where((F.col("lot") == lot) & (F.col("wafer_no") == wafer_no) & (F.col("recipe_step_num") == step))
    return found.select(F.date_format("processed_time", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("time"), *signals).orderBy("time")


def selector(trace: DataFrame, levels: list[str], chosen: dict[str, object] | None = None) -> DataFrame:
    """The values to choose from at the first of ``levels`` (recipe, stage, step; lot, wafer, step) that isn't chosen yet."""
    chosen = chosen or {}
    for level in levels:
        if level not in chosen:
            return trace.select(level).where(F.col(level).isNotNull()).distinct().orderBy(level)
        trace = trace.where(F.col(level) == chosen[level])
    raise ValueError("every level is chosen")
