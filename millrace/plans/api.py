"""The engine's entry points, one for each question a user asks; all return DataFrames or plain values.

Arguments are checked first (``parameters``); a wrong one raises ValueError. ``answered`` wraps any call into one outcome
of data or error, and ``sql`` runs a query with parameters bound by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.signals import FDC_SIGNALS, KEY_SIGNALS, SIGNALS, assert_known, setpoint_of
from millrace.operators import aggregates as agg
from millrace.operators import commonality as com
from millrace.operators import detectors, equipment, fdc, spc
from millrace.plans import parameters as check
from millrace.sources.ingest import has_rows


@dataclass
class Answer:
    """Either data or an error in words."""

    success: bool
    data: Any
    error: str | None


def answered(call: Callable[..., Any], *args: Any, **how: Any) -> Answer:
    try:
        return Answer(True, call(*args, **how), None)
    except ValueError as e:
        return Answer(False, None, str(e))


def sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, **values: Any) -> DataFrame:
    """A query with named parameters (``:name``), which are bound and never pasted into its text; ``{table}`` names a table."""
    return spark.sql(query, args=values or None, **(tables or {}))


def selector(df: DataFrame, levels: list[str], chosen: dict[str, object] | None = None) -> DataFrame:
    return agg.selector(df, [assert_known(x, {*agg.CONTEXT, *agg.RUN}, "level") for x in levels], chosen)


def wafers(df: DataFrame) -> DataFrame:
    return agg.wafer_steps(df).orderBy("start_time", *agg.RUN, *agg.CONTEXT)


def contexts(trace: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    return agg.list_contexts(trace).orderBy(*agg.CONTEXT), stats.orderBy("signal")


def trace(df: DataFrame, lot: str, wafer_no: str, step: int, signals: str | list[str]) -> DataFrame:
    check.text(lot=lot, wafer_no=wafer_no)
    check.step(step)
    known = set(df.columns)
    return agg.signal_trace(df, lot, wafer_no, step, [assert_known(s, known) for s in check.names(signals, least=1)])


def control_chart(df: DataFrame, recipe: str, stage: str, step: int, signal: str, indicator: str = agg.DEFAULT_INDICATOR, indicators: DataFrame | None = None) -> dict[str, DataFrame]:
    """All views of one context's chart: limits, diagnosis, violations, the four series, and capability where a setpoint is known.

    ``mean`` is taken from the trace; other indicators need the indicator table.
    """
    assert_known(signal, set(df.columns))
    agg.assert_indicator(indicator)
    check.text(recipe=recipe, stage=stage)
    check.step(step)
    part = agg.slice_context(df, recipe, stage, step)
    if indicator == agg.DEFAULT_INDICATOR:
        points = agg.run_points(part, [signal])
    elif indicators is None:
        raise ValueError("the indicator table is missing")
    else:
        points = agg.indicator_points(agg.slice_context(indicators, recipe, stage, step).where(F.col("signal") == signal), indicator)
    frozen = spc.with_frozen_baseline(points)
    out = {"points": points, "limits": spc.baseline_limits(points), "diagnosis": spc.diagnosis(points), "violations": spc.violations(frozen), "imr": spc.imr_chart(points), "ewma": spc.ewma_chart(frozen), "cusum": spc.cusum_chart(frozen), "residual": spc.residual_chart(points)}
    setpoint = setpoint_of(signal, df.columns)
    if setpoint is not None:
        out["capability"] = spc.capability(points, spc.spec_from_setpoint(agg.run_points(part, [setpoint])))
    return out


def multivariate(df: DataFrame, recipe: str, stage: str, step: int, signals: str | list[str] | None = None, confidence: float = fdc.CONFIDENCE) -> DataFrame:
    """Monitoring of one context; raises where it has too few complete runs for a baseline."""
    check.text(recipe=recipe, stage=stage)
    check.step(step)
    check.share(confidence=confidence)
    signals = [assert_known(s, set(df.columns)) for s in check.names(signals or []) or FDC_SIGNALS]
    found = fdc.monitor(agg.run_matrix(agg.slice_context(df, recipe, stage, step), signals), signals, agg.CONTEXT, ["time", "lot", "wafer_no"], confidence=confidence)
    if found.isEmpty():
        raise ValueError(f"fewer than {fdc.LEAST_BASELINE + 1} complete runs, or a baseline that doesn't vary")
    return found


def commonality(indicators: DataFrame, signal: str, indicator: str = agg.DEFAULT_INDICATOR, recipe: str | None = None, k: float = 3.5) -> tuple[DataFrame, DataFrame]:
    """(findings, top anomalies)"""
    check.text(signal=signal)
    check.threshold(k)
    marked = com.mark_anomalies(com.commonality_rows(indicators, signal, agg.assert_indicator(indicator), recipe), k)
    return com.findings(marked), com.top_anomalies(marked)


def equipment_report(df: DataFrame, on_time: str | None = "SOURCE_ON_TIME", pm_threshold: float = 100_000) -> dict[str, DataFrame]:
    check.positive(pm_threshold=pm_threshold)
    runs = equipment.equipment_runs(df, on_time if on_time in df.columns else None).withColumn("tool", F.lit("tool"))
    ratio, due = equipment.pm_proxy(F.max("on_time"), pm_threshold)
    return {
        "stats": equipment.equipment_stats(runs, ["tool"]),
        "recent": equipment.recent_runs(runs),
        "trend": equipment.downsample(runs.where(F.col("on_time") > 0).select("start_ms", "on_time", "lot", "wafer_no"), ["start_ms", "lot", "wafer_no"], 200),
        "downtimes": equipment.downtimes(equipment.idle_gaps(runs, ["tool"])),
        "maintenance": runs.agg(ratio.alias("ratio"), due.alias("due")),
    }


def yield_link(points: DataFrame, quality: DataFrame | None, response: str = "yield_pct", least: int = 5) -> DataFrame | None:
    """Correlations with a quality response, or None where there is no quality data."""
    com.assert_response(response)
    return com.yield_correlations(points, quality, response, least) if has_rows(quality) else None


def dashboard(df: DataFrame, top_contexts: int = 8) -> dict[str, DataFrame]:
    signals = [s for s in KEY_SIGNALS if s in df.columns] or [c for c in df.columns if c in set(SIGNALS)][:4]
    listed = agg.list_contexts(df)
    return {"summary": agg.dataset_summary(df), "totals": spc.risk_summary(df, signals, listed, top_contexts), "risk": spc.risk_scan(df, signals, listed, top_contexts).limit(12), "recent": agg.wafer_steps(df).orderBy(F.desc("start_time"), *agg.RUN, *agg.CONTEXT).limit(8)}


def benchmark(spark: SparkSession, scenarios: list[tuple[str, int, float]] | None = None, mode: str = "reference") -> DataFrame:
    """Detection quality and average run lengths of every method; arl1 under each scenario's magnitude.

    mode ``reference`` shifts whole series, so that arl1 says nothing of the shift; ``shifted`` keeps the baseline.
    """
    return detectors.report(spark, scenarios, mode)
