"""Utilisation of equipment from the union of its run intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DOWNTIME_MS = 4 * HOUR_MS


def merge_intervals(runs: DataFrame, by: list[str]) -> DataFrame:
    """The union of intervals (start_ms, end_ms): overlapping or touching ones become one block."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    end = F.greatest("start_ms", "end_ms")
    df = runs.withColumn("end_ms", end).withColumn("so_far", F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("so_far").isNull() | (F.col("start_ms") > F.col("so_far")), 1).otherwise(0)
    df = df.withColumn("block", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*by, "block").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def idle_gaps(runs: DataFrame, by: list[str], downtime_ms: int = DOWNTIME_MS) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start_ms")
    df = merge_intervals(runs, by).withColumn("gap_start_ms", F.lag("end_ms").over(w)).where(F.col("gap_start_ms").isNotNull())
    gap = F.col("start_ms") - F.col("gap_start_ms")
    return df.select(*by, (F.col("block") - 2).alias("after_index"), "gap_start_ms", gap.alias("gap_ms"), (gap > downtime_ms).alias("is_downtime"))


def equipment_stats(runs: DataFrame, by: list[str], downtime_ms: int = DOWNTIME_MS) -> DataFrame:
    """Span, productive and idle time, utilisation, mean run, mean distance of starts and the longest gap."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    own = runs.withColumn("step", F.col("start_ms") - F.lag("start_ms").over(w))
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    base = own.groupBy(*by).agg(
        F.count("*").alias("runs"), F.min("start_ms").alias("first"), F.max_by("end_ms", F.struct("start_ms", "end_ms")).alias("last"),
        F.avg(length).alias("mean_run_ms"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_interval_ms"),
    )
    busy = merge_intervals(runs, by).groupBy(*by).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("productive_ms"))
    top = F.max_by("gap_start_ms", F.struct("gap_ms", -F.col("gap_start_ms")))
    gaps = idle_gaps(runs, by, downtime_ms).groupBy(*by).agg(F.max("gap_ms").alias("longest_gap_ms"), top.alias("longest_gap_at_ms"), F.count("*").alias("gaps"), F.count_if("is_downtime").alias("downtimes"))
    df = base.join(busy, by).join(gaps, by, "left")
    span = F.col("last") - F.col("first")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select(
        *by, "runs", span.alias("span_ms"), "productive_ms", F.greatest(F.lit(0), span - F.col("productive_ms")).alias("idle_ms"),
        F.when(span > 0, F.col("productive_ms") / span).otherwise(0.0).alias("utilization"), "mean_run_ms", "mean_interval_ms",
        zero("longest_gap_ms"), "longest_gap_at_ms", zero("gaps"), zero("downtimes"),
    )


def format_duration(ms: Column) -> Column:
    """Days, hours and minutes that aren't zero, as "1d 2h 5m"; else "0m"."""
    ms = F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0))
    units = [(F.floor(ms / 86_400_000), "d"), (F.floor(ms % 86_400_000 / HOUR_MS), "h"), (F.floor(ms % HOUR_MS / 60_000), "m")]
    text = F.concat_ws(" ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in units))
    return F.when(text == "", "0m").otherwise(text)


def pm_proxy(current: Column, threshold: float) -> tuple[Column, Column]:
    """(ratio of use to the maintenance threshold, whether maintenance is due)."""
    ratio = current / F.lit(float(threshold)) if threshold > 0 else F.lit(0.0)
    return ratio, ratio >= 1


def equipment_runs(trace: DataFrame, on_time: str | None = None) -> DataFrame:
    t = F.col("processed_time").cast("timestamp")
    used = F.coalesce(F.max(on_time), F.lit(0.0)) if on_time else F.lit(0.0)
    return trace.groupBy("lot", "wafer_no").agg(F.min("recipe").alias("recipe"), F.unix_millis(F.min(t)).alias("start_ms"), F.unix_millis(F.max(t)).alias("end_ms"), used.alias("on_time"))


def downsample(df: DataFrame, order: list[str], most: int, buckets: int = 64) -> DataFrame:
    """At most ``most`` rows, at positions floor(i * n / most) of the order. The first order column must be a number.

    Rows are dealt into ranges of the first column; a row's position is its place in its range after all earlier ranges,
    so no task sorts them all. A null comes first.
    """
    first = F.col(order[0])
    bounds = sorted(set(df.approxQuantile(order[0], [i / buckets for i in range(1, buckets)], 0.005)))
    bucket = F.coalesce(sum(((first > b).cast("int") for b in bounds), F.lit(0)), F.lit(0))
    dealt = df.withColumn("__bucket", bucket)
    sizes = {r["__bucket"]: r["count"] for r in dealt.groupBy("__bucket").count().collect()}  # a few rows
    n, before, offsets = sum(sizes.values()), 0, []
    for b in sorted(sizes):
        offsets.append((b, before))
        before += sizes[b]
    if n <= most:
        return df
    at = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("__nth", at).join(F.broadcast(df.sparkSession.createDataFrame(offsets, "__bucket int, __before long")), "__bucket")
    wanted = df.sparkSession.createDataFrame([(i * n // most,) for i in range(most)], "__at long")
    return ranked.withColumn("__at", F.col("__nth") + F.col("__before")).join(F.broadcast(wanted), "__at", "left_semi").select(*df.columns)


def recent_runs(runs: DataFrame, most: int = 60) -> DataFrame:
    """The latest runs with their start as text and their length."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    return runs.orderBy(F.desc("start_ms"), "lot", "wafer_no").limit(most).select("lot", "wafer_no", "recipe", iso_millis(F.col("start_ms")).alias("start"), length.alias("duration_ms"))


def downtimes(gaps: DataFrame, most: int = 10) -> DataFrame:
    """The longest gaps that count as downtime."""
    return gaps.where("is_downtime").orderBy(F.desc("gap_ms"), "gap_start_ms").limit(most).select(iso_millis(F.col("gap_start_ms")).alias("start"), F.col("gap_ms").alias("duration_ms"))


def iso_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
