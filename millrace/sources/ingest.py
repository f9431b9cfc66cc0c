"""From raw CSV files to the trace, signal statistics, indicator and quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.signals import CONTEXT_COLUMNS, MAX_STEP, SIGNALS
from millrace.operators.aggregates import indicators, signal_stats

# fixed values: column -> accepted headers (lower case), type, whether it must be there
QUALITY = {
    "lot": (["lot", "lot_id", "lotid"], "string", True),
    "wafer_no": (["wafer_no", "wafer", "waferno", "wafer_id", "slot"], "string", True),
    "yield_pct": (["yield_pct", "yield", "yield_percent", "cp_yield"], "double", False),
    "defect_count": (["defect_count", "defects", "defect", "defect_cnt"], "double", False),
    "bin": (["bin", "hardbin", "softbin", "bin_code"], "string", False),
}


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by header; quotes are doubled to escape."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')


def _cast(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "timestamp":  # as it is written: a zone in the text is left out, the session's zone doesn't matter
        return c.try_cast("timestamp_ntz")
    if kind == "int":  # fractions round, as text like "5.0" occurs
        return F.round(c.try_cast("double")).try_cast("int")
    return c.try_cast(kind) if kind != "string" else c


def typed_trace(raw: DataFrame, signals: list[str] | None = None) -> DataFrame:
    """Raw text columns renamed and cast; what can't be read is null."""
    columns = [*CONTEXT_COLUMNS, MAX_STEP]
    return raw.select(*(_cast(h, k).alias(n) for h, n, k in columns), *(_cast(s, "double").alias(s) for s in signals or SIGNALS))


def validate(trace: DataFrame, expected_rows: int | None = None) -> dict[str, int]:
    row = trace.agg(F.count("*").alias("rows"), F.count_if(F.col("processed_time").isNull()).alias("bad_times")).first().asDict()
    if row["bad_times"] or expected_rows is not None and row["rows"] != expected_rows:
        raise ValueError(f"ingest: {row}, expected {expected_rows} rows and no bad times")
    return row


def ingest(spark: SparkSession, csv: str, out: str, signals: list[str] | None = None, expected_rows: int | None = None) -> dict[str, int]:
    """Writes trace (by recipe), signal_stats and indicators (by signal) below ``out``; returns the checked counts."""
    signals = signals or SIGNALS
    typed_trace(read_text_csv(spark, csv), signals).sortWithinPartitions("stage", "recipe_step_num", "lot", "wafer_no").write.mode("overwrite").partitionBy("recipe").parquet(f"{out}/trace")
    trace = spark.read.parquet(f"{out}/trace")
    counts = validate(trace, expected_rows)
    signal_stats(trace, signals).write.mode("overwrite").parquet(f"{out}/signal_stats")
    return counts | build_indicators(spark, out, signals)


def build_indicators(spark: SparkSession, out: str, signals: list[str] | None = None) -> dict[str, int]:
    """Makes the indicator table anew from the trace table below ``out``."""
    if not table_exists(spark, f"{out}/trace"):
        raise ValueError(f"there is no trace table below {out}")
    trace = spark.read.parquet(f"{out}/trace")
    indicators(trace, signals or SIGNALS).write.mode("overwrite").partitionBy("signal").parquet(f"{out}/indicators")
    n = spark.read.parquet(f"{out}/indicators").count()
    if not n:
        raise ValueError("no indicators")
    return {"indicators": n}


def quality_table(raw: DataFrame) -> DataFrame:
    """Columns found by any of their accepted headers; optional ones that are absent are typed nulls."""
    heads = {c.strip().lower(): c for c in raw.columns}
    out = []
    for name, (aliases, kind, required) in QUALITY.items():
        found = next((heads[a] for a in aliases if a in heads), None)
        if found is None and required:
            raise ValueError(f"quality data has none of the headers {aliases}")
        out.append((F.lit(None).cast(kind) if found is None else _cast(found, kind)).alias(name))
    return raw.select(*out)


def load_quality(spark: SparkSession, csv: str) -> DataFrame | None:
    """The quality table, or None where there is no such file."""
    return quality_table(read_text_csv(spark, csv)) if table_exists(spark, csv) else None


def has_rows(df: DataFrame | None) -> bool:
    return df is not None and not df.isEmpty()


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder matches ``path`` (which may be a pattern)."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0
