"""All queries by name, and their equivalents in SQL (written on their own, for another engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import signals as names
from millrace.operators import aggregates as agg
from millrace.operators import commonality as com
from millrace.operators import detectors, equipment, fdc, spc
from millrace.sources import bindings as b

CTX = agg.CONTEXT
KEYS = spc.KEYS


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; -0.0 as 0.0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _trace(spark, sf):
    return b.trace(spark, sf)


def _points(spark, sf, signals=b.TRACE_SIGNALS):
    return agg.run_points(b.trace(spark, sf), list(signals))


def line_points(spark, sf):
    """Points of all signals of lineitem: their number grows with the tables."""
    return agg.run_points(b.line_trace(spark, sf), b.LINE_SIGNALS)


def _indicators(spark, sf):
    return agg.indicators(b.trace(spark, sf), b.TRACE_SIGNALS)


def _iso(df, *columns):
    return df.withColumns({c: agg.iso(F.col(c)) for c in columns})


def wafer_matrix(spark, sf):
    return rounded(agg.run_matrix(b.line_trace(spark, sf), b.LINE_SIGNALS).drop("time"))


def signal_catalog(spark, sf):
    df = spark.createDataFrame([(s,) for s in names.SIGNALS], "signal string")
    return df.select("signal", names.subsystem(F.col("signal")).alias("subsystem"), names.looks_analog(F.col("signal")).alias("analog"))


def lot_types(spark, sf):
    df = b.table(spark, sf, "events").select(F.col("event_type").alias("lot")).distinct()
    df = df.unionByName(spark.createDataFrame([(x,) for x in ("AGING-1", "Dummy7", "QC_3", "N123", "lot-mon")], "lot string"))
    return df.select("lot", names.wafer_type(F.col("lot")).alias("wafer_type"))


def _line_contexts(t):
    return t.groupBy(*CTX).agg(F.count_distinct(F.struct("lot", "wafer_no")).alias("wafer_runs"))


def risk_scan(spark, sf):
    t = b.line_trace(spark, sf)
    return spc.risk_scan(t, b.LINE_SIGNALS, _line_contexts(t))


def risk_summary(spark, sf):
    t = b.line_trace(spark, sf)
    return spc.risk_summary(t, b.LINE_SIGNALS, _line_contexts(t))


def yield_correlations(spark, sf):
    return rounded(com.yield_correlations(line_points(spark, sf), b.quality(spark, sf), "yield_pct"))


def yield_pairs(spark, sf):
    return rounded(com.yield_pairs(line_points(spark, sf), b.quality(spark, sf), "defect_count").select(*CTX, "signal", "lot", "wafer_no", "value", "response"))


def marked(spark, sf):
    return com.mark_anomalies(com.commonality_rows(_indicators(spark, sf), None, "mean"), 2.0)


def anomalies(spark, sf):
    return rounded(marked(spark, sf).where("is_bad").select("context", "lot", "wafer_no", "value", "median", "robust_sigma", "z"), 5)


def diagnosis(spark, sf):
    return rounded(spc.diagnosis(line_points(spark, sf)).withColumn("alternatives", F.concat_ws(",", "alternatives")), 3)


def _vectors(spark, sf):
    e = b.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("trace"))


def trace_envelope(spark, sf):
    return rounded(fdc.envelope(_vectors(spark, sf), "trace", ["label"], 33))


def trace_deviation(spark, sf):
    v = _vectors(spark, sf)
    return rounded(fdc.deviation(v, "vec_id", "trace", fdc.envelope(v, "trace", ["label"], 33, 2.0), ["label"], 33), 5)


def trace_overlay(spark, sf):
    long = agg.long_signals(b.trace(spark, sf), b.TRACE_SIGNALS)
    return rounded(_iso(fdc.overlay(long, [*CTX, "lot", "wafer_no", "signal"]).withColumn("time", F.date_format("processed_time", "yyyy-MM-dd'T'HH:mm:ss.SSS")).drop("processed_time", "system_label")))


def standardized(spark, sf):
    m = agg.run_matrix(b.line_trace(spark, sf), b.LINE_SIGNALS).drop("time")
    return rounded(fdc.standardize(m, b.LINE_SIGNALS, CTX), 5)


def correlation_matrix(spark, sf):
    return rounded(fdc.correlation_matrix(agg.run_matrix(b.line_trace(spark, sf), b.LINE_SIGNALS), b.LINE_SIGNALS, CTX))


def equipment_report(spark, sf):
    df = equipment.equipment_stats(b.user_runs(spark, sf), ["machine"])
    ratio, due = equipment.pm_proxy(F.col("productive_ms"), 1e9)
    return rounded(df.withColumns({"span_text": equipment.format_duration(F.col("span_ms")), "pm_ratio": ratio, "pm_due": due}))


def injected_faults(spark, sf):
    idx = F.row_number().over(Window.partitionBy(*KEYS).orderBy("time", "lot", "wafer_no")) - 1
    series = _points(spark, sf).select(*KEYS, idx.alias("idx"), "value")
    out = None
    for kind, m in (("shift", 1.0), ("drift", 0.1), ("spike", 4.0), ("variance", 2.0)):
        got = detectors.inject(series, kind, 60, m, 2.0).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return rounded(out)


def dashboard(spark, sf):
    steps = agg.wafer_steps(b.trace(spark, sf)).orderBy(F.desc("start_time"), *CTX).limit(8)
    return _iso(steps, "start_time")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "contexts": lambda s, d: agg.list_contexts(_trace(s, d)),
    "wafer_points": lambda s, d: rounded(_iso(_points(s, d, b.TRACE_SIGNALS), "time")),
    "wafer_matrix": wafer_matrix,
    "equipment_runs": lambda s, d: rounded(equipment.equipment_runs(_trace(s, d), "k")),
    "wafer_steps": lambda s, d: _iso(agg.wafer_steps(_trace(s, d)), "start_time"),
    "dataset_summary": lambda s, d: agg.dataset_summary(_trace(s, d)),
    "signal_stats": lambda s, d: rounded(agg.signal_stats(_trace(s, d), b.TRACE_SIGNALS, exact=True)),
    "analog_signals": lambda s, d: agg.analog_signals(agg.signal_stats(b.line_trace(s, d), b.LINE_SIGNALS, exact=True)).select("signal"),
    "indicators": lambda s, d: rounded(_iso(_indicators(s, d), "start_time"), 5),
    "indicator_counts": lambda s, d: agg.indicator_counts(_indicators(s, d)),
    "indicator_points": lambda s, d: rounded(_iso(agg.indicator_points(_indicators(s, d), "overshoot"), "time")),
    "control_limits": lambda s, d: rounded(spc.control_limits(line_points(s, d)), 3),
    "spc_violations": lambda s, d: rounded(_iso(spc.violations(spc.with_own_limits(line_points(s, d))), "time")),
    "chart_status": lambda s, d: spc.chart_status(spc.with_own_limits(line_points(s, d))),
    "baseline_limits": lambda s, d: rounded(spc.baseline_limits(_points(s, d))),
    "imr_status": lambda s, d: spc.chart_status(spc.with_frozen_baseline(_points(s, d))),
    "ewma_chart": lambda s, d: rounded(spc.ewma_chart(spc.with_frozen_baseline(_points(s, d))).drop("time")),
    "cusum_chart": lambda s, d: rounded(spc.cusum_chart(spc.with_frozen_baseline(_points(s, d))).drop("time")),
    "residual_chart": lambda s, d: rounded(spc.residual_chart(line_points(s, d)).drop("time"), 3),
    "diagnosis": diagnosis,
    "adaptive_spc": lambda s, d: rounded(spc.adaptive(_points(s, d)).drop("alternatives", "reason")),
    "linear_fit": lambda s, d: rounded(spc.linear_fit(line_points(s, d)), 3),
    "capability": lambda s, d: rounded(spc.capability(_points(s, d), spc.spec_from_setpoint(_points(s, d, ["k"])))),
    "risk_scan": risk_scan,
    "risk_summary": risk_summary,
    "yield_correlations": yield_correlations,
    "yield_pairs": yield_pairs,
    "commonality_anomalies": anomalies,
    "commonality_findings": lambda s, d: rounded(com.findings(marked(s, d))),
    "equipment_report": equipment_report,
    "idle_gaps": lambda s, d: equipment.idle_gaps(b.user_runs(s, d), ["machine"]),
    "trace_overlay": trace_overlay,
    "trace_envelope": trace_envelope,
    "trace_deviation": trace_deviation,
    "standardized": standardized,
    "correlation_matrix": correlation_matrix,
    "injected_faults": injected_faults,
    "signal_catalog": signal_catalog,
    "lot_types": lot_types,
    "dashboard": dashboard,
}

# ---------------------------------------------------------------- the same in SQL

_T = """trace AS (SELECT ts AS processed_time, strftime(ts, '%Y%m%d') AS lot, event_type AS recipe, 'S' || (user_id % 2) AS stage,
 CAST(hour(ts) // 6 AS VARCHAR) AS wafer_no, 'S' || (user_id % 2) AS system_label, 1 AS recipe_step_num, value,
 CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)"""
_L = """ltrace AS (SELECT l_shipdate AS processed_time, CAST(l_suppkey AS VARCHAR) AS lot, l_returnflag AS recipe, l_linestatus AS stage,
 CAST(year(l_shipdate) AS VARCHAR) AS wafer_no, l_linestatus AS system_label, CAST(l_linenumber AS INTEGER) AS recipe_step_num,
 l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""
_C, _K, _R = "recipe, stage, recipe_step_num", "recipe, stage, recipe_step_num, signal", "lot, wafer_no"
_LONG = _T + """, samples AS (SELECT *, 'value' AS signal, value AS v FROM trace WHERE value IS NOT NULL
 UNION ALL SELECT *, 'k', k FROM trace WHERE k IS NOT NULL)"""
_LLONG = _L + "".join((", lsamples AS (" if i == 0 else " UNION ALL ") + f"SELECT {_C}, {_R}, processed_time, '{s}' AS signal, {s} AS v FROM ltrace" for i, s in enumerate(b.LINE_SIGNALS)) + ")"


def _pts(source: str, name: str, where: str = "") -> str:
    return f""", {name} AS (SELECT {_K}, {_R}, min(processed_time) AS time, avg(v) AS value, coalesce(stddev_samp(v), 0) AS std, min(v) AS min,
 max(v) AS max, count(v) AS samples FROM {source} {where} GROUP BY {_K}, {_R})"""


_VALUE = "WITH " + _LONG + _pts("samples", "pts")
_LVALUE = "WITH " + _LLONG + _pts("lsamples", "pts")
_W, _ALL = f"(PARTITION BY {_K} ORDER BY time, lot, wafer_no)", f"(PARTITION BY {_K})"
_NUMBERED = f", o AS (SELECT *, value AS x, row_number() OVER {_W} - 1 AS idx, count(*) OVER {_ALL} AS n, abs(value - lag(value) OVER {_W}) AS mr FROM pts)"
_ORD, _LORD = _VALUE + _NUMBERED, _LVALUE + _NUMBERED
_OWN = _LORD + f", lim AS (SELECT *, avg(x) OVER {_ALL} AS cl, coalesce(avg(mr) OVER {_ALL}, 0) / 1.128 AS sg FROM o)"
_FROZEN = _ORD + f""", w8 AS (SELECT {_K}, a.idx AS lo, avg(c.mr) AS q FROM o a JOIN o c USING ({_K}) WHERE c.idx BETWEEN a.idx + 1 AND a.idx + 7 AND a.idx + 8 <= a.n GROUP BY ALL),
 best AS (SELECT {_K}, arg_min(lo, (q, lo)) AS lo FROM w8 GROUP BY ALL),
 span AS (SELECT o.*, CASE WHEN n < 8 THEN 0 ELSE best.lo END AS b0, CASE WHEN n < 8 THEN n - 1 ELSE best.lo + 7 END AS b1 FROM o LEFT JOIN best USING ({_K})),
 base AS (SELECT {_K}, any_value(b0) AS base_start, any_value(b1) AS base_end, any_value(n) AS points, avg(x) FILTER (idx BETWEEN b0 AND b1) AS cl,
  coalesce(avg(mr) FILTER (idx > b0 AND idx <= b1), 0) / 1.128 AS sg FROM span GROUP BY {_K}),
 lim AS (SELECT o.*, cl, sg FROM o JOIN base USING ({_K}))"""
_RULES = f""", zz AS (SELECT *, CASE WHEN sg > 0 THEN (x - cl) / sg END AS z FROM lim),
 flags AS (SELECT *, coalesce(abs(z) > 3, false) AS r1,
 coalesce(idx >= 2 AND ((z > 2 AND sum((z > 2)::INT) OVER w3 >= 2) OR (z < -2 AND sum((z < -2)::INT) OVER w3 >= 2)), false) AS r2,
 coalesce(idx >= 4 AND ((z > 1 AND sum((z > 1)::INT) OVER w5 >= 4) OR (z < -1 AND sum((z < -1)::INT) OVER w5 >= 4)), false) AS r3,
 coalesce(idx >= 7 AND (sum((z > 0)::INT) OVER w8 = 8 OR sum((z < 0)::INT) OVER w8 = 8), false) AS r4 FROM zz
 WINDOW w3 AS (PARTITION BY {_K} ORDER BY time, lot, wafer_no ROWS 2 PRECEDING), w5 AS (PARTITION BY {_K} ORDER BY time, lot, wafer_no ROWS 4 PRECEDING),
 w8 AS (PARTITION BY {_K} ORDER BY time, lot, wafer_no ROWS 7 PRECEDING))"""
_STATUS = f""", status AS (SELECT {_K}, count(*) AS points, count(*) FILTER (r1) AS alarms, CAST(sum(r2::INT + r3::INT + r4::INT) AS BIGINT) AS warns FROM flags GROUP BY {_K})"""
_STATUS_COLS = "alarms, warns, CASE WHEN alarms > 0 THEN 'violation' WHEN warns > 0 THEN 'warning' ELSE 'in_control' END AS status"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _limits(cl: str = "cl", sg: str = "sg", digits: int = 6) -> str:
    parts = [(cl, "center_line"), (sg, "sigma"), (f"{cl} + 3 * {sg}", "ucl"), (f"{cl} - 3 * {sg}", "lcl"), (f"{cl} + {sg}", "zone_upper1"), (f"{cl} + 2 * {sg}", "zone_upper2"), (f"{cl} - {sg}", "zone_lower1"), (f"{cl} - 2 * {sg}", "zone_lower2")]
    return ", ".join(_r(e, n, digits) for e, n in parts)


_ISO = "'%Y-%m-%dT%H:%M:%S'"
_RHO = f""", dev AS (SELECT *, avg(x) OVER {_ALL} AS mu FROM o), dd AS (SELECT *, x - mu AS d, (x - mu) * (lag(x) OVER {_W} - mu) AS dl FROM dev),
 rho AS (SELECT *, CASE WHEN n < 3 OR sum(d * d) OVER {_ALL} = 0 THEN 0 ELSE sum(dl) OVER {_ALL} / sum(d * d) OVER {_ALL} END AS rho FROM dd)"""
_DIAG = _RHO + f""", cums AS (SELECT *, abs(sum(d) OVER (PARTITION BY {_K} ORDER BY time, lot, wafer_no ROWS UNBOUNDED PRECEDING)) AS cum FROM rho),
 one AS (SELECT {_K}, count(*) AS n, coalesce(avg(mr), 0) / 1.128 AS sw, coalesce(stddev_samp(x), 0) AS st, any_value(rho) AS lag1,
  CASE WHEN count(*) < 3 OR coalesce(stddev_samp(x), 0) = 0 THEN 0 ELSE skewness(x) END AS sk, max(cum) AS top, arg_max(idx, (cum, -idx)) AS cpi FROM cums GROUP BY {_K}),
 diag AS (SELECT *, CASE WHEN sw > 0 THEN st / sw WHEN st > 0 THEN 'inf'::DOUBLE ELSE 1 END AS ratio, abs(lag1) > 2 / sqrt(n) AS sig, CASE WHEN n >= 4 AND st > 0 AND top >= st THEN cpi END AS cp FROM one),
 grade AS (SELECT *, CASE WHEN isinf(ratio) OR ratio < 1.5 THEN 'high' WHEN ratio < 3 THEN 'medium' ELSE 'low' END AS trust FROM diag)"""


def _diag_cols(digits: int = 6) -> str:
    figures = ", ".join(_r(e, n, digits) for e, n in (("sw", "sigma_within"), ("st", "sigma_total"), ("lag1", "lag1"), ("ratio", "ratio"), ("sk", "skewness")))
    return f"{figures}, sig AS autocorr_significant, cp AS change_point, trust, CASE WHEN sig OR trust = 'low' THEN 'residual' WHEN cp IS NOT NULL THEN 'cusum' ELSE 'ewma' END AS recommended"


def fixed_sql(expr: str, digits: int) -> str:
    return f"CAST(CAST(round({expr}, {digits}) AS DECIMAL(38,{digits})) AS VARCHAR)"


_REASON_COLS = f"""CASE WHEN sig OR trust = 'low' THEN 'imr,ewma,cusum' WHEN cp IS NOT NULL THEN 'imr,ewma,residual' ELSE 'imr,cusum,residual' END AS alternatives,
 CASE WHEN sig THEN 'Neighbouring points are correlated (' || {fixed_sql('lag1', 2)} || '), so residuals of an autoregression are charted.'
 WHEN trust = 'low' THEN 'Points vary ' || CASE WHEN isinf(ratio) THEN 'infinitely' ELSE {fixed_sql('CASE WHEN isinf(ratio) THEN NULL ELSE ratio END', 1)} || ' times' END || ' as much overall as between neighbours, so a trend is taken out first.'
 WHEN cp IS NOT NULL THEN 'The level may change after point ' || cp || '; sums show small lasting shifts soonest.'
 ELSE 'No trend or correlation shows and trust is ' || trust || '; weighted means show small shifts soon.' END AS reason"""
_IND = {
    "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "start_val": "arg_min(v, processed_time)", "end_val": "arg_max(v, processed_time)", "std": "coalesce(stddev_samp(v), 0)",
    "robust_std": "coalesce((quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349, 0)", "min_val": "min(v)", "max_val": "max(v)", "range_val": "max(v) - min(v)", "p05": "quantile_cont(v, 0.05)", "p95": "quantile_cont(v, 0.95)",
    "rms": "sqrt(avg(v * v))", "slope": "coalesce(nullif(regr_slope(v, epoch(processed_time)), 'nan'::DOUBLE), 0)", "area": "sum(v)", "overshoot": "max(v) - avg(v)", "undershoot": "avg(v) - min(v)",
    "rate_of_change": "(arg_max(v, processed_time) - arg_min(v, processed_time)) / nullif(((epoch_us(max(processed_time)) // 1000) - (epoch_us(min(processed_time)) // 1000)) / 1000.0::DOUBLE, 0)",
    "step_duration_s": "((epoch_us(max(processed_time)) // 1000) - (epoch_us(min(processed_time)) // 1000)) / 1000.0::DOUBLE",
}
_INDTAB = ", ind AS (SELECT lot, wafer_no, recipe, stage, recipe_step_num, system_label, signal, min(processed_time) AS start_time, " + ", ".join(f"{e} AS {n}" for n, e in _IND.items()) + ", count(v) AS n_samples FROM samples GROUP BY lot, wafer_no, recipe, stage, recipe_step_num, system_label, signal)"
_MARK = _INDTAB + """, cr AS (SELECT recipe || '|' || stage || '|' || recipe_step_num || '|' || signal AS context, mean AS value, lot, wafer_no, recipe, stage, CAST(recipe_step_num AS VARCHAR) AS step,
 system_label AS chamber, strftime(start_time, '%Y-%m-%d') AS date FROM ind),
 q AS (SELECT context, count(*) AS size, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, coalesce(stddev_samp(value), 0) AS sd FROM cr GROUP BY context),
 md AS (SELECT context, median(abs(value - median)) / 0.6745 AS mad FROM cr JOIN q USING (context) GROUP BY context),
 sg AS (SELECT *, CASE WHEN mad > 0 THEN mad WHEN iqr > 0 THEN iqr / 1.349 ELSE sd END AS s0 FROM q JOIN md USING (context)),
 mk AS (SELECT cr.*, median, CASE WHEN s0 > 1e-9 * (abs(median) + 1) THEN s0 ELSE 0 END AS s, size FROM cr JOIN sg USING (context)),
 mz AS (SELECT *, CASE WHEN size >= 4 AND s > 0 THEN (value - median) / s ELSE 0 END AS z FROM mk)"""
_RUNS = """runs AS (SELECT user_id % 8 AS machine, (epoch_us(min(ts)) // 1000) AS s, (epoch_us(max(ts)) // 1000) AS e FROM events GROUP BY user_id % 8, user_id, CAST(ts AS DATE)),
 flag AS (SELECT *, max(e) OVER (PARTITION BY machine ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM runs),
 isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY machine ORDER BY s, e) AS g FROM flag),
 blocks AS (SELECT machine, g, min(s) AS s, max(e) AS e FROM isl GROUP BY machine, g),
 gaps AS (SELECT machine, CAST(g - 2 AS BIGINT) AS after_index, lag(e) OVER (PARTITION BY machine ORDER BY s) AS gs, s - lag(e) OVER (PARTITION BY machine ORDER BY s) AS gap FROM blocks)"""
_RES = """res AS (SELECT vec_id, label, i AS pos, CASE WHEN floor(p) = ceil(p) THEN t[floor(p)::INT + 1] ELSE t[floor(p)::INT + 1] + (p - floor(p)) * (t[ceil(p)::INT + 1] - t[floor(p)::INT + 1]) END AS v
 FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS t, CAST(i AS INTEGER) AS i, i / 32.0::DOUBLE * (len(embedding) - 1) AS p FROM embeddings, range(33) r(i)))"""
_SQLRUNS = "SELECT machine, after_index, gs AS gap_start_ms, gap AS gap_ms, gap > 14400000 AS is_downtime FROM gaps WHERE gs IS NOT NULL"
_DUR = "coalesce(nullif(concat_ws(' ', CASE WHEN span // 86400000 > 0 THEN (span // 86400000) || 'd' END, CASE WHEN span % 86400000 // 3600000 > 0 THEN (span % 86400000 // 3600000) || 'h' END, CASE WHEN span % 3600000 // 60000 > 0 THEN (span % 3600000 // 60000) || 'm' END), ''), '0m')"
_QUAL = "qual AS (SELECT CAST(l_suppkey AS VARCHAR) AS lot, CAST(year(l_shipdate) AS VARCHAR) AS wafer_no, 100.0 * avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) AS yield_pct, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS defect_count FROM lineitem GROUP BY ALL)"
_MAT = f", mat AS (SELECT {_C}, {_R}, " + ", ".join(f"avg({s}) AS {s}" for s in b.LINE_SIGNALS) + f" FROM ltrace GROUP BY {_C}, {_R})"
_SC = "(PARTITION BY recipe, stage, recipe_step_num)"


_SCAN = f"""{_LLONG}, top8 AS (SELECT {_C} FROM ltrace GROUP BY {_C} ORDER BY count(DISTINCT (lot, wafer_no)) DESC, {_C} LIMIT 8), chosen AS (SELECT lsamples.* FROM lsamples JOIN top8 USING ({_C})){_pts('chosen', 'pts')}{_NUMBERED},
 lim AS (SELECT *, avg(x) OVER {_ALL} AS cl, coalesce(avg(mr) OVER {_ALL}, 0) / 1.128 AS sg FROM o){_RULES}{_STATUS}"""


def _subsystem_sql() -> str:
    out = "CASE "
    for name, (prefixes, whole) in names.SUBSYSTEMS.items():
        tests = [f"starts_with(signal, '{p}')" for p in prefixes] + [f"signal = '{w}'" for w in whole]
        out += f"WHEN {' OR '.join(tests)} THEN '{name}' "
    return out + "ELSE 'interlock' END"


ORACLES: dict[str, str] = {
    "contexts": f"WITH {_T} SELECT {_C}, count(DISTINCT (lot, wafer_no)) AS wafer_runs, count(*) AS samples FROM trace GROUP BY {_C}",
    "wafer_points": f"WITH {_LONG}{_pts('samples', 'p')} SELECT {_K}, {_R}, strftime(time, {_ISO}) AS time, {_r('value', 'value')}, {_r('std', 'std')}, {_r('min', 'min')}, {_r('max', 'max')}, samples FROM p",
    "wafer_matrix": f"WITH {_L}{_MAT} SELECT {_C}, {_R}, " + ", ".join(_r(s, s) for s in b.LINE_SIGNALS) + " FROM mat",
    "equipment_runs": f"WITH {_T} SELECT {_R}, min(recipe) AS recipe, (epoch_us(min(processed_time)) // 1000) AS start_ms, (epoch_us(max(processed_time)) // 1000) AS end_ms, {_r('coalesce(max(k), 0)', 'on_time')} FROM trace GROUP BY {_R}",
    "wafer_steps": f"WITH {_T} SELECT {_R}, {_C}, count(*) AS samples, strftime(min(processed_time), {_ISO}) AS start_time FROM trace GROUP BY {_R}, {_C}",
    "dataset_summary": f"WITH {_T} SELECT count(*) AS samples, count(DISTINCT lot) AS lots, count(DISTINCT (lot, wafer_no)) AS wafers, count(DISTINCT recipe) AS recipes, count(DISTINCT stage) AS stages, count(DISTINCT system_label) AS chambers FROM trace",
    "signal_stats": f"WITH {_LONG} SELECT signal, count(v) AS non_null, {_r('min(v)', 'min_val')}, {_r('max(v)', 'max_val')}, count(DISTINCT v) AS distinct_vals, coalesce(count(DISTINCT v) <= 2 AND min(v) >= 0 AND max(v) <= 1, false) AS is_flag FROM samples GROUP BY signal",
    "analog_signals": f"WITH {_LLONG} SELECT signal FROM lsamples GROUP BY signal HAVING NOT (count(DISTINCT v) <= 2 AND min(v) >= 0 AND max(v) <= 1)",
    "indicators": f"WITH {_LONG}{_INDTAB} SELECT lot, wafer_no, recipe, stage, recipe_step_num, system_label, signal, strftime(start_time, {_ISO}) AS start_time, n_samples, " + ", ".join(_r(n, n, 5) for n in _IND) + " FROM ind",
    "indicator_counts": f"WITH {_LONG}{_INDTAB} SELECT count(*) AS rows, count(DISTINCT signal) AS signals, count(DISTINCT (lot, wafer_no, recipe, stage, recipe_step_num, system_label)) AS wafer_steps FROM ind",
    "indicator_points": f"WITH {_LONG}{_INDTAB} SELECT {_K}, {_R}, system_label, strftime(start_time, {_ISO}) AS time, {_r('overshoot', 'value')}, {_r('std', 'std')}, {_r('min_val', 'min')}, {_r('max_val', 'max')}, n_samples AS samples FROM ind WHERE isfinite(overshoot)",
    "control_limits": f"{_OWN} SELECT {_K}, n, n < 8 AS insufficient, {_limits(digits=3)} FROM (SELECT DISTINCT {_K}, n, cl, sg FROM lim)",
    "spc_violations": f"{_OWN}{_RULES} SELECT {_K}, {_R}, strftime(time, {_ISO}) AS time, idx, {_r('x', 'value')}, {_r('cl', 'center_line')}, {_r('sg', 'sigma')}, rule, CASE WHEN rule = 'beyond_3sigma' THEN 'alarm' ELSE 'warn' END AS severity FROM (SELECT *, 'beyond_3sigma' AS rule FROM flags WHERE r1 UNION ALL SELECT *, 'two_of_three_2sigma' FROM flags WHERE r2 UNION ALL SELECT *, 'four_of_five_1sigma' FROM flags WHERE r3 UNION ALL SELECT *, 'eight_in_row_side' FROM flags WHERE r4)",
    "chart_status": f"{_OWN}{_RULES}{_STATUS} SELECT {_K}, points, {_STATUS_COLS} FROM status",
    "baseline_limits": f"{_FROZEN} SELECT {_K}, base_start, base_end, points, base_end - base_start + 1 AS n, base_end - base_start + 1 < 8 AS insufficient, {_limits()} FROM base",
    "imr_status": f"{_FROZEN}{_RULES}{_STATUS} SELECT {_K}, points, {_STATUS_COLS} FROM status",
    "ewma_chart": f"""{_FROZEN.replace("WITH ", "WITH RECURSIVE ", 1)}, ew AS (SELECT {_K}, {_R}, idx, cl, sg, 0.2 * x + 0.8 * cl AS z FROM lim WHERE idx = 0
 UNION ALL SELECT l.recipe, l.stage, l.recipe_step_num, l.signal, l.lot, l.wafer_no, l.idx, l.cl, l.sg, 0.2 * l.x + 0.8 * ew.z FROM ew JOIN lim l ON l.recipe = ew.recipe AND l.stage = ew.stage AND l.recipe_step_num = ew.recipe_step_num AND l.signal = ew.signal AND l.idx = ew.idx + 1),
 ws AS (SELECT *, 3 * sg * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (idx + 1)))) AS w FROM ew)
 SELECT {_K}, {_R}, idx, {_r('cl', 'center_line')}, {_r('z', 'statistic')}, {_r('cl + w', 'ucl')}, {_r('cl - w', 'lcl')}, sg > 0 AND abs(z - cl) > w AS alarm FROM ws""",
    "cusum_chart": f"""{_FROZEN.replace("WITH ", "WITH RECURSIVE ", 1)}, zs AS (SELECT *, CASE WHEN sg > 0 THEN (x - cl) / sg ELSE 0 END AS z FROM lim),
 cu AS (SELECT {_K}, {_R}, idx, sg, greatest(0, z - 0.5) AS u, greatest(0, -z - 0.5) AS d FROM zs WHERE idx = 0
 UNION ALL SELECT l.recipe, l.stage, l.recipe_step_num, l.signal, l.lot, l.wafer_no, l.idx, l.sg, greatest(0, cu.u + l.z - 0.5), greatest(0, cu.d - l.z - 0.5) FROM cu JOIN zs l ON l.recipe = cu.recipe AND l.stage = cu.stage AND l.recipe_step_num = cu.recipe_step_num AND l.signal = cu.signal AND l.idx = cu.idx + 1)
 SELECT {_K}, {_R}, idx, {_r('u', 'statistic')}, {_r('d', 'statistic_low')}, 5.0::DOUBLE AS ucl, 0.0::DOUBLE AS lcl, sg > 0 AND (u > 5 OR d > 5) AS alarm FROM cu""",
    "residual_chart": f"""{_LORD}{_RHO}, ar AS (SELECT *, CASE WHEN idx = 0 OR n < 3 THEN 0 ELSE x - mu * (1 - rho) - rho * lag(x) OVER {_W} END AS e FROM rho),
 m2 AS (SELECT *, CASE WHEN idx > 1 THEN abs(e - lag(e) OVER {_W}) END AS emr FROM ar), s3 AS (SELECT *, coalesce(avg(emr) OVER {_ALL}, 0) / 1.128 AS es FROM m2)
 SELECT {_K}, {_R}, idx, {_r('rho', 'phi', 3)}, {_r('e', 'statistic', 3)}, {_r('3 * es', 'ucl', 3)}, {_r('-3 * es', 'lcl', 3)}, es > 0 AND idx > 0 AND abs(e) > 3 * es AS alarm FROM s3""",
    "diagnosis": f"{_LORD}{_DIAG} SELECT {_K}, n, {_diag_cols(3)}, {_REASON_COLS} FROM grade",
    "adaptive_spc": f"{_FROZEN}{_DIAG}{_RULES}{_STATUS} SELECT {_K}, base_start, base_end, base.points, base_end - base_start + 1 < 8 AS insufficient, {_limits()}, grade.n, {_diag_cols()}, {_STATUS_COLS} FROM base JOIN grade USING ({_K}) JOIN status USING ({_K})",
    "linear_fit": f"{_LORD} SELECT {_K}, count(*) AS n, {_r('regr_slope(x, idx)', 'slope', 3)}, {_r('regr_intercept(x, idx)', 'intercept', 3)}, {_r('sqrt((regr_syy(x, idx) - regr_slope(x, idx) * regr_sxy(x, idx)) / count(*))', 'residual_rms', 3)} FROM o GROUP BY {_K}",
    "capability": f"""{_ORD}{_pts('samples', 'kp', "WHERE signal = 'k'")}, spec AS (SELECT {_C}, avg(value) AS target FROM kp GROUP BY {_C}),
 c AS (SELECT {_K}, avg(x) AS m, coalesce(avg(mr), 0) / 1.128 AS sw, coalesce(stddev_samp(x), 0) AS st FROM o GROUP BY {_K}),
 u AS (SELECT *, target + 0.05 * abs(target) AS usl, target - 0.05 * abs(target) AS lsl FROM c LEFT JOIN spec USING ({_C})),
 k AS (SELECT *, (usl - lsl) / (6 * sw) AS cp, least((usl - m) / (3 * sw), (m - lsl) / (3 * sw)) AS cpk, (usl - lsl) / (6 * st) AS pp, least((usl - m) / (3 * st), (m - lsl) / (3 * st)) AS ppk FROM u)
 SELECT {_K}, {_r('m', 'mean')}, {_r('sw', 'sigma_within')}, {_r('st', 'sigma_total')}, {_r('target', 'target')}, {_r('usl', 'usl')}, {_r('lsl', 'lsl')}, {_r('cp', 'cp')}, {_r('cpk', 'cpk')}, {_r('pp', 'pp')}, {_r('ppk', 'ppk')}, CASE WHEN cpk IS NULL THEN 'unknown' WHEN cpk >= 1.33 THEN 'capable' WHEN cpk >= 1 THEN 'marginal' ELSE 'incapable' END AS grade FROM k""",
    "risk_scan": f"""WITH {_SCAN} SELECT {_K}, points, {_STATUS_COLS}, points < 8 AS insufficient FROM status WHERE alarms + warns > 0""",
    "risk_summary": f"""WITH {_SCAN} SELECT count(*) FILTER (alarms + warns > 0) AS charts, count(*) FILTER (points < 8) AS insufficient, CAST(sum(alarms) AS BIGINT) AS total_alarms, CAST(sum(warns) AS BIGINT) AS total_warns,
 (SELECT count(*) * 4 FROM top8) AS scanned FROM status""",
    "yield_correlations": f"WITH {_LLONG}{_pts('lsamples', 'p')}, {_QUAL} SELECT {_K}, {_r('corr(value, yield_pct)', 'r')}, count(*) AS n FROM p JOIN qual USING (lot, wafer_no) GROUP BY {_K} HAVING count(*) >= 5",
    "yield_pairs": f"""WITH {_LLONG}{_pts('lsamples', 'p')}, {_QUAL} SELECT {_K}, lot, wafer_no, {_r('value', 'value')}, {_r('defect_count', 'response')} FROM p JOIN qual USING (lot, wafer_no)""",
    "commonality_anomalies": f"WITH {_LONG}{_MARK} SELECT context, lot, wafer_no, {_r('value', 'value', 5)}, {_r('median', 'median', 5)}, {_r('s', 'robust_sigma', 5)}, {_r('z', 'z', 5)} FROM mz WHERE abs(z) > 2",
    "commonality_findings": f"""WITH {_LONG}{_MARK}, tot AS (SELECT count(*) FILTER (abs(z) > 2) AS nb, count(*) FILTER (abs(z) <= 2) AS ng FROM mz),
 u AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) FILTER (abs(z) > 2) AS bc, count(*) FILTER (abs(z) <= 2) AS gc FROM mz GROUP BY {d}" for d in com.DIMENSIONS)}),
 f AS (SELECT *, bc / nb AS br, gc / ng AS gr, (bc + gc) / (nb + ng) AS p FROM u, tot WHERE value IS NOT NULL AND bc + gc >= 3),
 g AS (SELECT *, CASE WHEN p * (1 - p) = 0 THEN 0 ELSE (br - gr) / sqrt(p * (1 - p) * (1 / nb + 1 / ng)) END AS z FROM f)
 SELECT dimension, value, bc AS bad_count, gc AS good_count, {_r('br', 'bad_ratio')}, {_r('gr', 'good_ratio')}, {_r('br - gr', 'ratio_gap')}, {_r('z', 'z')}, bc + gc AS support, abs(z) >= 1.96 AS significant FROM g""",
    "equipment_report": f"""WITH {_RUNS}, st AS (SELECT *, s - lag(s) OVER (PARTITION BY machine ORDER BY s, e) AS step FROM runs),
 a AS (SELECT machine, count(*) AS runs, arg_max(e, (s, e)) - min(s) AS span, avg(greatest(0, e - s)) AS mr, coalesce(avg(step), 0) AS mi FROM st GROUP BY machine),
 p AS (SELECT machine, CAST(sum(e - s) AS BIGINT) AS prod FROM blocks GROUP BY machine),
 g AS (SELECT machine, max(gap) AS lg, arg_max(gs, (gap, -gs)) AS la, count(*) AS ng, count(*) FILTER (gap > 14400000) AS nd FROM gaps WHERE gs IS NOT NULL GROUP BY machine)
 SELECT machine, runs, span AS span_ms, prod AS productive_ms, greatest(0, span - prod) AS idle_ms, {_r('CASE WHEN span > 0 THEN prod / span ELSE 0 END', 'utilization')}, {_r('mr', 'mean_run_ms')}, {_r('mi', 'mean_interval_ms')},
 coalesce(lg, 0) AS longest_gap_ms, la AS longest_gap_at_ms, coalesce(ng, 0) AS gaps, coalesce(nd, 0) AS downtimes, {_DUR} AS span_text, {_r('prod / 1e9', 'pm_ratio')}, prod >= 1000000000 AS pm_due FROM a JOIN p USING (machine) LEFT JOIN g USING (machine)""",
    "idle_gaps": f"WITH {_RUNS} {_SQLRUNS}",
    "trace_overlay": f"""WITH {_LONG} SELECT {_C}, {_R}, signal, strftime(processed_time, '%Y-%m-%dT%H:%M:%S.%g') AS time, {_r('v', 'v')}, {_r(f'CASE WHEN max(v) OVER w = min(v) OVER w THEN 0.5 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END', 'scaled')} FROM samples WINDOW w AS (PARTITION BY {_C}, {_R}, signal)""",
    "trace_envelope": f"WITH {_RES} SELECT label, pos, {_r('avg(v)', 'center')}, {_r('avg(v) - 3 * coalesce(stddev_samp(v), 0)', 'lower')}, {_r('avg(v) + 3 * coalesce(stddev_samp(v), 0)', 'upper')} FROM res GROUP BY label, pos",
    "trace_deviation": f"""WITH {_RES}, env AS (SELECT label, pos, avg(v) - 2 * coalesce(stddev_samp(v), 0) AS lo, avg(v) + 2 * coalesce(stddev_samp(v), 0) AS hi FROM res GROUP BY label, pos),
 ex AS (SELECT vec_id, label, greatest(v - hi, lo - v, 0) AS e FROM res JOIN env USING (label, pos)) SELECT vec_id, label, {_r('count(*) FILTER (e > 0) / 33.0::DOUBLE', 'out_of_band', 5)}, {_r('coalesce(avg(e) FILTER (e > 0), 0)', 'mean_excess', 5)}, count(*) FILTER (e > 0) / 33.0::DOUBLE > 0.1 AS alarm FROM ex GROUP BY vec_id, label""",
    "standardized": f"WITH {_L}{_MAT} SELECT {_C}, {_R}, " + ", ".join(_r(f"({s} - avg({s}) OVER {_SC}) / CASE WHEN stddev_samp({s}) OVER {_SC} > 0 THEN stddev_samp({s}) OVER {_SC} ELSE 1 END", s, 5) for s in b.LINE_SIGNALS) + " FROM mat",
    "correlation_matrix": f"WITH {_L}{_MAT} " + " UNION ALL ".join(f"SELECT {_C}, '{x}' AS a, '{y}' AS b, {_r(f'coalesce(nullif(corr({x}, {y}), {chr(39)}nan{chr(39)}::DOUBLE), 0)', 'r')} FROM mat GROUP BY {_C}" for i, x in enumerate(b.LINE_SIGNALS) for y in b.LINE_SIGNALS[i:]),
    "injected_faults": f"""{_ORD}, c AS (SELECT {_K}, CAST(idx AS INTEGER) AS idx, x, avg(x) OVER {_ALL} AS mu FROM o)
 SELECT {_K}, idx, {_r('CASE WHEN idx >= 60 THEN x + 2 ELSE x END', 'value')}, idx >= 60 AS is_faulty, 'shift' AS kind FROM c UNION ALL SELECT {_K}, idx, {_r('CASE WHEN idx >= 60 THEN x + 0.2 * (idx - 59) ELSE x END', 'value')}, idx >= 60, 'drift' FROM c
 UNION ALL SELECT {_K}, idx, {_r('CASE WHEN idx = 60 THEN x + 8 ELSE x END', 'value')}, idx = 60, 'spike' FROM c UNION ALL SELECT {_K}, idx, {_r('CASE WHEN idx >= 60 THEN x + (x - mu) ELSE x END', 'value')}, idx >= 60, 'variance' FROM c""",
    "signal_catalog": "SELECT signal, " + _subsystem_sql() + " AS subsystem, " + " OR ".join(f"contains(signal, '{p}')" for p in names.ANALOG_PARTS) + " AS analog FROM (VALUES " + ", ".join(f"('{s}')" for s in names.SIGNALS) + ") t(signal)",
    "lot_types": "SELECT lot, CASE WHEN regexp_matches(lot, 'aging|age', 'i') THEN 'aging' WHEN regexp_matches(lot, 'bare|dummy|dmy', 'i') THEN 'bare' WHEN regexp_matches(lot, 'mon|test|ted|qual|qc', 'i') THEN 'monitor' ELSE 'product' END AS wafer_type FROM (SELECT DISTINCT event_type AS lot FROM events UNION ALL VALUES ('AGING-1'), ('Dummy7'), ('QC_3'), ('N123'), ('lot-mon'))",
    "dashboard": f"WITH {_T} SELECT {_R}, {_C}, count(*) AS samples, strftime(min(processed_time), {_ISO}) AS start_time FROM trace GROUP BY {_R}, {_C} ORDER BY min(processed_time) DESC, {_C} LIMIT 8",
}
