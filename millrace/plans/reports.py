"""Queries of ingest, monitoring, detectors and reports, and their equivalents in SQL (written on their own)."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import explain
from millrace.operators import aggregates as agg
from millrace.operators import commonality as com
from millrace.operators import detectors, equipment, fdc, spc
from millrace.plans import api, registry
from millrace.plans.registry import CTX, rounded
from millrace.sources import bindings as b
from millrace.sources import ingest
from millrace.sources.scratch import shared_folder

RUN_ORDER = ["time", "lot", "wafer_no"]
RAW = {"processed_time": "Processed Time", "lot": "Lot", "recipe": "Recipe", "stage": "Stage", "wafer_no": "Wafer No.", "system_label": "System Label", "step": "Recipe_Step_Num", "top_step": "Recipe_Max_Step"}
RAW_SIGNALS = ["APC_Position", "Gas1_Monitor"]


# ---------------------------------------------------------------- ingest
def raw_csv(spark: SparkSession, sf: str) -> str:
    """events as raw files of text, with what raw files hold: steps with a fraction, values that can't be read, blanks."""
    t, odd = b.trace(spark, sf), F.col("value") > 90
    rows = t.select(
        F.date_format("processed_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_time"), "lot", "recipe", "stage", "wafer_no", "system_label", F.when(odd, "1.0").otherwise("1").alias("step"),
        F.col("value").cast("string").alias("APC_Position"), F.when(F.col("k") % 5 == 0, "bad").when(F.col("k") % 5 == 1, F.lit(None)).otherwise(F.col("k").cast("string")).alias("Gas1_Monitor"), F.lit("9").alias("top_step"),
    )
    out = shared_folder(spark, "raw")
    rows.select(*(F.col(c).alias(RAW.get(c, c)) for c in rows.columns)).write.csv(out, header=True, quote='"', escape='"')
    return out


def ingested_trace(spark, sf):
    df = ingest.typed_trace(ingest.read_text_csv(spark, raw_csv(spark, sf)), RAW_SIGNALS)
    return df.withColumn("processed_time", F.date_format("processed_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def ingest_counts(spark, sf):
    """The whole ingest (trace, signal statistics, indicators written below a folder) and its checked counts."""
    counts = ingest.ingest(spark, raw_csv(spark, sf), out := shared_folder(spark, "store"), RAW_SIGNALS, b.table(spark, sf, "events").count())
    stats = spark.read.parquet(f"{out}/signal_stats").agg(F.count("*").alias("signals"), F.sum("non_null").alias("values"))
    return stats.select(*(F.lit(n).cast("long").alias(c) for c, n in counts.items()), "signals", "values")


def ingested_quality(spark, sf):
    out = shared_folder(spark, "quality")
    b.quality(spark, sf).select(F.col("lot").alias("Lot_ID"), F.col("wafer_no").alias("Slot"), F.col("yield_pct").alias("CP_Yield"), F.col("defect_count").alias("Defects")).write.csv(out, header=True)
    return rounded(ingest.load_quality(spark, out))


# ---------------------------------------------------------------- choices, listings, texts
def context_choices(spark, sf):
    """The values to choose from at each level, one level after the other."""
    t = b.trace(spark, sf)
    recipes = api.selector(t, CTX)
    first = recipes.first()["recipe"]
    stages = api.selector(t, CTX, {"recipe": first})
    steps = api.selector(t, CTX, {"recipe": first, "stage": stages.first()["stage"]})
    text = lambda df, level: df.select(F.lit(level).alias("level"), F.col(level).cast("string").alias("choice"))
    return text(recipes, "recipe").unionByName(text(stages, "stage")).unionByName(text(steps, "recipe_step_num"))


def run_trace(spark, sf):
    t = b.trace(spark, sf)
    lot = t.agg(F.min("lot").alias("lot")).first()["lot"]
    return rounded(api.trace(t, lot, "0", 1, "value, k"))


def bound_query(spark, sf):
    """SQL with parameters bound by name."""
    found = api.sql(spark, "SELECT recipe, stage, count(*) AS samples FROM {trace} WHERE value >= :low AND value < :high GROUP BY recipe, stage", {"trace": b.trace(spark, sf)}, low=10.0, high=60.0)
    return api.answered(lambda: found).data


def limit_texts(spark, sf):
    df = spc.control_limits(registry._points(spark, sf))
    return df.select(*spc.KEYS, explain.sigma(F.col("sigma")).alias("sigma_text"), explain.limits(F.col("center_line"), F.col("lcl"), F.col("ucl")).alias("limits_text"), explain.stability(F.col("n"), F.col("insufficient")).alias("stability_text"))


def setpoint_values(spark, sf):
    return rounded(registry._iso(agg.run_points(b.trace(spark, sf), ["k"]).select(*CTX, "lot", "wafer_no", "time", "value"), "time"))


def listed_signals(spark, sf):
    stats = agg.signal_stats(b.line_trace(spark, sf), b.LINE_SIGNALS, exact=True)
    return rounded(api.contexts(b.line_trace(spark, sf), stats)[1])


# ---------------------------------------------------------------- multivariate monitoring
def _monitored(spark, sf, components=3):
    """Three components of four signals, so that a residual is left in every context."""
    m = agg.run_matrix(b.line_trace(spark, sf), b.LINE_SIGNALS)
    return fdc.monitor(m, b.LINE_SIGNALS, CTX, RUN_ORDER, components=components)


def fdc_monitor(spark, sf):
    return rounded(registry._iso(_monitored(spark, sf).drop("causes", "residual_causes"), "time"), 4)


def _causes(df: DataFrame, column: str) -> DataFrame:
    nth = df.select(*CTX, *RUN_ORDER, F.posexplode(column).alias("nth", "c")).select(*CTX, *RUN_ORDER, "nth", "c.signal", "c.value", "c.percent")
    return rounded(registry._iso(nth, "time"), 3)


def fdc_full_rank(spark, sf):
    """All components: T2 is the whole distance, and there is no SPE chart."""
    return rounded(registry._iso(_monitored(spark, sf, 4).select(*CTX, *RUN_ORDER, "t2", "t2_alarm", "spe", "spe_alarm", F.col("spe_limit").isNull().alias("without_spe"), "components"), "time"), 5)


def dtw_distances(spark, sf):
    v = registry._vectors(spark, sf)
    goal = [r["center"] for r in fdc.envelope(v, "trace", [], 32).orderBy("pos").collect()]  # 32 rows
    return rounded(fdc.dtw_to(v.withColumn("t", fdc.resample(F.col("trace"), 32)), "t", goal, 4).drop("trace", "t"))


def deviation_points(spark, sf):
    v = registry._vectors(spark, sf)
    return rounded(fdc.deviation_points(v, "vec_id", "trace", fdc.envelope(v, "trace", ["label"], 33, 2.0), ["label"], 33), 5)


# ---------------------------------------------------------------- equipment, dashboard
def downsampled_runs(spark, sf):
    runs = equipment.equipment_runs(b.trace(spark, sf), "k").where(F.col("on_time") > 0)
    return rounded(equipment.downsample(runs.select("start_ms", "lot", "wafer_no", "on_time"), ["start_ms", "lot", "wafer_no"], 50))


def dashboard_figures(spark, sf):
    """The dashboard's summary and totals in one row."""
    return agg.dataset_summary(b.line_trace(spark, sf)).join(F.broadcast(registry.risk_summary(spark, sf)))


def detector_alarms(spark, sf):
    return detectors.alarms(detectors.scenario_series(spark))


def detector_report(spark, sf):
    return rounded(detectors.report(spark, mode="shifted"))


def lcg_numbers(spark, sf):
    u = detectors.uniform(4242)
    return spark.createDataFrame([(i, int(next(u) * 2**32)) for i in range(1, 501)], "i long, state long")


def normal_numbers(spark, sf):
    return rounded(spark.createDataFrame(list(enumerate(detectors.normal_series(200, 5.0, 2.0, 4242))), "idx long, value double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ingested_trace, ingest_counts, ingested_quality, context_choices, run_trace, bound_query, limit_texts, setpoint_values, listed_signals, fdc_monitor, fdc_full_rank, dtw_distances, deviation_points,
        downsampled_runs, dashboard_figures, detector_alarms, detector_report, lcg_numbers, normal_numbers,
    )
} | {
    "fdc_alarms": lambda s, d: _causes(fdc.alarms(_monitored(s, d)), "causes"),
    "fdc_residual_ranks": lambda s, d: _causes(_monitored(s, d), "residual_causes"),
    "detector_benchmark": lambda s, d: rounded(detectors.grade(detectors.run_scenarios(s))),
    "detector_run_lengths": lambda s, d: rounded(detectors.run_lengths(s)),
    "recent_runs": lambda s, d: equipment.recent_runs(equipment.equipment_runs(b.trace(s, d), "k")),
    "downtimes": lambda s, d: equipment.downtimes(equipment.idle_gaps(b.user_runs(s, d), ["machine"])),
    "top_findings": lambda s, d: rounded(com.top_findings(com.findings(registry.marked(s, d))).select("dimension", "value", "bad_count", "good_count", "ratio_gap", "z")),
    "top_anomalies": lambda s, d: rounded(com.top_anomalies(registry.marked(s, d)).select("context", "lot", "wafer_no", "value", "z"), 5),
}

# ---------------------------------------------------------------- the same in SQL
_r, _C, _K, _T, _L = registry._r, registry._C, registry._K, registry._T, registry._L
_ISO = registry._ISO
_SIG = b.LINE_SIGNALS
_P = range(1, 5)
_Z99 = repr(NormalDist().inv_cdf(0.99))


def _wh(df: str) -> str:
    return f"pow(1 - 2 / (9.0::DOUBLE * {df}) + {_Z99}::DOUBLE * sqrt(2 / (9.0::DOUBLE * {df})), 3)"


def _sum(parts) -> str:
    return " + ".join(parts)


def _corr(i: int, j: int) -> str:
    return "1.0::DOUBLE" if i == j else f"r{min(i, j)}{max(i, j)}"


_BASE = f"""{_L}, mat AS (SELECT {_C}, lot, wafer_no, min(processed_time) AS time, {", ".join(f"avg({s}) AS x{i}" for i, s in zip(_P, _SIG))} FROM ltrace GROUP BY {_C}, lot, wafer_no),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY time, lot, wafer_no) AS nth_run, count(*) OVER (PARTITION BY {_C}) AS n FROM mat QUALIFY n > 10),
 st AS (SELECT {_C}, count(*) AS nb, {", ".join(f"avg(x{i}) AS m{i}, stddev_samp(x{i}) AS s{i}" for i in _P)}, {", ".join(f"corr(x{i}, x{j}) AS r{i}{j}" for i in _P for j in _P if i < j)}
  FROM ranked WHERE nth_run <= greatest(10, floor(0.4::DOUBLE * n)) GROUP BY {_C}),
 c1 AS (SELECT *, r12 AS l21, r13 AS l31, r14 AS l41, sqrt(1 - r12 * r12) AS l22 FROM st),
 c2 AS (SELECT *, (r23 - l31 * l21) / l22 AS l32, (r24 - l41 * l21) / l22 AS l42 FROM c1),
 c3 AS (SELECT *, sqrt(1 - l31 * l31 - l32 * l32) AS l33 FROM c2),
 c4 AS (SELECT *, (r34 - l41 * l31 - l42 * l32) / l33 AS l43 FROM c3),
 ch AS (SELECT *, sqrt(1 - l41 * l41 - l42 * l42 - l43 * l43) AS l44, greatest({", ".join(_sum(f"abs({_corr(i, j)})" for j in _P) for i in _P)}) AS top FROM c4)"""
_NEXT = ", ".join(f"top * v{i} - ({_sum(f'{_corr(i, j)} * v{j}' for j in _P)}) AS w{i}" for i in _P)
_Z = ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in _P)
_SOLVED = """ y1 AS (SELECT *, z1 AS y1 FROM zs), y2 AS (SELECT *, (z2 - l21 * y1) / l22 AS y2 FROM y1), y3 AS (SELECT *, (z3 - l31 * y1 - l32 * y2) / l33 AS y3 FROM y2),
 y4 AS (SELECT *, (z4 - l41 * y1 - l42 * y2 - l43 * y3) / l44 AS y4 FROM y3), b4 AS (SELECT *, y4 / l44 AS q4 FROM y4), b3 AS (SELECT *, (y3 - l43 * q4) / l33 AS q3 FROM b4),
 b2 AS (SELECT *, (y2 - l32 * q3 - l42 * q4) / l22 AS q2 FROM b3), b1 AS (SELECT *, y1 - l21 * q2 - l31 * q3 - l41 * q4 AS q1, y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 AS whole FROM b2)"""
_FULL = f"WITH {_BASE}, zs AS (SELECT ranked.*, {_Z}, ch.* EXCLUDE (recipe, stage, recipe_step_num) FROM ranked JOIN ch USING ({_C})),{_SOLVED}"
# the least eigenvalue's vector by power iteration on top * 1 - R; the other three are the components
_FDC = f"""WITH RECURSIVE {_BASE}, pw AS (SELECT ch.*, 0 AS it, 0.5::DOUBLE AS v1, 0.45::DOUBLE AS v2, -0.4::DOUBLE AS v3, 0.35::DOUBLE AS v4 FROM ch
 UNION ALL SELECT * EXCLUDE (w1, w2, w3, w4, v1, v2, v3, v4, it), it + 1, {", ".join(f"w{i} / sqrt(w1 * w1 + w2 * w2 + w3 * w3 + w4 * w4)" for i in _P)} FROM (SELECT *, {_NEXT} FROM pw WHERE it < 1500)),
 ev AS (SELECT *, {_sum(f"v{i} * ({_sum(f'{_corr(i, j)} * v{j}' for j in _P)})" for i in _P)} AS lam FROM pw WHERE it = 1500),
 zs AS (SELECT ranked.*, {_Z}, ev.* EXCLUDE (recipe, stage, recipe_step_num) FROM ranked JOIN ev USING ({_C})),{_SOLVED},
 sc AS (SELECT *, {_sum(f"v{i} * z{i}" for i in _P)} AS s FROM b1),
 t AS (SELECT *, whole - s * s / lam AS t2, s * s AS spe, 3 * (nb * nb - 1.0::DOUBLE) / (nb * (nb - 3.0::DOUBLE)) * ({_wh("3")} / ({_wh("(nb - 3)")})) AS t2_limit, lam * pow({_Z99}::DOUBLE * sqrt(2.0::DOUBLE) / 3 + 1 - 2 / 9.0::DOUBLE, 3) AS spe_limit FROM sc),
 al AS (SELECT *, t2 > t2_limit AS t2_alarm, spe > spe_limit AS spe_alarm FROM t)"""
_CAUSES = f"""{_FDC}, parts AS (SELECT {_C}, time, lot, wafer_no, unnest([{", ".join(f"struct_pack(i := {i}, signal := '{s}', e := pow(v{i} * s, 2), value := pow(v{i} * s, 2) + greatest(0, z{i} * (q{i} - v{i} * s / lam)))" for i, s in zip(_P, _SIG))}], recursive := true), t2_alarm, spe_alarm FROM al)"""
_KEYT = f"{_C}, lot, wafer_no, strftime(time, {_ISO}) AS time"

_GOLD = registry._RES.replace("/ 32.0::DOUBLE", "/ 31.0::DOUBLE").replace("range(33)", "range(32)")
_INF = "'inf'::DOUBLE"
_DTW = f"""WITH RECURSIVE {_GOLD}, gold AS (SELECT list(c ORDER BY pos) AS g FROM (SELECT pos, avg(v) AS c FROM res GROUP BY pos)), arr AS (SELECT vec_id, label, list(v ORDER BY pos) AS t FROM res GROUP BY vec_id, label),
 d AS (SELECT vec_id, label, t, g, 1 AS s, list_transform(range(33), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE {_INF} END) AS c2, list_transform(range(33), lambda i: {_INF}) AS c1,
  list_transform(range(33), lambda i: 0) AS n2, list_transform(range(33), lambda i: 0) AS n1 FROM arr, gold
 UNION ALL SELECT vec_id, label, t, g, s + 1, c1,
  list_transform(range(33), lambda i: CASE WHEN i < 1 OR s + 1 - i < 1 OR s + 1 - i > 32 OR abs(2 * i - s - 1) > 4 THEN {_INF} ELSE abs(t[i] - g[s + 1 - i]) + least(c2[i], c1[i], c1[i + 1]) END),
  n1, list_transform(range(33), lambda i: CASE WHEN i < 1 OR s + 1 - i < 1 OR s + 1 - i > 32 OR abs(2 * i - s - 1) > 4 THEN 0 WHEN c2[i] <= c1[i] AND c2[i] <= c1[i + 1] THEN n2[i] + 1 WHEN c1[i] <= c1[i + 1] THEN n1[i] + 1 ELSE n1[i + 1] + 1 END)
  FROM d WHERE s < 64)
 SELECT vec_id, label, {_r('c1[33]', 'dtw')}, {_r('c1[33] / n1[33]', 'dtw_normalized')} FROM d WHERE s = 64"""


def _numbers(seeds: str, most: int) -> str:
    """CTEs u (states of the generator for each g) and normal (g, idx, x). seeds: a query of (g, seed)."""
    return f"""u AS (SELECT g, 1 AS i, (1664525 * (seed::BIGINT % 4294967296) + 1013904223) % 4294967296 AS st FROM ({seeds})
 UNION ALL SELECT g, i + 1, (1664525 * st + 1013904223) % 4294967296 FROM u WHERE i < {most}),
 pr AS (SELECT g, (i + 1) // 2 AS p, 2 * max(st) FILTER (i % 2 = 1) / 4294967296.0::DOUBLE - 1 AS a, 2 * max(st) FILTER (i % 2 = 0) / 4294967296.0::DOUBLE - 1 AS b FROM u GROUP BY g, (i + 1) // 2),
 ok AS (SELECT *, a * a + b * b AS s, row_number() OVER (PARTITION BY g ORDER BY p) - 1 AS k FROM pr WHERE a * a + b * b > 0 AND a * a + b * b < 1),
 normal AS (SELECT g, CAST(2 * k + h AS INTEGER) AS idx, CASE WHEN h = 0 THEN a ELSE b END * sqrt(-2 * ln(s) / s) AS x FROM ok, (VALUES (0), (1)) hh(h))"""


def _alarms(series: str) -> str:
    """CTEs up to al (g, idx, method): alarms of all methods, of series (g, idx, x) with frozen limits from the first 30 points."""
    w = "(PARTITION BY g ORDER BY idx)"
    return f"""se AS ({series}), sm AS (SELECT *, abs(x - lag(x) OVER {w}) AS mr, lag(x) OVER {w} AS px FROM se),
 li AS (SELECT g, avg(x) AS oc, avg(mr) / 1.128 AS os, avg(x) FILTER (idx < 30) AS fc, avg(mr) FILTER (idx < 30) / 1.128 AS fs, avg(x) AS mu FROM sm GROUP BY g),
 ew AS (SELECT g, idx, fc, fs, 0.2 * x + 0.8 * fc AS z FROM se JOIN li USING (g) WHERE idx = 0 UNION ALL SELECT ew.g, se.idx, fc, fs, 0.2 * se.x + 0.8 * z FROM ew JOIN se ON se.g = ew.g AND se.idx = ew.idx + 1),
 cu AS (SELECT g, idx, fc, fs, greatest(0, (x - fc) / fs - 0.5) AS u, greatest(0, (fc - x) / fs - 0.5) AS d FROM se JOIN li USING (g) WHERE idx = 0
  UNION ALL SELECT cu.g, se.idx, fc, fs, greatest(0, u + (se.x - fc) / fs - 0.5), greatest(0, d + (fc - se.x) / fs - 0.5) FROM cu JOIN se ON se.g = cu.g AND se.idx = cu.idx + 1),
 ph AS (SELECT g, sum((x - mu) * (px - mu)) / sum((x - mu) * (x - mu)) AS phi FROM sm JOIN li USING (g) GROUP BY g),
 re AS (SELECT g, idx, CASE WHEN idx = 0 THEN 0 ELSE x - mu * (1 - phi) - phi * px END AS e FROM sm JOIN li USING (g) JOIN ph USING (g)),
 rm AS (SELECT *, abs(e - lag(e) OVER {w}) AS emr FROM re), rs AS (SELECT g, avg(emr) FILTER (idx > 1) / 1.128 AS es FROM rm GROUP BY g),
 al AS (SELECT g, idx, 'static3sigma' AS method FROM se JOIN li USING (g) WHERE abs(x - oc) > 3 * os UNION ALL SELECT g, idx, 'frozenImr' FROM se JOIN li USING (g) WHERE abs(x - fc) > 3 * fs
  UNION ALL SELECT g, idx, 'ewma' FROM ew WHERE abs(z - fc) > 3 * fs * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (idx + 1)))) UNION ALL SELECT g, idx, 'cusum' FROM cu WHERE u > 5 OR d > 5
  UNION ALL SELECT g, idx, 'residual' FROM re JOIN rs USING (g) WHERE idx > 0 AND abs(e) > 3 * es)"""


_METHODS = "(VALUES " + ", ".join(f"('{m}')" for m in detectors.METHODS) + ") mm(method)"
_FAULTS = """(SELECT g.* REPLACE (CASE WHEN kind = 'spike' THEN idx = start ELSE idx >= start END AS bad) FROM (SELECT n.idx, n.x, f.*, false AS bad FROM normal n,
 (VALUES ('shift 1', 'shift', 60, 1.0::DOUBLE), ('shift 3', 'shift', 60, 3.0::DOUBLE), ('drift 0.1', 'drift', 60, 0.1::DOUBLE), ('spike 4', 'spike', 60, 4.0::DOUBLE)) f(name, kind, start, m) WHERE n.idx < 120) g)"""
_SERIES = f"SELECT name AS g, idx, CASE WHEN NOT bad THEN x WHEN kind = 'drift' THEN x + m * (idx - start + 1) ELSE x + m END AS x FROM {_FAULTS}"
_SCEN = f"WITH RECURSIVE {_numbers('SELECT 0 AS g, 4242 AS seed', 400)}, {_alarms(_SERIES)}"


def _grade(c: str) -> str:
    return f"CASE WHEN {c} >= 0.8 THEN 'good' WHEN {c} >= 0.4 THEN 'fair' ELSE 'poor' END AS {c}_grade"


_METRICS = f""", mt AS (SELECT p.name AS scenario, mm.method, count(*) FILTER (bad AND al.g IS NOT NULL) AS tp, count(*) FILTER (NOT bad AND al.g IS NOT NULL) AS fp, count(*) FILTER (bad AND al.g IS NULL) AS fn,
 min(p.idx - start) FILTER (al.g IS NOT NULL AND p.idx >= start) AS delay, count(*) FILTER (NOT bad) AS nn FROM {_FAULTS} p CROSS JOIN {_METHODS} LEFT JOIN al ON al.g = p.name AND al.idx = p.idx AND al.method = mm.method GROUP BY p.name, mm.method),
 m2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN nn > 0 THEN fp / nn ELSE 0 END AS far FROM mt),
 m3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m2)"""
_METRIC_COLS = f"scenario, method, tp, fp, fn, delay, {_r('precision', 'precision')}, {_r('recall', 'recall')}, {_r('far', 'far')}, {_r('f1', 'f1')}, {_grade('recall')}, {_grade('f1')}, CASE WHEN far <= 0.02 THEN 'good' WHEN far <= 0.1 THEN 'fair' ELSE 'poor' END AS far_grade"


def _arl(seed: int, deltas: list[float], start: int) -> str:
    """A query of (m, method, arl, censored), as a subquery with its own CTEs."""
    seeds = f"SELECT r AS g, {seed} + r * 7919 AS seed FROM range(60) rr(r)"
    shifted = f"SELECT g || ' ' || m AS g, idx, x + CASE WHEN idx >= {start} THEN m ELSE 0 END AS x FROM normal, (VALUES {', '.join(f'({d}::DOUBLE)' for d in deltas)}) dd(m) WHERE idx < 200"
    return f"""(WITH RECURSIVE {_numbers(seeds, 440)}, {_alarms(shifted)}, fi AS (SELECT g, method, min(idx) + 1 - {start} AS f FROM al WHERE idx >= {start} GROUP BY g, method)
 SELECT CAST(split_part(k.g, ' ', 2) AS DOUBLE) AS m, mm.method, avg(coalesce(f, {200 - start})) AS arl, avg(CASE WHEN f IS NULL THEN 1.0 ELSE 0.0 END) AS censored FROM (SELECT DISTINCT g FROM se) k CROSS JOIN {_METHODS} LEFT JOIN fi ON fi.g = k.g AND fi.method = mm.method GROUP BY ALL)"""


_MS = "strftime(make_timestamp({} * 1000), '%Y-%m-%d %H:%M:%S')"
_LEVELS = f"""WITH {_T}, c AS (SELECT min(recipe) AS r FROM trace), s AS (SELECT min(stage) AS s FROM trace, c WHERE recipe = r) SELECT DISTINCT 'recipe' AS level, recipe AS choice FROM trace UNION ALL SELECT DISTINCT 'stage', stage FROM trace, c WHERE recipe = r
 UNION ALL SELECT DISTINCT 'recipe_step_num', CAST(recipe_step_num AS VARCHAR) FROM trace, c, s WHERE recipe = r AND stage = s"""
_READ = "CASE WHEN k % 5 IN (0, 1) THEN NULL ELSE k END"
_FX = registry.fixed_sql

ORACLES: dict[str, str] = {
    "ingested_trace": f"WITH {_T} SELECT strftime(processed_time, '%Y-%m-%dT%H:%M:%S.%f') AS processed_time, lot, recipe, stage, wafer_no, system_label, 1 AS recipe_step_num, 9 AS recipe_max_step, value AS APC_Position, {_READ} AS Gas1_Monitor FROM trace",
    "ingest_counts": f"""WITH {_T}, s AS (SELECT *, {_READ} AS kk FROM trace), g AS (SELECT lot, wafer_no, {_C}, system_label, count(value) AS a, count(kk) AS b FROM s GROUP BY ALL)
 SELECT (SELECT count(*) FROM s) AS rows, 0::BIGINT AS bad_times, CAST(sum((a > 0)::INT + (b > 0)::INT) AS BIGINT) AS indicators, 2::BIGINT AS signals, CAST(sum(a + b) AS BIGINT) AS values FROM g""",
    "ingested_quality": f"WITH {registry._QUAL} SELECT lot, wafer_no, {_r('yield_pct', 'yield_pct')}, {_r('defect_count', 'defect_count')}, NULL::VARCHAR AS bin FROM qual",
    "context_choices": _LEVELS,
    "run_trace": f"WITH {_T} SELECT strftime(processed_time, '%Y-%m-%dT%H:%M:%S.%g') AS time, {_r('value', 'value')}, {_r('k', 'k')} FROM trace WHERE lot = (SELECT min(lot) FROM trace) AND wafer_no = '0' AND recipe_step_num = 1",
    "bound_query": f"WITH {_T} SELECT recipe, stage, count(*) AS samples FROM trace WHERE value >= 10 AND value < 60 GROUP BY recipe, stage",
    "limit_texts": f"""{registry._ORD}, lim AS (SELECT {_K}, count(*) AS n, avg(x) AS cl, coalesce(avg(mr), 0) / 1.128 AS sg FROM o GROUP BY {_K})
 SELECT {_K}, 'Runs differ by a sigma of ' || {_FX('sg', 4)} || '; limits lie three sigmas to either side.' AS sigma_text,
 'Usual values lie from ' || {_FX('cl - 3 * sg', 3)} || ' to ' || {_FX('cl + 3 * sg', 3)} || ' around ' || {_FX('cl', 3)} || '; these are limits of stability, not of quality.' AS limits_text,
 CASE WHEN n < 8 THEN n || ' points are too few for firm limits.' ELSE n || ' points are enough for limits.' END AS stability_text FROM lim""",
    "setpoint_values": f"WITH {_T} SELECT {_C}, lot, wafer_no, strftime(min(processed_time), {_ISO}) AS time, {_r('avg(k)', 'value')} FROM trace WHERE k IS NOT NULL GROUP BY {_C}, lot, wafer_no",
    "listed_signals": f"WITH {registry._LLONG} SELECT signal, count(v) AS non_null, {_r('min(v)', 'min_val')}, {_r('max(v)', 'max_val')}, count(DISTINCT v) AS distinct_vals, count(DISTINCT v) <= 2 AND min(v) >= 0 AND max(v) <= 1 AS is_flag FROM lsamples GROUP BY signal",
    "fdc_monitor": f"{_FDC} SELECT {_KEYT}, {', '.join(_r(c, c, 4) for c in ('t2', 'spe', 't2_limit', 'spe_limit'))}, t2_alarm, spe_alarm, 3 AS components FROM al",
    "fdc_alarms": f"""{_CAUSES}, nth AS (SELECT *, value / sum(value) OVER w * 100 AS percent, row_number() OVER (w ORDER BY value DESC) - 1 AS nth FROM parts WHERE t2_alarm OR spe_alarm WINDOW w AS (PARTITION BY {_C}, time, lot, wafer_no))
 SELECT {_KEYT}, CAST(nth AS INTEGER) AS nth, signal, {_r('value', 'value', 3)}, {_r('percent', 'percent', 3)} FROM nth WHERE nth < 3""",
    "fdc_residual_ranks": f"""{_CAUSES}, nth AS (SELECT *, e / sum(e) OVER w * 100 AS percent, row_number() OVER (w ORDER BY e DESC) - 1 AS nth FROM parts WHERE spe_alarm WINDOW w AS (PARTITION BY {_C}, time, lot, wafer_no))
 SELECT {_KEYT}, CAST(nth AS INTEGER) AS nth, signal, {_r('e', 'value', 3)}, {_r('percent', 'percent', 3)} FROM nth""",
    "fdc_full_rank": f"{_FULL} SELECT {_KEYT}, {_r('whole', 't2', 5)}, whole > 4 * (nb * nb - 1.0::DOUBLE) / (nb * (nb - 4.0::DOUBLE)) * ({_wh('4')} / ({_wh('(nb - 4)')})) AS t2_alarm, 0.0::DOUBLE AS spe, false AS spe_alarm, true AS without_spe, 4 AS components FROM b1",
    "dtw_distances": _DTW,
    "deviation_points": f"""WITH {registry._RES}, env AS (SELECT label, pos, avg(v) - 2 * coalesce(stddev_samp(v), 0) AS lo, avg(v) + 2 * coalesce(stddev_samp(v), 0) AS hi FROM res GROUP BY label, pos)
 SELECT vec_id, label, pos, {_r('v', 'v', 5)}, {_r('greatest(v - hi, lo - v, 0)', 'excess', 5)} FROM res JOIN env USING (label, pos)""",
    "downsampled_runs": f"""WITH {_T}, r AS (SELECT lot, wafer_no, epoch_us(min(processed_time)) // 1000 AS start_ms, coalesce(max(k), 0) AS on_time FROM trace GROUP BY lot, wafer_no HAVING coalesce(max(k), 0) > 0),
 n AS (SELECT *, row_number() OVER (ORDER BY start_ms, lot, wafer_no) - 1 AS place, count(*) OVER () AS n FROM r) SELECT start_ms, lot, wafer_no, {_r('on_time', 'on_time')} FROM n WHERE n <= 50 OR place IN (SELECT i * n // 50 FROM range(50) ii(i))""",
    "dashboard_figures": f"""WITH {registry._SCAN} SELECT (SELECT count(*) FROM ltrace) AS samples, (SELECT count(DISTINCT lot) FROM ltrace) AS lots, (SELECT count(DISTINCT (lot, wafer_no)) FROM ltrace) AS wafers, (SELECT count(DISTINCT recipe) FROM ltrace) AS recipes,
 (SELECT count(DISTINCT stage) FROM ltrace) AS stages, (SELECT count(DISTINCT system_label) FROM ltrace) AS chambers, count(*) FILTER (alarms + warns > 0) AS charts, count(*) FILTER (points < 8) AS insufficient, CAST(sum(alarms) AS BIGINT) AS total_alarms,
 CAST(sum(warns) AS BIGINT) AS total_warns, (SELECT count(*) * 4 FROM top8) AS scanned FROM status""",
    "detector_alarms": f"{_SCEN} SELECT g AS recipe, 's' AS signal, idx, method FROM al",
    "detector_benchmark": f"{_SCEN}{_METRICS} SELECT {_METRIC_COLS} FROM m3",
    "detector_run_lengths": f"SELECT method, {_r('arl', 'arl')}, {_r('censored', 'censored')} FROM {_arl(4242, [0.0], 0)} q",
    "detector_report": f"""{_SCEN}{_METRICS}, q0 AS (SELECT * FROM {_arl(4242, [0.0], 0)} q), q1 AS (SELECT * FROM {_arl(4243, [0.1, 1.0, 3.0, 4.0], 30)} q)
 SELECT {_METRIC_COLS}, {_r('q0.arl', 'arl0')}, {_r('q0.censored', 'censored0')}, {_r('q1.arl', 'arl1')}, {_r('q1.censored', 'censored1')} FROM m3 JOIN q0 USING (method) JOIN q1 USING (method) WHERE q1.m = CAST(split_part(scenario, ' ', 2) AS DOUBLE)""",
    "lcg_numbers": f"WITH RECURSIVE {_numbers('SELECT 0 AS g, 4242 AS seed', 500)} SELECT CAST(i AS BIGINT) AS i, st AS state FROM u",
    "normal_numbers": f"WITH RECURSIVE {_numbers('SELECT 0 AS g, 4242 AS seed', 440)} SELECT CAST(idx AS BIGINT) AS idx, {_r('5 + 2 * x', 'value')} FROM normal WHERE idx < 200",
    "recent_runs": f"""WITH {_T}, r AS (SELECT lot, wafer_no, min(recipe) AS recipe, epoch_us(min(processed_time)) // 1000 AS s, epoch_us(max(processed_time)) // 1000 AS e FROM trace GROUP BY lot, wafer_no)
 SELECT lot, wafer_no, recipe, {_MS.format('s')} AS start, greatest(0, e - s) AS duration_ms FROM r ORDER BY s DESC, lot, wafer_no LIMIT 60""",
    "downtimes": f"WITH {registry._RUNS} SELECT {_MS.format('gs')} AS start, gap AS duration_ms FROM gaps WHERE gs IS NOT NULL AND gap > 14400000 ORDER BY gap DESC, gs LIMIT 10",
    "top_findings": registry.ORACLES["commonality_findings"].replace(" SELECT dimension, value,", ", ff AS (SELECT dimension, value,", 1) + ") SELECT dimension, value, bad_count, good_count, ratio_gap, z FROM ff WHERE ratio_gap > 0 ORDER BY ratio_gap DESC, abs(z) DESC, dimension, value LIMIT 15",
    "top_anomalies": registry.ORACLES["commonality_anomalies"].replace("SELECT context, lot,", "SELECT context, lot,", 1) + " ORDER BY abs(mz.z) DESC, context, lot, wafer_no LIMIT 50",
}
ORACLES["top_anomalies"] = ORACLES["top_anomalies"].replace(f"{_r('median', 'median', 5)}, {_r('s', 'robust_sigma', 5)}, ", "")
