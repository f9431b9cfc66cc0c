import datetime as dtm
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import signals as sg
from millrace.functions.stats import f_quantile, normal_quantile
from millrace.operators import aggregates as agg
from millrace.operators import commonality as com
from millrace.operators import detectors as dt
from millrace.operators import equipment, fdc, spc
from millrace.plans import api
from millrace.sources import bindings, ingest


def points(spark, *series):
    rows = [("r", "s", 1, f"x{k}", i, "l", "w", float(v)) for k, values in enumerate(series) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recipe string, stage string, recipe_step_num int, signal string, time int, lot string, wafer_no string, value double")


def with_limits(spark, cl, sigma, values):
    return spc._ordered(points(spark, values)).withColumns({"center_line": F.lit(float(cl)), "sigma": F.lit(float(sigma))})


def test_limits(spark):
    a, b, c = (r.asDict() for r in spc.control_limits(points(spark, [3, 7, 4, 9], [2.5] * 6, range(11))).orderBy("signal").collect())
    assert a["center_line"] == 5.75 and a["sigma"] == pytest.approx(4 / 1.128) and a["ucl"] == pytest.approx(5.75 + 12 / 1.128) and a["insufficient"]
    assert b["sigma"] == 0 and b["ucl"] == b["lcl"] == 2.5
    assert not c["insufficient"]


@pytest.mark.parametrize(("values", "sigma", "want"), [
    ([0.4, -3.2, 0.1], 1, [(1, "beyond_3sigma", "alarm")]),
    ([-2.6, 0.3, -2.1], 1, [(2, "two_of_three_2sigma", "warn")]),
    ([1.7, -0.2, 1.1, 1.9, 1.05], 1, [(4, "four_of_five_1sigma", "warn")]),
    ([-0.5, -0.9, -0.1, -0.7, -0.3, -0.2, -0.6, -0.8], 1, [(7, "eight_in_row_side", "warn")]),
    ([0.9, -1.4, 0.2, -0.6, 1.3], 1, []),
    ([2, 2, 2, 2, 2], 0, []),
])
def test_rules(spark, values, sigma, want):
    got = spc.violations(with_limits(spark, 0 if sigma else 2, sigma, values)).select("idx", "rule", "severity").collect()
    assert [tuple(r) for r in got] == want


def test_trust_and_charts(spark):
    stable = dt.normal_series(36, 40, 0.5, 311)
    shifted = stable + dt.normal_series(18, 46, 0.5, 977)
    p = points(spark, [4.0, 4.3, 3.9, 4.2, 4.1, 3.8, 4.2, 4.0, 4.1], [1, 1.2, 1, 1.2, 1, 9, 9.2, 9, 9.2, 9], [7] * 5, shifted, stable + [55, 25] * 8)
    got = {r["signal"]: r for r in spc.diagnosis(p).collect()}
    assert [got[f"x{i}"]["trust"] for i in range(3)] == ["high", "low", "high"] and got["x2"]["ratio"] == 1
    assert got["x3"]["recommended"] == "residual" and len(got["x3"]["alternatives"]) == 3 and all(r["reason"] for r in got.values())
    frozen = spc.with_frozen_baseline(p)
    for chart in (spc.ewma_chart(frozen), spc.cusum_chart(frozen)):
        assert {r["idx"] for r in chart.where("alarm and signal = 'x3'").collect()} & set(range(36, 54))
    base = {r["signal"]: r for r in spc.baseline_limits(p).collect()}
    assert base["x4"]["center_line"] == pytest.approx(40, abs=1) and base["x3"]["sigma"] < got["x3"]["sigma_total"]
    assert not spc.residual_chart(p).where("alarm and idx = 0").count()


@pytest.mark.parametrize("lam", [0.05, 0.2, 0.9])
def test_ewma_of_a_long_series_equals_the_recursion(spark, lam):
    x = dt.normal_series(1500, 10, 2, 17)
    x[700] = 500.0
    limited = with_limits(spark, 10, 2, x)
    got = {r["idx"]: r["statistic"] for r in spc.ewma_chart(limited, lam).collect()}
    z = 10.0
    for i, v in enumerate(x):
        z = lam * v + (1 - lam) * z
        assert got[i] == pytest.approx(z, rel=1e-9), i


def test_capability(spark):
    r = spc.capability(points(spark, [9, 11, 10, 10.5, 9.5]), (10.0, 13.0, None)).first()
    assert r["cp"] is None and r["cpk"] == pytest.approx((13 - 10) / (3 * r["sigma_within"])) and r["grade"] in ("capable", "marginal", "incapable")
    assert spc.capability(points(spark, [5, 5, 5]), (5.0, 6.0, 4.0)).first()["grade"] == "unknown"


def test_anomalies_and_findings(spark):
    flat = [("A", float(v)) for v in (5, 6, 5, 7, 6, 5, 6, 7, 5, 400)] + [("B", 3.0)] * 6 + [("C", 2.0), ("C", 77.0)]
    df = spark.createDataFrame(flat, "context string, value double")
    assert [r["value"] for r in com.mark_anomalies(df).where("is_bad").collect()] == [400]
    rows = [("P", 30.0 + i % 3, "left") for i in range(12)] + [("P", 80.0, "right")] + [("Q", 50.0 + i % 4, "left") for i in range(10)] + [("Q", 5.0, "right")] * 2
    marked = com.mark_anomalies(spark.createDataFrame(rows, "context string, value double, chamber string"), 3.0)
    found = com.findings(marked, ["chamber"])
    assert found.first()["value"] == "right" and found.first()["ratio_gap"] > 0
    assert [r["value"] for r in com.top_findings(found).collect()] == ["right"]
    assert not com.findings(marked, ["chamber"], 100).count()


def test_equipment(spark):
    m = 60_000
    rows = [("a", 0, 12 * m), ("a", 30 * m, 36 * m), ("b", 400 * m, 402 * m), ("b", 0, 3 * m), ("c", 0, 8 * m), ("c", 5 * m, 19 * m), ("c", 19 * m, 26 * m)]
    runs = spark.createDataFrame(rows, "tool string, start_ms long, end_ms long")
    got = {r["tool"]: r for r in equipment.equipment_stats(runs, ["tool"]).collect()}
    assert (got["a"]["span_ms"], got["a"]["productive_ms"], got["a"]["idle_ms"]) == (36 * m, 18 * m, 18 * m) and got["a"]["utilization"] == 0.5
    assert got["b"]["downtimes"] == 1 and got["b"]["longest_gap_ms"] == 397 * m
    assert got["c"]["productive_ms"] == 26 * m and got["c"]["gaps"] == 0
    assert [r["duration_ms"] for r in equipment.downtimes(equipment.idle_gaps(runs, ["tool"])).collect()] == [397 * m]
    text = spark.createDataFrame([(0,), (75 * m,), (26 * 60 * m,)], "ms long").select(equipment.format_duration(F.col("ms")))
    assert [r[0] for r in text.collect()] == ["0m", "1h 15m", "1d 2h"]
    ratio, due = equipment.pm_proxy(F.lit(50), 100)
    assert tuple(spark.range(1).select(ratio, due).first()) == (0.5, False)


@pytest.mark.parametrize("n", [0, 7, 200, 5000])
def test_downsample_takes_even_positions(spark, n):
    values = [None if i == 3 else (i * 7919) % 1000 for i in range(n)]
    df = spark.createDataFrame([(v, i, "x") for i, v in enumerate(values)], "at int, tie int, __nth string").repartition(5)
    order = sorted(range(n), key=lambda i: (values[i] is not None, values[i] or 0, i))
    want = order if n <= 60 else [order[i * n // 60] for i in range(60)]
    got = equipment.downsample(df, ["at", "tie"], 60)
    assert sorted(r["tie"] for r in got.collect()) == sorted(want) and got.columns == df.columns


def gaussian_matrix(n, seed):
    a, b, c = (dt.normal_series(n, 0, 1, seed * 10 + i) for i in range(3))
    return np.column_stack((a, np.array(a) + 0.1 * np.array(b), c))


def test_multivariate(spark):
    base = gaussian_matrix(120, 7)
    model = fdc.fit(base)
    assert np.cumsum(model.values)[model.k - 1] / model.values.sum() >= 0.9 and model.k == 2
    odd = [0.1, 0.3, 7.0]
    t2, spe, parts = fdc.evaluate(np.array([odd]), model)
    assert t2[0] > model.t2_limit and parts[0].argmax() == 2
    names = ["x1", "x2", "x3", "flat"]
    data = np.vstack((base, [odd], [[2.0, -2.0, 0.0]]))
    rows = [("c", i, *map(float, r), 5.0) for i, r in enumerate(data)] + [("few", 0, 1.0, 2.0, 3.0, 5.0), ("c", 999, None, 1.0, 1.0, 5.0), ("c", 998, float("nan"), 1.0, 1.0, 5.0)]
    rows += [("still", i, 1.0, 2.0, 3.0, 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, "ctx string, i int, x1 double, x2 double, x3 double, flat double")
    got = {r["i"]: r for r in fdc.monitor(df, names, ["ctx"], ["i"]).collect()}
    assert sorted(got) == list(range(122)) and got[120]["t2_alarm"] and got[120]["causes"][0]["signal"] == "x3"
    assert got[121]["spe_alarm"] and {c["signal"] for c in got[121]["residual_causes"][:2]} == {"x1", "x2"} and not got[0]["causes"]
    assert sum(r["t2_alarm"] or r["spe_alarm"] for r in got.values()) < 30
    # the same figures by matrices
    n = int(0.4 * 122)
    model = fdc.fit(data[:n])
    t2, spe, parts = fdc.evaluate(data, model)
    for i, r in got.items():
        assert (r["t2"], r["spe"]) == (pytest.approx(t2[i]), pytest.approx(spe[i], abs=1e-9)) and r["t2_limit"] == pytest.approx(model.t2_limit) and r["spe_limit"] == pytest.approx(model.spe_limit)
        assert [c["signal"] for c in r["causes"]] == ([["x1", "x2", "x3"][j] for j in np.argsort(-parts[i])] if r["t2_alarm"] or r["spe_alarm"] else [])
    with pytest.raises(ValueError):
        fdc.fit(np.ones((12, 3)))
    assert f_quantile(4, 6, 0.01) == pytest.approx(1.185, abs=2e-3) and normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_without_a_residual_there_is_no_spe_chart(spark):
    """All components, and signals of which one is the sum of others: rounding noise raises no alarm."""
    x = gaussian_matrix(60, 5)
    x = np.column_stack((x, x[:, 0] + x[:, 2]))
    df = spark.createDataFrame([("c", i, *map(float, r)) for i, r in enumerate(x)], "ctx string, i int, a double, b double, c double, d double")
    for signals, explained in ((["a", "b", "c"], 1.0), (["a", "c", "d"], 1.0), (["a", "b", "c", "d"], 1.0)):
        got = fdc.monitor(df, signals, ["ctx"], ["i"], explained=explained).collect()
        assert len(got) == 60 and not any(r["spe_alarm"] for r in got) and all(r["spe_limit"] is None and r["spe"] == 0 for r in got)
        assert sum(r["t2_alarm"] for r in got) < 20


def test_traces(spark):
    x = np.array([2.0, 4.0, 3.0, 8.0])
    assert fdc.dtw(x, x)[0] == 0 and fdc.dtw(x, [])[0] == math.inf
    d, _, path = fdc.dtw(np.array([1.0, 3.0, 2.0, 5.0]), np.array([1.0, 1.0, 3.0, 3.0, 2.0, 5.0]))
    assert d == 0 and path[0] == (0, 0) and path[-1] == (3, 5)
    df = spark.createDataFrame([([2.0, 8.0],), ([3.0],), ([],)], "t array<double>").select(fdc.resample(F.col("t"), 4))
    assert [r[0] for r in df.collect()] == [pytest.approx([2, 4, 6, 8]), [3.0] * 4, [0.0] * 4]
    waves = [(i, "a", [math.cos(t / 4) + e for t, e in enumerate(dt.normal_series(24, 0, 0.04, 51 + i))]) for i in range(12)]
    env = fdc.envelope(spark.createDataFrame(waves, "id int, g string, t array<double>"), "t", ["g"], 24)
    probe = spark.createDataFrame([(0, "a", [math.cos(t / 4) for t in range(24)]), (1, "a", [math.cos(t / 4) - 3 for t in range(24)])], "id int, g string, t array<double>")
    assert {r["id"]: r["alarm"] for r in fdc.deviation(probe, "id", "t", env, ["g"], 24).collect()} == {0: False, 1: True}
    assert {r["id"] for r in fdc.deviation_points(probe, "id", "t", env, ["g"], 24).where("excess > 0").collect()} == {1}


def test_many_warpings_equal_single_ones(spark):
    r = np.random.default_rng(2)
    arrays = [r.integers(0, 4, n).astype(float) for n in (5, 9, 5, 1, 9, 0, 12)]
    goal = r.integers(0, 4, 8).astype(float)
    for band in (0, 2):
        d, per = fdc.dtw_many([*arrays, None], goal, band)
        for i, a in enumerate(arrays):
            one = fdc.dtw(a, goal, band)
            assert (d[i], per[i]) == (one[0], one[1])
    df = spark.createDataFrame([(i, None if i == 3 else a.tolist()) for i, a in enumerate(arrays)], "i int, t array<double>")
    got = {r["i"]: r["dtw"] for r in fdc.dtw_to(df, "t", goal.tolist(), 2).collect()}
    assert got[3] is None and got[0] == fdc.dtw(arrays[0], goal, 2)[0]


def test_overlay_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0), ("b", 2.0), ("b", 2.0)], "s string, v double")
    got = sorted(((r["s"], r["v"], r["scaled"]) for r in fdc.overlay(df, ["s"]).collect()), key=str)
    assert got == sorted([("a", 1.0, 0.0), ("a", 3.0, 1.0), ("a", None, None), (None, 5.0, 0.5), ("b", 2.0, 0.5), ("b", 2.0, 0.5)], key=str)


def test_detector_benchmark(spark):
    got = {(r["scenario"], r["method"]): r for r in dt.run_scenarios(spark).collect()}
    want = {("shift 1", "cusum"): (1, 0.7167, 15, 0), ("shift 3", "static3sigma"): (0.1429, 0.0167, 14, 0.1), ("shift 3", "frozenImr"): (1, 0.2333, 2, 0), ("drift 0.1", "ewma"): (1, 0.7667, 14, 0), ("spike 4", "residual"): (1, 1, 0, 0), ("shift 1", "residual"): (0, 0, None, 0.0167)}
    for key, (precision, recall, delay, far) in want.items():
        r = got[key]
        assert (round(r["precision"], 4), round(r["recall"], 4), r["delay"], round(r["far"], 4)) == (precision, recall, delay, far), key
    arl = {r["method"]: (round(r["arl"], 3), round(r["censored"], 3)) for r in dt.run_lengths(spark).collect()}
    assert arl == {"static3sigma": (158.783, 0.633), "frozenImr": (125.9, 0.383), "ewma": (123.317, 0.4), "cusum": (129.383, 0.433), "residual": (165.067, 0.7)}


def test_ingest(spark, tmp_path):
    heads = "Processed Time,Lot,Recipe,Stage,Wafer No.,System Label,Recipe_Step_Num,APC_Position,Recipe_Max_Step"
    lines = [f"2024-01-01T00:00:{i:02d}{'.5' if i % 2 else ''}Z,L1,R1,S1,{i % 3},C1,{'2' if i % 2 else '2.0'},{'bad' if i == 3 else i},9" for i in range(12)]
    (tmp_path / "part1.csv").write_text("\n".join([heads, *lines[:6]]))
    (tmp_path / "part2.csv").write_text("\n".join([heads, *lines[6:]]))
    out = ingest.ingest(spark, f"{tmp_path}/part*.csv", f"{tmp_path}/out", ["APC_Position"], 12)
    assert out == {"rows": 12, "bad_times": 0, "indicators": 3}
    trace = spark.read.parquet(f"{tmp_path}/out/trace")
    assert trace.where("APC_Position is null").count() == 1 and {r[0] for r in trace.select("recipe_step_num").collect()} == {2}
    with pytest.raises(ValueError):
        ingest.validate(trace, 13)
    (tmp_path / "q.csv").write_text("Lot_ID,Slot,CP_Yield\nL1,0,98.5\nL1,1,x\n")
    q = ingest.load_quality(spark, f"{tmp_path}/q.csv")
    assert sorted(map(tuple, q.collect())) == [("L1", "0", 98.5, None, None), ("L1", "1", None, None, None)]
    assert ingest.load_quality(spark, f"{tmp_path}/none.csv") is None and not ingest.has_rows(None)
    with pytest.raises(ValueError):
        ingest.quality_table(q.drop("lot"))


def test_times_do_not_depend_on_the_session_zone(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Processed Time,Lot,Recipe,Stage,Wafer No.,System Label,Recipe_Step_Num,APC_Position,Recipe_Max_Step\n2024-03-31T02:30:00.25,L,R,S,1,C,1,5,9\n2024-03-31T02:30:00.25Z,L,R,S,1,C,1,5,9\nno time,L,R,S,1,C,1,5,9\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = ingest.typed_trace(ingest.read_text_csv(spark, f"{tmp_path}/t.csv"), ["APC_Position"]).select(F.col("processed_time").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[0] for r in got] == ["2024-03-31 02:30:00.25"] * 2 + [None]


def test_names():
    assert len(sg.SIGNALS) == 119 and len(set(sg.SIGNALS)) == 119
    assert sg.setpoint_of("Gas1_Monitor") == "Gas1_Set" and sg.setpoint_of("SourcePwr_Read") is None and sg.setpoint_of("Temp") == "Temp_Set"
    with pytest.raises(ValueError):
        agg.assert_indicator("n_samples")
    assert len(agg.INDICATORS) == 19 and agg.CHARTABLE[0] == "mean"


def test_many_signals_are_aggregated_side_by_side(spark):
    names = [f"s{i}" for i in range(60)]
    rows = [("r", "st", 1, f"l{i % 3}", "w", "c", dtm.datetime(2024, 1, 1, 0, 0, i), *(None if (i + j) % 4 == 0 or j == 7 else float(i * j) for j in range(60))) for i in range(30)]
    t = spark.createDataFrame(rows, "recipe string, stage string, recipe_step_num int, lot string, wafer_no string, system_label string, processed_time timestamp, " + ", ".join(f"{n} double" for n in names))
    got = {(r["signal"], r["lot"]): r for r in agg.indicators(t, names).collect()}
    assert len(got) == 59 * 3
    for (s, lot), r in got.items():
        v = [x[7 + names.index(s)] for x in rows if x[3] == lot and x[7 + names.index(s)] is not None]
        assert (r["n_samples"], r["start_val"], r["end_val"], r["mean"]) == (len(v), v[0], v[-1], pytest.approx(np.mean(v)))
        assert (r["median"], r["p95"], r["std"]) == (pytest.approx(np.median(v)), pytest.approx(np.quantile(v, 0.95)), pytest.approx(np.std(v, ddof=1)))
    assert agg.run_points(t, names).count() == 59 * 3 and agg.signal_stats(t, names).count() == 59


def test_the_scan_cuts_the_trace_down_first(spark, sf):
    t = bindings.line_trace(spark, sf)
    plan = spc.risk_scan(t, bindings.LINE_SIGNALS, agg.list_contexts(t))._jdf.queryExecution().optimizedPlan().toString()
    points = plan[: plan.index("GlobalLimit")]  # the side of the points, above the chosen contexts
    assert "LeftSemi" in points and points.index("LeftSemi") > points.index("Generate") and "Generate" not in plan[plan.index("LeftSemi") :]


def test_api(spark, sf):
    t = bindings.trace(spark, sf)
    chart = api.control_chart(t, "click", "S0", 1, "value")
    assert chart["points"].count() == 120 and chart["limits"].count() == 1 and chart["ewma"].count() == 120
    wrong = [
        lambda: api.control_chart(t, "click", "S0", 1, "nope"), lambda: api.control_chart(t, "", "S0", 1, "value"), lambda: api.control_chart(t, "click", "S0", -1, "value"), lambda: api.control_chart(t, "click", "S0", 1.5, "value"),
        lambda: api.trace(t, "20240101", "0", 1, ["value"] * 7), lambda: api.trace(t, "20240101", "0", 1, " , "), lambda: api.multivariate(t, "click", "S0", 1, ["value"], 1.0), lambda: api.equipment_report(t, None, 0),
        lambda: api.commonality(t, "value", k=11), lambda: api.selector(t, ["value"]), lambda: api.selector(t, ["recipe"], {"recipe": "click"}), lambda: api.multivariate(t, "no such recipe", "S0", 1, ["value"]),
    ]
    for call in wrong:
        with pytest.raises(ValueError):
            call()
        outcome = api.answered(call)
        assert not outcome.success and outcome.data is None and outcome.error
    assert api.answered(api.wafers, t).data.count() == agg.wafer_steps(t).count()
    assert [r[0] for r in api.selector(t, ["recipe", "stage"], {"recipe": "click"}).collect()] == ["S0", "S1"]
    assert api.sql(spark, "SELECT :a + id AS x FROM {t}", {"t": spark.range(2)}, a=5).collect()[1]["x"] == 6
    assert api.yield_link(chart["points"], None) is None
    report = api.equipment_report(t, None)
    assert report["stats"].count() == 1 and report["recent"].count() == 60
    found, top = api.commonality(agg.indicators(t, ["value"]), "value", k=2.0)
    assert found.count() and top.count() <= 50
    assert api.multivariate(t, "click", "S0", "1", "value, k").count() == 120


def test_stream(spark, tmp_path):
    from millrace.streaming.charts import monitor_stream

    p = points(spark, dt.normal_series(36, 40, 0.5, 311) + dt.normal_series(14, 46, 0.5, 5), [3.0] * 20).withColumn("time", F.timestamp_seconds("time"))
    frozen = spc.with_frozen_baseline(p)
    limits = spc.baseline_limits(p)
    for lo, hi in ((0, 11), (11, 30), (30, 31), (31, 99)):  # a file is a trigger; rows within it are out of order
        p.where(F.unix_seconds("time").between(lo, hi - 1)).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = monitor_stream(stream, limits).writeStream.format("memory").queryName("charts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(180)
    got = {(r["signal"], r["idx"]): (r["ewma"], r["cusum_up"]) for r in spark.table("charts").collect()}
    want = {(r["signal"], r["idx"]): r["statistic"] for r in spc.ewma_chart(frozen).collect()}
    up = {(r["signal"], r["idx"]): r["statistic"] for r in spc.cusum_chart(frozen).collect()}
    assert len(got) == 70 and all(got[i] == (pytest.approx(want[i]), pytest.approx(up[i], abs=1e-9)) for i in got)


def test_windowed_points_of_a_stream(spark, tmp_path):
    from millrace.streaming.charts import windowed_points

    rows = [("r", "s", 1, "x", dtm.datetime(2024, 1, 1, 0, 0, i), float(i)) for i in (0, 1, 5, 12, 14, 40)]
    df = spark.createDataFrame(rows, "recipe string, stage string, recipe_step_num int, signal string, processed_time timestamp, v double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windowed_points(stream, "5 seconds", "10 seconds").writeStream.format("memory").queryName("points").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    got = {r["time"].second: (r["value"], r["samples"]) for r in spark.table("points").collect()}
    assert got == {0: (2.0, 3), 10: (13.0, 2)}  # the window that is still open is not given
