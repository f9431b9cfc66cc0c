"""Multivariate monitoring and trace comparison.

A context's model needs the means and covariances of its baseline only: these are aggregates, one row a context, of which
a small table of models is made (an eigendecomposition each). Rows are scored by array expressions over the joined model,
so neither a context's matrix nor the models meet in one place. Envelopes and overlays are DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import f_quantile, finite, normal_quantile

CONFIDENCE, EXPLAINED, TOP = 0.99, 0.9, 5
BASELINE_SHARE, LEAST_BASELINE = 0.4, 10
#: An eigenvalue below this share of their sum is rounding noise.
NOISE = 1e-10


def standardize(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns less their mean over their sample standard deviation (1 where that is 0 or missing), within ``by``."""
    w = Window.partitionBy(*by)
    sd = lambda c: F.stddev_samp(c).over(w)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.when(sd(c) > 0, sd(c)).otherwise(1.0) for c in columns})


def correlation_matrix(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, a, b, r) for each pair of columns, a <= b; 0 where one doesn't vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cov = [F.coalesce(F.try_divide(F.covar_samp(a, b), F.sqrt(F.var_samp(a) * F.var_samp(b))), F.lit(0.0)).alias(f"{a}~{b}") for a, b in pairs]
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs]
    return df.groupBy(*by).agg(*cov).select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.a", "e.b", "e.r")


@dataclass
class Model:
    columns: np.ndarray  # positions of columns that vary
    mean: np.ndarray
    sd: np.ndarray
    values: np.ndarray  # all eigenvalues, descending
    vectors: np.ndarray  # (column, component), k of them
    t2_limit: float
    spe_limit: float | None  # None where no residual is left: there is no SPE chart then

    @property
    def k(self) -> int:
        return self.vectors.shape[1]


def t2_limit(n: int, k: int, confidence: float) -> float:
    return math.inf if n <= k else k * (n * n - 1) / (n * (n - k)) * f_quantile(k, n - k, 1 - confidence)


def spe_limit(rest: np.ndarray, confidence: float) -> float | None:
    """Jackson and Mudholkar's limit from the eigenvalues that the model leaves out; None where they leave nothing."""
    t1, t2, t3 = (float((rest**i).sum()) for i in (1, 2, 3))
    if t1 <= 0:
        return None
    h = 1 - 2 * t1 * t3 / (3 * t2 * t2)
    return t1 * (normal_quantile(confidence) * math.sqrt(2 * t2 * h * h) / t1 + 1 + t2 * h * (h - 1) / t1**2) ** (1 / h)


def model_of(n: int, mean: np.ndarray, cov: np.ndarray, confidence: float = CONFIDENCE, explained: float = EXPLAINED, components: int | None = None) -> Model:
    """Principal components of the baseline's correlation matrix: as many as explain the given share of variance, or so many."""
    columns = np.flatnonzero(np.diag(cov) > 0)
    if not len(columns):
        raise ValueError("no column of the baseline varies")
    cov = cov[np.ix_(columns, columns)]
    sd = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    values = np.where(values > NOISE * values.sum(), values, 0.0)
    k = components or int(np.searchsorted(np.cumsum(values) / values.sum(), explained * (1 - 1e-12))) + 1
    k = min(len(values), k)
    return Model(columns, mean[columns], sd, values, vectors[:, :k], t2_limit(n, k, confidence), spe_limit(values[k:], confidence))


def fit(baseline: np.ndarray, confidence: float = CONFIDENCE, explained: float = EXPLAINED) -> Model:
    if len(baseline) < 2:
        raise ValueError("no column of the baseline varies")
    return model_of(len(baseline), baseline.mean(0), np.atleast_2d(np.cov(baseline, rowvar=False)), confidence, explained)


def evaluate(rows: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T2, SPE, contribution of each modelled column) of each row."""
    z = (rows[:, model.columns] - model.mean) / model.sd
    score = z @ model.vectors
    scaled = score / np.where(model.values[: model.k] > 0, model.values[: model.k], 1e-12)
    rest = z - score @ model.vectors.T
    return (score * scaled).sum(1), (rest**2).sum(1), rest**2 + np.maximum(0, z * (scaled @ model.vectors.T))


def _models(p: int, by: list[str], confidence: float, explained: float, components: int | None):
    """From one row a context (n, means, covariances) to its model, spread over all signals: constant ones have no weight."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                cov = np.zeros((p, p))
                cov[np.triu_indices(p)] = r.cov
                try:
                    m = model_of(int(r.n), np.array(r.mean, float), cov + np.triu(cov, 1).T, confidence, explained, components)
                except ValueError:
                    continue
                full = np.zeros((p, m.k))
                full[m.columns] = m.vectors
                weight, sd, used = m.values[: m.k], np.ones(p), np.zeros(p)
                sd[m.columns], used[m.columns] = m.sd, 1.0
                inner = (full / np.where(weight > 0, weight, 1e-12)) @ full.T
                rest = np.diag(used) - full @ full.T
                out.append((*(getattr(r, c) for c in by), list(r.mean), (used / sd).tolist(), inner.tolist(), rest.tolist(), m.k, m.t2_limit, m.spe_limit))
            yield pd.DataFrame(out, columns=[*by, "mean", "per_sd", "inner", "rest", "components", "t2_limit", "spe_limit"])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: _dot(row, v))


def monitor(matrix: DataFrame, signals: list[str], by: list[str], order: list[str], *, confidence: float = CONFIDENCE, explained: float = EXPLAINED, components: int | None = None, top: int = TOP) -> DataFrame:
    """T2 and SPE of each complete row against the first 40 % (ten at least) of its context, with the top causes of alarms.

    Contexts of fewer than eleven complete rows, or whose baseline doesn't vary, give no rows. Where the components leave
    no residual there is no SPE chart: its limit is null and it never alarms. Returns by, order, t2, spe, their limits and
    alarms, components, causes and residual_causes: arrays of (signal, value, percent), the latter by residuals alone.
    """
    p, pairs = len(signals), [(a, b) for i, a in enumerate(signals) for b in signals[i:]]
    complete = F.lit(True)
    for s in signals:
        complete = complete & finite(F.col(s))
    rows = matrix.where(complete).select(*by, *order, *(F.col(s).cast("double").alias(s) for s in signals))
    whole = Window.partitionBy(*by)
    ranked = rows.withColumns({"__at": F.row_number().over(whole.orderBy(*order)), "__n": F.count("*").over(whole)}).where(F.col("__n") > LEAST_BASELINE)
    base = ranked.where(F.col("__at") <= F.greatest(F.lit(LEAST_BASELINE), F.floor(F.lit(BASELINE_SHARE).cast("double") * F.col("__n"))))
    sums = base.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.avg(s) for s in signals)).alias("mean"), F.array(*(F.covar_samp(a, b) for a, b in pairs)).alias("cov"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    schema = f"{fields}, mean array<double>, per_sd array<double>, inner array<array<double>>, rest array<array<double>>, components int, t2_limit double, spe_limit double"
    models = sums.mapInPandas(_models(p, by, confidence, explained, components), schema)

    x = F.array(*signals)
    df = ranked.select(*by, *order, x.alias("x")).join(models, by)
    df = df.withColumn("z", F.zip_with(F.zip_with("x", "mean", lambda a, m: a - m), "per_sd", lambda d, w: d * w))
    df = df.withColumns({"az": _times(F.col("inner"), F.col("z")), "e": _times(F.col("rest"), F.col("z"))})
    df = df.withColumns({"t2": _dot(F.col("z"), F.col("az")), "spe": F.when(F.col("spe_limit").isNotNull(), _dot(F.col("e"), F.col("e"))).otherwise(0.0)})
    df = df.withColumns({"t2_alarm": F.col("t2") > F.col("t2_limit"), "spe_alarm": F.coalesce(F.col("spe") > F.col("spe_limit"), F.lit(False))})
    names = F.array(*map(F.lit, signals))
    square = F.when(F.col("spe_limit").isNotNull(), F.transform("e", lambda v: v * v)).otherwise(F.array_repeat(F.lit(0.0), p))
    part = F.zip_with(square, F.zip_with("z", "az", lambda a, b: F.greatest(F.lit(0.0), a * b)), lambda a, b: a + b)
    alarm = F.col("t2_alarm") | F.col("spe_alarm")

    def ranks(value: Column, rows: Column) -> Column:
        total = F.aggregate(value, F.lit(0.0), lambda s, v: s + v)
        entries = F.zip_with(names, F.zip_with(value, "per_sd", lambda v, w: F.when(w > 0, v)), lambda n, v: F.struct(n.alias("signal"), v.alias("value"), (100 * v / F.when(total > 0, total).otherwise(1.0)).alias("percent")))
        entries = F.filter(entries, lambda e: e["value"].isNotNull())
        first = F.array_sort(entries, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))
        return F.when(rows, F.slice(first, 1, top)).otherwise(F.slice(entries, 1, 0))

    out = df.withColumns({"causes": ranks(part, alarm), "residual_causes": ranks(square, F.col("spe_alarm"))})
    return out.select(*by, *order, "t2", "spe", "t2_limit", "spe_limit", "t2_alarm", "spe_alarm", "components", "causes", "residual_causes")


def alarms(monitored: DataFrame, top: int = 3) -> DataFrame:
    found = monitored.where(F.col("t2_alarm") | F.col("spe_alarm"))
    return found.withColumn("causes", F.slice("causes", 1, top))


def dtw(a: np.ndarray, b: np.ndarray, band: int = 0) -> tuple[float, float, list[tuple[int, int]]]:
    """Dynamic time warping by absolute cost: (distance, distance by path length, path); band 0 is without limit.

    Traced back, the diagonal is preferred, then a step in ``a``.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return math.inf, math.inf, []
    cost, _ = _warp(np.asarray(a, float)[None, :], np.asarray(b, float), band)
    cost = cost[:, :, 0]
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        best = min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
        if cost[i - 1, j - 1] == best:
            i, j = i - 1, j - 1
        elif cost[i - 1, j] == best:
            i -= 1
        else:
            j -= 1
    return float(cost[n, m]), float(cost[n, m]) / len(path), path[::-1]


def _warp(rows: np.ndarray, goal: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs and path lengths (n + 1, m + 1, row) of all rows at once, one array step for each cell of the table."""
    count, n = rows.shape
    m = len(goal)
    radius = max(band, abs(n - m)) if band else max(n, m)
    cost = np.full((n + 1, m + 1, count), np.inf)
    length = np.zeros((n + 1, m + 1, count), np.int32)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - radius), min(m, i + radius) + 1):
            back, up, left = cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]
            best = np.minimum(np.minimum(back, up), left)
            cost[i, j] = np.abs(rows[:, i - 1] - goal[j - 1]) + best
            length[i, j] = 1 + np.where(back == best, length[i - 1, j - 1], np.where(up == best, length[i - 1, j], length[i, j - 1]))
    return cost, length


def dtw_many(arrays: list[np.ndarray | None], goal: np.ndarray, band: int = 0, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(distance, distance by path length) of each array to ``goal``; arrays of one length are warped together."""
    out = np.full((2, len(arrays)), np.nan)
    sizes = np.array([-1 if x is None else len(x) for x in arrays])
    for n in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        if not n or not len(goal):
            out[:, rows] = np.inf
            continue
        step = max(1, at_once // ((n + 1) * (len(goal) + 1)))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            cost, length = _warp(np.array([arrays[i] for i in some], float), goal, band)
            out[0, some], out[1, some] = cost[n, -1], cost[n, -1] / length[n, -1]
    return out[0], out[1]


def dtw_to(df: DataFrame, array: str, golden: list[float], band: int = 0) -> DataFrame:
    """Adds ``dtw`` and ``dtw_normalized``: the distance of each row's array to a golden trace (null for a null array)."""
    goal = np.array(golden, float)

    @F.pandas_udf("distance double, normalized double")
    def distance(col: pd.Series) -> pd.DataFrame:
        arrays = [None if x is None else np.asarray(x, float) for x in col]
        d, per = dtw_many(arrays, goal, band)
        known = np.array([x is not None for x in arrays], bool)
        return pd.DataFrame({"distance": pd.Series(d).where(known), "normalized": pd.Series(per).where(known)})

    d = df.withColumn("__dtw", distance(array))
    return d.select(*df.columns, F.col("__dtw.distance").alias("dtw"), F.col("__dtw.normalized").alias("dtw_normalized"))


def resample(array: Column, length: int) -> Column:
    """``length`` values of an array by linear interpolation; an empty one gives zeros, one value a constant."""
    n = F.size(array)
    spread = float(max(length - 1, 1))

    def at(i: Column) -> Column:
        pos = i / spread * (n - 1)
        lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
        a, b = F.get(array, lo), F.get(array, hi)
        return a + (pos - lo) * (b - a)

    return F.when(n == 0, F.array_repeat(F.lit(0.0), length)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))


def envelope(traces: DataFrame, array: str, by: list[str], length: int, k: float = 3.0) -> DataFrame:
    """(by, pos, center, lower, upper): pointwise mean and k sample standard deviations of resampled traces."""
    df = traces.select(*by, F.posexplode(resample(F.col(array).cast("array<double>"), length)).alias("pos", "v"))
    df = df.groupBy(*by, "pos").agg(F.avg("v").alias("center"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    return df.select(*by, "pos", "center", (F.col("center") - k * F.col("s")).alias("lower"), (F.col("center") + k * F.col("s")).alias("upper"))


def _excess(traces: DataFrame, key: str, array: str, env: DataFrame, by: list[str], length: int) -> DataFrame:
    df = traces.select(key, *by, F.posexplode(resample(F.col(array).cast("array<double>"), length)).alias("pos", "v")).join(env, [*by, "pos"])
    return df.withColumn("excess", F.greatest(F.col("v") - F.col("upper"), F.col("lower") - F.col("v"), F.lit(0.0)))


def deviation_points(traces: DataFrame, key: str, array: str, env: DataFrame, by: list[str], length: int) -> DataFrame:
    """(key, by, pos, v, excess): how far each point of each trace lies out of its envelope, 0 inside."""
    return _excess(traces, key, array, env, by, length).select(key, *by, "pos", "v", "excess")


def deviation(traces: DataFrame, key: str, array: str, env: DataFrame, by: list[str], length: int, alarm_ratio: float = 0.1) -> DataFrame:
    """Of each trace: the share of points out of its envelope, their mean excess, and whether the share is an alarm."""
    e = F.col("excess")
    df = _excess(traces, key, array, env, by, length).groupBy(key, *by).agg((F.count_if(e > 0) / F.lit(float(length))).alias("out_of_band"), F.coalesce(F.avg(F.when(e > 0, e)), F.lit(0.0)).alias("mean_excess"))
    return df.withColumn("alarm", F.col("out_of_band") > alarm_ratio)


def overlay(long: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``scaled``: v between its series' least (0) and greatest (1) value, 0.5 where it is constant.

    Ranges are aggregates that meet the samples again, so samples are never sorted; a series without a value has nulls.
    """
    keys = [f"__key{i}" for i in range(len(by))]
    ranges = long.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys))).agg(F.min("v").alias("__low"), F.max("v").alias("__high"))
    same = F.lit(True)
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    low, high = F.col("__low"), F.col("__high")
    scaled = F.when(F.col("v").isNotNull(), F.when(high == low, 0.5).otherwise((F.col("v") - low) / F.nullif(high - low, F.lit(0.0))))
    return long.join(ranges, same).select(*long.columns, scaled.alias("scaled"))
