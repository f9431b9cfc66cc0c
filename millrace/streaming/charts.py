"""Control charts over streams of chart points: limits are frozen beforehand, state is a few numbers for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.spc import CUSUM_H, CUSUM_K, EWMA_L, KEYS, LAMBDA

OUT = "recipe string, stage string, recipe_step_num int, signal string, time timestamp, idx int, ewma double, ewma_alarm boolean, cusum_up double, cusum_down double, cusum_alarm boolean"


def _one_sided(last: float, steps: np.ndarray) -> np.ndarray:
    """max(0, C + step) over all steps from C = last: sums less their least so far."""
    sums = last + np.cumsum(steps)
    return sums - np.minimum(np.minimum.accumulate(sums), 0.0)


def monitor_stream(points: DataFrame, limits: DataFrame) -> DataFrame:
    """points: a stream of KEYS, time, value; limits: a static table of KEYS, center_line, sigma.

    Points of a key are put in order of time within a trigger; those of a later trigger must not be earlier.
    Returns a stream with both charts' statistics and alarms.
    """
    joined = points.join(limits.select(*KEYS, "center_line", "sigma"), KEYS)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, last, up, down = state.get if state.exists else (0, None, 0.0, 0.0)
        pdf = pd.concat(list(frames)).sort_values("time", kind="stable", ignore_index=True)
        if not len(pdf):
            return
        center, sigma, x = float(pdf["center_line"][0]), float(pdf["sigma"][0]), pdf["value"].to_numpy(float)
        z = pd.Series(np.concatenate(([center if last is None else last], x))).ewm(alpha=LAMBDA, adjust=False).mean().to_numpy()[1:]
        at = idx + np.arange(len(x))
        width = EWMA_L * sigma * np.sqrt(LAMBDA / (2 - LAMBDA) * (1 - (1 - LAMBDA) ** (2 * (at + 1.0))))
        u = (x - center) / sigma if sigma > 0 else np.zeros(len(x))
        ups, downs = _one_sided(up, u - CUSUM_K), _one_sided(down, -u - CUSUM_K)
        out = pd.DataFrame({"time": pdf["time"], "idx": at.astype("int32"), "ewma": z, "ewma_alarm": (sigma > 0) & (np.abs(z - center) > width), "cusum_up": ups, "cusum_down": downs, "cusum_alarm": np.maximum(ups, downs) > CUSUM_H})
        state.update((int(idx + len(x)), float(z[-1]), float(ups[-1]), float(downs[-1])))
        for name, value in reversed(list(zip(KEYS, key))):
            out.insert(0, name, value)
        yield out

    return joined.groupBy(*KEYS).applyInPandasWithState(step, OUT, "idx int, z double, up double, down double", "append", GroupStateTimeout.NoTimeout)


def windowed_points(samples: DataFrame, lateness: str, width: str) -> DataFrame:
    """Chart points of a stream of samples (KEYS, processed_time, v): means of tumbling windows, late data dropped."""
    w = F.window("processed_time", width)
    return samples.withWatermark("processed_time", lateness).groupBy(*KEYS, w.alias("w")).agg(F.avg("v").alias("value"), F.count("*").alias("samples")).select(*KEYS, F.col("w.start").alias("time"), "value", "samples")
