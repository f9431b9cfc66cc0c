"""What the figures mean, in a sentence each: columns of text, made from columns of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

T2 = "T2 joins all signals into one distance from the usual state, weighed by how they usually move together."
SPE = "SPE is what the model of usual joint movement leaves over; it rises when signals stop moving together."


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, rounded half up, without grouping."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


def sigma(s: Column) -> Column:
    return _text("Runs differ by a sigma of ", fixed(s, 4), "; limits lie three sigmas to either side.")


def limits(center: Column, lcl: Column, ucl: Column) -> Column:
    return _text("Usual values lie from ", fixed(lcl, 3), " to ", fixed(ucl, 3), " around ", fixed(center, 3), "; these are limits of stability, not of quality.")


def stability(n: Column, insufficient: Column) -> Column:
    return F.when(insufficient, _text(n.cast("string"), " points are too few for firm limits.")).otherwise(_text(n.cast("string"), " points are enough for limits."))


def run_lengths(arl0: Column, arl1: Column) -> Column:
    return _text("A false alarm comes once in ", fixed(arl0, 0), " points; a fault is found after ", fixed(arl1, 1), " points on average.")


def contribution(signal: Column, percent: Column) -> Column:
    return _text(signal, " contributes most (", fixed(percent, 0), " %): look there first.")


def recommendation(correlated: Column, lag1: Column, trust: Column, ratio: Column, change_point: Column) -> Column:
    """Why a chart is recommended, by the same order of tests as the recommendation itself."""
    times = F.when(ratio == float("inf"), "infinitely").otherwise(F.concat(fixed(F.when(ratio < float("inf"), ratio), 1), F.lit(" times")))
    return (
        F.when(correlated, _text("Neighbouring points are correlated (", fixed(lag1, 2), "), so residuals of an autoregression are charted."))
        .when(trust == "low", _text("Points vary ", times, " as much overall as between neighbours, so a trend is taken out first."))
        .when(change_point.isNotNull(), _text("The level may change after point ", change_point.cast("string"), "; sums show small lasting shifts soonest."))
        .otherwise(_text("No trend or correlation shows and trust is ", trust, "; weighted means show small shifts soon."))
    )
