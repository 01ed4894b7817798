"""Monotone calibration: the greatest convex minorant of running sums, found slice by slice and merged in rounds.

With points in the order of their score, W the running weight and Y the running sum of labels, the monotone fit of least
squares is the slope of the greatest convex minorant of (W, Y). The minorant of a whole order is that of its slices'
minorants, so each slice is first cut down to the corners of its own, and neighbouring slices are merged FAN at a time.
Corners never reach the driver, and a row meets only the blocks of its slice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, one_row
from creditlake.functions.ordering import durable, running_totals

#: Neighbouring slices merged at once.
FAN = 8


def minorant(w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the greatest convex minorant of points with rising w, the ends included.

    Points on a line between others are no corners. One pass with a stack."""
    kept: list[int] = []
    for i in range(len(w)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (y[b] - y[a]) * (w[i] - w[b]) < (y[i] - y[b]) * (w[b] - w[a]):
                break
            kept.pop()
        kept.append(i)
    return np.asarray(kept, np.int64)


def _blocks(df: DataFrame) -> DataFrame:
    """The segments of the minorant of all points (slice, w, y): the w and slice where each begins and ends, and slope."""

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("w", ignore_index=True)
        part = part.iloc[minorant(part["w"].to_numpy(), part["y"].to_numpy())].reset_index(drop=True)
        part["since"] = part["slice"].shift(fill_value=-1)
        part["slope"] = (part["y"] - part["y"].shift()) / (part["w"] - part["w"].shift())
        return part[["slice", "w", "y", "since", "slope"]]

    schema = "slice int, w double, y double, since int, slope double"
    now, size = durable(df.select("slice", "w", "y").groupBy("slice").applyInPandas(merged, schema)), 1
    slices = (now.agg(F.max("slice")).first()[0] or 0) + 1
    while size < slices:
        size *= FAN
        now = durable(now.groupBy(F.expr(f"slice div {size}").alias("_group")).applyInPandas(merged, schema))
    return now.where("since >= 0")


def isotonic(df: DataFrame, score: str, target: str, name: str = "calibrated") -> DataFrame:
    """df plus name: the least-squares fit of the target that never falls as the score rises.

    Equal scores are one point, however many rows have one. Rows without a label take no part in the fit and get the
    value of the block they lie in or above, those below all labelled scores the lowest; a row without a score gets
    null, and all do if no row has both. Sums of 0 and 1 are exact, so the fit does not depend on the order of addition."""
    s, y = dbl(score), dbl(target)
    scored = F.when(~F.isnan(s), s + F.lit(0.0))
    points = df.where(scored.isNotNull()).groupBy(scored.alias("s")).agg(
        F.coalesce(F.sum(y), F.lit(0.0)).alias("y"), F.count(y).cast("double").alias("w"))
    totals = durable(running_totals(points, [], ["s"], ["y", "w"], "slice"))
    origin = df.sparkSession.createDataFrame([(0, 0.0, 0.0)], "slice int, w double, y double")
    blocks = _blocks(totals.where("w > 0").select("slice", F.col("cum_w").alias("w"), F.col("cum_y").alias("y")).unionByName(origin))
    # The last block also stands for what lies above it without a label.
    last = one_row(totals.agg(F.max("cum_w").alias("w"), F.max("slice").alias("slice")))
    end = F.when(F.col("w") == F.col("_last.w"), F.col("_last.slice")).otherwise(F.col("slice"))
    blocks = blocks.withColumn("_last", last).select("w", "slope", F.explode(F.sequence("since", end)).alias("of"))

    def valued(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(around):
            return pd.DataFrame({"s": own["s"], name: pd.Series([None] * len(own), dtype=float)})
        around = around.sort_values("w")
        at = np.searchsorted(around["w"].to_numpy(), own["cum_w"].to_numpy(), "left")
        return pd.DataFrame({"s": own["s"], name: around["slope"].to_numpy()[np.minimum(at, len(around) - 1)]})

    fitted = totals.groupBy("slice").cogroup(blocks.groupBy("of")).applyInPandas(valued, f"s double, `{name}` double")
    rows = df.withColumn("_s", scored)
    return rows.join(fitted.withColumnRenamed("s", "_p"), F.col("_s") == F.col("_p"), "left").drop("_s", "_p")
