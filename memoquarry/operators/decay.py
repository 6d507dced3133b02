"""Closed forms of activation decay between touches of a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trajectories(steps: DataFrame, slot: str, order: str, time: str, touch: str, rate: float = 0.95, half_life: float = 3600.0) -> DataFrame:
    """Activation of each slot at each of its steps since its first touch.

    A touch sets activation to 1 and adds a rehearsal.  After n further steps it is
    rate^n * 2^(-sum of elapsed seconds at each step / (half_life * (1 + rehearsals / 2))).
    """
    by = Window.partitionBy(slot).orderBy(order)
    segment = Window.partitionBy(slot, "rehearsals").orderBy(order)
    rows = steps.withColumn("rehearsals", F.sum(F.col(touch).cast("long")).over(by)).filter("rehearsals > 0")
    rows = rows.withColumn("n", F.row_number().over(segment) - 1).withColumn("elapsed", F.col(time) - F.first(time).over(segment))
    total = F.sum("elapsed").over(segment)
    return rows.withColumn("activation", F.pow(F.lit(rate), F.col("n")) * F.pow(F.lit(2.0), -total / (half_life * (1 + 0.5 * F.col("rehearsals")))))


def cold_start(activation: Column, seconds: Column, rate: float = 0.95) -> Column:
    """Step decay for each whole 30 seconds away."""
    return activation * F.pow(F.lit(rate), F.floor(seconds / 30))
