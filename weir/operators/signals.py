"""Signals over metric series: windows and folds within one series, ordered by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(values: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array, seeded with its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.lit(1), F.size(values))), F.get(values, F.lit(0)), lambda a, v: alpha * v + (1 - alpha) * a)


def slope(df: DataFrame, by: str, step: str, value: str) -> DataFrame:
    """Least-squares slope over the index; 0 for fewer than two points."""
    at = df.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(step)).cast("double"))
    return at.groupBy(by).agg(F.coalesce(F.regr_slope(value, "_i"), F.lit(0.0)).alias("slope"))


def runs(df: DataFrame, by: str, step: str, bad: Column) -> DataFrame:
    """Adds `streak`: how many rows in a row, up to this one, are bad."""
    w = Window.partitionBy(by).orderBy(step)
    island = F.sum(F.when(bad, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_b", bad).withColumn("_i", island)
    return out.withColumn("streak", F.sum(F.col("_b").cast("int")).over(Window.partitionBy(by, "_i").orderBy(step).rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "_i")


def alerts(df: DataFrame, by: str, step: str, value: str, high: float, times: int, spike: float, window: int = 20) -> DataFrame:
    """Adds alert: STOP after `times` values above `high` in a row, WARN for a value above `spike` times the mean before it."""
    w = Window.partitionBy(by).orderBy(step)
    past = w.rowsBetween(-window, -1)
    out = runs(df, by, step, F.col(value) > high).withColumn("_m", F.avg(value).over(past)).withColumn("_c", F.count(value).over(past))
    return out.withColumn("alert", F.when(F.col("streak") >= times, "STOP").when((F.col("_c") >= 4) & (F.col(value) > spike * F.col("_m")), "WARN")).drop("_m", "_c")


def regression(df: DataFrame, by: str, step: str, value: str, rise: float, lookback: int = 4) -> DataFrame:
    """Adds regressed: the value is `rise` or more above the least of the `lookback` before it."""
    past = Window.partitionBy(by).orderBy(step).rowsBetween(-lookback, -1)
    return df.withColumn("regressed", F.coalesce(F.col(value) - F.min(value).over(past) >= rise, F.lit(False)))


def plateau(values: Column, patience: int, delta: float) -> Column:
    """No improvement over the best of the rest in the last `patience` values of an array."""
    n = F.size(values)
    last = F.slice(values, F.greatest(F.lit(1), n - patience + 1), patience)
    rest = F.slice(values, 1, F.greatest(F.lit(0), n - patience))
    return (n >= patience + 1) & (F.array_max(last) <= F.array_max(rest) + delta)
