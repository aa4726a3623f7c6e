"""Severity tiers, frozen cuts, measurement gates and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import tertile
from boxloom.operators.ranks import quantiles


def tertile_cuts(df: DataFrame, value: str, where: Column | None = None) -> DataFrame:
    """``low, high``: exact 1/3 and 2/3 quantiles of finite values, linearly interpolated."""
    v = F.col(value)
    rows = df if where is None else df.where(where)
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    return quantiles(rows, [], "v", [1 / 3, 2 / 3]).select(F.col("q0").alias("low"), F.col("q1").alias("high"))


def with_tiers(df: DataFrame, value: str, cuts: DataFrame) -> DataFrame:
    """Add ``tier`` by frozen cuts (one row)."""
    return df.crossJoin(F.broadcast(cuts)).withColumn("tier", tertile(value, F.col("low"), F.col("high"))).drop("low", "high")


def snr(value: Column, spread: Column) -> Column:
    """Signal over spread; infinite where the spread is 0."""
    return F.when(spread > 0, value / spread).when(spread.isNotNull() & value.isNotNull(), F.lit(float("inf")))


#: Whole values up to this are added up as numbers of 64 bits.
WHOLE = 1_000_000


def spread_of(df: DataFrame, group: list[str], value: str, *more: Column) -> DataFrame:
    """``group, dbs, sd, snr, n`` and ``more`` of each group: sum, population deviation, their ratio, rows.

    Running means round differently by the order in which rows and partial results arrive, and so move
    ratios that lie on a limit to either side of it. Whole values are added up exactly instead, and
    the ratio is taken before either is divided by their number: on a limit it is that limit.
    """
    v = F.col(value)
    fits = (v == F.floor(v)) & (F.abs(v) <= WHOLE)
    whole = F.when(fits, v).cast("long")
    sums = df.groupBy(*group).agg(
        F.sum(v).alias("dbs"), F.stddev_pop(v).alias("sd"), F.count("*").alias("n"), F.bool_and(fits).alias("_fits"),
        F.count(v).alias("_n"), F.sum(whole).alias("_s"), F.try_sum(whole * whole).alias("_q"), *more,
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # The number of values squared times their variance.
    sums = sums.withColumn("_root", F.sqrt((wide("_n") * wide("_q") - wide("_s") * wide("_s")).cast("double")))
    exact = F.col("_fits") & F.col("_root").isNotNull()
    return sums.withColumns({
        "snr": F.when(exact, snr((wide("_n") * wide("_s")).cast("double"), F.col("_root"))).otherwise(snr(F.col("dbs"), F.col("sd"))),
        "sd": F.when(exact, F.col("_root") / F.col("_n")).otherwise(F.col("sd")),
    }).drop("_fits", "_n", "_s", "_q", "_root")


def snr_band(ratio: Column) -> Column:
    """clean above 2, marginal from 1 to 2, noise below 1; null for what is not finite."""
    finite = ratio.isNotNull() & ~F.isnan(ratio) & (ratio < float("inf"))
    return F.when(~finite, None).when(ratio > 2, "clean").when(ratio >= 1, "marginal").otherwise("noise")


def is_clean(text: Column) -> Column:
    """Whether a ratio written as text is above 2; unreadable is not."""
    return F.coalesce(text.try_cast("double") > 2, F.lit(False))


def measurement_flag(in_mask: Column, ring: Column, fitted: Column, inliers: Column) -> Column:
    """Why a measurement fails, in this order; ``low_inlier`` is a warning only, the value stays."""
    return (
        F.when(in_mask < 20, "mask_fail").when(ring < 200, "ring_fail").when(~fitted, "ransac_fail").when(inliers < 0.5, "low_inlier").otherwise("")
    )


def shares_above(df: DataFrame, group: str, value: str, thresholds: list[float]) -> DataFrame:
    """``group, threshold, pct``: percentage of a population at or above each candidate threshold."""
    grid = F.explode(F.array(*map(F.lit, thresholds)))
    spread = df.select(group, value, grid.alias("threshold"))
    return spread.groupBy(group, "threshold").agg((F.avg(F.when(F.col(value) >= F.col("threshold"), 1.0).otherwise(0.0)) * 100).alias("pct"))
