"""Exact quantiles, ranks and significance, against NumPy and integration."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.operators import ranks as R

SHARES = [0.0, 0.05, 1 / 3, 0.5, 2 / 3, 0.95, 1.0]


def test_quantiles_of_groups(spark):
    rng = random.Random(6)
    data = {"a": [rng.choice([1.0, 2.5, 7.0]) for _ in range(500)], "b": [rng.random() for _ in range(301)], None: [3.0, 1.0], "c": [4.0], "d": []}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "grp string, v double")
    got = {r["grp"]: r for r in R.quantiles(df, ["grp"], "v", SHARES).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        assert r["n"] == len(data[g])
        assert [r[f"q{i}"] for i in range(len(SHARES))] == pytest.approx(list(np.quantile(data[g], SHARES)), abs=1e-12)


def test_quantiles_without_group_or_rows(spark):
    df = spark.range(10_001).select((F.col("id") % 5000).alias("v"))
    r = R.quantiles(df, [], "v", [0.25, 0.5]).first()
    assert (r["n"], r["q0"], r["q1"]) == (10_001, *np.quantile(np.arange(10_001) % 5000, [0.25, 0.5]))
    empty = R.quantiles(df.where("v < 0"), [], "v", [0.5]).collect()
    assert [(r["n"], r["q0"]) for r in empty] == [(0, None)]
    assert R.quantiles(df.where("v < 0").withColumn("g", F.lit(1)), ["g"], "v", [0.5]).count() == 0


def test_running_counts_cross_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 1009).alias("v"))
    want, seen = {}, sorted((i % 2, i * 7919 % 1009) for i in range(3000))
    for k, (g, v) in enumerate(seen):
        want.setdefault((g, v), k - (0 if g == 0 else 1500))
    assert {(r["g"], r["v"]): r["before"] for r in R.running(df, ["g"], "v").collect()} == want
    plan = R.running(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "percentile" not in plan


def tail(t, d, steps=200_000):
    """Two-sided, by Simpson's rule after substituting u = sqrt(d) tan(x)."""
    a, b = math.atan(t / math.sqrt(d)), math.pi / 2
    h = (b - a) / steps
    f = lambda x: math.cos(x) ** (d - 1)
    s = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(a + i * h) for i in range(steps + 1)) * h / 3
    return 2 * s * math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2)) / math.sqrt(math.pi)


def test_student_tail(spark):
    cases = [(0.0, 5.0), (0.3, 1.0), (2.0, 3.0), (1.96, 40.0), (4.5, 12.0), (0.02, 999.0), (3.1, 4000.0), (30.0, 2.0)]
    df = spark.createDataFrame(cases, "t double, d double")
    got = {(r["t"], r["d"]): r["p"] for r in df.withColumn("p", R.student_tail(F.col("t") * F.col("t"), F.col("d"))).collect()}
    for t, d in cases:
        assert got[t, d] == pytest.approx(tail(t, d), abs=1e-9)


def test_spearman_odd(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (None, 1.0)], "a double, b double")
    assert tuple(R.spearman(df, "a", "b").first()) == (pytest.approx(1.0), 0.0, 3)
    assert R.spearman(df.limit(2), "a", "b").first()["p"] is None
    assert R.spearman(df.where("a > 9"), "a", "b").first()["n"] == 0
