"""Exact order statistics of any number of rows: counted values, dealt by range, with running counts across ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.operators.duplicates import checkpointed


def running(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``group, value, c, before``: how often each value of a group occurs, and how many of its rows have less.

    Null values are left out; NaN is one value, above all others. Rows are added up by value where
    they lie; distinct values are dealt by range, so a group of any size is spread over tasks, and
    summed within each range. A range's rows of a group then need one number: those of the ranges before it.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    dealt = counted.repartitionByRange(*group, value).withColumn("_range", F.spark_partition_id())
    within = Window.partitionBy("_range", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    dealt = checkpointed(dealt)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum("c").over(within), F.lit(0)))
    sizes = dealt.groupBy("_range", *group).agg(F.sum("c").alias("_size"))
    # One row for each range that a group is in: a handful, which Spark broadcasts when it has seen how small they are.
    ahead = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    rows = dealt.join(offsets, (F.col("_range") == F.col("_r")) & _same(group))
    return rows.select(*group, value, "c", (F.col("_in") + F.col("_ahead")).alias("before"))


def _same(group: Sequence[str]) -> Column:
    """Whether the groups of two sides are equal, the other's columns being ``_g0, _g1, ..``; nulls are."""
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return on


def quantiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``group, n, q0, q1, ..``: exact quantiles of each group, linearly interpolated between the two ranks next to them.

    Only the values at those ranks leave their range. A group without values has no row; without
    a group there is always one, of nulls if there are no values.
    """
    counts = running(df, group, value)
    # The last value of a group has all others before it.
    total = counts.groupBy(*group).agg(F.max(F.col("before") + F.col("c")).alias("n"))
    named = total.select("n", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    rows = counts.join(named if group else F.broadcast(named), _same(group))
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
    ends = []
    for i, p in enumerate(place):
        ends += [(f"_lo{i}", F.when(holds(F.floor(p)), F.col(value))), (f"_hi{i}", F.when(holds(F.ceil(p)), F.col(value)))]
    wanted = rows.select(*group, "n", *[c.alias(k) for k, c in ends]).where(F.coalesce(*[F.col(k).cast("double") for k, _ in ends]).isNotNull())
    found = wanted.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(k).cast("double").alias(k) for k, _ in ends])
    out = []
    for i, p in enumerate(place):
        lo, hi, part = F.col(f"_lo{i}"), F.col(f"_hi{i}"), p - F.floor(p)
        out.append(F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part).alias(f"q{i}"))
    return found.select(*group, F.coalesce("n", F.lit(0)).alias("n"), *out)


def average_ranks(df: DataFrame, column: str, to: str) -> DataFrame:
    """``column, to``: each value once with its rank from 1, ties sharing their mean rank."""
    return running(df, [], column).select(column, (F.col("before") + (F.col("c") + 1) / 2).alias(to))


def student_tail(t2: Column, degrees: Column, terms: int = 400) -> Column:
    """Two-sided probability of a Student t whose square is at least ``t2``: the regularised incomplete beta function.

    I(x; a, 1/2) with x = d / (d + t2) and a = d / 2, by the continued fraction, on whichever side it
    converges fast, folded over its terms in one expression.
    """
    x = degrees / (degrees + t2)
    a, b = degrees / 2, F.lit(0.5)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = 1 / safe(1 - (p + q) * z / (p + 1))

    def part(acc: Column, top: Column) -> Column:
        d = 1 / safe(1 + top * acc["d"])
        c = safe(1 + top / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def step(acc: Column, m: Column) -> Column:
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        # Names bound by a fold over one element, so that each part is worked out once.
        mid = F.get(F.transform(F.array(part(acc, even)), lambda s: part(s, odd)), F.lit(0))
        return mid

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda acc, m: step(acc, m.cast("double")))["h"]
    # ln Beta(a, 1/2) by Stirling's series, shifted until it holds to the last digits.
    log_beta = _log_gamma(p) + _log_gamma(q) - _log_gamma(p + q)
    front = F.exp(p * F.ln(z) + q * F.ln(1 - z) - log_beta) / p
    inner = F.when(z <= 0, F.lit(0.0)).otherwise(front * fraction)
    return F.when(swap, 1 - inner).otherwise(inner)


def _log_gamma(x: Column, shift: int = 12) -> Column:
    """Logarithm of the gamma function of a positive number."""
    product = x
    for k in range(1, shift):
        product = product * (x + k)
    y = x + shift
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + series - F.ln(product)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``rho, p, n``: correlation of average ranks over rows that have both values, and how likely one as far from 0 is by chance.

    ``p`` is two-sided, of Student's t with n - 2 degrees of freedom; null below three rows.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    r = both.join(average_ranks(both, a, "_ra"), a).join(average_ranks(both, b, "_rb"), b).agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))
    degrees = F.greatest(F.col("n") - 2, F.lit(1)).cast("double")
    rest = 1 - F.col("rho") * F.col("rho")
    p = F.when(rest <= 0, F.lit(0.0)).otherwise(student_tail(F.try_divide(F.col("rho") * F.col("rho") * degrees, rest), degrees))
    return r.select("rho", F.when((F.col("n") > 2) & F.col("rho").isNotNull() & ~F.isnan("rho"), p).alias("p"), "n")
