"""Precision, recall, average precision, sweeps and agreement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def ratios(tp: str = "tp", fp: str = "fp", n_gt: str = "n_gt") -> dict[str, Column]:
    """Precision, recall and F1; null where undefined, never NaN."""
    t, f, n = F.col(tp), F.col(fp), F.col(n_gt)
    p, r = F.try_divide(t, t + f), F.try_divide(t, n)
    return {"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)}


def with_ratios(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({k: F.round(v, digits) for k, v in ratios().items()})


def by_domain(events: DataFrame, gt: DataFrame, domains: DataFrame, conf: float) -> DataFrame:
    """``domain, n_gt, n_pred, tp, fp, fn`` for each domain and OVERALL, counts of all rows together."""
    e = events.where(F.col("conf") >= conf).select("image_id", F.lit(0).alias("g"), F.col("is_tp").cast("int").alias("t"), F.lit(1).alias("p"))
    both = e.unionByName(gt.select("image_id", F.lit(1).alias("g"), F.lit(0).alias("t"), F.lit(0).alias("p")))
    # One row an image before the lookup; most of the rows meet here.
    per = both.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("g", "t", "p")]).join(domains, "image_id")
    total = per.rollup("domain").agg(F.grouping("domain").alias("all"), *[F.sum(c).alias(c) for c in ("g", "t", "p")])
    return total.select(
        F.when(F.col("all") == 1, "OVERALL").otherwise(F.col("domain")).alias("domain"),
        F.col("g").alias("n_gt"),
        F.col("p").alias("n_pred"),
        F.col("t").alias("tp"),
        (F.col("p") - F.col("t")).alias("fp"),
        (F.col("g") - F.col("t")).alias("fn"),
    ).where("domain is not null")


def sweep(events: DataFrame, totals: DataFrame, key: list[str], first: int = 1, last: int = 10, step: float = 0.05) -> DataFrame:
    """``key, conf, tp, fp, n_gt`` at each threshold i * step, from one set of match events.

    Each event adds to all thresholds it reaches; they are a handful, so it is spread before the
    counts are added up in the task.
    """
    reached = F.filter(F.sequence(F.lit(first), F.lit(last)), lambda i: F.col("conf") >= i.cast("double") * F.lit(step))
    hits = events.select(*key, "is_tp", F.explode(reached).alias("i")).groupBy(*key, "i").agg(count_if(F.col("is_tp")).alias("tp"), count_if(~F.col("is_tp")).alias("fp"))
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(first), F.lit(last))))
    out = grid.join(hits, [*key, "i"], "left")
    return out.select(*key, (F.col("i").cast("double") * F.lit(step)).alias("conf"), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), "n_gt")


def ranked(events: DataFrame, key: list[str], parts: int = 64) -> DataFrame:
    """Add ``n`` and ``cum_tp``: rank by falling confidence and true ones so far, within each key.

    Confidences repeat, so events are first added up by confidence: running sums over the distinct
    confidences of a key give each its offset, and only ties are ranked together. One task never
    holds all events of a key.
    """
    steps = events.groupBy(*key, "conf").agg(F.count("*").alias("c"), F.sum(F.col("is_tp").cast("int")).alias("t"))
    before = Window.partitionBy(*key).orderBy(F.col("conf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*key, "conf", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    ties = Window.partitionBy(*key, "conf").orderBy("image_id", "pred_idx")
    so_far = ties.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = events.withColumns({"_n": F.row_number().over(ties), "_t": F.sum(F.col("is_tp").cast("int")).over(so_far)})
    return own.join(steps, [*key, "conf"]).select(
        *events.columns, (F.col("c0") + F.col("_n")).cast("long").alias("n"), (F.col("t0") + F.col("_t")).cast("long").alias("cum_tp")
    )


def average_precision(events: DataFrame, totals: DataFrame, key: list[str], points: int = 101) -> DataFrame:
    """``key, ap``: mean over recall thresholds i / (points - 1) of the best precision at that recall or more.

    Each event at a true positive reaches the thresholds up to its recall; the best precision by
    the highest threshold reached is added up first, so at most ``points`` rows a key are left for
    the running maximum. Null without boxes or detections.
    """
    curve = ranked(events, key).where("is_tp").join(totals, key)
    step = 1.0 / (points - 1)
    recall, precision = F.col("cum_tp") / F.col("n_gt"), F.col("cum_tp") / F.col("n")
    guess = F.floor(recall / step).cast("int")
    # The highest i with recall >= i * step in double arithmetic is the guess or a neighbour of it.
    reach = F.array_max(F.filter(F.sequence(F.greatest(guess - 1, F.lit(0)), F.least(guess + 1, F.lit(points - 1))), lambda i: recall >= i.cast("double") * F.lit(step)))
    best = curve.select(*key, reach.alias("i"), precision.alias("p")).groupBy(*key, "i").agg(F.max("p").alias("p"))
    up = Window.partitionBy(*key).orderBy(F.col("i").desc())
    # A threshold between two reached ones takes the best precision from the higher one on.
    best = best.withColumns({"p": F.max("p").over(up), "low": F.lag("i", 1, -1).over(Window.partitionBy(*key).orderBy("i"))})
    area = best.groupBy(*key).agg(F.sum(F.col("p") * (F.col("i") - F.col("low"))).alias("area"))
    some = events.groupBy(*key).agg(F.count("*").alias("n_pred"))
    out = totals.join(some, key, "left").join(area, key, "left")
    ap = F.coalesce("area", F.lit(0.0)) / points
    return out.select(*key, F.when((F.col("n_gt") > 0) & (F.col("n_pred") > 0), ap).alias("ap"))


def best_row(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; nulls should be ordered last by the caller."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """``truth, guess, n`` for every pair of the given labels, zero-filled."""
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("truth"), F.array(*map(F.lit, labels)).alias("g"))
    grid = grid.select("truth", F.explode("g").alias("guess"))
    return grid.join(F.broadcast(seen.where(F.col("truth").isin(labels) & F.col("guess").isin(labels))), ["truth", "guess"], "left").select(
        "truth", "guess", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def present(matrix: DataFrame) -> DataFrame:
    """The rows of a confusion matrix whose labels occur, as a truth or as a guess; scores of others are not averaged in."""
    seen = matrix.where("n > 0").select(F.explode(F.array("truth", "guess")).alias("label")).distinct()
    side = lambda c: F.broadcast(seen.withColumnRenamed("label", c))
    return matrix.join(side("truth"), "truth", "left_semi").join(side("guess"), "guess", "left_semi")


def class_scores(matrix: DataFrame) -> DataFrame:
    """``label, precision, recall, f1`` from a confusion matrix; undefined ratios are 0."""
    rows = matrix.select(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("n_true"), F.lit(0).alias("n_guess"))
    cols = matrix.select(F.col("guess").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("n_true"), F.col("n").alias("n_guess"))
    s = rows.unionByName(cols).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "n_true", "n_guess")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select(
        "label",
        zero(F.col("tp"), F.col("n_guess")).alias("precision"),
        zero(F.col("tp"), F.col("n_true")).alias("recall"),
        zero(2 * F.col("tp"), F.col("n_guess") + F.col("n_true")).alias("f1"),
    )
