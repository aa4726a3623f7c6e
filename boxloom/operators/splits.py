"""Reproducible, leakage-safe assignment of groups to splits and folds, samples and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(seed: int, key: Column) -> Column:
    """A hash that puts keys in a reproducible random order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: Groups placed before what was placed is added to the whole: an array is copied when it grows.
CHUNK = 512


def water_fill(groups: DataFrame, targets: dict[str, float], seed: int) -> DataFrame:
    """``unit, bucket`` for groups ``(unit, stratum, size)``.

    Strata are visited in order, groups within one in a seeded order; each goes to the bucket with
    the least filled share of its target, ties to the first named. What is filled carries over from
    stratum to stratum. This is a fold by nature; it runs over one array of groups (not rows),
    inside the JVM, a chunk at a time.
    """
    names, shares = list(targets), list(targets.values())
    order = F.struct(F.col("stratum").cast("string").alias("s"), seeded(seed, F.col("unit")).alias("h"), F.col("unit").cast("string").alias("u"), F.col("size").cast("long").alias("n"))
    line = groups.agg(F.sort_array(F.collect_list(order)).alias("line"))
    counts = F.sequence(F.lit(0), F.floor((F.size("line") - 1) / CHUNK).cast("int"))
    line = line.where(F.size("line") > 0).select(F.transform(counts, lambda i: F.slice("line", i * CHUNK + 1, CHUNK)).alias("chunks"))
    none = F.array().cast("array<struct<u:string,i:int>>")
    start = F.struct(F.array(*[F.lit(0).cast("long")] * len(names)).alias("filled"), F.array().cast("array<array<struct<u:string,i:int>>>").alias("out"))
    goals = F.array(*[F.lit(float(s)) for s in shares])

    def step(acc, x):
        level = F.zip_with(acc["filled"], goals, lambda c, g: c / g)
        at = F.array_position(level, F.array_min(level)).cast("int")
        filled = F.transform(acc["filled"], lambda c, i: F.when(i == at - 1, c + x["n"]).otherwise(c))
        return F.struct(filled.alias("filled"), F.array_append(acc["out"], F.struct(x["u"].alias("u"), at.alias("i"))).alias("out"))

    def chunk(acc, items):
        # An array of one binds the chunk's fold, so that it is not run for each of its fields.
        done = F.array(F.aggregate(items, F.struct(acc["filled"].alias("filled"), none.alias("out")), step))
        return F.get(F.transform(done, lambda d: F.struct(d["filled"].alias("filled"), F.array_append(acc["out"], d["out"]).alias("out"))), F.lit(0))

    placed = line.select(F.explode(F.flatten(F.aggregate("chunks", start, chunk)["out"])).alias("e"))
    return placed.select(F.col("e.u").alias("unit"), F.element_at(F.array(*map(F.lit, names)), F.col("e.i")).alias("bucket"))


def cut_by_order(keys: DataFrame, key: str, seed: int, shares: tuple[float, float] = (0.7, 0.15), names: tuple[str, str, str] = ("train", "val", "test")) -> DataFrame:
    """``key, split``: distinct keys in seeded order, whole-number shares to the first splits, the rest to the last."""
    distinct = keys.select(key).distinct()
    n = distinct.agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(seeded(seed, F.col(key)), key)) - 1
    first = (F.col("n") * F.lit(shares[0])).cast("int")
    second = first + (F.col("n") * F.lit(shares[1])).cast("int")
    placed = distinct.withColumn("_place", place).crossJoin(F.broadcast(n))
    return placed.select(key, F.when(F.col("_place") < first, names[0]).when(F.col("_place") < second, names[1]).otherwise(names[2]).alias("split"))


def background_limit(positives: int, share: float = 0.30) -> int:
    """How many background images make up that share beside so many positive ones."""
    return int(share / (1 - share) * positives)


def cap_backgrounds(df: DataFrame, background: Column, key: str, seed: int, share: float = 0.30) -> DataFrame:
    """All positive rows, and the first backgrounds in seeded order up to their share."""
    limit = background_limit(df.where(~background).count(), share)
    return df.where(~background).unionByName(df.where(background).orderBy(seeded(seed, F.col(key)), key).limit(limit))


def oversample(df: DataFrame, positive: Column, times: int = 3) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(positive, times).otherwise(1))))


def spanning_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in more than one split; there should be none."""
    return df.groupBy(group).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select(group)


def coverage(df: DataFrame, key: str) -> DataFrame:
    """``n_rows, n_keys, n_twice``: whether each key has exactly one row."""
    per = df.groupBy(key).agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_twice"))
