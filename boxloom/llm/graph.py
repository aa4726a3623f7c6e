"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import shared

#: Edges that a task of a round gets, at least: small graphs are not spread over many files.
EDGES = 16384


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger end ``u`` to the smaller end ``v``."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: no node hangs on two, or on one that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    n, odd = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("least") == 0)))).first()
    return n, not odd


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``edges(u, v)``: the label is the smallest node reachable.

    A round hangs every larger neighbour on the least neighbour, then every smaller one too; a
    chain of n nodes needs about log n rounds. Rows never outnumber the edges by more than the
    nodes, joins are on one node (which Spark can split where a hub is hot), and each round ends
    in a checkpoint. Edges with a null end are left out; no edges give no rows.
    """
    now = shared(_down(edges))
    n, done = _state(now)
    while not done:
        # Rounds do not add to the edges, so their number says how many tasks are worth having.
        tasks = -(-n // EDGES)
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = shared(_down(small).coalesce(tasks))
        n, done = _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels(node, label)`` of ``components`` after ``edges(u, v)`` are added, computed once.

    Rounds go over the components that the edges join, each as its label; most of the graph is only read.
    """
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}l"))
    joined = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    joined = shared(joined.select("u", "v", F.coalesce("ul", "u").alias("a"), F.coalesce("vl", "v").alias("b")))
    over = components(joined.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("label", "to")
    ends = joined.select(F.col("u").alias("node"), F.col("a").alias("label")).unionByName(joined.select(F.col("v").alias("node"), F.col("b").alias("label")))
    every = labels.unionByName(ends).distinct().join(over, "label", "left")
    return shared(every.select("node", F.coalesce("to", "label").alias("label")))
