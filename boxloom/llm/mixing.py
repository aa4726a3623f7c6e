"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.llm.common import WORD, ordered_rank, pack, shared

#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all sizes, and the most of a source as a multiple of its size.
SHARE, CAP = 1.5, 2
#: Words of a block, and about how many words a shard holds.
BLOCK, SHARD = 32, 1 << 18
#: Blocks that a task draws from, and rows of sums by group, or repeated ids, that are broadcast at most.
TASK, BROADCAST_GROUPS = 1 << 18, 100_000
#: Copies of a row that are written out by one task.
COPIES = 4096


def size_of(text: Column) -> Column:
    """White-space words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``sid`` (place of the source in code-point order, null last) and ``target`` to ``source, source_size``.

    All sources get one factor times their weight; a source whose target would pass ``cap`` times
    its size stops there and the rest is shared anew by weight, until none is above. A round adds
    up two numbers over the sources, wherever they lie, so any number of sources will do.
    """
    # Null is last: no string is above every other, so it has a rank of its own.
    named = sizes.where("source is not null")
    ranked = ordered_rank(named, F.col("source").asc(), "sid")
    count = ranked.count()
    ranked = ranked.unionByName(sizes.where("source is null").withColumn("sid", F.lit(count).cast("long")))
    at = (F.col("sid") % len(weights)).cast("int")
    ranked = shared(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), at + 1)))
    room = F.col("source_size") * cap
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget, full, factor = share * total, -1, 0.0
    while True:
        over = room < F.lit(factor) * F.col("weight")
        used, free, now = ranked.agg(
            F.coalesce(F.sum(F.when(over, room)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)
        ).first()
        if now == full or not free:
            break
        full, factor = now, (budget - used) / free
    over = room < F.lit(factor) * F.col("weight")
    return ranked.withColumn("target", F.when(over, room.cast("double")).otherwise(F.lit(factor) * F.col("weight"))).drop("weight")


def _joined(rows: DataFrame, sums: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with what ``sums`` says of their group; few groups are sent to where the rows lie."""
    return rows.join(F.broadcast(sums) if sums.count() <= BROADCAST_GROUPS else sums, group)


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: Column) -> DataFrame:
    """Add ``quota``: Sainte-Laguë seats of each party in its group.

    ``seats`` (a column constant in a group) go one by one to the highest quotient
    votes / (2 * seats so far + 1). Rounding votes by a divisor a little too large gives every
    party a sure part of its seats; only the few left, at most about one a party, are dealt by
    comparing quotients, ties in the order of ``key``, which names a party. Groups without votes get none.

    Votes and sure seats are added up by group where they lie, and quotients are ranked by range,
    so a group of any number of parties is spread over tasks.
    """
    names = list(parties.columns)
    sums = shared(parties.groupBy(*group).agg(F.sum(votes).alias("_v"), F.count("*").alias("_n")))
    df = _joined(parties.withColumn("_h", seats.cast("double")), sums, group)
    # With divisor v / (h - n / 2), rounding gives h seats at most; with few seats none is sure.
    divisor = F.when(F.col("_h") > F.col("_n"), F.col("_v") / (F.col("_h") - F.col("_n") / 2))
    sure = F.coalesce(F.floor(F.try_divide(F.col(votes), divisor) + 0.5), F.lit(0)).cast("long")
    df = shared(df.withColumn("_sure", F.when(F.col("_v") > 0, sure).otherwise(F.lit(0))))
    df = _joined(df, shared(df.groupBy(*group).agg(F.sum("_sure").alias("_given"))), group)
    df = df.withColumn("_left", F.when(F.col("_v") > 0, F.col("_h").cast("long") - F.col("_given")).otherwise(F.lit(0)))
    # No party gets more of what is left than its share of it and one seat on either side.
    most = F.ceil(F.try_divide(F.col(votes), F.col("_v")) * (F.col("_left") + F.col("_n"))) + 1
    most = F.when((F.col("_left") > 0) & (F.col(votes) > 0), F.least(F.col("_left"), most)).otherwise(F.lit(0)).cast("int")
    quotients = df.where(most > 0).select(*{*group, *key}, votes, "_left", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + most - 1)).alias("_k"))
    falling = F.struct(*group, (-F.col(votes) / (2 * F.col("_k") + 1)).alias("_q"), *[F.col(k).alias(f"_{k}") for k in key])
    ranked = ordered_rank(quotients, falling, "_place")
    ranked = _joined(ranked, shared(ranked.groupBy(*group).agg(F.min("_place").alias("_start"))), group)
    won = ranked.where(F.col("_place") - F.col("_start") < F.col("_left")).groupBy(*key).agg(F.count("*").alias("_won"))
    return df.join(won, key, "left").select(*names, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota"))


def _written_out(classes: DataFrame) -> DataFrame:
    """``classes`` with a row for each of ``copies``, numbered by ``copy``; many copies of one row are dealt to many tasks."""
    few = classes.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    lots = classes.where(F.col("copies") > COPIES)
    last = F.floor((F.col("copies") - 1) / COPIES)
    lots = lots.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("content", "_chunk")
    first = F.col("_chunk") * COPIES
    lots = lots.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1))).drop("_chunk")
    return few.unionByName(lots).drop("copies")


def _keyed(classes: DataFrame, seed: int) -> DataFrame:
    """A row for each row of ``classes`` (id, source, size, content, copies), with its ``key``.

    The key is a seeded hash of the id; where that is null or repeated, of content and copy number
    too, so that rows without ids of their own don't go to one shard.
    """
    again = shared(classes.where("id is not null").groupBy("id").agg(F.sum("copies").alias("_n")).where("_n > 1").select(F.col("id").alias("_again")))
    again = F.broadcast(again) if again.count() <= BROADCAST_GROUPS else again
    rows = _written_out(classes.join(again, F.col("id") == F.col("_again"), "left"))
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    more = F.concat_ws(":", own, "content", "size", "copy")
    return rows.withColumn("key", F.md5(F.when(F.col("id").isNull() | F.col("_again").isNotNull(), more).otherwise(own))).drop("_again", "content", "copy")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = 42,
) -> DataFrame:
    """``id, source, size, source_size, target, sid, shard, start, quota, n_blocks, taken`` for each row.

    The rows of a source are dealt to shards by a seeded hash of the id (of content and a number too
    where the id is null or repeated) and laid end to end within the shard in the order of that hash; the shard's words, cut every ``block`` words, are its
    blocks. Sources get whole numbers of blocks by Sainte-Laguë for their targets, then a source's
    shards for their sizes. A shard takes each block as often as its quota goes around, and once
    more the blocks that come first by a seeded hash. No quota passes twice the shard's blocks, so
    no word is taken more than twice.

    A shard is about ``shard`` words (one document may be longer), so no task holds a source; a hot
    source only has more shards. Null texts and texts without words have size 0 and take nothing;
    null sources are one source, the last; rows with null or repeated ids are spread over shards
    like others; equal rows are rows of their own, numbered, and one can't tell which got which number; an empty table gives an empty result. The same rows give the same result.
    """
    text = F.col(text_col).cast("string")
    rows = pack(docs, id=F.col(id_col), source=F.col(source_col).cast("string"), size=size_of(text), content=F.xxhash64(text))
    classes = shared(rows.groupBy("id", "source", "size", "content").agg(F.count("*").alias("copies")))
    sources = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights)
    total = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    seats = math.floor(total / block + 0.5)
    sources = apportion(sources.withColumn("_all", F.lit(0)), ["_all"], ["sid"], "target", F.lit(seats)).drop("_all")
    sources = shared(sources.withColumnRenamed("quota", "source_quota"))

    rows = _keyed(classes, seed)
    dealt = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
    pieces = F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1))
    dealt = dealt.withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % pieces)
    along = Window.partitionBy("sid", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = shared(dealt.withColumn("start", F.coalesce(F.sum("size").over(along), F.lit(0))).drop("key"))

    cells = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_quota").alias("source_quota"))
    cells = apportion(cells, ["sid"], ["sid", "shard"], "cell_size", F.col("source_quota"))
    cells = cells.withColumn("n_blocks", F.ceil(F.col("cell_size") / block)).withColumn("quota", F.least("quota", CAP * F.col("n_blocks")))
    cells = shared(cells.where("n_blocks > 0").select("sid", "shard", "n_blocks", "quota"))
    whole = F.floor(F.col("quota") / F.col("n_blocks"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "sid", "shard", "block"))
    # Cells are few and small before their blocks are written out: they are dealt by blocks first.
    n_blocks = cells.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    cells = cells.repartition(math.ceil((n_blocks + 1) / TASK), "sid", "shard")
    blocks = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    first = F.row_number().over(Window.partitionBy("sid", "shard").orderBy(draw, "block"))
    # Where quota is twice the blocks none is left over.
    more = blocks.withColumn("more", F.when(first <= F.col("quota") % F.col("n_blocks"), F.lit("1")).otherwise(F.lit("0")))
    flags = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "more"))), lambda x: x["more"]), "")
    chosen = more.groupBy("sid", "shard").agg(flags.alias("flags"))
    cells = cells.join(chosen, ["sid", "shard"]).withColumn("whole", whole)

    end, start = F.col("start") + F.col("size"), F.col("start")
    head, tail = F.floor(start / block), F.floor((end - 1) / block)
    flag = lambda at: F.substring(F.col("flags"), (at + 1).cast("int"), F.lit(1)) == "1"
    inner = F.substring(F.col("flags"), (head + 2).cast("int"), F.greatest(tail - head - 1, F.lit(0)).cast("int"))
    ones = F.length(inner) - F.length(F.replace(inner, F.lit("1"), F.lit("")))
    extra = (
        F.when(flag(head), F.least(end, (head + 1) * block) - start).otherwise(0)
        + F.when((tail > head) & flag(tail), end - tail * block).otherwise(0)
        + ones * block
    )
    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + extra).otherwise(0)
    out = dealt.join(cells, ["sid", "shard"], "left").withColumn("taken", taken.cast("long"))
    return out.select("id", "source", "size", "source_size", "target", "sid", "shard", "start", "quota", "n_blocks", "taken")
