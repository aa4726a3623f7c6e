"""Document fingerprints: weighted term hashes vote on signed bits, permuted block tables find near ones. Built-in functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import GAP, ordered_rank, pack, shared
from boxloom.llm.graph import components

#: A fingerprint has so many longs of 64 bits.
LANES = 2
BITS = 64 * LANES
#: What a word votes with, and a word with the one before it: pairs tell texts of one language apart.
WORD, PAIR = 1, 4
#: Blocks a fingerprint is cut into, and the radius in bits that links two.
BLOCKS, RADIUS = 4, 2
#: Fingerprints of a table entry above which pairs are not written out.
CROWD = 16
#: Words read at once, and words whose weight 15 bits can count: one adds WORD + PAIR at most.
STEP = 4
SPAN = 6_000
#: The low bits of four counters of 16 bits in a long, and two of them, 32 apart.
FOUR, TWO = 0x0001000100010001, 0x0000FFFF0000FFFF
#: White space around words.
BLANKS = " \t\n\x0b\x0c\r"
#: A text itself, and edited with the row next to the last of its like or with its like.
OWN, LAST, LIKE = range(3)
FP = [f"fp{lane}" for lane in range(LANES)]


def words(text: Column) -> Column:
    """Words between white space, in lower case; null if there is none."""
    inner = F.btrim(F.lower(text), F.lit(BLANKS))
    return F.when(inner != "", F.split(inner, GAP))


def voted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fp0, fp1`` of ``rows(keys, words)``: each term's weight counts for the bits its hash has.

    A bit is set if over half the weight is for it, so a text without words has none. A word or pair
    counts each time it occurs. ``STEP`` words are read at once. ``SPAN`` words are added up in counters of
    16 bits, four of which share a long, and those of a text in counters of 32, which hold for 400
    million words. Both sums are taken in the task that reads the text.
    """
    # An outer explode keeps rows without words.
    starts = F.explode_outer(F.when(F.col("words").isNotNull(), F.sequence(F.lit(0), F.size("words") - 1, F.lit(STEP))))
    each = rows.select(*keys, "words", starts.alias("p"))
    chunk = F.floor(F.coalesce("p", F.lit(0)) / SPAN).cast("int").alias("chunk")
    each = each.select(*keys, chunk, *[F.get("words", F.col("p") + (k - 1)).alias(f"w{k}") for k in range(STEP + 1)])
    each = each.select(*keys, "chunk", *[F.when(F.col(f"w{k}").isNotNull(), F.xxhash64(f"w{k}")).alias(f"a{k}") for k in range(STEP + 1)])
    n = reduce(lambda x, y: x + y, [F.col(f"a{k}").isNotNull().cast("long") * WORD + (F.col(f"a{k - 1}").isNotNull() & F.col(f"a{k}").isNotNull()).cast("long") * PAIR for k in range(1, STEP + 1)])
    none = F.lit(0).cast("long")
    terms = []
    for lane in range(LANES):
        for k in range(1, STEP + 1):
            one, two = F.col(f"a{k - 1}"), F.col(f"a{k}")
            terms.append(F.coalesce(F.when(two.isNotNull(), F.xxhash64(F.lit(lane), two)), none).alias(f"x{lane}_{k}"))
            terms.append(F.coalesce(F.when(one.isNotNull() & two.isNotNull(), F.xxhash64(F.lit(lane), one, two)), none).alias(f"y{lane}_{k}"))
    each = each.select(*keys, "chunk", n.alias("n"), *terms)
    bit = lambda c, i: F.shiftrightunsigned(c, i).bitwiseAND(F.lit(FOUR))

    def step(lane: int, i: int) -> Column:
        # One sum is one method of the generated code, small enough to be compiled.
        of = lambda kind: reduce(lambda x, y: x + y, [bit(f"{kind}{lane}_{k}", i) for k in range(1, STEP + 1)])
        return F.sum(of("x") * WORD + of("y") * PAIR).alias(f"c{lane}_{i}")

    part = each.groupBy(*keys, "chunk").agg(F.sum("n").alias("n"), *[step(lane, i) for lane in range(LANES) for i in range(16)])
    wide = lambda lane, i: [F.sum(F.shiftrightunsigned(f"c{lane}_{i}", 16 * h).bitwiseAND(F.lit(TWO))).alias(f"d{lane}_{i + 16 * h}") for h in range(2)]
    counts = part.groupBy(*keys).agg(F.sum("n").alias("n"), *[c for lane in range(LANES) for i in range(16) for c in wide(lane, i)])

    def lane_bits(lane: int) -> Column:
        out = []
        for i in range(32):
            both = F.col(f"d{lane}_{i}")
            for count, at in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), i), (F.shiftrightunsigned(both, 32), i + 32)):
                # The sign bit is set if twice the count is more than the weight.
                out.append(F.shiftleft(F.shiftrightunsigned(F.col("n") - count * 2, 63), at))
        return reduce(lambda x, y: x.bitwiseOR(y), out).alias(FP[lane])

    return counts.select(*keys, *[lane_bits(lane) for lane in range(LANES)])


def distance(a: list[Column], b: list[Column]) -> Column:
    """How many bits of two fingerprints differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """The share of bits that agree."""
    return 1 - distance(a, b) / BITS


def hexed(fp: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in fp])


def _block(at: int) -> Column:
    """Bits of block ``at``; blocks do not cross lanes."""
    per = BLOCKS // LANES
    width = 64 // per
    mask = F.lit((1 << width) - 1 if width < 64 else -1)
    return F.shiftrightunsigned(FP[at // per], width * (at % per)).bitwiseAND(mask)


def tables(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``table, key, fp0, fp1``: each fingerprint under each choice of blocks that a near one must have equal.

    Two within ``radius`` bits differ in at most that many blocks, so all blocks of one of the
    choices of the others are equal: a table is the fingerprints permuted so that these come first.
    """
    if radius >= BLOCKS:
        raise ValueError("a radius needs more blocks than it has bits")
    keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(*map(_block, chosen)).alias("key")) for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius))]
    return fps.select(*FP, F.explode(F.array(*keys)).alias("e")).select("e.table", "e.key", *FP)


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """``u, v``: nodes of ``fps(node, fp0, fp1)`` such that whatever is within ``radius`` is connected, and nothing else.

    Entries of up to ``crowd`` fingerprints give their near pairs. Members of larger ones would give
    the square of a group; as two within an even radius have a point half-way, each is put
    under all points of its ball of half the radius, and those that share a point are linked to one of them.
    """
    if radius % 2:
        raise ValueError("radius must be even, so that a point half-way proves it")
    rows = tables(fps, radius)
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = shared(rows.join(fps, FP).join(sizes, ["table", "key"]))
    few = rows.where(F.col("n") <= crowd).groupBy("table", "key").agg(F.collect_list(F.struct("node", *FP)).alias("x"))
    pairs = few.select(F.explode("x").alias("u"), "x").select("u", F.explode("x").alias("v")).where("u.node < v.node")
    side = lambda x: [F.col(f"{x}.{c}") for c in FP]
    pairs = pairs.where(distance(side("u"), side("v")) <= radius).select(F.col("u.node").alias("u"), F.col("v.node").alias("v")).distinct()
    full = rows.where(F.col("n") > crowd).select("node", *FP).distinct()
    flips = [c for r in range(radius // 2 + 1) for c in combinations(range(BITS), r)]
    masks = [[sum(1 << b % 64 for b in c if b // 64 == lane) for lane in range(LANES)] for c in flips]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    points = F.array(*[F.struct(*[signed(m).alias(FP[lane]) for lane, m in enumerate(mask)]) for mask in masks])
    spread = full.select("node", *FP, F.explode(points).alias("m")).select("node", *[F.col(c).bitwiseXOR(F.col(f"m.{c}")).alias(c) for c in FP])
    hubs = spread.groupBy(*FP).agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = spread.join(hubs, FP).where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    return pairs.unionByName(stars)


def near_classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp0, fp1, class_id`` for each fingerprint of ``fps(id, fp0, fp1)``: the least id linked by near fingerprints.

    Equal fingerprints are one node, added up where they lie. Null ids name a class only where nothing else does.
    """
    nodes = shared(fps.groupBy(*FP).agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    labels = components(links(nodes.select("node", *FP), radius)).withColumnRenamed("node", "at")
    named = nodes.join(labels, F.col("node") == F.col("at"), "left").select(*FP, "least", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("class_id"))
    return named.join(least, "label").select(*FP, "class_id")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, id, text``: the key is that of the id and the text together."""
    rows = pack(docs, id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # Null ids hash apart from all numbers.
    return rows.select(F.xxhash64("id", F.col("id").isNull(), "text").alias("k1"), F.xxhash64("text", F.lit("key"), "id").alias("k2"), "id", "text")


def spliced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each text with its end replaced by the next one's start: the last half of the characters, rounded
    down, gives way to as many first ones, or all, of the row next by falling id (the first's after the
    last; null ids last, one id's texts by hash).

    Gives ``k1, k2, id, n_chars, m, n1, n2``, the key of a row, how many rows are equal to it in id and
    text and so share it, and the key of the row next to the last of them; and ``k1, k2, text, last, like``: the text, the
    edited text of the last, and that of the others, whose next row is like them, null if there are none.

    Order is found on keys and lengths alone. Texts are dealt by their key once, for both of their parts;
    only starts go on to the rows before them.
    """
    rows = keyed(docs, id_col, text_col)
    slim = rows.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first(F.char_length("text").cast("long")).alias("n_chars"), F.count("*").alias("m"))
    ranked = ordered_rank(slim, F.struct(F.col("id").isNull(), F.bitwise_not("id"), "k1", "k2"), "place")
    ranked = shared(ranked)
    after = ranked.select(F.pmod(F.col("place") - 1, F.lit(max(1, ranked.count()))).alias("place"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    ranked = shared(ranked.join(after, "place").drop("place"))
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = ranked.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), half.alias("half"))
    heads = texts.join(wanted, ["k1", "k2"]).select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.substring("text", F.lit(1), F.col("half")).alias("head"))
    own = texts.join(ranked.select("k1", "k2", "m", half.alias("half")), ["k1", "k2"]).join(heads, ["k1", "k2"])
    start = F.substring("text", F.lit(1), F.char_length("text") - F.col("half"))
    like = F.when(F.col("m") > 1, F.concat(start, F.substring("text", F.lit(1), F.col("half"))))
    return ranked, own.select("k1", "k2", "text", F.concat(start, "head").alias("last"), like.alias("like"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fp0, fp1, edited0, edited1, near_edited, near_next, class_id`` for each row of ``docs``.

    Each whole text and its edited text (see ``spliced``) get a fingerprint; ``near_edited`` and
    ``near_next`` are the shares of bits that the text's has in common with that of its edited text
    and with that of the next row, ``class_id`` the least id of those linked to it by fingerprints within ``RADIUS`` bits.

    Null texts are empty; a text without a word has fingerprint 0 and is linked like any other; rows
    equal in id and text each get a row; an empty table gives an empty result; other columns are ignored.
    """
    ranked, rows = spliced(docs, id_col, text_col)
    text = lambda way, sha, t: F.struct(F.lit(way).alias("way"), sha.alias("sha"), t.alias("t"))
    sha = lambda t: F.sha2(F.col(t).cast("binary"), 256)
    ways = [text(OWN, F.lit(""), F.col("text")), text(LAST, sha("last"), F.col("last"))]
    like = text(LIKE, sha("like"), F.col("like"))
    both = rows.select("k1", "k2", F.explode(F.when(F.col("like").isNotNull(), F.array(*ways, like)).otherwise(F.array(*ways))).alias("x"))
    found = shared(voted(both.select("k1", "k2", "x.way", "x.sha", words(F.col("x.t")).alias("words")), ["k1", "k2", "way", "sha"]))
    own = ranked.join(found.where(F.col("way") == OWN).drop("way", "sha"), ["k1", "k2"])
    classes = near_classes(own.select("id", *FP))
    own = shared(own.join(classes, FP))
    edited = found.where(F.col("way") != OWN).select("k1", "k2", "way", F.col("sha").alias("edited_sha256"), *[F.col(c).alias(f"edited{i}") for i, c in enumerate(FP)])
    after = own.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), *[F.col(c).alias(f"next{i}") for i, c in enumerate(FP)])
    fp = lambda name: [F.col(f"{name}{i}") for i in range(LANES)]
    out = own.join(after, ["n1", "n2"]).withColumn("near_next", likeness(fp("fp"), fp("next"))).join(edited, ["k1", "k2"])
    alike = F.col("way") == LIKE
    out = out.withColumns({"near_edited": likeness(fp("fp"), fp("edited")), "near_next": F.when(alike, 1.0).otherwise(F.col("near_next"))})
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.when(alike, F.col("m") - 1).otherwise(1)))
    return out.withColumn("copy", each).select("id", "n_chars", "edited_sha256", *FP, *[f"edited{i}" for i in range(LANES)], "near_edited", "near_next", "class_id")
