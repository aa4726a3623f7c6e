"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import few_at_once, pack, shared
from boxloom.llm.graph import components

#: Shingles hashed at once; bounds a worker's memory for a text of any length.
CHUNK = 1 << 16
SEED = 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of a text: words between white space, A-Z lower-cased, ``width``-word shingles.

    A text of fewer words is one shingle; none gives 0. A bit is set if over half the shingles'
    XXH64 values (seed 42) have it, repeats included.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        k = len(part) - width + 1
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[:k].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(k, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp`` for each row; ``fp`` holds the 64 bits as a signed BIGINT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = [fingerprint(t.as_py(), width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = pack(docs, id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """XOR masks of a Hamming ball of ``radius`` over the low ``bits`` bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = 2, segments: int = 2, bucket: int = 16) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp`` that join all within ``distance`` bits.

    Each fingerprint is cut into ``segments``. If two differ in k bits, k = segments * r + a, then
    one of the first a + 1 segments differs in at most r bits or a later one in at most r - 1
    (the pigeonhole bound of multi-index hashing). So each fingerprint enumerates those Hamming
    balls, fetches the table entries of equal segment value, and verifies complete distances.

    A table entry with more than ``bucket`` fingerprints would give all pairs of a group. It is
    kept as a marker instead; fingerprints that fetch a marker are linked exactly by midpoints:
    two within ``distance`` share a member of their 64-bit balls of half that radius, and two that
    share one are within it, so each ball member links its fetchers in a star. No link is lost.
    """
    if distance % 2:
        raise ValueError("distance must be even, so that a ball member between two fingerprints proves it")
    size = 64 // segments
    r, a = divmod(distance, segments)
    radii = [r if s <= a else r - 1 for s in range(segments)]

    def value(s: int) -> Column:
        width = size if s < segments - 1 else 64 - size * (segments - 1)
        return F.shiftrightunsigned("fp", size * s).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    def shifted(s: int) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(s).alias("s"), value(s).bitwiseXOR(m).alias("v"))

    entry = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), value(s).alias("v")) for s in range(segments) if radii[s] >= 0]))
    tables = fps.select("fp", entry.alias("e")).select("fp", "e.s", "e.v")
    full = tables.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > bucket).drop("n")
    entries = tables.join(full, ["s", "v"], "left_anti").unionByName(full.withColumn("fp", F.lit(None).cast("long")))
    probe = []
    for s, radius in enumerate(radii):
        if radius >= 0:
            width = size if s < segments - 1 else 64 - size * (segments - 1)
            masks = F.array(*[F.lit(_signed(m)).cast("long") for m in ball(width, radius)])
            probe.append(F.transform(masks, shifted(s)))
    probes = fps.select(F.col("fp").alias("q"), F.explode(F.concat(*probe)).alias("e")).select("q", "e.s", "e.v")
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= distance
    found = shared(
        probes.join(entries, ["s", "v"]).where(F.col("fp").isNull() | ((F.col("q") < F.col("fp")) & near)).select("q", "fp")
    )
    pairs = found.where(F.col("fp").isNotNull()).select(F.col("q").alias("u"), F.col("fp").alias("v"))
    crowd = found.where(F.col("fp").isNull()).select(F.col("q").alias("fp")).distinct()
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in ball(64, distance // 2)])
    spread = crowd.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    hubs = spread.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = spread.join(hubs, "key").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, bucket: int = 16
) -> DataFrame:
    """``id, fp, component`` for each row: ``component`` is the smallest id linked by near fingerprints.

    Whole texts are read once. Equal fingerprints are one node, so groups of copies of any size
    meet in a pre-aggregated row. Null and empty texts have fingerprint 0 and are linked like any
    other; a null id keeps its row and never names a component unless nothing else is in it;
    repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    with few_at_once(docs.sparkSession):
        rows = shared(fingerprints(docs, id_col, text_col, width))
    nodes = shared(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(links(nodes.select("fp"), distance, bucket=bucket))
    named = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(least, "label").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")
