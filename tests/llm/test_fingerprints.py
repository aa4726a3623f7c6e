"""Document fingerprints against brute force."""

import hashlib
import itertools
import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from boxloom.llm import fingerprints
from boxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def spark_long_hash(x, seed):
    return xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed)


def spark_int_hash(x, seed):
    return xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)


def simhash(text):
    """128 bits of the weighted votes of words and pairs, lanes hashed from the words' own XXH64."""
    words = [w for w in "".join(" " if c in fingerprints.BLANKS else c for c in (text or "").lower()).split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    total, votes = 0, [[0] * 64 for _ in range(2)]
    for before, h in zip([None, *hashes], hashes):
        for lane in range(2):
            seed = spark_int_hash(lane, 42)
            terms = [(spark_long_hash(h, seed), fingerprints.WORD)]
            if before is not None:
                terms.append((spark_long_hash(h, spark_long_hash(before, seed)), fingerprints.PAIR))
            for x, weight in terms:
                total += weight if lane == 0 else 0
                for bit in range(64):
                    votes[lane][bit] += weight * (x >> bit & 1)
    return [sum(1 << b for b in range(64) if 2 * v[b] > total) for v in votes]


def expected(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, b, c = simhash(text), simhash(edited), simhash(after)
        like = lambda x, y: 1 - sum((p ^ q).bit_count() for p, q in zip(x, y)) / 128
        out.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), "%016x%016x" % tuple(a), "%016x%016x" % tuple(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)


def classes(pairs):
    """``id -> least id`` linked by fingerprints within two bits, of ``(id, fingerprint)``."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            up[top(a)] = top(b)
    least = {}
    for key, f in pairs:
        least[top(f)] = min(least.get(top(f), key), key)
    return {key: least[top(f)] for key, f in pairs}


def test_fingerprints_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = QUERIES["op12_document_fingerprints"](spark, SF)
    assert rows(found) == expected(docs)
    pairs = [(r["doc_id"], int(r["fingerprint"], 16)) for r in found.collect()]
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == classes(pairs)


def test_fingerprints_tell_edits(spark):
    """Half of a text is told from another text at sf0.01, and copies have one fingerprint."""
    got = QUERIES["op12_document_fingerprints"](spark, "/root/testdata/sf0.01").toPandas()
    long = got[got.n_chars > 300]
    assert (long.near_edited > long.near_next).mean() > 0.97
    assert len(got) == 1000 and got.near_edited.between(0, 1).all()


ODD = [None, "", " \n\t", "a", "a b", "A  B", "été 中文 \U0001f600 x", "one two three four five six seven", "w " * 20_000 + "end", "x" * 50_000, "a b c", "abc", "abcd"]


def test_fingerprints_odd_rows(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, "same same")] * 4 + [(None, "no id")] * 2 + [(-5, "negative id here")]
    spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, k1 int, way string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["op12_document_fingerprints"](spark, str(tmp_path))) == expected(docs)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(7, "only one text")], [(7, "twice"), (7, "twice")]])
def test_fingerprints_few_rows(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["op12_document_fingerprints"](spark, str(tmp_path))) == expected(docs)


@pytest.mark.parametrize("crowd", [2, 16, 1000])
def test_permuted_tables(spark, crowd):
    """Near classes equal those of all pairs, whether entries are small or crowded."""
    rng = random.Random(crowd)
    fps = {rng.getrandbits(128) for _ in range(200)}
    for f in list(fps)[:40]:
        for _ in range(12):
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(128)
            fps.add(f)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, signed(f >> 64), signed(f & MASK)) for i, f in pairs], "id long, fp0 long, fp1 long")
    nodes = df.select(F.col("id").alias("node"), "fp0", "fp1")
    linked = fingerprints.links(nodes, crowd=crowd)
    assert linked.join(nodes, linked.u == nodes.node).count() == linked.count()
    got = fingerprints.near_classes(df).join(df, ["fp0", "fp1"]).select("id", "class_id").collect()
    assert {r["id"]: r["class_id"] for r in got} == classes(pairs)


def test_long_text_counts(spark):
    """Counters of all widths hold: a text of many more words than a span has the bits of its only word and pair."""
    text = "word " * (3 * fingerprints.SPAN + 5)
    rows = spark.createDataFrame([(1, text)], "id long, text string").select("id", fingerprints.words(F.col("text")).alias("words"))
    r = fingerprints.voted(rows, ["id"]).first()
    assert [r["fp0"] & MASK, r["fp1"] & MASK] == simhash(text)
