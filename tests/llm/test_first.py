"""Quality rules, SimHash and mixing against brute force."""

import heapq
import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from boxloom.llm import graph, mixing, quality, simhash
from boxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c a b c\n\n\n", "x\nx\nx\n y", "é ü é ü é ü", "A a A a A a", "# * | < ok", "w " * 3000, "　 x y"]


def docs(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}),
    }


def texts_of(sf=SF):
    return duckdb.sql(f"select doc_id, text, source from '{sf}/documents.parquet' order by 1").fetchall()


def test_quality(spark):
    for given in (ODD, [r[1] for r in texts_of()]):
        got = {r["id"]: r for r in quality.ledger(quality.measure(docs(spark, given, w="clash", s=1, failed=2))).collect()}
        assert len(got) == len(given)
        for i, t in enumerate(given):
            want = measured(t)
            assert {k: got[i][k] for k in want} == want
            base = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
            assert bool(got[i]["failed"] & quality.mask("base")) == base


def test_quality_ablations(spark):
    led = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed long")
    got = {r["rule"]: tuple(r)[1:] for r in quality.ablations(led, "v1").collect()}
    assert got == {"few_words": (3, 2, 3), "repeated_windows": (1, 0, 1), "symbols": (1, 1, 2), "repeated_lines": (0, 0, 1)}
    assert {tuple(r)[1:] for r in quality.ablations(led.limit(0), "v1").collect()} == {(0, 0, 0)}


def fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_fingerprint():
    for t in [*ODD, *[r[1] for r in texts_of()[:60]]]:
        assert simhash.fingerprint(None if t is None else t.encode()) % (1 << 64) == fingerprint(t)


def test_simhash_query(spark):
    rows = texts_of()
    fps = [fingerprint(t) for _, t, _ in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r["doc_id"]: r for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, (d, *_) in enumerate(rows):
        assert got[d]["fingerprint"] == f"{fps[i]:016x}"
        assert got[d]["component_id"] == rows[want[i]][0]


@pytest.mark.parametrize("bucket", [0, 2, 1000])
def test_simhash_links(spark, bucket):
    rng = random.Random(bucket)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket)
    place = {f: i for i, f in enumerate(signed)}
    pairs = [(place[r["u"]], place[r["v"]]) for r in edges.collect()]
    assert roots(len(fps), pairs) == want


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(5, None), (None, ""), (3, "same text here ok"), (3, "same text here ok"), (None, "zzz")], "doc_id long, text string")
    got = sorted(((str(r["id"]), r["component"]) for r in simhash.near_duplicates(df.withColumn("fp", F.lit("x"))).collect()), key=str)
    assert got == [("3", 3), ("3", 3), ("5", 5), ("None", 5), ("None", None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    want = roots(300, edges)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: want[x] for e in edges for x in e if any(y != x for f in edges for y in f if x in f)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def water(sizes):
    order = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in sizes if s not in full)
        factor = (budget - sum(2 * sizes[s] for s in full)) / free if free else 0
        over = {s for s in sizes if s not in full and 2 * sizes[s] < factor * w[s]}
        if not over:
            return {s: float(2 * sizes[s]) if s in full else factor * w[s] for s in sizes}
        full |= over


def test_mixing(spark):
    rows = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    rows += [(10**6, None, "src0"), (10**6 + 1, "", None), (None, "a b c " * 50, None), (7, "w " * 2000, "tiny"), (7, "w " * 2000, "tiny"), (8, " ", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(0))
    got = mixing.mix(df, block=8, shard=2000).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = water(dict(sizes)), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 * (1 + sizes[s] / 2000) + 0.01 * want[s], s
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.005 * sum(sizes.values()) + 100
    again = mixing.mix(df.repartition(5), block=8, shard=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_without_own_ids(spark):
    """Null and repeated ids, and copies in any number, are spread over shards; each row is in the result."""
    rows = [(None, f"t{i} " * 20, "s") for i in range(1500)] + [(5, f"u{i} " * 20, "s") for i in range(900)] + [(None, "same words here " * 2, "s")] * 9000 + [(i, "x " * 20, "s") for i in range(10, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=8, shard=4000).collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    words = Counter()
    for r in got:
        words[r["shard"]] += r["size"]
    assert len(words) >= 20 and max(words.values()) <= 2 * 4000, words
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 0.005 * total + 100
    again = mixing.mix(df.repartition(3), block=8, shard=4000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_apportion(spark):
    rng = random.Random(3)
    groups = {g: ([rng.randint(0, 1000) for _ in range(rng.randint(1, 9))], rng.choice([0, 1, 3, 10, 57, 400])) for g in range(30)}
    rows = [(g, i, float(v), seats) for g, (votes, seats) in groups.items() for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, sid int, v double, seats int")
    got = {(r["g"], r["sid"]): r["quota"] for r in mixing.apportion(df, ["g"], ["g", "sid"], "v", F.col("seats")).collect()}
    for g, (votes, seats) in groups.items():
        held = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            held[max(range(len(votes)), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))] += 1
        assert [got[g, i] for i in range(len(votes))] == held, (g, votes, seats)


def test_apportion_many_parties(spark):
    """One group of thousands of parties, many of them equal."""
    votes = [random.Random(i // 3).randint(1, 500) for i in range(5000)]
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(votes)], "g int, sid int, v double")
    got = {r["sid"]: r["quota"] for r in mixing.apportion(df, ["g"], ["g", "sid"], "v", F.lit(7777)).collect()}
    heap = [(-v, i, 0) for i, v in enumerate(votes)]
    heapq.heapify(heap)
    held = [0] * len(votes)
    for _ in range(7777):
        _, i, k = heapq.heappop(heap)
        held[i] = k + 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    assert [got[i] for i in range(len(votes))] == held
