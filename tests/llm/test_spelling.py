"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from boxloom.llm import spelling
from boxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def counted(docs):
    out = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def expected(words):
    """Near words share what is left when a letter is taken out, or replaced by a mark."""
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes["-", w[:i] + w[i + 1 :]].add(w)
            holes["?", w[:i], w[i + 1 :]].add(w)
        holes["-", w].add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= holes["?", w[:i], w[i + 1 :]]
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
        near[w].discard(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def rows(df):
    found = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in found}) == len(found)
    return {r["word"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_spelling_tables(spark, sf):
    words = counted(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    assert rows(QUERIES["op13_spelling_variants"](spark, sf)) == expected(words)


def test_spelling_odd_rows(spark, tmp_path):
    texts = [None, "", "1 2 3 ×÷", "color colour COLOUR colour color color", "Étude étude Étude " * 3, "aaaaa aaaaaa aaaaaaa " * 4, "x" * 30_000 + " " + "x" * 29_999, "naïve naïve " * 3, "söme some中thing " * 3]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "colour theatre theater")] * 4 + [(6, texts[6])] * 3
    spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, n int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(QUERIES["op13_spelling_variants"](spark, str(tmp_path)))
    assert got == expected(counted(docs))
    assert got["color"][0] == "colour" and got["aaaaa"][3] >= 1


def family(rng, n):
    """Words of one frame: many share their rare grams, and chains of forms occur."""
    out = {}
    for _ in range(n):
        w = list("mississippi" if rng.random() < 0.5 else "banananas")
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0 and len(w) > 5:
                del w[i]
            elif kind == 1:
                w.insert(i, rng.choice("abims"))
            else:
                w[i] = rng.choice("abimsé")
        out["".join(w)] = 3 * 2 ** rng.randrange(8)
    return out


def test_spelling_families_and_blocks(spark, monkeypatch):
    words = family(random.Random(2), 900)
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    want = expected(words)
    assert rows(spelling.variants(given)) == want
    # Lists in small blocks: whole lists and pairs of blocks give the same pairs.
    parts = spelling.cells(spelling.postings(given, spelling.frequencies(given)))
    whole = parts.count()
    monkeypatch.setattr(spelling, "CELL", 256)
    cut = spelling.cells(spelling.postings(given, spelling.frequencies(given)))
    assert cut.where("j > 0").count() and cut.count() > whole
    assert rows(spelling.variants(given)) == want


def test_chosen_postings_meet():
    """Any two words of one edit have a posting in common."""
    rng = random.Random(8)
    counts = [rng.randrange(50) for _ in range(1 << spelling.TABLE)]
    for _ in range(5000):
        a = "".join(rng.choices("ab" if rng.random() < 0.5 else "abcdefgh", k=rng.randrange(5, 14)))
        i = rng.randrange(len(a))
        b = a[:i] + rng.choice("abz") + a[i + rng.randrange(2) :]
        if a == b:
            continue

        def keys(w, n):
            return {(g, at + d) for space, q, short in spelling.spaces(w) if space == n for g, at in spelling.chosen(w, q, space, counts) for d in range(1 + short)}

        n = max(len(a), len(b))
        assert keys(a, n) & keys(b, n), (a, b)


def test_spelling_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_spelling_variants"](spark, str(tmp_path)).count() == 0
    assert spelling.tally(spark.createDataFrame([(1, "One one")], "doc_id int, text string")).collect()[0]["n"] == 2
