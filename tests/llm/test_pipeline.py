"""Each stage of the pipeline against brute force on what the stage before kept."""

import corpus_pipeline as P
import duckdb
import pytest
from pyspark.sql import functions as F
from test_first import fingerprint, roots, water
from test_lines import brute
from test_more import brute_hits, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(P.shared(stage(spark, steps[-1], SF)))
    assert all(d.columns[:5] == docs.columns for d in steps) and [d.columns == docs.columns for d in steps[:-1]]
    raw, lang, line, near, clean, mixed = [{r["doc_id"]: r for r in d.collect()} for d in steps]
    assert len(raw) >= len(lang) >= 0.97 * len(raw) and all(lang[i] == raw[i] for i in lang)

    ids = sorted(lang)
    want = dict(zip(ids, brute([(i, lang[i]["text"]) for i in ids]), strict=True))
    assert sum(line[i]["text"] != want[i] if i in line else want[i] != "" for i in ids) <= 0.02 * len(ids)
    assert all(r["n_chars"] == len(r["text"]) for r in line.values())

    ids = sorted(line)
    fps = [fingerprint(line[i]["text"]) for i in ids]
    groups = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert set(near) == {ids[g] for g in groups}

    items = [(str(i), words(t)) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    for i, r in near.items():
        ws = words(r["text"])
        hit, _ = brute_hits(ws, items)
        assert (i in clean) == (not hit or 20 * len(hit) < len(ws))

    sizes = {}
    for r in clean.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    want, taken = water(sizes), {}
    for i, r in mixed.items():
        assert 0 < r["taken"] <= 2 * r["size"] == 2 * len(clean[i]["text"].split())
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken.get(s, 0) - want[s]) <= 70 + 0.02 * want[s] for s in sizes)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, "same id here", "en", "s", 1), (None, "no id " * 30, "en", None, 2), (2, "", "de", "s", 0), (3, "a b c " * 50, "en", "t", 3), (3, "a b c " * 50, "en", "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit("clash")).withColumn("size", F.lit(0))
    want = {
        "language": [(1, "same id here"), (3, "a b c " * 50), (3, "a b c " * 50), (None, "no id " * 30)],
        "lines": [(1, "same id here"), (3, "a b c " * 50), (3, "a b c " * 50), (None, "no id " * 30)],
        "near duplicates": [(1, "same id here"), (3, "a b c " * 50), (None, "no id " * 30)],
        "decontamination": [(1, "same id here"), (3, "a b c " * 50), (None, "no id " * 30)],
    }
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in P.STAGES:
            now = P.shared(stage(spark, now, SF))
            got = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str)
            if name in want:
                assert got == (want[name] if start is docs else [])
        assert {r["doc_id"] for r in now.collect()} <= {1, 3, None}


def test_shared_ids(spark):
    """A text that goes doesn't take another with its id along."""
    item = duckdb.sql(f"select text from '{SF}/benchmark.parquet' limit 1").fetchall()[0][0]
    rows = [(1, item, "en", "s", 1), (1, "quite another text of its own", "en", "s", 1), (None, item, "en", "s", 1), (2, "12 34", "en", "s", 1), (2, "this has letters", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = P.decontaminate(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in clean) == [(1, rows[1][1]), (2, "12 34"), (2, "this has letters")]
    lang = P.identify_language(spark, docs, SF).collect()
    assert (2, "this has letters") in {(r["doc_id"], r["text"]) for r in lang} and len(lang) == 4


def test_mix_of_shared_ids(spark):
    """Takes of rows that share an id add up to the mix, and reruns agree."""
    rows = [(i % 40 if i % 3 else None, f"word{i} " * (40 + i % 7), "en", f"s{i % 3}", 9) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.mix_sources(spark, docs, SF).collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 0.01 * total
    assert len({r["text"] for r in got}) == len(got) and all(r["size"] == len(r["text"].split()) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, P.mix_sources(spark, docs.repartition(3), SF).collect()))


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is P.run
