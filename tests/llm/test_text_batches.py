"""Whole texts go to Python workers in small batches."""

from boxloom.llm import common, decontam


def test_index_of_small_batches(spark, monkeypatch):
    at, was = [], spark.conf.get(common.ROWS_AT_ONCE)
    monkeypatch.setattr(decontam, "shared", lambda df: (at.append(int(spark.conf.get(common.ROWS_AT_ONCE))), common.shared(df))[1])
    text = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(i, None if i == 7 else f"É {text}" if i % 2 else "own words") for i in range(1500)], "doc_id long, text string").coalesce(1)
    got = {r["id"]: (r["n_words"], r["n_hit"]) for r in decontam.contamination(docs, spark.createDataFrame([("a", text)], "item_id string, text string")).collect()}
    assert got == {i: (0, 0) if i == 7 else (14, 13) if i % 2 else (2, 0) for i in range(1500)}
    assert at and max(at) <= common.ROWS and spark.conf.get(common.ROWS_AT_ONCE) == was
