"""Disclosing terms are found from lines alone, and marked alike whether their texts are sent to tasks or dealt."""

from boxloom.llm import privacy

TEXTS = [f"zebra one{i} anna@x.org\nplain words {i}" for i in range(6)] + ["a zebra\nno entity", "", "10.0.0.1 lone"]


def test_terms_need_no_spans_of_whole_texts(spark):
    docs = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    assert "zebra" in {r["term"] for r in privacy.disclosing_terms(docs, generalise=0.6).collect()}


def test_hits_sent_or_dealt(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    told = lambda: sorted((r["id"], r["l"]) for r in privacy.sanitise(docs, generalise=0.6).selectExpr("id", "cast(spans as string) l").collect())
    sent = told()
    monkeypatch.setattr(privacy, "BROADCAST_HITS", 0)
    assert told() == sent and any("term" in x for _, x in sent)
