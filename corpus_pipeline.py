"""From raw documents to a training mix: language, line and near-duplicate cleaning, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import decontam, language, lines, mixing, simhash
from boxloom.llm.common import shared, table

#: Ids sent to every executor at most (8 bytes each); beyond that the join is shuffled.
BROADCAST_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, a hash of id and text: rows that share only an id are judged apart."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))


def _without(docs: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """``docs`` but those whose ``on`` is in ``ids(id)``; rows without one stay."""
    ids = shared(ids.where("id is not null").distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(few, docs[on] == ids.id, "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language likelier than not, go.

    Declared language and source are the evidence beside the text. Rows that share id and text
    share a verdict; rows without an id are judged like others. An empty table stays empty.
    """
    rows = _keyed(docs)
    found = language.identify(language.evidence(rows, "row_key", declared=F.col("lang"), host=F.col("source")))
    return _without(rows, found.where("not kept").select("id"), "row_key")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and alike lines go but the first; documents of which nothing else is left go too."""
    rows = lines.dedup_lines(docs, carry=("lang", "source", "n_chars")).where("kept")
    n = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("carried.n_chars"))
    return rows.select(F.col("id").alias("doc_id"), "text", "carried.lang", "carried.source", n.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with linked fingerprints the one with the least id stays.

    Of rows that share an id one stays; rows without an id can't be told apart and stay.
    """
    found = shared(simhash.near_duplicates(docs))
    kept = _without(docs, found.where("id <> component").select("id"))
    again = shared(found.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, kept.doc_id == again.id, "left_semi").dropDuplicates(["doc_id"])
    return _without(kept, again).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark windows go, rows without an id too."""
    rows = _keyed(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), "row_key")
    return _without(rows, found.where(decontam.contaminated()).select("id"), "row_key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with ``size``, ``source_size``, ``target`` and ``taken``.

    Rows that share only an id have takes of their own; rows equal in id and text get the larger of theirs.
    """
    rows = _keyed(docs)
    found = mixing.mix(rows, id_col="row_key").where("taken > 0").groupBy("id", "size").agg(*[F.max(c).alias(c) for c in ("source_size", "target", "taken")])
    same = (rows.row_key == found.id) & (mixing.size_of(rows.text) == found.size)
    return rows.join(found, same).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL has no XXH64, MinHash or trained model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else shared(docs), sf_dir)
    return docs
