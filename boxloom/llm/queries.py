"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import compression, conversations, decontam, fingerprints, language, licenses, lines, mixing, privacy, quality, simhash, spelling, substrings
from boxloom.llm.common import table
from boxloom.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What SQL can't express is tested against brute force.
ORACLE_SQL: dict[str, str] = ORACLES


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(quality.measure(table(spark, sf_dir, "documents")))
    rows = quality.apply_policy(quality.apply_policy(rows, "v2"), "base", "base_kept")
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"),
        "kept",
        "failed",
    )


@_query
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the policy how many documents fail it, fail it alone, and would be kept without it, from the ledger's bits."""
    return quality.ablations(quality.ledger(quality.measure(table(spark, sf_dir, "documents"))), "v2")


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["exact"]), lambda m: m["item"])))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


@_query
def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of words behind the verdicts, exact and near."""
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=6)
    return rows.select(F.col("id").alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.item", "m.first", "m.last", "m.exact")


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language.identify(language.evidence(docs, declared=F.col("lang"), host=F.col("source")))
    return rows.select(F.col("id").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", "kept")


@_query
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all its evidence is at hand: markup, address suffix and host hierarchy."""
    pages = table(spark, sf_dir, "pages").withColumn("text", language.html_text(F.col("html")))
    rows = language.evidence(pages, "page_id", declared=language.html_language(F.col("html")), url=F.col("url"))
    return language.identify(rows).select(F.col("id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", "host", "kept")


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_judged", "n_removed", "kept", "text")


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression.fit(docs, table(spark, sf_dir, "labels"))
    return compression.classify(docs, model).withColumnRenamed("id", "doc_id")


@_query
def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = privacy.sanitise(table(spark, sf_dir, "documents")).select("id", "spans")
    base = F.filter("spans", lambda x: x["kind"].isin(*privacy.KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in privacy.KINDS],
        F.sha2(privacy.listed(base), 256).alias("base_sha256"),
        privacy.listed(F.col("spans")).alias("spans"),
    )


@_query
def privacy_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with personal data and disclosing terms generalised or removed."""
    rows = privacy.sanitise(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), privacy.redacted(F.col("text"), F.col("spans")).alias("text"), F.size("spans").cast("long").alias("n_spans"))


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.summarise(conversations.damage(rows)).withColumnRenamed("conv_id", "found")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found")) & F.col("cost").isNotNull(), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


@_query
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edit_likeness(table(spark, sf_dir, "documents"))
    edited = [F.col(f"edited{i}") for i in range(fingerprints.LANES)]
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprints.hexed([F.col(c) for c in fingerprints.FP]).alias("fingerprint"),
        fingerprints.hexed(edited).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "class_id",
    )


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.tally(table(spark, sf_dir, "documents"), change=spelling.misspelt)
    return spelling.variants(spelling.vocabulary(words))
