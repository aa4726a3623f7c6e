"""Quality rules: measurements and failed rules of a text are kept in a ledger that policies read later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import GAP, pack

SYMBOLS = r"[#*$%&|<>]"

#: Rule -> (bit, failure). Bits are never given to another rule, so that old ledgers stay readable.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > 3 * n_words"),
    "repeated_lines": (3, "2 * n_dup_lines > n_lines"),
    "word_length": (4, "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    "exclamations": (5, "10 * n_marks > 3 * n_words"),
    "shouting": (6, "n_letters > 0 and 2 * n_capitals > n_letters"),
}
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _count(text: str, pattern: str) -> Column:
    """Characters of ``text`` in the one-character class ``pattern``."""
    return (F.size(F.split(F.col(text), pattern, -1)) - 1).cast("long")


def _pairs(array: str, size: Column, merge) -> Column:
    """``merge`` of each element of ``array`` and the next."""
    rest = F.greatest(size - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), rest), F.slice(array, F.lit(2), rest), merge)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the measurements of each text, all by built-in functions within one row.

    Repeated 3-word windows are found by sorting the text's windows and comparing neighbours, so
    the work grows as n log n with a text's length and no row leaves its task. A null text counts
    as an empty one: no words, no lines, every count 0. Rows are measured each by itself, so repeated
    rows, null and equal ids keep a row each; an empty table gives an empty result; other columns,
    whatever their names, are left out.
    """
    df = pack(docs, id=F.col(id_col), text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.select(
        "id",
        _count("text", SYMBOLS).alias("n_symbols"),
        _count("text", "!").alias("n_marks"),
        _count("text", r"\p{Lu}").alias("n_capitals"),
        _count("text", r"\p{Ll}").alias("n_small"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]")).alias("lines"),
        F.array_remove(F.split("text", GAP, -1), "").alias("w"),
    )
    n = F.size("w")
    df = df.select(
        "id",
        "n_symbols",
        "n_marks",
        "n_capitals",
        (F.col("n_capitals") + F.col("n_small")).alias("n_letters"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(
            n >= 3,
            F.sort_array(
                F.arrays_zip(
                    F.slice("w", F.lit(1), n - 2).alias("a"),
                    F.slice("w", F.lit(2), n - 2).alias("b"),
                    F.slice("w", F.lit(3), n - 2).alias("c"),
                    F.sequence(F.lit(0), n - 3).alias("i"),
                )
            ),
        ).alias("s"),
    )
    df = df.withColumnRenamed("s", "sorted_windows")
    same = _pairs(
        "sorted_windows",
        F.size("sorted_windows"),
        lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["i"], y["i"])),
    )
    kept = [c for c in df.columns if c != "sorted_windows"]
    df = df.select(*kept, F.filter(same, lambda x: x.isNotNull()).alias("twice"))
    df = df.select(*kept, F.when(F.size("twice") > 0, F.sort_array(F.array_distinct(F.flatten("twice")))).alias("at"))
    covered = F.aggregate(_pairs("at", F.size("at"), lambda x, y: F.least(F.lit(3), y - x)), F.lit(3), lambda x, y: x + y)
    return df.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(measured: DataFrame) -> DataFrame:
    """Add ``failed``: a bit for each rule that the measurements fail; every rule is evaluated once."""
    bits = [F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, fails in RULES.values()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed", total.cast("long"))


def apply_policy(kept_ledger: DataFrame, policy: str | tuple[str, ...] = "v2", to: str = "kept") -> DataFrame:
    """Add the verdict of a policy, from the ledger alone."""
    return kept_ledger.withColumn(to, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(kept_ledger: DataFrame, policy: str | tuple[str, ...] = "v2") -> DataFrame:
    """``rule, n_failed, n_only, n_kept_without`` for each rule of a policy.

    Documents are first counted by the ledger's bits under the policy, at most two to the power of
    the number of rules; each rule is then switched off in those counts. An empty ledger gives
    zeros.
    """
    whole = mask(policy)
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    counts = kept_ledger.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in rules]))
    names = kept_ledger.sparkSession.range(1).select(each.alias("r")).select("r.rule", "r.bit")
    off = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    add = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return (
        names.join(F.broadcast(counts), F.lit(True), "left")
        .groupBy("rule")
        .agg(
            add(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            add(F.col("bits") == F.col("bit")).alias("n_only"),
            add(off == 0).alias("n_kept_without"),
        )
    )
