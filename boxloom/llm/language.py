"""Language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import pack, shared

#: Buckets that byte trigrams are hashed to.
BUCKETS = 1 << 14
#: Trigrams whose evidence counts in full: those of a text depend on each other, so a longer one
#: counts as if it had so many of its mean evidence.
TRUST = 100.0
#: Pseudo-observations: of the parent's shares in a host's, of uniform ones in the corpus's, of
#: each confusion in a declaration's, and of each bucket in a language's.
HOST_PRIOR, TOP_PRIOR, CONFUSION, BUCKET_PRIOR = 20.0, 1.0, 1.0, 0.1
LANGUAGE = r"^[a-z]{2,3}$"
#: Declared codes that are tried as languages, those with the most declarations: bounds the tables, not the rows.
MOST_CODES = 1000
#: Halves of the rows: a row's text is judged by what the other half declares.
FOLDS = 2


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text with white space, digits and symbols as one space."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.empty(0, np.int64)
    code = (data[:-2] * np.uint32(65599) + data[1:-1]) * np.uint32(65599) + data[2:]
    return ((code * np.uint32(2654435769)) >> np.uint32(18)).astype(np.int64)


_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def evidence(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    url: Column | None = None,
    host: Column | None = None,
) -> DataFrame:
    """``id, text, declared, suffix, host, parent`` of each row; what is not given or not usable is null.

    ``declared`` is cut to its primary subtag. The suffix is the last label of the url's host, and
    a host's parent the rest after its first label.
    """
    null = F.lit(None).cast("string")
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)) if url is not None else null
    name = F.when(name != "", name)
    given = F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]{2,3})(?:[-_]|$)", 1)) if declared is not None else null
    place = F.coalesce(host.cast("string"), name) if host is not None else name
    rest = F.regexp_replace(place, r"^[^.]*\.", "")
    return pack(
        docs,
        id=F.col(id_col).cast("long"),
        text=F.col(text_col).cast("string"),
        declared=F.when(given != "", given),
        suffix=F.substring_index(name, ".", -1),
        host=place,
        parent=F.when(rest != place, rest),
    )


def html_language(html: Column) -> Column:
    """Language that a page's html tag declares."""
    return F.regexp_extract(html, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""", 1)


def html_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")


def agreeing(counts: np.ndarray) -> list[int]:
    """Places of the codes whose declarations agree, among ``counts`` by half, code and bucket, codes by falling number of rows.

    A code is a language if each half has text of it and its tables, each from the other half, explain
    that text better in all than the tables of any language with more rows. A made-up code on few texts of a
    common language does not pass; a rare language does, whatever its share of the corpus.
    """
    table = counts + np.float32(BUCKET_PRIOR)
    logs = np.log(table / table.sum(axis=2, keepdims=True))
    fit = sum(counts[f] @ logs[1 - f].T for f in range(FOLDS))
    told = (counts.sum(axis=2) > 0).all(axis=0)
    found: list[int] = []
    for i in np.flatnonzero(told).tolist():
        if not found or fit[i, i] > fit[i, found].max():
            found.append(i)
    return found


def train(rows: DataFrame, least_share: float = 0.0) -> tuple[list[str], np.ndarray]:
    """Languages that rows declare, and for each fold each one's log shares of the trigram buckets in all rows of other folds.

    Declarations are the labels. Tasks add up counts and send a row a language, fold and bucket;
    bucket -1 counts rows. Codes are languages if their halves agree (``agreeing``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()))
            for lang, fold, text in zip(*columns, strict=True):
                got = np.bincount(trigrams(text.as_py() or b"") + 1, minlength=BUCKETS + 1)
                got[0] = 1
                key = lang, fold
                counts[key] = counts[key] + got if key in counts else got
        for (lang, fold), n in counts.items():
            full = np.flatnonzero(n)
            k = len(full)
            columns = [pa.array([lang] * k, pa.string()), pa.array([fold] * k, pa.int32()), pa.array(full - 1, pa.int32()), pa.array(n[full], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "fold", "bucket", "n"])

    counted = rows.where(F.col("declared").rlike(LANGUAGE)).select("declared", "fold", "text").mapInArrow(run, "lang string, fold int, bucket int, n long")
    # A declaration has two or three letters, so these have a bounded number of rows.
    counted = shared(counted.groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n")))
    seen = {r["lang"]: r["n"] for r in counted.where("bucket = -1").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    enough = [(-n, x) for x, n in seen.items() if n >= least_share * sum(seen.values())]
    codes = [x for _, x in sorted(enough)[:MOST_CODES]]
    counts = np.zeros((FOLDS, len(codes), BUCKETS), np.float32)
    found = counted.where(F.col("bucket") >= 0).where(F.col("lang").isin(codes) if codes else F.lit(False))
    for r in found.groupBy("lang", "fold").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect():
        counts[r["fold"], codes.index(r["lang"]), r["b"]] = r["n"]
    at = sorted(agreeing(counts), key=lambda i: codes[i])
    # With two halves, the other rows of a half are the other half.
    table = counts[::-1, at] + np.float32(BUCKET_PRIOR)
    return [codes[i] for i in at], np.log(table / table.sum(axis=2, keepdims=True))


def text_likelihoods(rows: DataFrame, langs: list[str], logs: np.ndarray, trust: float = TRUST) -> DataFrame:
    """``rows`` without their text and fold, with ``ll`` (tempered log likelihood by language) and ``n_grams``."""
    tables = logs.transpose(0, 2, 1).copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lls, sizes = [], []
            for text, fold in zip(batch.column("text").cast(pa.large_binary()), batch.column("fold").to_pylist(), strict=True):
                grams, table = trigrams(text.as_py() or b""), tables[fold]
                n = len(grams)
                counts = np.bincount(grams, minlength=BUCKETS) if n > BUCKETS else None
                ll = counts @ table.astype(np.float64) if counts is not None else table[grams].sum(axis=0, dtype=np.float64) if n else np.zeros(len(langs))
                lls.append((ll * min(1.0, trust / n) if n else ll).tolist())
                sizes.append(n)
            own = batch.drop_columns(["text", "fold"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lls, pa.list_(pa.float64())), pa.array(sizes, pa.int64())], [*own.schema.names, "ll", "n_grams"])

    return rows.mapInArrow(run, "id long, declared string, suffix string, host string, parent string, ll array<double>, n_grams long")


def identify(rows: DataFrame, threshold: float = 0.5, least_share: float = 0.0) -> DataFrame:
    """``id, language, posterior, text_language, declared, host, n_grams, kept`` for each row of ``evidence``.

    Text likelihoods come from trigram shares of the declared languages: codes whose texts in one half
    of the rows are explained by those in the other (``agreeing``), if ``least_share`` of all
    declarations name them, of any share by default; no row's text is judged by its own declaration, but by those of the
    other half of the rows (dealt by a hash of id and text). Then three tables are
    added up over all rows, by the language that text alone makes likeliest: how often it stands
    with each declaration, with each address suffix, and with each host, whose shares are smoothed
    towards its parent's, and those towards the whole corpus's. The posterior multiplies host
    prior, text likelihood, declaration and suffix likelihood; a source of evidence that a row
    lacks is left out. Counts are one row a key and language, added up before they are dealt, so a
    host with any share of the rows is one small row.

    ``kept`` is false for rows without a letter (language null, posterior 0), and those whose best
    language has a posterior below ``threshold``. Ties go to the first language by name. Null ids
    and repeated rows stay; without any declaration nothing can be learned and no row is kept.
    """
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("id", "text"), F.lit(FOLDS)).cast("int"))
    langs, logs = train(rows, least_share)
    if not langs:
        return rows.select("id", "declared", "host").selectExpr(
            "id", "cast(null as string) language", "cast(0 as double) posterior", "cast(null as string) text_language", "declared", "host", "cast(0 as bigint) n_grams", "false kept"
        )
    k = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    scored = shared(text_likelihoods(rows, langs, logs).withColumn("best", F.when(F.col("n_grams") > 0, best(F.col("ll")))))
    seen = scored.where("best is not null")

    def tally(*keys: str) -> DataFrame:
        """For each key: ``c``, its rows of each language, added up by key and language first."""
        each = seen.where(F.col(keys[0]).isNotNull()).groupBy(*keys, "best").agg(F.count("*").alias("n"))
        held = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"))
        return held.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("c"))

    def by_language(rows: DataFrame) -> list[int]:
        found = {r["best"]: r["n"] for r in rows.groupBy("best").agg(F.count("*").alias("n")).collect()}
        return [found.get(i + 1, 0) for i in range(k)]

    def shares(counts: DataFrame, key: str, parent: Column, weight: float) -> DataFrame:
        """For each key: its smoothed share of each language; ``parent`` gives the shares smoothed towards."""
        total = F.aggregate("c", F.lit(0).cast("long"), lambda x, y: x + y)
        mixed = F.zip_with("c", parent, lambda n, p: n + p * weight)
        return counts.withColumn("total", total).select(key, F.transform(mixed, lambda x: x / (F.col("total") + weight)).alias(f"{key}_share"))

    tops = by_language(seen)
    top = F.array(*[F.lit((n + TOP_PRIOR) / (sum(tops) + TOP_PRIOR * k)) for n in tops])
    parents = shares(tally("parent"), "parent", top, HOST_PRIOR)
    hosts = shares(tally("host", "parent").join(parents, "parent", "left"), "host", F.coalesce("parent_share", top), HOST_PRIOR)

    def likelihoods(key: str) -> DataFrame:
        """For each value: its log share among the rows of each language."""
        values = shared(tally(key))
        n, size = values.count(), by_language(seen.where(F.col(key).isNotNull()))
        below = F.array(*[F.lit(float(x + CONFUSION * max(1, n))) for x in size])
        return values.select(key, F.zip_with("c", below, lambda c, d: F.log((c + CONFUSION) / d)).alias(f"{key}_log"))

    out = scored.join(hosts, "host", "left").join(likelihoods("declared"), "declared", "left").join(likelihoods("suffix"), "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    joint = F.transform(F.coalesce("host_share", top), lambda x: F.log(x))
    for part in ("ll", F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero)):
        joint = F.zip_with(joint, part, lambda x, y: x + y)
    out = out.withColumn("joint", joint).withColumn("at", best(F.col("joint")))
    weight = F.aggregate(F.transform("joint", lambda x: F.exp(x - F.array_max("joint"))), F.lit(0.0), lambda x, y: x + y)
    text = F.col("n_grams") > 0
    out = out.withColumn("posterior", F.when(text, 1 / weight).otherwise(0.0))
    return out.select(
        "id",
        F.when(text, F.element_at(names, F.col("at"))).alias("language"),
        "posterior",
        F.when(text, F.element_at(names, F.col("best"))).alias("text_language"),
        "declared",
        "host",
        "n_grams",
        (F.col("posterior") >= threshold).alias("kept"),
    )
