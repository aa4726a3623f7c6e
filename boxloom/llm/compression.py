"""Quality classifier by compression: dictionaries of good and of bad text, and a calibrated size difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import pack

#: Labelled documents read for either class, and bytes of their whole texts at most.
SAMPLE, SAMPLE_BYTES = 2000, 8 << 20
#: Bytes compressed by themselves. Pieces cover the whole text; a long one would teach the
#: compressor its own words and make the dictionaries alike.
PIECE = 2048
#: Bytes of a trained dictionary, and of the pieces of texts that it is trained on.
DICTIONARY, TRAIN_PIECE = 256 << 10, 1024
LEVEL = 9


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Dictionaries of either class, and the line that turns a size difference into log odds."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30)))


def difference(text: bytes, good, bad) -> float:
    """How many bytes fewer a byte of the text takes with the good dictionary than with the bad one."""
    total = 0
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        total += len(bad.compress(piece)) - len(good.compress(piece))
    return total / max(1, len(text))


def compressors(model: Model):
    import zstandard

    def of(data: bytes):
        # Trained dictionaries name themselves; other content is taken as it is.
        known = zstandard.ZstdCompressionDict(data)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False)

    return of(model.good), of(model.bad)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of the labels on one number, by Newton's method."""
    scale = max(float(x.std()), 1e-9)
    z, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(x) + ridge * np.eye(2), z.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, sample_bytes: int) -> list[tuple[bytes, int]]:
    """Whole texts and labels to learn from: of either label those whose ids hash lowest, within both bounds.

    Texts are taken in that order; one with which a label's would pass ``sample_bytes`` is left out,
    and the next ones are tried. That is settled on lengths alone, of at most twice ``sample`` rows,
    before any text is brought to the driver. An id that is repeated counts once, with its least
    text; an id with both labels tells nothing and is left out.
    """
    marked = pack(labels, label_id=F.col(id_col).cast("long"), label=F.col(label_col).cast("int")).where("label in (0, 1) and label_id is not null")
    marked = marked.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    marked = marked.where("label = other").select("label_id", "label")
    order = F.xxhash64("label_id"), F.col("label_id")
    chosen = marked.where("label = 1").orderBy(*order).limit(sample).unionByName(marked.where("label = 0").orderBy(*order).limit(sample))
    texts = pack(docs, label_id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string")).where("text is not null")
    # At most 2 * sample rows of two numbers, so always small enough to send to every executor.
    rows = texts.join(F.broadcast(chosen), "label_id")
    sizes = rows.groupBy("label_id", "label").agg(F.octet_length(F.min("text")).alias("size")).orderBy(*order).collect()
    taken, total = [], [0, 0]
    for r in sizes:
        if total[r["label"]] + r["size"] <= sample_bytes:
            total[r["label"]] += r["size"]
            taken.append((r["label_id"],))
    fits = docs.sparkSession.createDataFrame(taken, "fits long")
    found = rows.join(F.broadcast(fits), F.col("label_id") == F.col("fits")).groupBy("label_id", "label").agg(F.min("text").alias("text")).orderBy(*order)
    return [(r["text"].encode(), r["label"]) for r in found.collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from labelled documents that are not held out.

    At most ``sample`` documents of either label and ``sample_bytes`` of their text are read, so
    the model's cost does not grow with the corpus. Dictionaries are trained on all of that; the
    line from size difference to log odds is fitted on differences by dictionaries that have not
    seen the text: each half is compressed with those of the other half. Labels keep their shares.
    """
    rows = sampled(docs, labels, id_col, text_col, label_col, sample, sample_bytes)
    half = [rows[0::2], rows[1::2]]
    of = lambda part, y: dictionary([t for t, q in part if q == y])
    x, marks = [], []
    for k in (0, 1):
        good, bad = compressors(Model(of(half[1 - k], 1), of(half[1 - k], 0)))
        x += [difference(t, good, bad) for t, _ in half[k]]
        marks += [q for _, q in half[k]]
    line = calibrate(np.array(x), np.array(marks, float)) if len(set(marks)) == 2 else (0.0, 0.0)
    return Model(of(rows, 1), of(rows, 0), *line)


def dictionary(texts: list[bytes], size: int = DICTIONARY, piece: int = TRAIN_PIECE) -> bytes:
    """A zstandard dictionary trained on whole texts, in pieces; too little text to train on is the dictionary itself."""
    import zstandard

    pieces = [t[at : at + piece] for t in texts for at in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces) or b" "


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for each row, from its whole text alone.

    Null texts count as empty; an empty text scores what no evidence gives. Without labels of both
    kinds every score is 0.5. A null id is never held out; repeated rows stay; an empty table
    gives an empty result.
    """
    rows = pack(docs, id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = compressors(model)
        for batch in batches:
            x = np.array([difference(t.as_py() or b"", good, bad) for t in batch.column(1).cast(pa.large_binary())], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    scored = rows.mapInArrow(run, "id long, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
