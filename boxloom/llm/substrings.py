"""Exact substring deduplication: windows of threshold bytes that start more than once, grouped by hashes.

This is not a radix sort by leading bytes: suffixes are dealt by the least hash of the strings in
their window, then by hashes of the whole window, and no order among them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.llm.common import pack, release, shared

THRESHOLD = 200
#: Bytes of the first digit.
GRAM = 120
#: Bytes of a text handled at once; a longer one is cut into pieces whose windows overlap.
PIECE = 1 << 20
#: Rows that a task gathers before it looks for repeats among them, and how many of them may share
#: a first digit.
CHUNK, HOT = 1 << 18, 64

_WORD = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=_WORD)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _WORD)
    out[0] = 1
    return np.multiply.accumulate(out)


class Passes:
    """What the suffixes of a text that are threshold bytes deep are dealt by first: a hash, called their first digit."""

    def __init__(self, threshold: int, gram: int) -> None:
        self.threshold, self.gram, self.width = threshold, gram, threshold - gram + 1
        n = PIECE + threshold + 1
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of suffixes with one first digit: first suffix, number of suffixes, and the digit.

        The first digit of a suffix is the least hash among the ``gram``-byte strings in its first
        threshold bytes, so equal windows have equal digits. Neighbouring suffixes mostly have
        theirs at one place and go on as one row.
        """
        n = len(data)
        sums = np.zeros(n + 1, _WORD)
        np.cumsum(_BYTES[data] * self.up[:n], out=sums[1:])
        m = n - self.gram + 1
        x = (sums[self.gram :] - sums[:m]) * self.down[:m]
        x ^= x >> _WORD(32)
        x *= _WORD(0xD6E8FEB86659FD93)
        x ^= x >> _WORD(29)
        # The place in the low bits: of equal hashes in a window, the first counts.
        keyed = (x & _WORD(0xFFFFFFFFFFC00000)) | np.arange(m, dtype=_WORD)
        w = self.width
        padded = np.full(-(-m // w) * w, _WORD(0xFFFFFFFFFFFFFFFF))
        padded[:m] = keyed
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - self.threshold + 1
        place = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & _WORD(0x3FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        return first, np.diff(np.append(first, count)), x[place[first]].view(np.int64)


def _pieces(text: bytes, threshold: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(len(text) - threshold + 1, 0), PIECE):
        yield at, text[at : at + PIECE + threshold - 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the number of each row's group in it."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    return order, np.cumsum(new)


def _resolve(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Settle repeats among the rows (a, b, r1, r2, at, n, weight) that one task has gathered.

    Rows of equal (a, b) that weigh two or more together are repeats: one stands for them from
    here on, with weight 2, and the others go on as settled rows of random first key, each by
    itself. So no key, however frequent, has more than a row for each chunk of each task.
    """
    a, b, r1, r2, at, n, weight = rows
    order, group = _groups(b, a)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    total = np.add.reduceat(weight[order], starts)
    size = np.diff(np.append(starts, len(order)))
    stands = order[starts]
    weight = weight.copy()
    weight[stands] = np.minimum(total, 2)
    rest = order[np.flatnonzero((np.arange(len(order)) != starts[group]) & (size[group] > 1))]
    a, b = a.copy(), b.copy()
    weight[rest] = 2
    mixed = (r2[rest].view(_WORD) + at[rest].astype(_WORD) * _WORD(_BASE)) * _WORD(0xD6E8FEB86659FD93)
    a[rest], b[rest] = mixed.view(np.int64), 0
    return [a, b, r1, r2, at, n, weight]


def _split(rows: list[np.ndarray], hot: int) -> list[np.ndarray]:
    """Part rows of a first digit that more than ``hot`` of them share; adds a column that marks them.

    Such a row goes on under a digit that its content is mixed into, so rows of equal content still
    meet and no task gets the others. One marker with no suffixes stays under the old digit: it
    tells what other chunks left there that there are other contents.
    """
    a, b, r1, r2, at, n, weight = rows
    order, group = _groups(a)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(starts, len(order)))
    crowd = order[size[group] > hot]
    old = a[order[starts[size > hot]]]
    a, mark = a.copy(), np.zeros(len(a), np.int64)
    mixed = (a[crowd].view(_WORD) * _WORD(_BASE) + b[crowd].view(_WORD)) * _WORD(0xD6E8FEB86659FD93)
    a[crowd], mark[crowd] = (mixed ^ (mixed >> _WORD(29))).view(np.int64), 1
    none = np.zeros(len(old), np.int64)
    return [np.concatenate(x) for x in ((a, old), (b, none), (r1, none), (r2, none), (at, none), (n, none), (weight, none), (mark, none + 1))]


SUFFIXES = "a long, b long, r1 long, r2 long, at long, n long, weight long"
NAMES = ["a", "b", "r1", "r2", "at", "n", "weight"]


class _Gathered:
    def __init__(self, hot: int | None = None) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size, self.hot = 0, hot

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(list(columns))
        self.size += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            rows, names = _resolve([np.concatenate(c) for c in zip(*self.parts, strict=True)]), NAMES
            if self.hot is not None:
                rows, names = _split(rows, self.hot), [*NAMES, "hot"]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in rows], names)
        self.parts, self.size = [], 0


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, r1, r2``: the two hashes name a row by its id and text, null ids as well."""
    rows = pack(docs, id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.withColumns({"r1": F.xxhash64("text"), "r2": F.xxhash64(F.lit("row"), "id", "text")})


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with the text compressed for the shuffle, as ``z``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data = [squeeze(t.as_py()) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("r1"), batch.column("r2"), pa.array(data, pa.binary())], ["id", "r1", "r2", "z"])

    return rows.mapInArrow(run, "id long, r1 long, r2 long, z binary")


def first_pass(rows: DataFrame, threshold: int, gram: int, hot: int = HOT) -> DataFrame:
    """Runs of suffixes by first digit ``a``, with the run's content hash ``b``; ``hot`` marks those parted by ``_split``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        passes, found, digest = Passes(threshold, gram), _Gathered(hot), xxhash.xxh3_64_intdigest
        for batch in batches:
            columns = (batch.column("r1").to_pylist(), batch.column("r2").to_pylist(), batch.column("text").cast(pa.large_binary()))
            for r1, r2, t in zip(*columns, strict=True):
                for at, piece in _pieces(t.as_py(), threshold):
                    first, n, digit = passes.runs(np.frombuffer(piece, np.uint8))
                    ends = first + n + (threshold - 1)
                    content = np.array([digest(piece[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)], _WORD).view(np.int64)
                    k = len(first)
                    found.add(digit, content, np.full(k, r1), np.full(k, r2), first + at, n, np.ones(k, np.int64))
                    if found.size >= CHUNK:
                        yield from found.flush()
        yield from found.flush()

    return rows.select("r1", "r2", "text").mapInArrow(run, SUFFIXES + ", hot long")


def last_pass(opened: DataFrame, threshold: int) -> DataFrame:
    """Suffixes of opened runs by all their threshold bytes: ``a`` and ``b`` are a 128-bit hash of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        found, digest, expand = _Gathered(), xxhash.xxh3_128_digest, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for r1, r2, z, runs in zip(*(batch.column(c) for c in ("r1", "r2", "z", "runs")), strict=True):
                text = expand(z.as_py())
                for r in runs.as_py():
                    at, n = r["at"], r["n"]
                    pair = np.frombuffer(b"".join([digest(text[p : p + threshold]) for p in range(at, at + n)]), np.int64).reshape(n, 2)
                    own = np.full(n, 1)
                    found.add(pair[:, 0].copy(), pair[:, 1].copy(), own * r1.as_py(), own * r2.as_py(), np.arange(at, at + n), own, own * min(r["weight"], 2))
                    if found.size >= CHUNK:
                        yield from found.flush()
        yield from found.flush()

    return opened.select("r1", "r2", "z", "runs").mapInArrow(run, SUFFIXES)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``r1, r2, runs`` of each row with a window that starts elsewhere too; a run is (first start, number of starts).

    Suffixes are grouped only by their first ``threshold`` bytes and leave as soon as they are settled.
    The first pass deals runs of neighbouring suffixes by first digit, the least hash of the
    strings in their window; a digit that occurs once leaves. In the second, runs of equal content
    are repeats as a whole. Only where a digit has different contents are one run of each content
    opened and its suffixes grouped by a hash of all their bytes, 128 bits long; groups of several are
    repeated windows. A digit that more than ``hot`` rows of a chunk share surely has different
    contents, so its rows part before they are dealt.
    """
    rows = _row_keys(docs, id_col, text_col)
    by, same = Window.partitionBy("a"), Window.partitionBy("a", "b")
    runs = first_pass(rows, threshold, gram, hot)
    runs = runs.withColumns({"low": F.min("b").over(by), "high": F.max("b").over(by), "hot": F.max("hot").over(by)})
    runs = runs.withColumns({"total": F.sum("weight").over(same), "nth": F.row_number().over(same.orderBy("r1", "r2", "at"))})
    kept = runs.withColumn("opened", F.expr("(low <> high or hot = 1) and nth = 1")).where("n > 0 and (total > 1 or opened)")
    kept = shared(kept.selectExpr("r1", "r2", "at", "n", "total as weight", "opened"))
    # From here on the checkpoint holds what is left of the first pass, and its shuffle can go.
    del runs
    release(docs.sparkSession)
    opened = kept.where("opened").groupBy("r1", "r2").agg(F.collect_list(F.struct("at", "n", "weight")).alias("runs"))
    windows = last_pass(_packed(rows).join(opened, ["r1", "r2"]), threshold)
    windows = windows.withColumn("total", F.sum("weight").over(same)).where("total > 1").select("r1", "r2", "at", "n")
    found = kept.where("weight > 1").select("r1", "r2", "at", "n").unionByName(windows)
    found = shared(found.groupBy("r1", "r2").agg(F.collect_list(F.struct("at", "n")).alias("runs")))
    del opened, windows
    release(docs.sparkSession)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept`` for each row: removed byte runs and the bytes that stay.

    A byte goes if some ``threshold``-byte string over it also starts anywhere else in the table,
    in the same text or another, overlapping or not; strings never cross texts and are judged on
    the input. Whole texts count, however long. Null texts are empty; texts shorter than
    ``threshold`` keep everything; of repeated rows each is the other's repeat; null ids are fine;
    an empty table gives an empty result; other columns are ignored. ``kept`` is binary, as cuts
    may split a character.
    """
    found = repeated(docs, id_col, text_col, threshold, gram, hot)
    rows = _packed(_row_keys(docs, id_col, text_col)).join(found, ["r1", "r2"], "left").select("id", "z", "runs")
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()]
    names = ["id", "n_bytes", "n_removed", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for z, runs in zip(batch.column("z"), batch.column("runs"), strict=True):
                text = expand(z.as_py())
                spans: list[list[int]] = []
                for at, end in sorted((r["at"], r["at"] + r["n"] - 1 + threshold) for r in runs.as_py() or ()):
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([at, end])
                bounds = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(bounds[::2], bounds[1::2], strict=True))
                values = len(text), len(text) - len(kept), [{"first": i, "last": j - 1} for i, j in spans], kept
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary")
