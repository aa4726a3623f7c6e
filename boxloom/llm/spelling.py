"""Spelling variants: a positional q-gram inverted index whose postings are merged under a count filter, then verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import pack, shared

#: A run of letters A-Z, a-z, U+00C0 to U+00FF in UTF-8 whose A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words that a task holds while it adds up.
HELD = 1 << 17
#: Words have so many letters and occurrences at least.
LENGTH, SEEN = 5, 3
#: One occurrence in so many is misspelt by the query.
MISSPELT = 97
#: A form has so many times the occurrences of its variant at least.
RATIO = 2
#: Letters of a gram at most: longer ones have shorter postings, but one edit breaks more of them.
LONGEST = 4
#: Bits of the hash by which grams are counted, rows of a batch, and letters of a cell.
TABLE, ROWS, CELL = 16, 1 << 14, 1 << 16
#: Rows broadcast at most.
BROADCAST_ROWS = 100_000


def gram_length(space: int) -> int:
    """Letters of a gram for words of up to ``space`` letters: two of one edit still have one in common."""
    return min(LONGEST, space // 2)


def misspelt(prefix: int, run: bytes) -> bytes:
    """A run, without one letter for one in ``MISSPELT`` crc32 values of what ``prefix`` is the crc32 of and the run."""
    h = zlib.crc32(run, prefix)
    if h % MISSPELT:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def tally(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int, bytes], bytes] | None = None) -> DataFrame:
    """``word, n``: runs of letters in the whole texts, A-Z lower-cased, added up as far as a task can hold them.

    ``change`` makes the word of a run, given the crc32 of its document's id and a colon. Null texts
    have no runs; a null id is an empty one. A word can have several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.binary()).cast(pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])
            totals.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                runs = Counter(RUN.findall((text.as_py() or b"").translate(LOWER)))
                if change is not None:
                    prefix = zlib.crc32(f"{'' if key.as_py() is None else key.as_py()}:".encode())
                    for word, n in runs.items():
                        totals[change(prefix, word)] += n
                else:
                    totals.update(runs)
                if len(totals) > HELD:
                    yield flushed()
        if totals:
            yield flushed()

    return pack(docs, id=F.col(id_col).cast("string"), text=F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "word string, n long")


def vocabulary(words: DataFrame, length: int = LENGTH, seen: int = SEEN) -> DataFrame:
    """``word, n`` of the words of ``tally`` that are long and frequent enough."""
    return words.where(F.char_length("word") >= length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def spaces(word: str) -> list[tuple[int, int, bool]]:
    """``space, q, short`` of a word: words of one edit differ by at most one in length, so there is a space
    for each length. It holds the words of that length and the ``short`` ones, by one, in grams of
    the length that the longer ones allow."""
    return [(n, gram_length(n), n > len(word)) for n in (len(word), len(word) + 1)]


def _key(space: int, gram: str, at: int = 0) -> int:
    return xxhash.xxh64_intdigest(f"{space} {at} {gram}") - (1 << 63)


def frequencies(words: DataFrame) -> list[int]:
    """How often a space's grams fall in each of ``2 ** TABLE`` buckets by hash, over all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << TABLE, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for space, q, _ in spaces(word):
                    for i in range(len(word) - q + 1):
                        counts[_key(space, word[i : i + q]) & ((1 << TABLE) - 1)] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    found = words.select("word").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * (1 << TABLE)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def chosen(word: str, q: int, space: int, counts: list[int]) -> list[tuple[str, int]]:
    """``gram, at`` of the rarest grams of a word, until two of them do not overlap: one edit can't break both.

    All places of the last one's letters are taken, and all grams if any two overlap.
    """
    grams = [word[i : i + q] for i in range(len(word) - q + 1)]
    keys = [_key(space, g) for g in grams]
    order = sorted((counts[k & ((1 << TABLE) - 1)], k, g, i) for i, (k, g) in enumerate(zip(keys, grams, strict=True)))
    low = high = order[0][3]
    for n, (_, _, gram, at) in enumerate(order):
        low, high = min(low, at), max(high, at)
        if high - low >= q:
            return [(g, i) for _, _, g, i in order[:n]] + [(g, i) for _, _, g, i in order[n:] if g == gram]
    return [(g, i) for _, _, g, i in order]


def postings(words: DataFrame, counts: list[int]) -> DataFrame:
    """``space, key, short, word, n`` of the postings of ``words(word, n)`` that need to be merged.

    The key is that of the gram, its place and the space. Two words of one edit have a gram in
    common, behind the edit at the same place from the end; in the order of rarity, one that both
    choose (``chosen``): whichever's choice ends first has one that the edit left, and the other has it too.
    A short word's gram may be one place further in a longer one, so it is posted at both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for space, q, short in spaces(word):
                    keys = {_key(space, g, i + d) for g, i in chosen(word, q, space, counts) for d in range(1 + short)}
                    rows += [(space, k, short, word, n) for k in keys]
            for at in range(0, len(rows), ROWS):
                part = list(zip(*rows[at : at + ROWS], strict=True))
                types = [pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, types, strict=True)], ["space", "key", "short", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "space int, key long, short boolean, word string, n long")


def cells(posts: DataFrame) -> DataFrame:
    """``posts`` with ``i, j, side``: a posting list of many letters is cut in blocks, and each two of them meet in a cell."""
    sizes = posts.groupBy("space", "key").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") * F.col("space") / CELL).cast("int")
    large = shared(sizes.select("space", "key", blocks.alias("blocks")).where("blocks > 1"))
    few = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    rows = posts.join(few, ["space", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("space", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "short", "word", "n")


def matrix(words: list[str]) -> np.ndarray:
    """Letters as numbers, a row a word, 0 after its end; one byte each if that is enough."""
    out = np.array(words).view(np.uint32).reshape(len(words), -1)
    return out.astype(np.uint8) if out.max() < 256 else out


def letter_sets(letters: np.ndarray) -> np.ndarray:
    """The letters of each row as bits, by their number modulo 64."""
    bits = np.where(letters > 0, np.uint64(1) << (letters.astype(np.uint64) & np.uint64(63)), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def merge(words: list[str], short: np.ndarray, cell: np.ndarray, side: np.ndarray, cross: np.ndarray, space: int) -> np.ndarray:
    """Pairs of places in ``words``, which are sorted by ``cell``, that have one edit between them.

    The cells' lists are merged in step: the word at each place meets the one so many places on, all
    at once. Of those that may be near by length, the grams in common are counted, in place from the front,
    and for unlike lengths from the back; pairs under the bound of one edit go. The others are
    verified: what they share at the front and at the back must make up all but one letter of the longer.
    """
    front, back = matrix(words), matrix([w[::-1] for w in words])
    q, have = gram_length(space), letter_sets(front)
    need, out = space - 2 * q + 1, []
    at = np.arange(len(words))
    for step in range(1, len(words)):
        at = at[at + step < len(words)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        may = at[np.bitwise_count(have[at] ^ have[at + step]) <= 2]
        may = may[~(short[may] & short[may + step]) & (~cross[may] | (side[may] != side[may + step]))]
        for k in range(0, len(may), ROWS):
            a, b = may[k : k + ROWS], may[k : k + ROWS] + step
            ahead, behind = front[a] == front[b], back[a] == back[b]
            unlike = short[a] != short[b]
            common = _runs(ahead & (front[a] > 0), q) + np.where(unlike, _runs(behind & (back[a] > 0), q), 0)
            on = common >= need
            a, b, ahead, behind = a[on], b[on], ahead[on], behind[on]
            # The first place that differs; words differ somewhere, if only in their ends.
            shared_letters = ahead.argmin(axis=1) + behind.argmin(axis=1)
            same = ahead.all(axis=1)
            on = (shared_letters >= space - 1) & ~same
            out.append(np.stack([a[on], b[on]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _runs(equal: np.ndarray, q: int) -> np.ndarray:
    """How many places of each row begin ``q`` that are true."""
    n = equal.shape[1] - q + 1
    out = equal[:, :n].copy()
    for k in range(1, q):
        out &= equal[:, k : k + n]
    return out.sum(axis=1)


def near_pairs(words: DataFrame) -> DataFrame:
    """``wa, na, wb, nb``: pairs of ``words(word, n)`` that differ by one letter inserted, deleted or replaced, each once.

    A task merges whole cells, many at a time; a cell has at most about ``CELL`` letters.
    """

    def merged(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        for space, part in rows.groupby("space", sort=False):
            cell = (part[["key", "i", "j"]] != part[["key", "i", "j"]].shift()).any(axis=1).cumsum().to_numpy()
            found = merge(part["word"].tolist(), part["short"].to_numpy(bool), cell, part["side"].to_numpy(bool), (part["i"] != part["j"]).to_numpy(), int(space))
            word, n = part["word"].to_numpy(), part["n"].to_numpy()
            flip = word[found[:, 0]] > word[found[:, 1]]
            a, b = np.where(flip, found[:, 1], found[:, 0]), np.where(flip, found[:, 0], found[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(word[a], pa.string()), pa.array(n[a], pa.int64()), pa.array(word[b], pa.string()), pa.array(n[b], pa.int64())], ["wa", "na", "wb", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = pd.DataFrame(), 0
        for batch in batches:
            rows = batch.to_pandas()
            held = pd.concat([held, rows], ignore_index=True)
            letters += int(rows["space"].sum())
            if letters >= 4 * CELL:
                last = held[["space", "key", "i", "j"]].iloc[-1]
                ended = ~(held[["space", "key", "i", "j"]] == last).all(axis=1)
                yield from merged(held[ended])
                held = held[~ended]
                letters = int(held["space"].sum())
        if len(held):
            yield from merged(held)

    posts = postings(words, frequencies(words))
    rows = cells(posts).repartition("space", "key", "i", "j").sortWithinPartitions("space", "key", "i", "j")
    return rows.mapInArrow(run, "wa string, na long, wb string, nb long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form that ``forms(word, form)`` lead to, for each word that has one.

    A form is more frequent than its variant, so there is no way back. Each round doubles the
    steps that are taken, so rounds grow with the logarithm of the longest way.
    """
    now = shared(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        both = shared(now.join(on, F.col("root") == F.col("at"), "left").select("word", "root", "further"))
        if both.where("further is not null").isEmpty():
            return now
        now = both.select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of ``words(word, n)``.

    Words are near if they differ by one letter inserted, deleted or replaced; ``n_near`` counts them.
    A word's ``form`` is the most frequent near one (of several, the first by code points), if it is ``ratio``
    times as frequent at least; ``root`` is the last form of forms, the word itself if it has none.
    Words must differ and have ``LENGTH`` letters or more; null words are left out, and an empty table gives no rows.
    """
    words = shared(words.where(F.col("word").isNotNull() & (F.char_length("word") >= LENGTH)).select("word", F.col("n").cast("long").alias("n")))
    pairs = shared(near_pairs(words))
    ends = pairs.select(F.col("wa").alias("word"), "na", F.struct((-F.col("nb")).alias("m"), F.col("wb").alias("form")).alias("x"))
    ends = ends.unionByName(pairs.select(F.col("wb").alias("word"), F.col("nb").alias("na"), F.struct((-F.col("na")).alias("m"), F.col("wa").alias("form")).alias("x")))
    best = ends.groupBy("word").agg(F.min("x").alias("x"), F.count("*").alias("n_near"))
    rows = words.join(best, "word", "left")
    is_form = -F.col("x.m") >= ratio * F.col("n")
    rows = shared(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("x.form")).alias("form"), F.when(is_form, -F.col("x.m")).alias("form_n")))
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
