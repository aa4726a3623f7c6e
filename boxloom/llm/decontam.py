"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import few_at_once, pack, shared

#: Upper case to lower case, and everything that no word has to spaces; UTF-8 bytes above 127 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words of an index segment: what one search task holds at once, but for a longer document.
SEGMENT = 1 << 20
#: Characters of test texts searched for at once; more are searched for in blocks of this size.
BLOCK = 1 << 23
#: Bits of the filter of test words, a power of two; words a task remembers; windows looked for at once.
FILTER, MEMORY, WINDOWS = 1 << 25, 1 << 20, 1 << 16

INDEX = "segment long, term long, n long, positions binary, ids array<long>, keys array<long>, words array<long>"
FOUND = "id long, key long, n_words long, n_hit long, n_near long, matches array<struct<item:string,first:long,last:long,exact:boolean>>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, letters and any character above 127."""
    return text.translate(FOLD).split()


def _squeeze(positions: np.ndarray) -> bytes:
    """Gaps between rising positions in the fewest bytes that hold them all, after a byte that says how many."""
    gaps = np.diff(positions, prepend=0)
    size = 1 if (top := int(gaps.max())) < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + gaps.astype(f"<u{size}").tobytes()


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.int64)


def term_of(word: bytes) -> int:
    """A word's number in the index: 63 bits of its hash, so that no vocabulary is sent around."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


def mark(words: set[bytes], bits: np.ndarray) -> None:
    """Set the bits of test words in the filter (a byte for eight bits)."""
    at = np.array([term_of(w) & (len(bits) * 8 - 1) for w in words], np.int64)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


class Tests:
    """A block of test items: their words as places in a sorted vocabulary, and where windows start."""

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        self.width = width
        found = [(item, np.array([term_of(w) for w in ws], np.int64)) for item, text in items if (ws := words_of(text))]
        self.names = sorted({item for item, _ in found})
        place = {name: i for i, name in enumerate(self.names)}
        # The last item's windows are read to the full width too.
        terms = np.concatenate([t for _, t in found] + [np.zeros(width, np.int64)])
        self.vocabulary = np.unique(terms)
        self.tokens = np.searchsorted(self.vocabulary, terms).astype(np.int32)
        length = np.array([len(t) for _, t in found], np.int64)
        windows = np.maximum(length - width + 1, 1)
        self.starts, which = _expand(np.cumsum(length) - length, windows)
        self.size = np.minimum(length[which], width)
        self.item = np.array([place[item] for item, _ in found], np.int32)[which]
        self.counts = np.zeros(len(self.vocabulary), np.int64)

    def count(self, counts: dict[int, int]) -> None:
        """Take each word's number of postings in the whole index."""
        self.counts = np.array([counts.get(t, 0) for t in self.vocabulary.tolist()], np.int64)

    def rarest_first(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows a part at a time: number of the first, terms (-1 past the end) and their places from the rarest on, sizes."""
        n = np.append(self.counts, np.iinfo(np.int64).max)
        for at in range(0, len(self.starts), WINDOWS):
            size = self.size[at : at + WINDOWS]
            places = np.arange(self.width)
            terms = np.where(places < size[:, None], self.tokens[self.starts[at : at + WINDOWS, None] + places], -1).astype(np.int64)
            order = np.argsort(n[terms], axis=1, kind="stable")
            yield at, np.take_along_axis(terms, order, 1), order, size


def build_index(docs: DataFrame, bits: np.ndarray, gap: int, segment: int = SEGMENT) -> DataFrame:
    """Store the token postings of ``docs(id, text)`` for words that pass the filter ``bits``.

    All test words pass, however many there are, and a few others that are never asked for. The index is divided by documents. A segment has a row for each term with its positions in the
    segment's words, and a row (term -1) with the ids, text hashes and lengths of its documents in
    order; ``gap`` positions lie between documents, so that no phrase crosses them.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        terms: list[np.ndarray] = []
        places: list[np.ndarray] = []
        at = 0

        class Seen(dict):
            """Words met, with their terms, or -1 for those that the filter holds back."""

            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMORY:
                    self.clear()
                term = term_of(word)
                bit = term & (len(bits) * 8 - 1)
                self[word] = term if bits[bit >> 3] >> (bit & 7) & 1 else -1
                return self[word]

        seen = Seen()

        def flush() -> pa.RecordBatch:
            term, place = np.concatenate(terms), np.concatenate(places)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            data = [_squeeze(p) for p in np.split(place, starts[1:])] if len(term) else []
            sizes = np.diff(np.append(starts, len(term))) if len(term) else []
            k = len(data)
            ids, keys, words = zip(*held, strict=True)
            columns = [
                [number] * (k + 1),
                [-1, *term[starts].tolist()] if k else [-1],
                [len(held), *map(int, sizes)],
                [None, *data],
                [list(ids), *[None] * k],
                [list(keys), *[None] * k],
                [list(words), *[None] * k],
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["segment", "term", "n", "positions", "ids", "keys", "words"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                # A text's own bytes: cast as a whole, a batch would be held twice.
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = words_of(text)
                ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                known = np.flatnonzero(ids >= 0)
                terms.append(ids[known])
                places.append(known + at)
                held.append((i.as_py(), xxhash.xxh3_64_intdigest(text) - (1 << 63), len(words)))
                at += len(words) + gap
                if at >= segment:
                    yield flush()
                    number, held, terms, places, at = number + 1, [], [], [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, INDEX)


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges starts[i] .. starts[i] + counts[i] - 1: each number, and which range it is of."""
    which = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[which] + inner, which


def _search(part: tuple, keys: np.ndarray, near: int, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact and near matches, each as windows and their start positions.

    ``keys`` are the segment's postings, term << 40 | position, in order. From each window's
    rarest term its whole posting list gives the candidates; each further term's list, shifted by
    its place, is intersected with what is left.
    """
    at, terms, places, size = part
    rare = terms[:, 0]
    low = np.searchsorted(keys, rare << 40)
    rows, window = _expand(low, np.searchsorted(keys, (rare + 1) << 40) - low)
    start = (keys[rows] & ((1 << 40) - 1)) - places[window, 0]
    first = start >= 0
    window, start = window[first], start[first]

    def kept(window: np.ndarray, start: np.ndarray, k: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
        want = (terms[window, k] << 40) | np.maximum(start + places[window, k] - slop, 0)
        found = np.searchsorted(keys, want)
        there = (keys[np.minimum(found, len(keys) - 1)] <= want + 2 * slop) & (found < len(keys)) | (size[window] <= k)
        return window[there], start[there]

    w, s = window, start
    for k in range(1, terms.shape[1]):
        if len(w):
            w, s = kept(w, s, k, 0)
    if not near:
        return w + at, s, w[:0], s[:0]
    for k in range(1, min(near, terms.shape[1])):
        if len(window):
            window, start = kept(window, start, k, slop)
    return w + at, s, window + at, start


def search(index: DataFrame, tests: Tests, gap: int, near: int, slop: int) -> DataFrame:
    """``FOUND`` for each document of the index: runs of matched words by item, and how many words they cover."""
    names, item_of, size = tests.names, tests.item, tests.size

    def covered(runs: list[tuple[int, int]]) -> int:
        total, end = 0, 0
        for a, b in sorted(runs):
            total, end = total + max(0, b - max(a, end)), max(end, b)
        return total

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("term")
        head = found.slice(0, 1).to_pylist()[0]
        term, data = found.column("term").to_numpy()[1:], found.column("positions").to_pylist()[1:]
        term = np.searchsorted(tests.vocabulary, term)
        keys = np.concatenate([(t << 40) | _unsqueeze(d) for t, d in zip(term, data, strict=True)] or [np.empty(0, np.int64)])
        words = np.array(head["words"], np.int64)
        bases = np.cumsum(words + gap) - words - gap
        runs: dict[int, dict[tuple[str, bool], list[list[int]]]] = {}
        if len(keys) and len(size):
            w, s, w2, s2 = (np.concatenate(x) for x in zip(*[_search(part, keys, near, slop) for part in tests.rarest_first()], strict=True))
            # A near match may reach over the end of its text, and one that is exact isn't also near.
            doc2 = np.maximum(np.searchsorted(bases, s2, "right") - 1, 0)
            inside = s2 + size[w2] <= bases[doc2] + words[doc2]
            inside &= ~np.isin(w2 << 40 | s2, w << 40 | s)
            for ws, ss, exact in ((w, s, True), (w2[inside], s2[inside], False)):
                order = np.lexsort((ss, ws))
                docs = np.searchsorted(bases, ss[order], "right") - 1
                for x, p, d in zip(ws[order].tolist(), ss[order].tolist(), docs.tolist(), strict=True):
                    a = p - int(bases[d])
                    runs.setdefault(d, {}).setdefault((names[item_of[x]], exact), []).append([a, a + int(size[x])])
        columns: dict[str, list] = {"n_hit": [0] * len(words), "n_near": [0] * len(words), "matches": [[] for _ in words]}
        for d, by_item in runs.items():
            for (item, exact), spans in sorted(by_item.items()):
                spans.sort()
                merged = [spans[0]]
                for a, b in spans[1:]:
                    if a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                columns["matches"][d] += [{"item": item, "first": a, "last": b - 1, "exact": exact} for a, b in merged]
            for name, exact in (("n_hit", True), ("n_near", False)):
                columns[name][d] = covered([(m["first"], m["last"] + 1) for m in columns["matches"][d] if m["exact"] == exact])
        kind = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("exact", pa.bool_())]))
        return pa.table(
            {
                "id": pa.array(head["ids"], pa.int64()),
                "key": pa.array(head["keys"], pa.int64()),
                "n_words": pa.array(words, pa.int64()),
                "n_hit": pa.array(columns["n_hit"], pa.int64()),
                "n_near": pa.array(columns["n_near"], pa.int64()),
                "matches": pa.array(columns["matches"], kind),
            }
        )

    return index.groupBy("segment").applyInArrow(run, FOUND)


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    near: int = 0,
    slop: int = 2,
    segment: int = SEGMENT,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each document: ``id, key, n_words, n_hit, n_near, matches``.

    A window is ``width`` consecutive words of a test item, or all words of a shorter one. Matches
    are runs of document words inside windows: exact, or near (the window's ``near`` rarest terms
    all within ``slop`` of their places; 0: none are looked for). ``n_hit`` and ``n_near`` count the words so covered.

    Training postings are stored in the shared folder, once for all tests: words are numbered by
    hash, and which are test words comes from a filter of ``FILTER`` bits. Test texts are brought to
    the driver a block at a time, each of about ``block`` characters whatever the table's size, and
    looked for in the stored lists of their own words; how often a term occurs comes from adding
    those up. Blocks of any number are merged, so nothing sent to executors grows with either table.

    Null texts have no words and no matches. A null item id is the empty string; items that share
    an id are one item. Repeated rows stay; in more than one block, rows with equal id and text
    share their matches, which are equal. Empty tables give no rows, or no matches.
    """
    rows = pack(docs, id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    texts = pack(tests, item=F.coalesce(F.col(item_col).cast("string"), F.lit("")), text=F.col(item_text_col).cast("string"))
    texts = texts.where(F.col("text").isNotNull())
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block))
    part = lambda i: [(r["item"], r["text"].encode()) for r in texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()]
    bits = np.zeros(FILTER // 8, np.uint8)
    first = None
    for i in range(n):
        items = part(i)
        first = items if first is None else first
        mark({w for _, text in items for w in words_of(text)}, bits)
    gap = width + 2 * slop
    with few_at_once(docs.sparkSession):
        index = shared(build_index(rows, bits, gap, segment))
    found = []
    for i in range(n):
        own = Tests(first if i == 0 else part(i), width)
        # No more rows than a block has words.
        known = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"term": own.vocabulary})))
        lists = index.where("term >= 0").join(known, "term", "left_semi")
        own.count({r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()})
        found.append(search(index.where("term < 0").unionByName(lists), own, gap, near, slop))
    if n == 1:
        return found[0]
    matches = found[0]
    for f in found[1:]:
        matches = matches.unionByName(f)
    matches = shared(matches)
    spans = matches.select("id", "key", F.explode("matches").alias("m")).distinct()
    places = spans.where("m.exact").select("id", "key", F.explode(F.sequence("m.first", "m.last")).alias("p")).distinct()
    near_by = spans.where("not m.exact").select("id", "key", F.explode(F.sequence("m.first", "m.last")).alias("p")).distinct()
    key = lambda a: F.xxhash64("id", "key").alias(a)
    out = found[0].select("id", "key", "n_words", key("row"))
    for df, name in ((places, "n_hit"), (near_by, "n_near")):
        out = out.join(df.groupBy(key("row")).agg(F.count("*").alias(name)), "row", "left")
    out = out.join(spans.groupBy(key("row")).agg(F.sort_array(F.collect_list("m")).alias("matches")), "row", "left")
    none = F.array().cast("array<struct<item:string,first:long,last:long,exact:boolean>>")
    return out.select(
        "id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("matches", none).alias("matches")
    )


def contaminated() -> Column:
    """The verdict: hit words are at least a twentieth of the document's."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
