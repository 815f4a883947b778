"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of ``window`` consecutive words (an item with fewer words is one window). A document
contains a window if the window's words stand in it in a row. Each window is a set of ``shingle``-word shingles, and a
document that contains the window contains all of them, so one shingle is a sufficient prefix: the **rarest** in the
corpus. Step 1 counts every shingle of the items over all documents. Step 2 joins each document's shingles with the
windows' prefix shingles only; a match fixes where the window would start (positional bound: not before the
document's first word; length bound: not beyond its last), and the window's words are compared one by one there.

The item side goes round in blocks of at most ``BLOCK_WINDOWS`` windows, each broadcast (its size is that bound),
and every block meets all documents; the document side is never shuffled. Memory of a task: one block, and the words
of a few documents (at least one).

Defined results: a null or empty text has no words and no hits; an item without words gives no window; a null item_id
is listed as ``null``; repeated items and documents are counted as rows; windows shared by items count for
each of them. Rows are carried through, never joined back. Empty tables give an empty result or no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import beside, carried, sliced, with_text

WINDOW, SHINGLE = 13, 5
BLOCK_WINDOWS = 200_000
WORDS_AT_ONCE = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased; all UTF-8 bytes from 0x80 on belong to words
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows: words (joined by a blank), n (their number), items (ids as strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wins, sizes = [], [], []
            for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words_of(t)
                for at in range(max(1, len(w) - window + 1) if w else 0):
                    part = w[at:at + window]
                    ids.append(i)
                    wins.append(b" ".join(part))
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary()), pa.array(sizes, pa.int32())],
                                             names=["item", "words", "n"])

    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, words binary, n int").groupBy("words", "n").agg(F.collect_set("item").alias("items"))


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k numbers from each place on. It only proposes places; words are compared afterwards."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    u = ids.astype(np.uint64) + np.uint64(1)
    out = u[:n].copy()
    for j in range(1, k):
        out *= MULTIPLIER
        out += u[j:j + n]
    return out ^ (out >> np.uint64(29))


class Block:
    """One block of windows as arrays: vocabulary, words of each window by length, their shingles."""

    def __init__(self, rows: list, shingle: int) -> None:
        self.number: dict[bytes, int] = {}
        self.by_size: dict[int, np.ndarray] = {}
        self.items: dict[int, list[list[str]]] = {}
        grouped = defaultdict(list)
        for r in rows:
            grouped[r["n"]].append(r)
        for n, group in sorted(grouped.items()):
            self.by_size[n] = np.array([[self.number.setdefault(w, len(self.number)) for w in bytes(r["words"]).split(b" ")] for r in group], np.int64)
            self.items[n] = [r["items"] for r in group]
        self.k = {n: min(shingle, n) for n in self.by_size}

    def shingles(self, n: int) -> np.ndarray:
        """Hashes of the shingles of the windows of n words: a row for each window."""
        w, k = self.by_size[n], self.k[n]
        return np.stack([_codes(row, k) for row in w])

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of several documents with -1 for unknown words and between documents; their starts."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = chain.from_iterable(chain(t, (b"",)) for t in texts)
        return np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, int(starts[-1])), starts

    @staticmethod
    def known(ids: np.ndarray, k: int) -> np.ndarray:
        """Places from which k known words stand in a row."""
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        return np.flatnonzero(unknown[k:] == unknown[:-k]) if len(ids) >= k else np.empty(0, np.int64)


def _documents_at_once(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each) of as many documents as make up WORDS_AT_ONCE words."""
    texts, total, first = [], 0, 0
    for i, t in enumerate(batch.column("text")):
        texts.append(words_of(t.as_py()))
        total += len(texts[-1])
        if total >= WORDS_AT_ONCE:
            yield first, texts
            texts, total, first = [], 0, i + 1
    if texts:
        yield first, texts


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        wanted = {k: np.unique(np.concatenate([block.shingles(n).ravel() for n in block.by_size if block.k[n] == k])) for k in set(block.k.values())}
        for batch in sliced(batches, "text"):
            for _, texts in _documents_at_once(batch):
                ids, _ = block.numbers(texts)
                for k, codes in wanted.items():
                    seen = _codes(ids, k)[block.known(ids, k)]
                    at = np.minimum(np.searchsorted(codes, seen), len(codes) - 1)
                    found, n = np.unique(at[codes[at] == seen], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(codes[found].view(np.int64)), pa.array(np.full(len(found), k, np.int32)), pa.array(n)],
                                                         names=["code", "k", "n"])

    return run


class Index:
    """Prefix index of a block: each window under its rarest shingle."""

    def __init__(self, block: Block, counts: dict[tuple[int, int], int]) -> None:
        self.block, self.prefix = block, {}
        gathered = defaultdict(list)
        for n in block.by_size:
            s, k = block.shingles(n), block.k[n]
            freq = np.array([[counts.get((int(c), k), 0) for c in row] for row in s.view(np.int64)])
            rare = freq.argmin(axis=1)
            gathered[k] += [(s[i, o], n, i, o) for i, o in enumerate(rare)]
        for k, rows in gathered.items():
            rows.sort()
            self.prefix[k] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, window numbers) of the windows that stand in ``ids``."""
        for k, (codes, entries) in self.prefix.items():
            at = Block.known(ids, k)
            seen = _codes(ids, k)[at]
            left, right = np.searchsorted(codes, seen), np.searchsorted(codes, seen, "right")
            met = np.flatnonzero(right > left)
            for some in np.array_split(met, max(1, int((right - left)[met].sum()) // 1_000_000)):
                width = (right - left)[some]
                total = int(width.sum())
                entry = np.repeat(left[some] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(total)
                size, window, offset = entries[entry].T
                start = np.repeat(at[some], width) - offset
                bounds = (start >= 0) & (start + size <= len(ids))
                for n in np.unique(size[bounds]):
                    pick = np.flatnonzero(bounds & (size == n))
                    same = (ids[start[pick][:, None] + np.arange(n)] == self.block.by_size[n][window[pick]]).all(axis=1)
                    yield int(n), start[pick][same], window[pick][same]


def _runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _finder(shared, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in with_text(batches, text):
            n_words: list[int] = []
            spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            items = [set(x) for x in batch.column("items").to_pylist()]
            for first, texts in _documents_at_once(batch):
                n_words += map(len, texts)
                ids, starts = index.block.numbers(texts)
                fresh = defaultdict(list)
                for n, at, windows in index.matches(ids):
                    doc = np.searchsorted(starts, at, "right") - 1
                    for d, a, w in zip(doc.tolist(), (at - starts[doc]).tolist(), windows.tolist(), strict=True):
                        fresh[first + d].append((a, a + n))
                        items[first + d].update(index.block.items[n][w])
                for d, found in fresh.items():
                    a, b = np.array(spans[d] + found).T
                    spans[d] = _runs(a, b)
            found = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
                     "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([found.get(c, batch.column(c)) for c in names], names=names)

    return run


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) in the struct ``row``, then text, n_words, spans (maximal runs of hit
    words, word offsets, end excluded) and items (ids of the items with occurring windows, as sorted strings)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    rows = carried(docs, keep, text)
    out = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    wins = cut_lineage(item_windows(items, item_id, item_text, window))
    n_blocks = max(1, -(-wins.count() // BLOCK_WINDOWS))
    for b in range(n_blocks):
        # about BLOCK_WINDOWS rows: the bound of what is sent to the driver and to each executor
        block = Block(wins.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b).collect(), shingle)
        counts = {}
        if block.by_size:
            seen = rows.select(beside(rows, text)).mapInArrow(_counter(spark.sparkContext.broadcast(block)), "code long, k int, n long")
            counts = {(r["code"], r["k"]): r["n"] for r in seen.groupBy("code", "k").agg(F.sum("n").alias("n")).toLocalIterator()}
        out = out.mapInArrow(_finder(spark.sparkContext.broadcast(Index(block, counts)), text, out.columns), out.schema)
    return out.select("row", beside(out, text), "n_words", "spans", "items")


def n_hit(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(spans="spans", n_words="n_words"):
    """At least one word in twenty is hit."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))
