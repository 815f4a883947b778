"""Substring dedup by repeated-phrase automata: every word goes that a window of ``size`` words covers whose words also start earlier.

A word is a run without the bytes 20 and 09 to 0D. Earlier is a smaller document (doc_id, nulls last, then the text's hash) or an earlier start in the same one.

1. **Candidates.** A window's anchor is the string of ``GRAM`` of its words with the smallest hash (leftmost of equals); equal windows have equal
   anchors. Neighbouring windows with one anchor form a segment; each window is in exactly one. Anchors are counted over all documents, with
   partial sums before the shuffle; only segments whose anchor occurs twice or more can hold a recurring window.
2. **Copies.** Segments equal in all words (128 bits of hash over anchor and words) are merged by a partial minimum: the earliest goes on, of all others every window
   started earlier, so all their words go. A passage that stands in a third of all documents is one row from here on.
3. **Automata.** The earliest segments that share an anchor get their words and are dealt out by anchor into shards of about ``SHARD_WINDOWS`` windows. A shard confirms
   its recurring phrases (windows that start in it twice or more), compiles them into one Aho-Corasick automaton over word numbers, and streams its
   segments through it: every occurrence of every phrase is a hit, word by word, and of a phrase's hits all but the earliest are cut.
   An anchor with more than ``HOT_SEGMENTS`` distinct segments is too much for one shard: its segments are cut into their windows, which are merged as in step 2.
4. **Cutting.** The spans meet their documents by (doc_id, text hash) and the words in them are left out.

Defined results: a null text is empty; texts with fewer words than ``size`` stay whole; rows that repeat (same id and text) are one document, each
gets its result; rows of one id with different texts are ordered by the texts' hashes; ids may be null. Other columns are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import sliced
from .suffix import window_minima

SIZE, GRAM = 20, 8
SHARD_WINDOWS, HOT_SEGMENTS = 30_000, 5_000
_BASE = 0x9E3779B97F4A7C15
_B, _M = np.uint64(_BASE), np.uint64(0xBF58476D1CE4E5B9)
_BLOCK = 1 << 20
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= _M
    h ^= h >> np.uint64(32)
    return h


def _sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[1], out=sums[1:])
    return sums


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k words from each place on; it depends on these words only."""
    sums = _sums(h)
    return _mixed((sums[k:] - sums[:-k]) * _powers(len(h))[0][:len(h) - k + 1])


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts in order, and the text that each belongs to. Goes through the bytes in blocks."""
    texts = texts.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    step = np.diff(inside.view(np.int8), prepend=0, append=0)
    breaks = offsets[1:-1]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    breaks = np.unique(breaks[inside[breaks] & inside[breaks - 1]])  # one text's last word and the next one's first
    start = np.sort(np.concatenate([np.flatnonzero(step == 1), breaks]))
    end = np.sort(np.concatenate([np.flatnonzero(step == -1), breaks]))
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # words of about a block, from a word's start on
        to = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK, side="right")))
        base, top = start[at], end[to - 1]
        sums = _sums(data[base:top].astype(np.uint64) + np.uint64(1))
        h[at:to] = (sums[end[at:to] - base] - sums[start[at:to] - base]) * _powers(top - base)[0][start[at:to] - base]
        at = to
    return _mixed(h + (end - start).astype(np.uint64) * _M), np.searchsorted(offsets, start, side="right") - 1


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def segments(h: np.ndarray, text: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in one text: the anchor's hash, the first window's start and the last one's. h, text: of each word."""
    grams = window_hashes(h, gram)
    place = window_minima(grams, size - gram + 1)
    whole = text[size - 1:] == text[:len(place)]  # the window is in one text
    change = np.concatenate([[True], (place[1:] != place[:-1]) | ~whole[:-1] | ~whole[1:]])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    there = whole[first]
    first, last = first[there], last[there]
    return grams[place[first]], first, last


def _anchors(size: int, gram: int, full: bool):
    """Anchors of each text; if ``full`` with the segment's hash and place (first window << 8 | windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.arange(1, size + 1, dtype=np.uint64) * _M
        for batch in sliced(batches, "text", _BLOCK):
            h, owner = text_words(batch.column("text"))
            if len(h) < size:
                continue
            anchor, first, last = segments(h, owner, size, gram)
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["anchor"])
                continue
            n, of = last - first + 1, owner[first]
            whole = window_hashes(h, size)  # a segment's first and last window hold all its words; n is their distance
            segment = _mixed(whole[first] ^ (whole[last] * _B + seeds[n - 1]))
            keys = np.fromiter((text_key(t.as_py() or b"") for t in batch.column("text")), np.int64, batch.num_rows)
            begins = np.searchsorted(owner, np.arange(batch.num_rows))  # each text's first word
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), batch.column("doc_id").take(pa.array(of)),
                                              pa.array(keys[of]), pa.array((first - begins[of]) << 8 | n)], names=["anchor", "segment", "doc_id", "key", "at"])

    return run


_PLACE = "doc_id long, key long, at long"


def _place() -> Column:
    """Where a segment starts, in the order of earlier and later (null ids last)."""
    return F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key", "at")


def merged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found: anchor, segment, doc_id, key, at. The earliest row of each distinct segment, and the places of all others."""
    groups = found.groupBy("anchor", "segment").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    groups = cut_lineage(groups.select("anchor", "segment", "first.doc_id", "first.key", "first.at", (F.col("first") != F.col("last")).alias("again")))
    repeated = groups.filter("again").select(F.col("anchor").alias("a"), F.col("segment").alias("s"), F.struct("doc_id", "key", "at").alias("first"))
    same = (found["anchor"] == repeated["a"]) & (found["segment"] == repeated["s"])
    later = found.join(repeated, same).filter(~F.struct("doc_id", "key", "at").eqNullSafe(F.col("first"))).select("doc_id", "key", "at")
    return groups.drop("again"), later


def _words_of(size: int):
    """The words of the segments listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out, words = [], []
            for doc_id, key, text, listed in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), batch.column("listed").to_pylist(), strict=True):
                split = (text.as_py() or b"").split()
                for s in listed:
                    start, n = s["at"] >> 8, s["at"] & 255
                    out.append((s["anchor"], s["segment"], doc_id, key, s["at"]))
                    words.append(b" ".join(split[start:start + n + size - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), pa.array(words, pa.binary())],
                                                 names=["anchor", "segment", "doc_id", "key", "at", "words"])

    return run


def _single_windows(size: int):
    """Segments cut into their windows, each hashed by its own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "words"):
            h, owner = text_words(batch.column("words"))
            first = np.flatnonzero(owner[size - 1:] == owner[:len(h) - size + 1])
            of = owner[first]
            begins = np.searchsorted(owner, np.arange(batch.num_rows))
            at = batch.column("at").to_numpy()[of] + (first - begins[of] << 8) & ~255 | 1
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(rows), pa.array(window_hashes(h, size)[first].view(np.int64)), batch.column("doc_id").take(rows),
                                              batch.column("key").take(rows), pa.array(at)], names=["anchor", "segment", "doc_id", "key", "at"])

    return run


def phrase_automaton(words: np.ndarray, start: np.ndarray, count: np.ndarray, size: int) -> tuple[ahocorasick.Automaton | None, np.ndarray]:
    """Automaton of the phrases (windows of ``size`` words) that start twice or more in the sequences, and the sequences that may hold one.
    words: of all sequences in a row; start, count: of each. Windows are found by hash; the automaton compares their words."""
    owner = np.repeat(np.arange(len(start)), count)
    mixed = _mixed((words.astype(np.uint64) + np.uint64(1)) * _B)
    h = window_hashes(mixed, size)
    inside = np.flatnonzero(owner[size - 1:] == owner[:len(h)])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    places = order[twice]
    if not len(places):
        return None, places
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    listed = words.tolist()
    for n, i in enumerate(places[np.concatenate([[True], h[places[1:]] != h[places[:-1]]])].tolist()):
        automaton.add_word(tuple(listed[i:i + size]), n)
    automaton.make_automaton()
    return automaton, np.unique(owner[places])


def _shard(size: int):
    """Confirms the shard's phrases, locates every occurrence, and returns the spans of all but each phrase's earliest."""

    def run(table: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        split = [words.as_py().split() for words in table.column("words")]
        count = np.array([len(w) for w in split], np.int64)
        words = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int64, int(count.sum()))
        start = np.cumsum(count) - count
        automaton, held = phrase_automaton(words, start, count, size)
        spans = []
        if automaton is not None:
            rows = table.select(["doc_id", "key", "at"]).take(pa.array(held))
            places = [(d is None, d or 0, k, at >> 8) for d, k, at in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "key", "at")), strict=True)]
            earliest: dict[int, tuple] = {}
            hits = []
            for (without, d, k, at), i in zip(places, held.tolist(), strict=True):
                own = [(at + end - size + 1, phrase) for end, phrase in automaton.iter(tuple(words[start[i]:start[i] + count[i]].tolist()))]
                hits.append(own)
                for begin, phrase in own:
                    place = (without, d, k, begin)
                    if phrase not in earliest or place < earliest[phrase]:
                        earliest[phrase] = place
            for (without, d, k, _), own in zip(places, hits, strict=True):
                cut = sorted(at for at, phrase in own if earliest[phrase] < (without, d, k, at))
                i = 0
                while i < len(cut):
                    j = i
                    while j + 1 < len(cut) and cut[j + 1] == cut[j] + 1:
                        j += 1
                    spans.append({"doc_id": None if without else d, "key": k, "at": cut[i] << 8 | j - i + 1})
                    i = j + 1
        return pa.Table.from_pylist(spans, pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int64())]))

    return run


def _keyed(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").cast("binary").alias("text"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        keys = pa.array([text_key(t.as_py() or b"") for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), keys], names=["doc_id", "text", "key"])


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return (a["key"] == b["key_"]) & a["doc_id"].eqNullSafe(b["doc_id_"])


def later_spans(rows: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, key, at (first window << 8 | windows): every window of ``size`` words that started earlier. rows: doc_id, text (bytes)."""
    if not 0 < gram <= size or size - gram > 254:
        raise ValueError("gram must be from 1 to size, and size - gram 254 at most")
    counts = rows.select("text").mapInArrow(_anchors(size, gram, full=False), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    recurring = cut_lineage(counts.filter("n > 1").select("anchor"))
    found = rows.mapInArrow(_anchors(size, gram, full=True), f"anchor long, segment long, {_PLACE}")
    found = cut_lineage(found.join(recurring, "anchor", "left_semi"))
    groups, later = merged(found)

    # only segments that share their anchor with another one can share a window with it
    contested = cut_lineage(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    groups = groups.join(contested.select("anchor"), "anchor", "left_semi")
    listed = groups.groupBy(F.col("doc_id").alias("doc_id_"), F.col("key").alias("key_")).agg(F.collect_list(F.struct("anchor", "segment", "at")).alias("listed"))
    texts = rows.mapInArrow(_with_key, "doc_id long, text binary, key long")
    with_lists = texts.join(listed, _same_document(texts, listed)).select("doc_id", "key", "text", "listed")
    schema = f"anchor long, segment long, {_PLACE}, words binary"
    worded = cut_lineage(with_lists.mapInArrow(_words_of(size), schema).dropDuplicates(["anchor", "segment"]))

    hot = contested.filter(F.col("n") > HOT_SEGMENTS).select("anchor")
    if not hot.isEmpty():  # changes the plan only
        single = cut_lineage(worded.join(hot, "anchor", "left_semi").mapInArrow(_single_windows(size), f"anchor long, segment long, {_PLACE}"))
        later = later.unionByName(merged(single)[1])
        worded = worded.join(hot, "anchor", "left_anti")
    total = worded.agg(F.sum(F.col("at").bitwiseAND(255)).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_WINDOWS))
    located = worded.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(_shard(size), _PLACE)
    return later.unionByName(located)


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                n.append(len(words))
                left = words
                if spans:
                    step = np.zeros(len(words) + 1, np.int64)
                    at = np.array(spans, np.int64)
                    np.add.at(step, at >> 8, 1)
                    np.add.at(step, (at >> 8) + (at & 255) + size - 1, -1)
                    left = [w for w, k in zip(words, (np.cumsum(step[:-1]) == 0).tolist(), strict=True) if k]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_later_phrases(docs: DataFrame, size: int = SIZE, gram: int = GRAM, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space): a row for each row of ``docs``."""
    rows = _keyed(docs, F.col(text))
    spans = later_spans(rows, size, gram).groupBy(F.col("doc_id").alias("doc_id_"), F.col("key").alias("key_")).agg(F.collect_set("at").alias("spans"))
    texts = rows.mapInArrow(_with_key, "doc_id long, text binary, key long")
    out = texts.join(spans, _same_document(texts, spans), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept string")
