"""Exact removal of repeated passages: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``size`` bytes that covers it also starts anywhere else (same text included).

1. **Segments.** Every window of ``size`` bytes has an anchor: its ``gram``-byte string with the smallest hash, the leftmost
   of equals. Equal windows have equal anchors, so windows are dealt out by anchor. Neighbouring windows with the same
   anchor form one segment. Each window belongs to exactly one segment.
2. **Only repeated anchors go on.** Segments whose anchor occurs once cannot hold a repeated window. Equal segments
   (copies of texts and passages) become one segment with a weight, before anything is shuffled. If an anchor has one
   distinct segment only, that is repeated whole; all others are compared.
3. **Transform.** The segments of an anchor meet in one block of about ``BLOCK_BYTES``. The block's rotations are sorted to a
   depth of at least ``size``, which gives its transform. Interval borders are then found breadth first by increasing
   common prefix: from a border between rows with l bytes in common, one backward extension by each byte gives the
   borders with l + 1 bytes in common. It stops at ``size``: rows without a border between them share ``size`` bytes.
   A class of rows with total weight two or more is a repeated window.
4. **Spans.** Every occurrence of a segment takes over its repeated windows; spans are united for each distinct text.

An anchor whose distinct segments exceed ``HOT_BYTES`` is split exactly: its windows are counted one by one by a 128-bit hash
of the whole window, grouped over the cluster. No group is ever collected beyond a block, and no text beyond
itself. Everything depends on the text alone and is keyed by a 128-bit content hash, so null ids, repeated rows and clashing
columns do not matter. Null is the empty text; texts shorter than ``size`` keep all bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import content_key, give_back, sliced

MIN_BYTES, ANCHOR_BYTES = 400, 200
BLOCK_BYTES, HOT_BYTES = 1 << 19, 3 << 20
#: so few intervals (times bytes) are extended byte by byte instead of row by row
FEW_LOOKUPS = 16384
#: so many intervals are extended at once
FRONTIER_ROWS = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each place on; it depends on these bytes only."""
    up, down = _POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[:len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest hash (its upper half; the leftmost of equals) among each w in a row."""
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(after[:n], before[w - 1:w - 1 + n])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(data: bytes, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``size`` bytes with the same anchor: anchor hash, first start, last start."""
    if len(data) < size:
        none = np.empty(0, np.int64)
        return none, none, none
    h = gram_hashes(np.frombuffer(data, np.uint8), k)
    place = window_minima(h, size - k + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return h[place[first]].view(np.int64), first, last


def rotation_order(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rotations of ``t`` by their first ``depth`` bytes or more (prefix doubling; settled rows stay), and how many of
    the first 8 bytes each row shares with the row before."""
    n = len(t)
    key = np.ndarray((n,), ">u8", np.resize(t, n + 8), strides=(1,)).astype(np.uint64)  # the 8 bytes from each place on
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    differ = key[1:] ^ key[:-1]
    del key  # arrays of 8 bytes a place are most of what a block takes
    heads = np.concatenate([[True], differ != 0])
    common = np.zeros(n, np.int8)
    for j in range(1, 8):
        common[1:] += differ < np.uint64(1 << 64 - 8 * j)
    common[1:] += differ == 0
    del differ
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n, dtype=np.int32), np.int32(0)))
    done = 8
    while done < depth:
        open_ = ~heads
        open_[:-1] |= ~heads[1:]
        at = np.flatnonzero(open_).astype(np.int32)
        if not len(at):
            break
        rows = order[at]
        after = rows + np.int32(done)
        after[after >= n] %= n
        key = rank[rows].astype(np.int64)
        key <<= 32
        key |= rank[after]
        inner = np.argsort(key).astype(np.int32)
        rows, key = rows[inner], key[inner]
        del after, inner
        order[at] = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        heads[at] = new
        rank[rows] = np.maximum.accumulate(np.where(new, at, np.int32(0)))
        done *= 2
    return order, common


def interval_borders(bwt: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """True at each row that shares fewer than ``depth`` bytes with the row before. Rows that share fewer than 8 are known from the
    packed keys (``common``); from there on each round finds those that share one byte more."""
    n = len(bwt)
    occurrences = np.argsort(bwt, kind="stable").astype(np.int32)
    symbols = bwt[occurrences]
    step = np.zeros(n + 1, np.int32)  # row of the rotation that starts one byte earlier
    step[occurrences] = np.arange(n, dtype=np.int32)
    before = np.full(n + 1, n, np.int32)
    before[:n] = -1  # the row before with the same byte
    same = symbols[1:] == symbols[:-1]
    before[occurrences[1:][same]] = occurrences[:-1][same]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    ends = np.concatenate([starts[1:], [n]])
    base = np.arange(len(starts), dtype=np.int32 if len(starts) * n < 1 << 31 else np.int64) * n
    group = np.repeat(base, ends - starts)  # sorted by byte, then row
    group += occurrences
    del occurrences, symbols, same
    border = np.zeros(n + 1, bool)
    known = min(8, depth)
    border[:n] = common < known
    border[n] = True
    frontier = np.flatnonzero(common == known - 1).astype(np.int32)
    for _ in range(known, depth):
        if not len(frontier):
            break
        found = []
        for i in range(0, len(frontier), FRONTIER_ROWS):
            origin = row = frontier[i:i + FRONTIER_ROWS]
            for ahead in (1, 1, 1, 1, 60):  # rows of the intervals, some at a time
                while len(row):
                    rows = row[:, None] + np.arange(ahead, dtype=np.int32)
                    np.minimum(rows, n, out=rows)
                    closed = np.logical_or.accumulate(border[rows[:, 1:]], axis=1)
                    open_ = np.concatenate([np.ones((len(row), 1), bool), ~closed], axis=1) if ahead > 1 else np.ones((len(row), 1), bool)
                    first = open_ & (before[rows] < origin[:, None])  # the first row of the interval with this byte
                    found.append(step[rows[first]])
                    row = row + np.int32(ahead)
                    inside = open_[:, -1] & ~border[np.minimum(row, n)]
                    origin, row = origin[inside], row[inside]
                    if ahead == 1 or len(row) * len(starts) <= FEW_LOOKUPS:
                        break
            if len(origin):  # few long intervals are left: look up their first row with each byte
                target = np.searchsorted(group, base[:, None] + origin.astype(base.dtype))
                found.append(target[target < ends[:, None]].astype(np.int32))
        fresh = np.concatenate(found)
        fresh = fresh[~border[fresh]]
        border[fresh] = True
        frontier = np.unique(fresh) if len(fresh) < n >> 4 else np.flatnonzero(_marked(fresh, n)).astype(np.int32)
    return border[:n]


def _marked(rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[rows] = True
    return out


def repeated_starts(parts: list[bytes], own: list[int], weights: list[int], size: int) -> list[np.ndarray]:
    """For each part, whether the window at each of its first ``own`` places occurs twice or more in all."""
    t = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    weight = np.zeros(len(t), np.int8)
    for a, n, w in zip(at.tolist(), own, weights, strict=True):
        weight[a:a + n] = min(w, 2)  # two is enough
    order, common = rotation_order(t, size)
    first = np.flatnonzero(interval_borders(t[order - 1], common, size))
    del common
    total = np.add.reduceat(weight[order], first, dtype=np.int32)
    repeated = np.zeros(len(t), bool)
    repeated[order] = np.repeat(total >= 2, np.diff(first, append=len(t)))
    return [repeated[a:a + n] for a, n in zip(at.tolist(), own, strict=True)]


def _true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _segments(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for key, data in zip(batch.column("key"), batch.column("text"), strict=True):
                data = data.as_py()
                anchors, first, last = segments(data, size, gram)
                if len(anchors):
                    seg = [xxhash.xxh3_64_intdigest(data[a:b + size]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors), pa.array(np.array(seg, np.uint64).view(np.int64)), pa.array([key.as_py()] * len(seg), pa.binary()),
                         pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], names=["anchor", "seg", "key", "start", "own"])

    return run


def _parts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for data, chosen in zip(batch.column("text"), batch.column("chosen"), strict=True):
                rows = chosen.as_py()
                if rows:
                    data = data.as_py()
                    parts = [data[r["start"]:r["start"] + r["own"] + size - 1] for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["anchor"] for r in rows]), pa.array([r["seg"] for r in rows]), pa.array([r["copies"] for r in rows]),
                         pa.array([r["own"] for r in rows], pa.int32()), pa.array([r["hot"] for r in rows]), pa.array(parts, pa.binary())],
                        names=["anchor", "seg", "copies", "own", "hot", "part"])

    return run


_RUNS = "anchor long, seg long, first int, last int"


def _run_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "seg", "first", "last"])


def _blocks(size: int, block_bytes: int):
    """Rows sorted by anchor -> repeated windows of each segment. A block ends between two anchors."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        flags = repeated_starts([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], size)
        out = [(r[0], r[1], a, b) for r, f in zip(rows, flags, strict=True) for a, b in _true_runs(f)]
        if out:
            yield _run_rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        give_back()
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "seg", "copies", "own", "part")], strict=True):
                if rows and held >= block_bytes and row[0] != rows[-1][0]:
                    yield from solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield from solve(rows)
        del rows
        give_back()

    return run


def _windows(size: int):
    """Every window of the parts of hot anchors, by a hash of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, copies, own, part in zip(*[batch.column(c) for c in ("anchor", "seg", "copies", "own", "part")], strict=True):
                n, part = own.as_py(), part.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor.as_py()] * n, pa.int64()), pa.array([seg.as_py()] * n, pa.int64()), pa.array([copies.as_py()] * n, pa.int64()),
                     pa.array(range(n), pa.int32()), pa.array([xxhash.xxh3_128_digest(part[i:i + size]) for i in range(n)], pa.binary())],
                    names=["anchor", "seg", "copies", "at", "window"])

    return run


def _hot_runs(parts: DataFrame, size: int) -> DataFrame:
    """Repeated windows of hot anchors."""
    w = parts.mapInArrow(_windows(size), "anchor long, seg long, copies long, at int, window binary")
    again = w.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").select("window")
    return w.join(again, "window", "left_semi").select("anchor", "seg", F.col("at").alias("first"), F.col("at").alias("last"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        out = []
        for spans in batch.column("spans").to_pylist():
            runs: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            out.append([{"start": a, "end": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, _SPANS)], names=batch.schema.names)


SPANS = "array<struct<start:long,end:long>>"


def repeated_spans(texts: Column, docs: DataFrame, size: int = MIN_BYTES, gram: int = ANCHOR_BYTES, block_bytes: int = BLOCK_BYTES,
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """key (`content_key` of the text), text (bytes), spans (maximal runs of bytes to remove, end excluded): a row for each
    distinct text of ``docs`` that has any."""
    rows = docs.select(content_key(texts).alias("key"), texts.cast("binary").alias("text")).filter(F.octet_length("text") >= size)
    occ = cut_lineage(rows.mapInArrow(_segments(size, gram), "anchor long, seg long, key binary, start int, own int"))
    again = occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    occ = cut_lineage(occ.join(again, "anchor", "left_semi"))
    segs = cut_lineage(occ.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start", "own")).alias("at")))
    kinds = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), (F.sum(F.col("at.own") + size - 1) > hot_bytes).alias("hot"))
    segs = segs.join(kinds, "anchor")
    one = F.struct("anchor", "seg", "copies", "at.start", "at.own", "hot").alias("one")
    chosen = segs.filter("kinds > 1").select("at.key", one).groupBy("key").agg(F.collect_list("one").alias("chosen"))
    distinct = rows.groupBy("key").agg(F.first("text").alias("text"))
    touched = occ.select("key").distinct().join(chosen, "key", "left")
    held = cut_lineage(distinct.join(touched, "key"))

    parts = held.filter("chosen IS NOT NULL").select("text", "chosen").mapInArrow(
        _parts(size), "anchor long, seg long, copies long, own int, hot boolean, part binary")
    runs = parts.filter("NOT hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_blocks(size, block_bytes), _RUNS)
    # copies of one segment and nothing else: all its windows are repeated, there is nothing to compare
    alone = segs.filter("kinds = 1").select("anchor", "seg", F.lit(0).alias("first"), (F.col("at.own") - 1).alias("last"))
    runs = runs.unionByName(alone)
    if not kinds.filter("hot").isEmpty():  # changes the plan only: without hot anchors there is nothing to add
        runs = runs.unionByName(_hot_runs(parts.filter("hot"), size))
    places = occ.select("anchor", "seg", "key", "start").distinct()
    spans = places.join(runs, ["anchor", "seg"]).select(
        "key", F.struct((F.col("start") + F.col("first")).cast("long").alias("start"),
                        (F.col("start") + F.col("last") + size).cast("long").alias("end")).alias("span"))
    spans = spans.groupBy("key").agg(F.collect_set("span").alias("spans"))
    return held.select("key", "text").join(spans, "key").mapInArrow(_united, f"key binary, text binary, spans {SPANS}")


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of the bytes."""
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        pairs = zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)
        left = [cut(d.as_py(), [(s["start"], s["end"]) for s in spans]) for d, spans in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(left, pa.binary()), batch.column("spans")], names=["key", "kept", "spans"])


def kept_bytes(spans: DataFrame) -> DataFrame:
    """From `repeated_spans`: key, kept (the bytes that stay, concatenated), spans."""
    return spans.mapInArrow(_kept, f"key binary, kept binary, spans {SPANS}")
