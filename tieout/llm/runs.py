"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter, roots extended into runs.

A run is a stretch of words with smallest period q, at least ``max(least, 2 * q)`` words long, that neither neighbour extends.

1. **Where runs can be.** Every word of a run is covered by a window of ``least // 2`` words that starts a second time inside the run
   (q words on or back), so only stretches covered by windows that occur twice in them are gone on with; the test is repeated inside
   each stretch until nothing more falls off. Windows are compared by hash, so a stretch may be kept needlessly, never lost.
2. **Grouping.** Suffixes begin in one group for each word. The highest group is taken; its word u is then the longest Lyndon word at each of
   its members. Every place below whose own word v ends where members begin takes them in, v becomes v u ... u, and all with the
   same v and the same number of u's form a new group just above that of v. So the lengths are the Lyndon array, without a suffix
   array. Each place is taken in once at most: the work is linear. This is done under the order of the words' codes and under its inverse.
3. **Runs.** Each run has a root that is the longest Lyndon word at its place under one of the two orders. The longest common
   extensions to the right and to the left of each root give its stretch; equal stretches meet in a set.

Each text is one row of one task; its memory is a few numbers a word. Nothing is shuffled.

Defined results: a null text is the empty text; texts without words or with fewer than ``least`` have no run. Order, ids and further
columns do not matter (rows are carried through), repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, unused

LEAST_WORDS = 12


def lyndon_lengths(x: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place (the end of ``x`` is smaller than any word): phase one of Baier's sorter."""
    n = len(x)
    size = [1] * n
    ender = [-1, *range(n)]  # the place whose word ends here
    final = bytearray(n)
    group = [0] * n
    by_word: dict[int, list[int]] = {}
    for i, c in enumerate(x):
        by_word.setdefault(c, []).append(i)
    members = [[]]  # group 0 stands below all
    for g, c in enumerate(sorted(by_word), 1):
        members.append(by_word[c])
        for i in by_word[c]:
            group[i] = g
    lower = list(range(-1, len(members) - 1))
    upper = list(range(1, len(members) + 1))
    top = len(members) - 1
    upper[top] = -1
    while top > 0:
        taken = [s for s in members[top] if group[s] == top]
        members[top] = []
        for s in taken:
            final[s] = 1
        grown: dict[int, int] = {}
        if taken:
            length = size[taken[0]]
            for s in taken:
                p = ender[s]
                if p >= 0 and not final[p]:
                    size[p] += length
                    ender[s + length] = p
                    grown[p] = grown.get(p, 0) + 1
        new: dict[tuple[int, int], list[int]] = {}
        for p, k in grown.items():
            new.setdefault((group[p], k), []).append(p)
        below = (-1, -1)
        for old, k in sorted(new):
            under = below[1] if below[0] == old else old
            g, above = len(members), upper[under]
            members.append(new[old, k])
            for p in members[g]:
                group[p] = g
            lower.append(under)
            upper.append(above)
            upper[under] = g
            lower[above] = g
            below = (old, g)
        top = lower[top]
    return size


def common_right(x: list[int], i: int, j: int) -> int:
    """How many words from i and from j > i on are equal."""
    m, step, limit = 0, 4, len(x) - j
    while m < limit:
        step = min(step, limit - m)
        if x[i + m:i + m + step] == x[j + m:j + m + step]:
            m += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return m


def common_left(x: list[int], i: int, j: int) -> int:
    """How many words before i and before j > i are equal."""
    m, step = 0, 4
    while m < i:
        step = min(step, i - m)
        if x[i - m - step:i - m] == x[j - m - step:j - m]:
            m += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return m


def stretch_runs(x: list[int], least: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of every run in one stretch."""
    n, found = len(x), set()
    for order in (x, [-c for c in x]):
        latest: dict[int, int] = {}  # end of the last stretch of each period
        for i, q in enumerate(lyndon_lengths(order)):
            if latest.get(q, -1) >= i + q:
                continue  # the root is inside that stretch, and would give it again
            start = i - (common_left(x, i, i + q) if i and x[i - 1] == x[i + q - 1] else 0)
            end = i + q + (common_right(x, i, i + q) if i + q < n and x[i] == x[i + q] else 0)
            latest[q] = end
            if end - start >= max(least, 2 * q):
                found.add((start, end, q))
    return found


def _window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(codes) - k + 1, np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[j:len(h) + j]
    return h


def stretches(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches that hold all runs of at least ``least`` words: parts covered by windows that occur twice in the part."""
    k = max(1, least // 2)
    open_, done = [(0, len(codes))], []
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        h = _window_hashes(codes[a:b], k)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h) + 1, np.int64)
        again[order[1:][same]] = 1
        again[order[:-1][same]] = 1
        step = np.zeros(b - a + 1, np.int64)
        step[:len(h) + 1] += again
        step[k:] -= again[:b - a + 1 - k]
        covered = np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered))
        parts = [(a + int(s), a + int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]
        if parts == [(a, b)]:
            done.append((a, b))
        else:
            open_ += parts
    return done


def runs_of(words: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < least:
        return []
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return []
    found = set()
    for a, b in stretches(codes, least):
        found |= {(a + s, e - s, q) for s, e, q in stretch_runs(codes[a:b].tolist(), least)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, found, left = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or b"").split()  # of bytes: at 20 and 09 to 0D only
                runs = runs_of(words, least)
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                left.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays([*[c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f != "text"], pa.array(n, pa.int64()),
                                              pa.array(found, _RUNS), pa.array(left, pa.binary()).cast(pa.string())],
                                             names=["row", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """row (the columns ``keep``, or all), n_words, runs (start, length, period in words) and collapsed (the text's words without what
    only repeats): a row for each row of ``docs``."""
    keep = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias(unused(docs, "nothing")))
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_batches(least), schema)
