"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A document's set is its distinct ``words``-word shingles. One permutation scatters the shingles, a second one gives the
ranks; coordinate k of the signature is the smallest rank after the scattered places are shifted k steps round the
circle. So two permutations generate all coordinates (both are bijections of the 32-bit numbers; a shingle's place is
its hash there). Bands of ``ROWS`` coordinates are buckets.

Copies come first: documents with equal sets are one class, so thousands of copies are one row from there on.
Candidates are compared exactly, in two rounds that never list all pairs of a bucket whose members turn out to be linked:

1. every class with the smallest class of each of its buckets (the hub);
2. after the links so far are joined to components, classes of a bucket that are still in different components. Small buckets
   give pairs. A large bucket is cut into blocks of about ``BLOCK_BYTES`` of text; two blocks at a time meet in a task, which
   counts common shingles by an inverted index and gives only links. A pair is compared in the first band it shares.

Every pair of classes that shares a bucket is therefore compared or already connected, and no task holds more than two blocks.
Sizes that rule a link out (100 * smaller < threshold * larger) are dropped before. A pair at similarity 0.8 shares none of 32 bands of 4 with
probability (1 - 0.8^4)^32 = 5e-8; links are confirmed on full shingle sets. Components use all links.

Defined results: a null or empty text has an empty set and is linked with nothing; fewer words than a shingle make one
shingle of the whole sequence; a null id takes part, but is never the smallest id (a component of null ids has a null
component_id); rows that repeat an id are decided each on its own text, so they can lie in different components. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import content_key, sliced
from .components import smallest_reachable

BANDS, ROWS = 32, 4
_SHINGLE = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 200_000
_CELLS = 1 << 16
SMALL_BUCKET, BLOCK_BYTES = 6, 1 << 20


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. Words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n < 1:  # the whole sequence; its length keeps it apart from real shingles
        k, n = len(h), 1
        h = h + np.uint64(len(words))
    out = h[:n].copy()
    for j in range(1, k):
        out *= _SHINGLE
        out ^= out >> np.uint64(31)
        out += h[j:j + n]
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _scatter(x: np.ndarray) -> np.ndarray:
    """First permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _rank(x: np.ndarray) -> np.ndarray:
    """Second permutation, in place."""
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE3D)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Smallest rank for each of ``size`` shifts of the circle."""
    places = _scatter((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    step = max(1, _CELLS // size)
    for at in range(0, len(places), step):
        np.minimum(best, _rank(places[at:at + step][None, :] - shifts).min(axis=1), out=best)
    return best


def _profiles(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, "text"):
            sizes, keys, found = [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), k, hashes)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    sig = signature(s, bands * rows).reshape(bands, rows)
                    found.append([xxhash.xxh3_64_intdigest(sig[b].tobytes(), seed=b) - (1 << 63) for b in range(bands)])
                else:
                    found.append([])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(found, pa.list_(pa.int64()))], names=["id", "key", "n", "node", "bands"])

    return run


def linked(common: Column | int, a: Column | int, b: Column | int, threshold: int):
    return 100 * common >= threshold * (a + b - common)


def _verify(k: int, threshold: int):
    """Rows (a, b, text_a, text_b), those with the same a in a row -> linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = WordHashes(), None, None
        for batch in sliced(batches, "text_a"):
            a_, b_ = [], []
            for a, b, ta, tb in zip(*[batch.column(c) for c in ("a", "b", "text_a", "text_b")], strict=True):
                a = a.as_py()
                if a != last:
                    last, left = a, shingle_set(ta.as_py(), k, hashes)
                right = shingle_set(tb.as_py(), k, hashes)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if linked(common, len(left), len(right), threshold):
                    a_.append(a)
                    b_.append(b.as_py())
            if a_:
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary())], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs (a, b) that are links. Texts travel, not sets: they compress; a hot ``a`` is split by the skew join."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return cut_lineage(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, threshold), "a binary, b binary"))


def _block_links(many: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) between different groups in large buckets. ``many``: bucket, node, n, group, bands, text."""
    many = cut_lineage(many)
    sizes = many.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("text")) / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = many.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cut_lineage(met.select("bucket", "i", "j", "own", "node", "n", "group", "bands", "text").mapInArrow(
        _meet(k, threshold), "a binary, b binary").distinct())


def _meet(k: int, threshold: int):
    def compare(rows: list[tuple], hashes: WordHashes) -> Iterator[pa.RecordBatch]:
        bucket, i, j = rows[0][:3]
        own, n = (np.array([r[c] for r in rows], np.int64) for c in (3, 5))
        node, names = [r[4] for r in rows], {}
        group = np.array([names.setdefault(r[6], len(names)) for r in rows])
        bands = np.array([r[7] for r in rows], np.int64)
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        sets = [shingle_set(r[8], k, hashes) for r in rows]
        shingles, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), n)
        order = np.argsort(place, kind="stable")
        owner_by = owner[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(shingles)))])
        at = np.concatenate([[0], np.cumsum(n)])
        usual = np.bincount(group).argmax()
        number = np.arange(len(rows))
        a_, b_ = [], []
        for x in np.flatnonzero(group != usual):
            todo = (group != group[x]) & ((group == usual) | (number < x)) & (100 * np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]))
            if i != j:
                todo &= own != own[x]
            todo &= ~(bands[:, :band] == bands[x, :band]).any(axis=1)  # pairs that have met in an earlier band
            if not todo.any():
                continue
            which = np.flatnonzero(todo)
            if len(which) < 64:
                common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in which.tolist()])
                hits = which[linked(common, n[which], n[x], threshold)]
                a_ += [node[x]] * len(hits)
                b_ += [node[y] for y in hits.tolist()]
                continue
            mine = place[at[x]:at[x + 1]]
            width = first[mine + 1] - first[mine]
            posting = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum()))
            common = np.bincount(owner_by[posting], minlength=len(rows))
            for y in np.flatnonzero(todo & linked(common, n, n[x], threshold)).tolist():
                a_.append(node[x])
                b_.append(node[y])
        if a_:
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHashes(), []
        for batch in sliced(batches, "text"):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and row[:3] != rows[0][:3]:
                    yield from compare(rows, hashes)
                    rows = []
                rows.append(row)
        if rows:
            yield from compare(rows, hashes)

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, key (`content_key` of the text), n_shingles, component_id (smallest id reachable over links of similarity >= threshold percent),
    component (names the component also where all ids are null; null for an empty set), kept (id = component_id): a row for each row
    of ``docs``."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    d = d.withColumn("key", content_key(F.col("text")))
    profiles = cut_lineage(d.mapInArrow(_profiles(words, bands, rows), "id long, key binary, n long, node binary, bands array<long>"))
    # a class: all documents with the same set; null ids sort last
    last = F.lit((1 << 63) - 1).cast("long")
    classes = cut_lineage(profiles.filter("n > 0").groupBy("node").agg(
        F.min(F.coalesce("id", last)).alias("value"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.min("key").alias("key")))
    in_bucket = classes.select("node", "n", F.explode("bands").alias("bucket"))
    hubs = in_bucket.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut_lineage(in_bucket.join(hubs.drop("size"), "bucket"))
    may_link = lambda a, b: 100 * F.least(a, b) >= threshold * F.greatest(a, b)
    pairs = members.filter((F.col("node") != F.col("hub.node")) & may_link(F.col("n"), F.col("hub.n"))).select(
        F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    shared = members.select("node").distinct()
    texts = _class_texts(d, classes.join(shared, "node", "left_semi").select("node", "key"))
    links = _confirmed(pairs, texts, words, threshold)
    nodes = classes.select("node", "value")
    labels = cut_lineage(smallest_reachable(nodes, links))

    # members of one bucket that are still apart; hubs have met everyone
    placed = members.join(labels.select("node", F.col("label.node").alias("group")), "node")
    mixed = placed.groupBy("bucket").agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count(F.lit(1)).alias("size")).filter("g1 <> g2")
    placed = cut_lineage(placed.filter(F.col("node") != F.col("hub.node")).join(mixed.select("bucket", "size"), "bucket").select(
        "bucket", "node", "n", "group", "size"))
    few = placed.filter(F.col("size") <= SMALL_BUCKET)
    x = few.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("group").alias("ga"))
    y = few.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("group").alias("gb"))
    rest = x.join(y, "bucket").filter((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & may_link(F.col("na"), F.col("nb")))
    more = _confirmed(rest.select("a", "b").distinct(), texts, words, threshold)
    many = placed.filter(F.col("size") > SMALL_BUCKET).drop("size").join(classes.select("node", "bands"), "node").join(texts, "node")
    more = more.unionByName(_block_links(many, words, threshold))
    if not more.isEmpty():  # else the components stand
        labels = cut_lineage(smallest_reachable(nodes, links.unionByName(more)))
    group = labels.select("node", F.nullif(F.col("label.value"), last).alias("smallest"), F.col("label.node").alias("component"))
    out = profiles.select("id", "key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(group, "node", "left")
    smallest = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id"))
    return out.select("id", "key", F.col("n").alias("n_shingles"), smallest.alias("component_id"), "component",
                      F.col("id").eqNullSafe(smallest).alias("kept"))


def _class_texts(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text: one text of each wanted class (node, key of that text). Equal texts meet before they are shuffled."""
    texts = d.select("key", "text").groupBy("key").agg(F.first("text").alias("text"))
    return cut_lineage(texts.join(wanted, "key").select("node", "text"))
