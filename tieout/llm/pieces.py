"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's pieces are the segmentation with the largest sum of piece scores (ties: the longest last piece). Blanks are part of
pieces, one blank is put in front, and characters without a piece become byte pieces, so decoding gives the text back exactly.

No piece goes across the place before a blank that follows another character, or next to a line feed (checked when a
vocabulary is loaded): such places are **cuts**, the best segmentation between two cuts depends on that part alone, and
parts are words that repeat and are remembered.

Texts beyond ``CHUNK`` characters are split into chunks of that size, wherever that falls, and go over the cluster:

1. Each chunk yields its transfer matrix: M[a, b] is the best score of the chunk if its first a characters belong to a piece
   begun before, and its last piece goes on b characters beyond it. The pieces between its cuts are kept, they are final.
2. Matrices are multiplied in max-plus algebra in groups of ``GROUP`` neighbours, the products again, and so on; from the top the best score of
   every state is carried down to the start of each group, and of each chunk. No task goes through a whole text.
3. With these scores a chunk knows, for each state at its end, the state at its start. These maps are composed from the end by the
   same scan, which fixes the states.
4. Each chunk traces its own pieces back, independently. Scores are whole numbers, so the result equals the one-pass search.

A chunk with a cut has a matrix of rank one; one without (a long run without blanks) has a full one.

Defined results: a null or empty text has no pieces, and decodes to the empty text. Rows are carried through; very long texts are
keyed by a 128-bit content hash, so repeated rows, null ids and further columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import beside, carried, content_key, sliced, with_text

CHUNK = 1 << 15
#: neighbouring chunks whose matrices are combined at once
GROUP = 32
_CACHE_WORDS = 250_000
_SHORT = 32
_PARTS_AT_ONCE = 100_000
_NEVER = float("-inf")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: parts between cuts: blanks and what follows them, or a line feed
_PART = re.compile(r" *[^ \n]+| +|\n")


@dataclass
class Vocabulary:
    """Pieces of a model file, blanks as blanks."""

    ids: dict[str, int]
    scores: dict[str, float]
    data: list[bytes]  # of each id
    byte_ids: list[int]
    longest: int
    unknown: float
    _hashes: tuple | None = None

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, data, byte_ids = {}, {}, [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                data.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                data.append(b"")
            else:
                piece = piece.replace("▁", " ")
                ids[piece], scores[piece] = i, sp.get_score(i)
                data.append(piece.encode())
        if any(" " in p.lstrip(" ") or "\n" in p for p in ids):
            raise ValueError("pieces go across blanks or line feeds: there are no cuts between words")
        out = Vocabulary(ids, scores, data, byte_ids, max(map(len, ids)), min(scores.values()) - 10)
        out._table()
        return out

    def search(self, text: str, first: list[float], end: int) -> tuple[list[float], list[int]]:
        """Best score of the segmentations up to each place, and where their last piece starts (-1: before the text).
        ``first``: scores of the states at the start, one for each number of characters already taken. Pieces start before ``end``."""
        n = len(text)
        best, origin = [_NEVER] * (n + 1), [-1] * (n + 1)
        best[:len(first)] = first[:n + 1]
        scores, longest = self.scores, self.longest
        for i in range(end):
            base = best[i]
            if base == _NEVER:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                s = scores.get(text[i:j])
                if s is None:
                    if j > i + 1:
                        continue
                    s = self.unknown
                if base + s > best[j]:
                    best[j], origin[j] = base + s, i
        return best, origin

    def trace(self, text: str, origin: list[int], at: int) -> tuple[list[int], int]:
        """Ids of the pieces that end at ``at``, back to the place where the pieces of this text begin."""
        parts: list[list[int]] = []
        while at > 0 and origin[at] >= 0:
            piece = text[origin[at]:at]
            i = self.ids.get(piece)
            parts.append([i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")])
            at = origin[at]
        return [i for p in reversed(parts) for i in p], at

    def best(self, text: str) -> tuple[float, bytes]:
        """Score and ids (4 bytes each) of a text that is searched on its own."""
        best, origin = self.search(text, [0.0], len(text))
        return best[-1], np.array(self.trace(text, origin, len(text))[0], np.int32).tobytes()

    def best_of_many(self, parts: list[str]) -> list[tuple[float, bytes]]:
        """`best` of many short parts of one length at once: the same search, a column of places at a time. Substrings are looked up
        by a 64-bit hash. Parts with a character that has no piece are searched one by one."""
        count, n = len(parts), len(parts[0])
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, n).T.astype(np.uint64)
        codes, score_of, id_of, starts, deepest = self._table()
        longest = min(self.longest, n)
        score, piece = np.full((longest, n, count), _NEVER), np.full((longest, n, count), -1, np.int32)
        h = np.zeros_like(chars)
        for size in range(1, longest + 1):
            h = (h[:n - size + 1] + chars[size - 1:]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            at = starts[h >> np.uint64(46)]
            for _ in range(deepest):  # within a bucket the hashes are sorted
                at = at + (codes[at] < h)
            hit = codes[at] == h
            score[size - 1, :n - size + 1] = np.where(hit, score_of[at], _NEVER)
            piece[size - 1, :n - size + 1] = np.where(hit, id_of[at], -1)
        strange = (piece[0] < 0).any(axis=0)
        best, taken = np.full((n + 1, count), _NEVER), np.zeros((n + 1, count), np.int64)
        best[0] = 0
        for end in range(1, n + 1):
            for size in range(min(longest, end), 0, -1):  # longer last pieces first: they keep ties
                s = best[end - size] + score[size - 1, end - size]
                better = s > best[end]
                best[end][better] = s[better]
                taken[end][better] = size
        ids, used = np.zeros((count, n), np.int32), np.zeros(count, np.int64)
        place, rows = np.full(count, n), np.flatnonzero(~strange)
        while len(rows):
            size = taken[place[rows], rows]
            place[rows] -= size
            used[rows] += 1
            ids[rows, n - used[rows]] = piece[size - 1, place[rows], rows]
            rows = rows[place[rows] > 0]
        return [self.best(p) if odd else (b, ids[i, n - u:].tobytes())
                for i, (p, odd, b, u) in enumerate(zip(parts, strange.tolist(), best[n].tolist(), used.tolist(), strict=True))]

    def _table(self) -> tuple:
        """Sorted piece hashes with their scores and ids, and where the hashes with the same upper bits begin."""
        if self._hashes is None:
            rows = [((1 << 64) - 1, _NEVER, -1)]
            for p, i in self.ids.items():
                h = np.zeros(1, np.uint64)
                for c in p:
                    h = (h + np.uint64(ord(c))) * _MULTIPLIER
                    h ^= h >> np.uint64(29)
                rows.append((int(h[0]), self.scores[p], i))
            rows.sort()
            codes = np.array([r[0] for r in rows], np.uint64)
            starts = np.searchsorted(codes, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46))
            starts[-1] = len(codes)
            self._hashes = (codes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int32), starts[:-1].astype(np.int32),
                            int(np.diff(starts).max()))
        return self._hashes

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Words(dict):
    """Part between two cuts -> (score, ids); forgets all when full. Long parts are not kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, part: str) -> tuple[float, bytes]:
        found = self.vocabulary.best(part)
        if len(part) <= _SHORT and len(self) < _CACHE_WORDS:
            self[part] = found
        return found

    def learn(self, parts: list[str]) -> None:
        """Search all short parts that are not remembered yet, together."""
        fresh = [p for p in dict.fromkeys(parts) if p not in self and len(p) <= _SHORT]
        if len(self) + len(fresh) > _CACHE_WORDS:
            self.clear()
            fresh = [p for p in dict.fromkeys(parts) if len(p) <= _SHORT][:_CACHE_WORDS]
        fresh.sort(key=len)
        for _, same in groupby(fresh, len):
            same = list(same)
            for at in range(0, len(same), 4096):
                some = same[at:at + 4096]
                self.update(zip(some, self.vocabulary.best_of_many(some), strict=True))


def encode_texts(words: Words, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text. Null is empty. Texts are taken together until they have ``_PARTS_AT_ONCE`` parts."""
    out: list[np.ndarray] = []
    waiting: list[list[str]] = []
    held = 0
    for i, text in enumerate(texts):
        waiting.append(_PART.findall(" " + text) if text else [])
        held += len(waiting[-1])
        if held >= _PARTS_AT_ONCE or i == len(texts) - 1:
            words.learn(list(chain.from_iterable(waiting)))
            out += [np.frombuffer(b"".join([words[p][1] for p in parts]), np.int32) for parts in waiting]
            waiting, held = [], 0
    return out


class Chunk:
    """One chunk: ``body`` and the characters ``ahead`` that a last piece may reach; ``before`` is the character before it."""

    def __init__(self, words: Words, before: str, body: str, ahead: str) -> None:
        self.words, self.v, self.body, self.text = words, words.vocabulary, body, body + ahead
        self.last = not ahead
        cut = lambda i: i > 0 and self._cut(self.text[i - 1], self.text[i]) or i == 0 and bool(before) and self._cut(before, self.text[0])
        n = len(body)
        self.first_cut = next((i for i in range(n) if cut(i)), None)
        self.last_cut = None if self.first_cut is None else next(i for i in range(n - 1, -1, -1) if cut(i))

    @staticmethod
    def _cut(a: str, b: str) -> bool:
        return a == "\n" or b == "\n" or (b == " " and a != " ")

    def _middle(self) -> list[tuple[float, bytes]]:
        parts = _PART.findall(self.body[self.first_cut:self.last_cut])
        self.words.learn(parts)
        return [self.words[p] for p in parts]

    def _exits(self, best: list[float], n: int) -> list[float]:
        out = best[n:n + self.v.longest]
        return out + [_NEVER] * (self.v.longest - len(out))

    def transfer(self) -> tuple[np.ndarray, bytes]:
        """The matrix M[a, b], and the ids of the pieces between the first cut and the last: they depend on nothing else."""
        size, n = self.v.longest, len(self.body)
        unit = [[0.0 if x == a else _NEVER for x in range(size)] for a in range(size)]
        if self.first_cut is None:
            return np.array([self._exits(self.v.search(self.text, unit[a], n)[0], n) for a in range(size)]), b""
        head = [self.v.search(self.text[:self.first_cut], unit[a], self.first_cut)[0][-1] if a <= self.first_cut else _NEVER for a in range(size)]
        tail = self._exits(self.v.search(self.text[self.last_cut:], [0.0], n - self.last_cut)[0], n - self.last_cut)
        middle = self._middle()
        return np.add.outer(np.array(head), np.array(tail)) + sum(s for s, _ in middle), b"".join(ids for _, ids in middle)

    def entries(self, scores: list[float]) -> list[int]:
        """For each state at the end the state at the start that its best path comes from."""
        n, size = len(self.body), self.v.longest
        if self.first_cut is not None:
            text, end, ends = self.text[:self.first_cut], self.first_cut, [self.first_cut] * size
        else:
            text, end, ends = self.text, n, [min(n + b, len(self.text)) for b in range(size)]
        _, origin = self.v.search(text, scores, end)
        return [min(self.v.trace(text, origin, e)[1], size - 1) for e in ends]  # states that no path reaches lead anywhere

    def pieces(self, scores: list[float], state: int, middle: bytes) -> bytes:
        """Ids of the pieces that start in the chunk, given the scores at its start, the state at its end and the ids between its cuts."""
        n = len(self.body)
        if self.first_cut is None:
            _, origin = self.v.search(self.text, scores, n)
            return np.array(self.v.trace(self.text, origin, n + state)[0], np.int32).tobytes()
        head = self.text[:self.first_cut]
        _, origin = self.v.search(head, scores, len(head))
        before = np.array(self.v.trace(head, origin, len(head))[0], np.int32).tobytes()
        tail = self.text[self.last_cut:]
        _, origin = self.v.search(tail, [0.0], n - self.last_cut)
        after = np.array(self.v.trace(tail, origin, n - self.last_cut + state)[0], np.int32).tobytes()
        return before + middle + after


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in max-plus algebra (associative)."""
    return (a[..., :, None] + b).max(axis=-2)


_CHUNK = "key binary, no int, before string, body string, ahead string"


def _chunks(size: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "no", "before", "body", "ahead"]
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                key, text = key.as_py(), " " + text.as_py()
                for no, at in enumerate(range(0, len(text), size)):
                    row = [key], [no], [text[max(0, at - 1):at]], [text[at:at + size]], [text[at + size:at + size + longest - 1]]
                    kinds = (pa.binary(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=names)

    return run


def _each_chunk(shared, work, kinds: dict[str, pa.DataType]):
    """``work`` on each chunk -> key, no and the columns ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in sliced(batches, "body"):
            made = list(zip(*(work(Chunk(words, r["before"], r["body"], r["ahead"]), r) for r in batch.to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), *(pa.array(c, k) for c, k in zip(made, kinds.values(), strict=True))],
                                             names=["key", "no", *kinds])

    return run


def _grouped(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    rows = zip(table.column("no").to_pylist(), table.column("value"), strict=True)
    return sorted(((no, v.values.to_numpy(zero_copy_only=False)) for no, v in rows), key=lambda r: r[0])


def _product(multiply):
    """The rows of one group -> their product."""

    def run(table: pa.Table) -> pa.Table:
        rows = _grouped(table)
        out = rows[0][1]
        for _, v in rows[1:]:
            out = multiply(out, v)
        return pa.table([table.column("key").slice(0, 1), pa.array([rows[0][0] // table.column("width")[0].as_py()], pa.int32()), pa.array([out], pa.list_(pa.float64()))],
                        names=["key", "no", "value"])

    return run


def _expansion(act):
    """The rows of one group and the state before it -> the state before each row."""

    def run(table: pa.Table) -> pa.Table:
        rows, out = _grouped(table), []
        state = table.column("state")[0].values.to_numpy(zero_copy_only=False)
        for _, v in rows:
            out.append(state)
            state = act(state, v)
        key = pa.array([table.column("key")[0].as_py()] * len(rows), pa.binary())
        return pa.table([key, pa.array([no for no, _ in rows], pa.int32()), pa.array(out, pa.list_(pa.float64()))], names=["key", "no", "state"])

    return run


def parallel_scan(rows: DataFrame, multiply, act, start: list[float], width: int) -> DataFrame:
    """State before each row of every sequence, by an associative scan. rows: key, no (from 0), value. Values are combined by ``multiply`` in
    groups of ``width`` neighbours, these again, until one group is left of each sequence; from there ``act`` carries the state ``start``
    into the groups, level by level. No task sees more than ``width`` values of a sequence at once."""
    group = (F.col("no") / width).cast("int")
    levels = [rows.select("key", "no", "value")]
    while not levels[-1].filter(F.col("no") >= width).isEmpty():
        level = levels[-1].withColumn("width", F.lit(width)).groupBy("key", group.alias("group")).applyInArrow(_product(multiply), "key binary, no int, value array<double>")
        levels.append(cut_lineage(level))
    above = None
    for level in reversed(levels):
        if above is None:
            told = level.withColumn("state", F.array(*map(F.lit, start)).cast("array<double>"))
        else:
            above = above.select("key", F.col("no").alias("group"), "state")
            told = level.withColumn("group", group).join(above, ["key", "group"])
        above = told.groupBy("key", group.alias("part")).applyInArrow(_expansion(act), "key binary, no int, state array<double>")
    return above


def _times(longest: int):
    def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return max_plus(a.reshape(longest, longest), b.reshape(longest, longest)).ravel()

    def act(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        return max_plus(v, m.reshape(longest, longest))

    return multiply, act


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The map (or state) a, then the map b."""
    return b[a.astype(np.int64)]


def _long_texts(texts: DataFrame, shared, longest: int, size: int) -> DataFrame:
    """key, parts (ids of the chunks in order, 4 bytes each) of the distinct very long texts (key, text)."""
    chunks = cut_lineage(texts.mapInArrow(_chunks(size, longest), _CHUNK).repartition("key", "no"))

    def transfer(c: Chunk, r: dict) -> tuple:
        m, middle = c.transfer()
        return m.ravel().tolist(), middle

    searched = cut_lineage(chunks.mapInArrow(_each_chunk(shared, transfer, {"value": pa.list_(pa.float64()), "middle": pa.binary()}),
                                             "key binary, no int, value array<double>, middle binary"))
    start = [0.0] + [_NEVER] * (longest - 1)
    scores = cut_lineage(parallel_scan(searched, *_times(longest), start, GROUP).withColumnRenamed("state", "scores"))
    entries = chunks.join(scores, ["key", "no"]).mapInArrow(
        _each_chunk(shared, lambda c, r: (c.entries(r["scores"]),), {"value": pa.list_(pa.float64())}), "key binary, no int, value array<double>")
    last = chunks.groupBy("key").agg(F.max("no").alias("last"))
    turned = cut_lineage(entries.join(last, "key").select("key", (F.col("last") - F.col("no")).alias("no"), "value", "last"))
    states = parallel_scan(turned, _then, _then, [0.0], GROUP).join(last, "key")
    states = states.select("key", (F.col("last") - F.col("no")).alias("no"), F.col("state")[0].cast("int").alias("state"))
    told = chunks.join(scores, ["key", "no"]).join(states, ["key", "no"]).join(searched.select("key", "no", "middle"), ["key", "no"])
    ids = told.mapInArrow(_each_chunk(shared, lambda c, r: (c.pieces(r["scores"], r["state"], r["middle"]),), {"data": pa.binary()}), "key binary, no int, data binary")
    # one text's ids make one row of the result, as its text is one row of the input
    listed = ids.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "data"))).alias("parts"))
    return listed.select("key", F.col("parts.data").alias("parts"))


def _id_lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0, np.int32), pa.int32()))


def _encoder(shared, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in with_text(batches, text):
            ids = encode_texts(words, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), _id_lists(ids)], names=[*names, "ids"])

    return run


def _joined(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(parts), np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), _id_lists(ids)], names=[*names, "ids"])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The ``keep`` columns (all by default) in the struct ``row``, then text (null is empty) and ids. ``model``: path of a model file; it
    is read here and broadcast (its size is the vocabulary's)."""
    vocabulary = Vocabulary.load(model or default_model())
    if chunk < vocabulary.longest:
        raise ValueError("a chunk must be at least as long as the longest piece")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    keep = docs.columns if keep is None else keep
    rows = carried(docs, keep, text)
    own = F.coalesce(beside(rows, text), F.lit(""))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    short = rows.filter(F.length(own) <= chunk).mapInArrow(_encoder(shared, text, names), schema)
    long = rows.filter(F.length(own) > chunk).withColumn("key", content_key(own))
    distinct = long.groupBy("key").agg(F.first(own).alias("text"))
    ids = _long_texts(distinct, shared, vocabulary.longest, chunk)
    out = short.unionByName(long.join(ids, "key").select(*names, "parts").mapInArrow(_joined(names), schema))
    return out.select("row", own.alias("text"), "ids")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Rows of `encode` with the column ``decoded``: the text that the ids give."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in sliced(batches, "text"):
            texts = [v.decode(ids.values.to_numpy().tolist()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
