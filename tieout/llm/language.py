"""Language identification by a linear-chain conditional random field over words.

Every word (a run without white space that has a letter) gets a language label. A word's features come from its letters in
lower case: prefixes and suffixes, character n-grams and, if it is in the lexicon (words seen in at least
``LEXICON_ROWS`` training passages), the word itself. Transitions between the
labels of neighbouring words are learned too, from passages of several languages put together, so code-switched text
keeps its runs. Forward-backward gives each word's label probabilities; a text's language has the largest mean.

Training is bounded by ``PASSAGES`` passages of ``PASSAGE_WORDS`` words for each language, drawn by a hash of the text from
all labelled rows. The model is at most ``MAX_FEATURES`` rows and is broadcast. Prediction sees the text only.

Forward-backward runs over blocks of words: each block's transfer matrix first, then the messages between blocks of a text, then
the words inside. A very long text is many blocks, and memory is a few numbers a word.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the first language in order; without
any training row every text is ``und``. Rows are carried through, so repeated rows, null ids and further columns do not
matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, with_text

PASSAGES, PASSAGE_WORDS = 500, 60
MAX_FEATURES = 60_000
LEXICON_ROWS = FEATURE_ROWS = 3
BLOCK = 64
GROUP_WORDS = 100_000
_CACHE_WORDS = 300_000
_SPACED = re.compile(r"\S+")
_NO_LETTER = re.compile(r"[\W\d_]+")
_SLOT_BITS = 20
_BIGRAM, _TRIGRAM, _PREFIX, _SUFFIX, _WORD = 1, 2, 3, 6, 9


def letters(token: str) -> str:
    """The letters of a token in lower case; empty if it has none."""
    if token.isalpha():
        return token.lower()
    if token[:-1].isalpha() and not token[-1].isalnum():  # a word and its full stop
        return token[:-1].lower()
    w = _NO_LETTER.sub("", token).lower()
    return w if any(map(str.isalpha, w)) else ""


def _mixed_code(code: np.ndarray, kind: int) -> np.ndarray:
    h = (code ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def feature_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the features of all words, and the word that each belongs to."""
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(words)), size)
    s21, s42 = np.uint64(21), np.uint64(42)
    two = flat[:-1] | flat[1:] << s21
    three = two[:-1] | flat[2:] << s42
    codes, owners = [], []

    def add(code: np.ndarray, kind: int, of: np.ndarray) -> None:
        codes.append(_mixed_code(code, kind))
        owners.append(of)

    inside = owner[:-1] == owner[1:]
    add(two[inside], _BIGRAM, owner[:-1][inside])
    inside = owner[:-2] == owner[2:]
    add(three[inside], _TRIGRAM, owner[:-2][inside])
    for n in (1, 2, 3):
        long = np.flatnonzero(size - 2 > n)
        for kind, at in ((_PREFIX, first[long] + 1), (_SUFFIX, first[long] + size[long] - 1 - n)):
            code = flat[at].copy()
            for j in range(1, n):
                code |= flat[at + j] << np.uint64(21 * j)
            add(code, kind + n - 1, long)
    with np.errstate(over="ignore"):
        place = (np.arange(len(flat)) - first[owner]).astype(np.uint64)
        whole = np.add.reduceat(_mixed_code(flat | place << np.uint64(32), _WORD), first)
    add(whole, _WORD, np.arange(len(words)))
    return np.concatenate(codes), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # of the features
    weights: np.ndarray  # feature x language
    transitions: np.ndarray  # language before x language

    def __post_init__(self) -> None:
        self._slots = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_slots": None}

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each feature code, -1 for unknown ones."""
        if self._slots is None:  # features are listed by frequency: of two in one slot the more frequent one stays
            slot, row = np.unique(self.codes >> np.uint64(64 - _SLOT_BITS), return_index=True)
            self._slots = np.full(1 << _SLOT_BITS, -1, np.int32)
            self._slots[slot] = row
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        row = self._slots[codes >> np.uint64(64 - _SLOT_BITS)]
        return np.where(self.codes[row] == codes, row, -1)

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature row, word) for every known feature of the words."""
        codes, owner = feature_codes(words)
        row = self.rows(codes)
        there = row >= 0
        return row[there], owner[there]

    def emissions(self, words: list[str]) -> np.ndarray:
        row, owner = self.known(words)
        return np.stack([np.bincount(owner, weights=self.weights[row, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One passage of each text, at a place chosen by the text's hash."""
    for batch in batches:
        langs, order, passages = [], [], []
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            text = text.as_py()
            words = [w for t in text.split() if (w := letters(t))]
            if words:
                h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                at = h % max(1, len(words) - PASSAGE_WORDS + 1)
                langs.append(lang.as_py())
                order.append(h - (1 << 63))
                passages.append(" ".join(words[at:at + PASSAGE_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(order, pa.int64()), pa.array(passages, pa.string())],
                                         names=["lang", "at", "passage"])


def sample_passages(labelled: DataFrame, per_language: int = PASSAGES) -> dict[str, list[list[str]]]:
    """language -> at most ``per_language`` passages. ``labelled``: lang, text, without nulls. Texts are thinned by a hash to about
    twice the bound before anything is cut or sent."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * per_language / n)))])
    chosen = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    out: dict[str, list] = {}
    for r in chosen.select("lang", "text").mapInArrow(_training_rows, "lang string, at long, passage string").collect():
        out.setdefault(r["lang"], []).append((r["at"], r["passage"]))
    return {lang: [p.split() for _, p in sorted(rows)[:per_language]] for lang, rows in sorted(out.items())}


def _mixed(passages: dict[str, list[list[str]]], length: int, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Training sequences: runs of 4 to 40 words of changing languages, cut to one length."""
    streams = {k: [w for p in (rows[i] for i in rng.permutation(len(rows))) for w in p] for k, rows in enumerate(passages.values())}
    at = dict.fromkeys(streams, 0)
    words: list[str] = []
    labels: list[int] = []
    while streams:
        k = int(rng.choice(list(streams)))
        n = int(rng.integers(4, 41))
        part = streams[k][at[k]:at[k] + n]
        words += part
        labels += [k] * len(part)
        at[k] += n
        if at[k] >= len(streams[k]):
            del streams[k]
    n = max(1, len(words) // length)
    words = (words * length)[:n * length]
    labels = (labels * length)[:n * length]
    return [words[i * length:(i + 1) * length] for i in range(n)], np.array(labels).reshape(n, length)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(passages: dict[str, list[list[str]]], epochs: int = 4, rate: float = 0.05, seed: int = 7) -> Model:
    """Maximum likelihood by Adam on the exact gradient of forward-backward."""
    seen = [np.unique(feature_codes(p)[0]) for rows in passages.values() for p in rows]
    codes, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.uint64), np.empty(0, int))
    often = np.flatnonzero(n >= FEATURE_ROWS)
    codes = codes[often[np.argsort(-n[often], kind="stable")]][:MAX_FEATURES]
    k, length = len(passages), 30
    model = Model(list(passages), codes, np.zeros((len(codes), k)), np.zeros((k, k)))
    if k < 2 or not len(codes):
        return model
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.transitions)]
    t = 0
    for _ in range(epochs):
        sequences, gold = _mixed(passages, length, rng)
        for at in range(0, len(sequences), 64):
            y = gold[at:at + 64]
            n = len(y)
            flat, owner = model.known([w for s in sequences[at:at + 64] for w in s])
            e = np.stack([np.bincount(owner, weights=model.weights[flat, j], minlength=n * length) for j in range(k)], axis=1).reshape(n, length, k)
            a = np.empty((n, length, k))
            b = np.zeros((n, length, k))
            a[:, 0] = e[:, 0]
            for i in range(1, length):
                a[:, i] = _log_sum(a[:, i - 1][:, :, None] + model.transitions, 1) + e[:, i]
            for i in range(length - 2, -1, -1):
                b[:, i] = _log_sum(model.transitions + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            z = _log_sum(a[:, -1], 1)
            one = np.exp(a + b - z[:, None, None])
            two = np.exp(a[:, :-1, :, None] + model.transitions + (e + b)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
            np.put_along_axis(one, y[:, :, None], np.take_along_axis(one, y[:, :, None], 2) - 1, 2)
            np.subtract.at(two, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            flat_grad = one.reshape(-1, k)[owner]
            grad = np.stack([np.bincount(flat, weights=flat_grad[:, j], minlength=len(codes)) for j in range(k)], axis=1)
            t += 1
            for p, g, (m, v) in zip((model.weights, model.transitions), (grad / n + 1e-3 * model.weights, two / n), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return model


class Labeller:
    """Label probabilities of the words of several texts at once."""

    def __init__(self, model: Model) -> None:
        self.model, self.row_of = model, {}
        self.table = np.empty((0, len(model.languages)), np.float32)
        self.step = np.exp(model.transitions - model.transitions.max(initial=-np.inf)).astype(np.float32)

    def potentials(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """exp of the emission scores of the tokens with a letter, scaled for each, and whether each token has one.
        Kept for the tokens seen last, forgotten when full."""
        fresh = [t for t in dict.fromkeys(tokens) if t not in self.row_of]
        if len(self.row_of) + len(fresh) > _CACHE_WORDS:
            self.row_of, self.table = {}, self.table[:0]
            fresh = list(dict.fromkeys(tokens))
        words = [(t, w) for t in fresh if (w := letters(t))]
        self.row_of.update(dict.fromkeys(fresh, -1))
        if words:
            e = self.model.emissions([w for _, w in words])
            e = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -12)).astype(np.float32)
            n = len(self.table)
            self.row_of.update(zip((t for t, _ in words), range(n, n + len(words)), strict=True))
            self.table = np.concatenate([self.table, e])
        row = np.fromiter(map(self.row_of.__getitem__, tokens), np.int64, len(tokens))
        return self.table[row[row >= 0]], row >= 0

    def probabilities(self, potentials: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward for texts of ``sizes`` words that stand one after the other. States come first in all arrays, so
        each step is one small matrix product over all blocks. Scaled every few steps."""
        k, step = potentials.shape[1], self.step
        n_blocks = -(-sizes // BLOCK)
        text_first = np.concatenate([[0], np.cumsum(n_blocks)])
        total = int(text_first[-1])
        doc = np.repeat(np.arange(len(sizes)), n_blocks)
        number = np.arange(total) - text_first[doc]
        offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])[doc] + number * BLOCK
        length = np.minimum(BLOCK, sizes[doc] - number * BLOCK)
        real = np.arange(BLOCK)[:, None] < length
        at = np.minimum(offset + np.arange(BLOCK)[:, None], len(potentials) - 1)
        e = np.where(real[:, None], potentials.T[:, at].transpose(1, 0, 2), np.float32(1))  # place, state, block
        opening = np.where(number == 0, np.float32(1), step[:, :, None])  # a text's first word has no word before
        one = lambda x, axes: x / x.max(axis=axes, keepdims=True)
        # transfer matrix of each block: to, from, block
        m = opening.transpose(1, 0, 2) * e[0][:, None]
        for t in range(1, BLOCK):
            new = (step.T @ m.reshape(k, -1)).reshape(k, k, total) * e[t][:, None]
            m = np.where(real[t], one(new, (0, 1)) if t % 4 == 0 else new, m)
        m = one(m, (0, 1))
        # messages between the blocks of a text
        into, out_of = np.ones((k, total), np.float32), np.ones((k, total), np.float32)
        for i in range(1, int(n_blocks.max(initial=1))):
            long = n_blocks > i
            b = text_first[:-1][long] + i
            into[:, b] = one(np.einsum("jib,ib->jb", m[:, :, b - 1], into[:, b - 1]), 0)
            last = text_first[1:][long] - 1 - i
            out_of[:, last] = one(np.einsum("jib,jb->ib", m[:, :, last + 1], out_of[:, last + 1]), 0)
        # words inside the blocks
        forward = np.empty((BLOCK, k, total), np.float32)
        forward[0] = np.einsum("ijb,ib->jb", opening, into) * e[0]
        for t in range(1, BLOCK):
            new = (step.T @ forward[t - 1]) * e[t]
            forward[t] = one(new, 0) if t % 4 == 0 else new
        back = out_of
        for t in range(BLOCK - 1, -1, -1):
            forward[t] *= back
            new = step @ (e[t] * back)
            back = np.where(real[t], one(new, 0) if t % 4 == 0 else new, back)
        out = forward.transpose(2, 0, 1)[real.T].astype(np.float64)
        return out / out.sum(axis=1, keepdims=True)

    def texts(self, tokens: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of the words (tokens with a letter) of each text."""
        potentials, is_word = self.potentials([w for t in tokens for w in t])
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        sizes = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(is_word)])[ends]]))
        return np.split(self.probabilities(potentials, sizes), np.cumsum(sizes)[:-1]) if len(potentials) else [np.empty((0, 1))] * len(tokens)

    def long_text(self, text: str) -> np.ndarray:
        """One text of any length: words are turned into potentials bit by bit."""
        tokens = (m.group() for m in _SPACED.finditer(text))
        parts = []
        while some := list(islice(tokens, GROUP_WORDS)):
            parts.append(self.potentials(some)[0])
        p = np.concatenate(parts) if parts else np.empty((0, 1))
        return self.probabilities(p, np.array([len(p)])) if len(p) else p


def word_labels(model: Model, text: str) -> list[tuple[str, str]]:
    """(word, language) for each word of one text."""
    tokens = text.split()
    words = [t for t in tokens if letters(t)]
    return [(w, model.languages[k]) for w, k in zip(words, Labeller(model).texts([tokens])[0].argmax(axis=1), strict=True)]


def _predictor(shared, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labeller = Labeller(model)

        def best(p: np.ndarray) -> tuple[str, float]:
            if not len(p):
                return "und", 0.0
            mean = p.mean(axis=0)
            k = int(mean.argmax())
            return model.languages[k], min(1.0, float(mean[k]))

        for batch in with_text(batches, text_column):
            found: list[tuple[str, float]] = [("und", 0.0)] * batch.num_rows
            group: list[tuple[int, list[str]]] = []
            held = 0
            for i, t in enumerate(batch.column("text")):
                text = t.as_py()
                if text and model.languages:
                    if len(text) > 8 * GROUP_WORDS:
                        found[i] = best(labeller.long_text(text))
                    else:
                        group.append((i, text.split()))
                        held += len(group[-1][1])
                if group and (held >= GROUP_WORDS or i == batch.num_rows - 1):
                    for (j, _), p in zip(group, labeller.texts([w for _, w in group]), strict=True):
                        found[j] = best(p)
                    group, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([b[0] for b in found], pa.string()),
                                              pa.array([b[1] for b in found], pa.float64())], names=["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) in the struct ``row``, then lang_pred and score (0 to 1)."""
    keep = docs.columns if keep is None else keep
    rows = carried(docs, keep, text)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model), text), f"row {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Documents that training never sees. A null id is not held out, and not learned from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """A model from the labelled documents (doc_id, text, lang) that are not held out."""
    labelled = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return train(sample_passages(labelled))
