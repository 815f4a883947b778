"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model over the presence of words and a few shares of
characters; the probabilities of the categories before it are further inputs. In training these are **out-of-fold**: each row's
probability comes from a model that has not seen the row (folds by a hash of the text, so copies share a fold). In
prediction they come from the model trained on all rows.

Training is bounded by ``MAX_ROWS`` labelled rows, thinned by a hash of the id; each model keeps at most ``MAX_WORDS`` words, those
whose presence differs most between the classes. The models are broadcast. Prediction is one map over whole texts.

Defined results: a null or empty text has no words and gets the models' base probability; rows with a null label are not
learned from; a category whose training rows are all of one kind gets its share for every row, no rows give 0. Repeated
rows and null ids are carried through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import letters

MAX_ROWS, MAX_WORDS, FOLDS = 4000, 3000, 3
MIN_ROWS, MIN_Z = 4, 3.0
_CACHE_WORDS = 300_000
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((range(65, 91), range(48, 58), b"#*$%&|<>", b"!?"), 1):
    _CLASS[list(_chars)] = _i
DENSE = 5


class WordCodes(dict):
    """Token -> 62-bit code of its letters, -1 without letters; forgets all when full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        w = letters(token)
        code = self[token] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 2 if w else -1
        return code


def shares(text: str) -> list[float]:
    """Shares of upper case, digits, symbols and exclamation among the bytes; repeated words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[data], minlength=5)[1:] / max(1, len(data))
    tokens = text.split()
    return [*n.tolist(), 1 - len(set(tokens)) / len(tokens) if tokens else 0.0]


@dataclass
class Linear:
    words: dict[int, float] = field(default_factory=dict)
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 2e-3) -> Linear:
    """Logistic regression by Adam on the words that tell the classes apart. ``rows``: word codes of each row, distinct."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    out = Linear(dense=np.zeros(dense.shape[1]))
    if not n1 or not n0:
        out.bias = 30.0 if n1 else -30.0
        return out
    codes, column = np.unique(np.concatenate(rows) if rows else np.empty(0, np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    total = np.bincount(column, minlength=len(codes))
    positive = np.bincount(column, weights=y[owner], minlength=len(codes))
    p = total / len(y)
    z = (positive / n1 - (total - positive) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[(total < MIN_ROWS) | (np.abs(z) < MIN_Z)] = 0
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:MAX_WORDS])
    chosen = chosen[z[chosen] != 0]
    place = np.full(len(codes), -1)
    place[chosen] = np.arange(len(chosen))
    there = place[column] >= 0
    column, owner = place[column][there], owner[there]
    w, d, b = np.zeros(len(chosen)), np.zeros(dense.shape[1]), np.log(n1 / n0)
    theta = np.concatenate([w, d, [b]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(chosen)
    for t in range(1, steps + 1):
        score = np.bincount(owner, weights=theta[:k][column], minlength=len(y)) + dense @ theta[k:-1] + theta[-1]
        e = (_sigmoid(score) - y) / len(y)
        g = np.concatenate([np.bincount(column, weights=e[owner], minlength=k), dense.T @ e, [e.sum()]])
        g[:-1] += ridge / len(y) * 10 * theta[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        theta -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    out.words = dict(zip(codes[chosen].tolist(), theta[:k].tolist(), strict=True))
    out.dense, out.bias = theta[k:-1], float(theta[-1])
    return out


def _scores(model: Linear, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    words = np.array([sum(model.words.get(c, 0.0) for c in r.tolist()) for r in rows])
    return _sigmoid(words + dense @ model.dense + model.bias)


def fit_chain(rows: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model for each column of ``labels``, in order; earlier out-of-fold probabilities are further dense inputs."""
    chain = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(fit(rows, dense, y))
        held = np.zeros(len(y))
        for f in np.unique(folds):
            use, rest = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            part = fit([rows[i] for i in use], dense[use], y[use]) if len(use) else chain[-1]
            held[rest] = _scores(part, [rows[i] for i in rest], dense[rest])
        dense = np.column_stack([dense, held])
    return chain


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes_of = WordCodes()
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([sorted(set(map(codes_of.__getitem__, t.split())) - {-1}) for t in texts], pa.list_(pa.int64())),
             pa.array([shares(t) for t in texts], pa.list_(pa.float64())),
             pa.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts], pa.int64()), batch.column("y")],
            names=["words", "dense", "fold", "y"])


def learn_chain(docs: DataFrame, labels: DataFrame, categories: dict, max_rows: int = MAX_ROWS) -> list[Linear]:
    """``categories``: name -> boolean column of ``labels``, in chain order. Only the drawn labels (their number is bounded) are
    broadcast to the documents."""
    y = F.array(*[c.cast("int") for c in categories.values()])
    known = labels.select(F.col("doc_id").alias("id"), y.alias("y")).filter("id IS NOT NULL AND NOT exists(y, v -> v IS NULL)")
    share = min(1.0, 1.2 * max_rows / max(1, known.count()))
    drawn = known.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 20))).filter(F.col("h") < share * (1 << 20))
    drawn = drawn.orderBy("h", "id").limit(max_rows).select("id", "y")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").select("text", "y").mapInArrow(
        _inputs, "words array<long>, dense array<double>, fold long, y array<int>").collect()
    if not rows:
        return [Linear(dense=np.zeros(DENSE + c), bias=-30.0) for c in range(len(categories))]
    rows.sort(key=lambda r: (r["fold"], r["dense"], r["words"], r["y"]))
    return fit_chain([np.array(r["words"], np.int64) for r in rows], np.array([r["dense"] for r in rows]), np.array([r["y"] for r in rows]),
                     np.array([r["fold"] for r in rows]))


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        known = sorted({c for m in chain for c in m.words})
        weights = np.array([[m.words.get(c, 0.0) for m in chain] for c in known]).reshape(len(known), len(chain))
        row_of = {c: i for i, c in enumerate(known)}
        codes_of = WordCodes()

        class Rows(dict):
            def __missing__(self, token: str) -> int:
                if len(self) >= _CACHE_WORDS:
                    self.clear()
                r = self[token] = row_of.get(codes_of.__missing__(token), -1)
                codes_of.clear()
                return r

        rows = Rows()
        for batch in batches:
            out = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                there = set(map(rows.__getitem__, text.split()))
                there.discard(-1)
                z = weights[list(there)].sum(axis=0)
                inputs = shares(text)
                for k, m in enumerate(chain):
                    inputs.append(float(_sigmoid(z[k] + np.dot(m.dense, inputs) + m.bias)))
                out.append(inputs[DENSE:])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(pa.float64()))], names=["row", "p"])

    return run


def predict(docs: DataFrame, chain: list[Linear], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) in the struct ``row``, then p: a probability for each category in chain order."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(chain)), f"row {kind}, p array<double>")
