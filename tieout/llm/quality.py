"""Quality rules with compression bands.

Base rules look at words (runs without ASCII white space): too few words, or too many of them inside 5-word
windows that occur twice or more. The bands judge Zstandard ratios (compressed / plain bytes) of the whole
text and of its fixed chunks: a ratio below ``low`` is repetitive, above ``high`` incompressible. Both limits depend
on the length, because a long text compresses better than a short one of the same kind (`BANDS`). A text fails when
its whole-text ratio is out of its band, or when more than ``CHUNK_SHARE`` of its bytes lie in chunks out of theirs.

One row is judged at a time inside one Arrow-fed map: no shuffle, memory of a few times one text.

Defined results: a null text has no words and no bytes and fails the base rules; an empty text likewise. Ties,
repeated rows, null ids and further columns change nothing: rows are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
CHUNK_BYTES = 8192
CHUNK_SHARE = 0.5
#: (from so many bytes, low, high): short texts carry the frame's overhead and have no history to refer to.
BANDS = ((0, 0.0, 8.0), (100, 0.20, 1.05), (300, 0.18, 0.85), (1000, 0.16, 0.72), (4000, 0.14, 0.65), (16000, 0.12, 0.60))
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, "
          "chunk_low double, chunk_high double, bad_chunk_share double, base_failed boolean, kept boolean, reason string")


def band(n_bytes: int) -> tuple[float, float]:
    """The limits of the last band that begins at or below this length."""
    return next((low, high) for start, low, high in reversed(BANDS) if n_bytes >= start)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included. Exact: words and
    pairs of neighbours become numbers, and a window is a pair of numbered parts."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    spans = codes[:n]
    for k in range(1, window):
        _, spans = np.unique(spans * len(number) + codes[k:k + n], return_inverse=True)
    hit = np.bincount(spans)[spans] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> dict:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeat = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    low, high = band(len(data))
    ratio = len(packer.compress(data)) / len(data) if data else 0.0
    ratios, bad, reason = [], 0, None
    for at in range(0, len(data), CHUNK_BYTES):
        chunk = data[at:at + CHUNK_BYTES]
        ratios.append(ratio if len(chunk) == len(data) else len(packer.compress(chunk)) / len(chunk))
        under, over = band(len(chunk))
        bad += len(chunk) * (not under <= ratios[-1] <= over)
    share = bad / len(data) if data else 0.0
    if base_failed:
        reason = "base"
    elif ratio < low:
        reason = "repetitive"
    elif ratio > high:
        reason = "incompressible"
    elif share > CHUNK_SHARE:
        reason = "chunks"
    return {"n_words": len(words), "word_chars": len(text) - sum(map(text.count, SPACES)), "n_symbols": sum(map(text.count, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat, "n_bytes": len(data), "ratio": ratio,
            "chunk_low": min(ratios, default=0.0), "chunk_high": max(ratios, default=0.0), "bad_chunk_share": share,
            "base_failed": base_failed, "kept": reason is None, "reason": reason}


_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
_SCHEMA = pa.struct([(c, _KINDS[k]) for c, k in (x.split() for x in RESULT.split(", "))])


def quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) in the struct ``row``, then the struct ``quality``."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = pa.array([judge(t.as_py(), packer) for t in batch.column("text")], _SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column("row"), out], names=["row", "quality"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, quality struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
