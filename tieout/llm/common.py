"""Column helpers shared by the operators."""

from __future__ import annotations

import ctypes
import io
import string
import sys
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def unused(df: DataFrame, name: str) -> str:
    """A column name the frame does not have yet (Spark resolves names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_key(c: Column) -> Column:
    """16-byte content hash, the key of everything that depends on a text alone. Null is the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(c.cast("binary"), F.lit(b"")), 256), 1, 32))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
#: of texts in one batch that a Python worker holds at once
BATCH_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of the column ``text`` (one row at least), so what is made of a slice stays
    bounded whatever the number of rows in a batch."""
    give_back()  # what the task before left behind
    for batch in batches:
        yield from _slices(batch, text, most)
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: worker processes live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def carried(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` as the struct ``row``, and the column ``text`` beside it only if it is not one of them: a text crosses to Python once."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    if text in keep and dict(docs.dtypes)[text] == "string":
        return docs.select(row)
    return docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))


def beside(rows: DataFrame, text: str) -> Column:
    """The text of rows made by `carried`."""
    return (F.col("text") if "text" in rows.columns else F.col(f"row.`{text}`")).alias("text")


def with_text(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of rows made by `carried`, each with the column ``text``."""
    give_back()
    for batch in batches:
        if "text" not in batch.schema.names:
            batch = pa.RecordBatch.from_arrays([*batch.columns, batch.column("row").field(text)], names=[*batch.schema.names, "text"])
        yield from _slices(batch, "text", BATCH_BYTES)
    give_back()


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Give the executors this package, once for each Spark application, as ``--py-files`` would: a zip in the shared
    folder, added with ``addPyFile``. Not needed where the package is installed on every machine."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    uri = scratch_path(spark, "modules") + ".zip"
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(packed.getvalue())
    sc.addPyFile(uri)
    _SHIPPED.add(sc.applicationId)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of a URI (``file:``, ``hdfs:``, ``s3:`` ... or a plain path)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
