"""What several operators share: settled tables, word hashing and Arrow batches in bounded pieces."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import portable
from ..functions.portable import discard, fresh, shared_dir  # noqa: F401


#: Rows of whole texts or ids that are sent to Python at once; Spark's own 10,000 may hold tens of megabytes.
BATCH_ROWS = 500
#: Where the paths of settled tables are noted, in ``recorded``.
_notes: ContextVar[list[str] | None] = ContextVar("_notes", default=None)


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note the path of each table that is settled meanwhile in ``paths``."""
    token = _notes.set(paths)
    try:
        yield
    finally:
        _notes.reset(token)


def discard_recorded(paths: list[str], docs: DataFrame) -> None:
    """Delete the tables at ``paths`` and forget them, unless ``docs`` may still be computed from one of them.

    A frame that is read from files names them all; one that names none, a cached one, say, may depend on anything.
    """
    files = docs.inputFiles()
    if not files or any(p.rsplit("/", 1)[-1] in f for p in paths for f in files):
        return
    for path in paths:
        portable.delete(docs.sparkSession, path)
    paths.clear()


def settle(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and its size is known.

    The columns ``folders``, last in ``df``, become folders: reading some of their values leaves out other files.
    """
    if not folders:
        out = portable.settle(df, name)
        path = out._settled_path
    else:
        path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*folders).parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (notes := _notes.get()) is not None:
        notes.append(path)
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nobody holds any more removed: Spark deletes them only once its driver has
    collected those plans, which a driver with little to do may put off until long after the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that are run meanwhile send ``BATCH_ROWS`` rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_rows(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text[, more]) with null texts as empty ones; further columns of any name are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n: the portable fold of a document."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of ``column`` hold about ``most`` bytes; one long text is a piece of its own."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // most if len(sizes) else sizes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered; forgets all when it holds too many words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
