"""What the operators of this package share: shared folders, bounded Arrow batches, words."""

from __future__ import annotations

import ctypes
import functools
import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.shared import passing, shared_folder

#: A word is a longest run of other characters than these six.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch sent to a Python worker, so that long texts don't pile up in one.
BATCH_BYTES = 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share; see shared_root where it is unset."""
    return shared_folder(spark, name)


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: its lineage ends there.

    Operators forget such tables once their readers are done; those that a returned plan still reads
    go when the driver ends. Spark deletes shuffle files of plans that are done when the driver's
    garbage goes, so it is collected here: else they would pile up beside the tables.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = passing(df.sparkSession, path)
    return out


def drop(spark: SparkSession, where: str) -> None:
    """Delete a folder, with what is in it; one that isn't there is none."""
    path, store = _path(spark, where)
    store.delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that kept() wrote, once nothing reads them any more."""
    for t in tables:
        drop(t.sparkSession, t._kept_at)


def remainder(column: str, n: int):
    """crc32 of an id's text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def trim() -> None:
    """Give a worker's free memory back, so that workers that wait don't hold what the last block took."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


@functools.cache
def one_thread() -> None:
    """Keep numpy's linear algebra in this worker to one thread: its small products don't gain by more, and tasks share the cores."""
    try:
        with open("/proc/self/maps", encoding="utf-8") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in paths:
        lib = ctypes.CDLL(path)
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Row ranges (lo, hi) of a batch with about `most` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    block = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = np.flatnonzero(np.diff(block)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def compact(texts: pa.Array) -> pa.Array:
    """Texts as large strings at the start of buffers of their own, a null one empty.

    Some Arrow functions on strings go wrong on slices.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pa.concat_arrays([texts, pa.array([], pa.large_string())])


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of some texts (null: none) as codes of their distinct words.

    Returns the codes of all words in order, the n+1 places where texts begin and end among
    them, and the distinct words. Only A-Z change when `lower` is set.
    """
    texts = compact(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.values.slice(ends[0], ends[-1] - ends[0])
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if len(full) and not full.all():  # white space at either end of a text gives empty words
        words = words.filter(pa.array(full))
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, coded.dictionary


def spaces(text: str) -> int:
    """Characters of a text that separate words."""
    return sum(map(text.count, " \t\n\x0b\x0c\r"))


WORD = re.compile(WORD_PATTERN)
