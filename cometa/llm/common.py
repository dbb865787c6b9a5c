"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import resource
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cometa.session import shared_path

# Words are maximal runs of characters other than ASCII white space. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"

LARGE_PROCESS = 256 << 20
# Shuffle files of a finished statement are removed under this setting instead
# of when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """Hold one session setting for the statements inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    The lineage is cut (a lost executor costs a re-read), the row order inside
    each file is fixed from then on, and the shuffle files that made the table
    are removed when the write ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}_{uuid.uuid4().hex}")
    with session_setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of some ``size`` bytes of a text column, a row at least."""
    part = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def give_back_memory() -> None:
    """Return a task's freed memory to the system: the worker process outlives the task, and the next may need other tables.
    Cycles are collected first in a process that has grown large (it takes too long to do so after every small task)."""
    with contextlib.suppress(OSError), open("/proc/self/statm") as f:
        if int(f.read().split()[1]) * resource.getpagesize() > LARGE_PROCESS:
            gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or ``name`` and so many primes that no column is called so (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "'"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
