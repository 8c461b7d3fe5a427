"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.session import shared_dir

#: Texts are taken from an Arrow batch in pieces of about so many characters, so that
#: working arrays stay small whatever the size of the batch.
PIECE_CHARS = 1 << 19


def materialize(df: DataFrame) -> DataFrame:
    """The rows as a written table in the cluster's shared folder, which cuts the lineage.

    A lost executor then costs a read, not a new run of all that went before, and rows
    that depend on a sampled partitioning stay as they were first computed.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once all that was made from them is written as well."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes at most for the jobs that run inside; a session that sets a limit itself keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.unset(key)


def bytes_of(text: Column) -> Column:
    """A text's UTF-8 bytes; those of a null text are empty."""
    return F.coalesce(text, F.lit(""))


def pieces(texts: list[str | None], chars: int = PIECE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of whole texts of about ``chars`` characters, with the first's place; null is empty."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= chars:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Places where runs of these lengths begin, with the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def take_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the elements of several runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    """A column of lists from flat values."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def worker_cache(name: str, make: Callable):
    """An object made once per Python worker process and kept for the tasks that it runs later."""
    kept = sys.modules.setdefault("_packwright_worker_cache", types.ModuleType("_packwright_worker_cache"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)
