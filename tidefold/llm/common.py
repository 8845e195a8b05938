"""Reading the text tables and cutting rows into folds."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def in_fold(doc_id: Column, folds: int, wanted: int) -> Column:
    """True for the wanted fold; a NULL id is in none."""
    return F.coalesce(fold(doc_id, folds) == wanted, F.lit(False))


def give_back() -> None:
    """Freed memory goes back to the system: Python workers are kept for other tasks, and what they hold is missing there."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(work):
    """A task's ``work`` on batches, which gives back what it freed when it ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def free_prefix(df: DataFrame) -> str:
    """A prefix for helper columns that no column of ``df`` begins with."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
