"""Shared helpers of the llm operators: session settings, shared folders, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscan.sources.shared import removed, shared_dir

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "WORD_ALNUM", "WORD_SPACE", "ascii_lower", "by_batch", "given_back", "removed", "shared_dir", "shuffle_parts", "stored", "table", "tuned"]

#: Rows of an Arrow batch between the JVM and Python; texts are a few kB, so a batch is a few MB.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20

#: The word patterns of the contracts, as Java and Python regular expressions.
WORD_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_SPACE = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory does not depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts ask; null becomes empty. Texts in ASCII take the faster function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """fn, after which freed memory goes back to the system: a worker keeps it otherwise while it waits and in all later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A mapInArrow function that works batch by batch and skips empty results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return run
