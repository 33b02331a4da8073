"""How texts are cut for parallel scans.

A chunk owns [start, start + own) and reads `lead` symbols before its start,
twice the pattern's length, which its scan warms up on. An alignment of cost
up to m spans at most 2 m symbols and no score exceeds m, so owned scores
equal those of an unchunked scan; each position belongs to one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the work-based chunk size, and the chunks wanted.
MIN_CHUNK, MAX_CHUNK, TARGET_CHUNKS = 5_000, 400_000, 768
#: Texts shorter than the first are not split between devices; the second part has at most the other.
MIN_SPLIT, MAX_SECOND = 1_000_000, 100_000_000


def with_chunks(texts: DataFrame, length: str, size: int) -> DataFrame:
    """A row for each chunk: adds chunk_id, start and own_len; an empty text has one chunk."""
    n = F.col(length).cast("long")
    last = F.greatest(F.lit(0).cast("long"), F.floor((n - 1) / size))
    out = texts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_id"))
    start = F.col("chunk_id") * size
    return out.withColumn("start", start).withColumn("own_len", F.least(F.lit(size).cast("long"), n - start))


def lead(start: Column, longest: Column | int) -> Column:
    """Symbols to read before a chunk's start."""
    return F.least(start, F.lit(2).cast("long") * longest)


def chunk_size_by_work(lengths: DataFrame, length: str, n_patterns: int, most: int = MAX_CHUNK, target: int = TARGET_CHUNKS) -> DataFrame:
    """One row (avg_len, target_chunks, chunk_size): the mean length over the chunks wanted per pattern, within bounds."""
    wanted = -(-target // max(1, n_patterns))
    mean = F.coalesce(F.expr(f"sum({length}) div count({length})"), F.lit(0)).cast("long")
    size = F.greatest(F.lit(MIN_CHUNK), F.least(F.lit(most), F.expr(f"avg_len div {wanted}")))
    return lengths.agg(mean.alias("avg_len")).select("avg_len", F.lit(wanted).cast("long").alias("target_chunks"), size.cast("long").alias("chunk_size"))


def chunk_size_by_memory(memory_bytes: int, n_patterns: int, per_symbol: int = 8) -> int:
    """The largest chunk whose lanes fit in the memory given."""
    return max(MIN_CHUNK, min(MAX_CHUNK, memory_bytes // max(1, n_patterns * per_symbol)))


def with_ratio_split(texts: DataFrame, length: str, ratio: float | Column, least: int = MIN_SPLIT, most: int = MAX_SECOND) -> DataFrame:
    """Two parts for each text: the first floor(n * ratio) symbols, and the rest.

    Texts below `least` stay whole; a second part over `most` gives its surplus
    to the first. Adds part, start and own_len.
    """
    n = F.col(length).cast("long")
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    cut = F.when(n < least, n).otherwise(F.greatest(F.floor(n * ratio).cast("long"), n - most))
    parts = F.filter(F.array(
        F.struct(F.lit("first").alias("part"), F.lit(0).cast("long").alias("start"), cut.alias("own_len")),
        F.struct(F.lit("second").alias("part"), cut.alias("start"), (n - cut).alias("own_len")),
    ), lambda p: (p["own_len"] > 0) | (p["part"] == "first"))
    return texts.select("*", F.inline(parts))
