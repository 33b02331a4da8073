"""Comparison of two runs' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("query_file", "ref_file")
FIELDS = ("num_hits", "hit_indexes", "lowest_score", "lowest_indexes", "last_score")


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of the left run with the right run's row of the same pair, and a flag for each field.

    Of several right rows of a pair the smallest counts. Lists are equal as
    multisets; a missing list equals an empty one. Runs are merged, never
    broadcast: what Spark estimates of a scan's output is far below its size.
    """
    packed = F.struct(*[F.col(c) for c in FIELDS])
    right = right.groupBy(*KEYS).agg(F.min(packed).alias("r"))
    both = left.select(*KEYS, packed.alias("l")).join(right.hint("merge"), list(KEYS), "left")
    flags = []
    for c in FIELDS:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        if c.endswith("indexes"):
            none = F.array().cast("array<int>")
            a, b = (F.array_sort(F.coalesce(x.cast("array<int>"), none)) for x in (a, b))
        flags.append(a.eqNullSafe(b).alias(f"same_{c}"))
    out = both.select(*KEYS, F.col("r").isNotNull().alias("found"), *flags)
    every = F.col("found")
    for c in FIELDS:
        every = every & F.col(f"same_{c}")
    return out.withColumn("matched", every)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: total, matched, mismatched, missing, match_percent."""
    return compared.agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if(F.expr("found AND NOT matched")).alias("mismatched"), F.count_if(F.expr("NOT found")).alias("missing"), F.round(F.coalesce(F.count_if("matched") * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("match_percent"))
