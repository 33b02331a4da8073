"""Workload ratios of two devices, their times and their power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first ratio, the weight of the new value, the dead band and the bounds.
START, ALPHA, BAND, LOW, HIGH = 0.72, 0.25, 0.03, 0.05, 0.95


def _updated(r: str, f: str, s: str, alpha: float, band: float | None) -> str:
    """SQL: the next ratio from the present one and the times of the first and second device."""
    still = f" WHEN abs({s} - {f}) / greatest({f}, {s}) < {band}D THEN {r}" if band is not None else ""
    return f"CASE WHEN {r} <= 0 THEN {START}D WHEN {f} <= 0 OR {s} <= 0 THEN {r}{still} ELSE greatest({LOW}D, least({HIGH}D, {1 - alpha}D * {r} + {alpha}D * {r} * sqrt({s} / {f}))) END"


def ratio_update(ratio: str, first: str, second: str, alpha: float = ALPHA, band: float | None = BAND) -> Column:
    """The next share of the first device; band=None leaves out the dead band."""
    return F.expr(_updated(ratio, first, second, alpha, band))


def ratio_trace(times: DataFrame, group: str, order: str, first: str, second: str, start: float = START, alpha: float = ALPHA, band: float | None = BAND) -> DataFrame:
    """(group, step, ratio, next_ratio): the ratio before and after each measurement, in order, from start in each group."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(first).cast("double").alias("f"), F.col(second).cast("double").alias("s"))))
    fold = F.expr(f"aggregate(v, named_struct('r', {float(start)}D, 'all', cast(array() AS array<struct<o: string, ratio: double, next_ratio: double>>)), (a, x) -> transform(array({_updated('a.r', 'x.f', 'x.s', alpha, band)}), n -> named_struct('r', n, 'all', concat(a.all, array(named_struct('o', cast(x.o AS string), 'ratio', a.r, 'next_ratio', n)))))[0], a -> a.all)")
    out = times.groupBy(group).agg(steps.alias("v")).select(group, F.posexplode(fold).alias("step", "x"))
    return out.select(group, F.col("step").alias("step"), F.col("x.ratio").alias("ratio"), F.col("x.next_ratio").alias("next_ratio"))


def convergence(trace: DataFrame, group: str, step: str, ratio: str, tolerance: float = 0.02, run: int = 3) -> DataFrame:
    """(group, converged_at): the first step that ends `run` changes in a row below the tolerance; null if none does."""
    small = f"abs({ratio} - lag({ratio}) OVER (PARTITION BY {group} ORDER BY {step})) < {tolerance}D"
    flagged = trace.withColumn("small", F.expr(f"coalesce(cast({small} AS int), 0)"))
    ended = flagged.withColumn("in_row", F.expr(f"sum(small) OVER (PARTITION BY {group} ORDER BY {step} ROWS BETWEEN {run - 1} PRECEDING AND CURRENT ROW)"))
    return ended.groupBy(group).agg(F.min(F.when(F.col("in_row") == run, F.col(step))).alias("converged_at"))


def power_stats(samples: DataFrame, t: str, watts: str, *groups: str) -> DataFrame:
    """Mean and peak watts of positive readings, the time they span, and energy as mean times duration."""
    good = samples.where(F.col(watts) > 0)
    mean, span = F.avg(watts), F.max(t) - F.min(t)
    return good.groupBy(*groups).agg(F.count("*").alias("n"), mean.alias("mean_w"), F.max(watts).alias("max_w"), span.alias("duration_s"), (mean * span).alias("energy_j"))


def device_times(times: DataFrame, group: str, value: str, loops: int = 10) -> DataFrame:
    """Sum of times, and the mean of a loop."""
    return times.groupBy(group).agg(F.sum(value).alias("total"), (F.sum(value) / loops).alias("per_loop"), F.avg(value).alias("mean"))
