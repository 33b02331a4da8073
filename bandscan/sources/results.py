"""Result files: a label line, a header line, a row for each pair; and power logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscan.functions.text import list_parsed, list_text

#: The columns of a result file, in order.
HEADER = "Query File,Query Length,Reference File,Reference Length,Number of Hits,Hit Indexes,Lowest Score,Lowest Score Indexes,Last Score"
COLUMNS = ("query_file", "query_len", "ref_file", "ref_len", "num_hits", "hit_indexes", "lowest_score", "lowest_indexes", "last_score")


def result_lines(pairs: DataFrame) -> DataFrame:
    """(value): each pair as a line of the file; lists are quoted, missing values N/A."""
    quoted = lambda c: F.concat(F.lit('"'), list_text(F.col(c)), F.lit('"'))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    name = lambda c: F.when(F.col(c).rlike('[,"]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    made = {"query_file": name, "ref_file": name, "hit_indexes": quoted, "lowest_indexes": quoted}
    return pairs.select(F.concat_ws(",", *(made.get(c, plain)(c) for c in COLUMNS)).alias("value"))


def write_results(pairs: DataFrame, path: str, label: str = "results", mode: str = "error") -> None:
    """A folder of text parts; the first begins with the label and the header."""
    spark = pairs.sparkSession
    top = spark.range(0, 2, 1, 1).select(F.when(F.col("id") == 0, F.lit(label)).otherwise(F.lit(HEADER)).alias("value"))
    top.unionAll(result_lines(pairs)).write.mode(mode).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of result files; label and header lines, and lines that are no rows, are passed over."""
    text = spark.read.text(path).where(F.col("value") != HEADER)
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    row = text.select(F.from_csv("value", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*").where("last_score IS NOT NULL AND try_cast(num_hits AS int) IS NOT NULL")
    number = lambda c: F.expr(f"try_cast({c} AS int)").alias(c)
    values = lambda c: F.when(F.col(c) != "N/A", list_parsed(F.col(c))).alias(c)
    kinds = {"query_len": number, "ref_len": number, "num_hits": number, "lowest_score": number, "last_score": number, "hit_indexes": values, "lowest_indexes": values}
    return row.select(*(kinds[c](c) if c in kinds else F.col(c) for c in COLUMNS))


def console_report(pairs: DataFrame, rows: int = 20) -> str:
    """The first pairs as lines of text."""
    line = F.format_string("%s x %s: hits %d, lowest %s at %s, last %d", "query_file", "ref_file", "num_hits", F.coalesce(F.col("lowest_score").cast("string"), F.lit("N/A")), list_text(F.col("lowest_indexes")), "last_score")
    return "\n".join(r[0] for r in pairs.orderBy("query_file", "ref_file").select(line).limit(rows).collect())


#: The head of a power log's summary block.
SUMMARY_HEAD = ("", "", "---,SUMMARY STATISTICS,---", "Metric,Value,Unit")


def _printed(rows: DataFrame, line: str) -> DataFrame:
    """(place, value): the numbers of rows (place, numbers) in a line, null if one is missing.

    Printed by their exact binary values, as C does; format_string rounds the
    shortest decimal that stands for a number half up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [None if None in v else line % tuple(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.string())], names=["place", "value"])

    return rows.select("place", "numbers").mapInArrow(run, f"place {rows.schema['place'].dataType.simpleString()}, value string")


def power_lines(samples: DataFrame) -> DataFrame:
    """(place, value): the lines of a power log in order: header, positive readings (t, watts) by time, summary block."""
    good = samples.where("watts > 0").select("t", F.col("t").cast("double").alias("s"), "watts", F.col("watts").cast("double").alias("w"))
    place = lambda part, t, k: F.struct(F.lit(part).alias("part"), t.alias("t"), k.alias("k")).alias("place")
    rows = _printed(good.select(place(1, F.col("s"), F.lit(0)), F.array("s", "w").alias("numbers")), "%.2f,%.2f")
    facts = good.agg((F.max("t") - F.min("t")).cast("double").alias("d"), F.avg("watts").cast("double").alias("mean"), F.max("w").alias("peak")).where("d IS NOT NULL")
    last = [("Duration", "d", "s"), ("Average Power", "mean", "W"), ("Peak Power", "peak", "W"), ("Total Energy", "mean * d", "J")]
    facts = facts.select(place(2, F.lit(0.0), F.lit(0)), F.array(*(F.expr(v) for _, v, _ in last)).alias("numbers"))
    block = F.concat(F.array(*map(F.lit, SUMMARY_HEAD)), F.split("value", "\n"))
    block = _printed(facts, "\n".join(f"{name},%.4f,{unit}" for name, _, unit in last)).select(F.posexplode(block).alias("k", "value"))
    block = block.select(place(2, F.lit(0.0), F.col("k").cast("int")), "value")
    head = samples.sparkSession.range(1).select(place(0, F.lit(0.0), F.lit(0)), F.lit("Time_s,Power_W").alias("value"))
    return head.unionAll(rows).unionAll(block)


def write_power_log(samples: DataFrame, path: str, mode: str = "error") -> None:
    """Readings (t, watts) and their summary as text parts in order."""
    power_lines(samples).orderBy("place").select("value").write.mode(mode).text(path)
