"""Small text helpers of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seq_length(seq: Column, unit: str = "byte") -> Column:
    return F.char_length(seq) if unit == "char" else F.octet_length(seq)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_text(values: Column, missing: str = "N/A") -> Column:
    """'1,2', or the missing mark for null or no values."""
    return F.when(F.size(values) > 0, F.array_join(values.cast("array<string>"), ",")).otherwise(F.lit(missing))


def list_parsed(text: Column) -> Column:
    """array<int> from '[1, 2]', '1,2' or a missing mark (null)."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]\s]", ""))
    good = inner.rlike(r"^-?[0-9]+(,-?[0-9]+)*$")
    return F.when(good, F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<int>")).when(inner == "", F.array().cast("array<int>"))


def time_text(seconds: Column) -> Column:
    """A time in the largest of s, ms, us and ns that is not below one."""
    steps = ((1.0, 1.0, "s"), (1e-3, 1e3, "ms"), (1e-6, 1e6, "us"))
    out = F.concat(F.format_number(seconds * 1e9, 3), F.lit(" ns"))
    for least, times, name in reversed(steps):
        out = F.when(seconds >= least, F.concat(F.format_number(seconds * times, 3), F.lit(f" {name}"))).otherwise(out)
    return out


def shortened(text: Column, n: int) -> Column:
    """At most n characters, the last three dots where some are left out."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, max(0, n - 3)), F.lit("..."))).otherwise(text)
