"""The recurrence as a Spark SQL aggregate() over a text's symbols: no Python, for patterns of up to 60 symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandscan.functions.metrics import checked

MAX_SYMBOLS = 60


def match_masks(pattern: str) -> Column:
    """A map from each symbol of the pattern column to the bits where it stands."""
    return F.expr(
        f"map_from_entries(transform(array_distinct(regexp_extract_all({pattern}, '(?s).', 0)), c -> struct(c, aggregate(sequence(1, char_length({pattern})), 0L, "
        f"(b, i) -> IF(substring({pattern}, i, 1) = c, b | shiftleft(1L, i - 1), b)))))"
    )


def score_array(eq: str, m: str, text: str, metric: str = "compat", anchor: str = "any") -> Column:
    """array<int> of all scores; eq is a column from match_masks(), m the pattern's length."""
    checked(metric, anchor)
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    mask = f"(shiftleft(1L, {m}) - 1)"
    x = f"coalesce({eq}[c], 0L)" + (" | s.mv" if metric == "compat" else "")
    swap = "" if metric == "levenshtein" else f" | (shiftleft((s.db ^ {mask}) & x, 1) & s.xb)"
    d = f"(((((x & s.pv) + s.pv) ^ s.pv) | x | s.mv{swap}) & {mask})"
    h = f"((shiftleft(s.mv | ((d | s.pv) ^ {mask}), 1){' | 1L' if anchor == 'start' else ''}) & {mask})"
    rise = f"cast(getbit(s.mv | ((d | s.pv) ^ {mask}), {m} - 1) AS int) - cast(getbit(d & s.pv, {m} - 1) AS int)"
    state = f"named_struct('pv', (shiftleft(d & s.pv, 1) | ((d | h) ^ {mask})) & {mask}, 'mv', d & h, 'xb', x, 'db', d, 'score', s.score + {rise}, 'all', concat(s.all, array(s.score + {rise})))"
    start = f"named_struct('pv', {mask}, 'mv', 0L, 'xb', 0L, 'db', 0L, 'score', cast({m} AS int), 'all', cast(array() AS array<int>))"
    step = let("x", x, let("d", d, let("h", h, state)))
    return F.expr(f"aggregate(regexp_extract_all({text}, '(?s).', 0), {start}, (s, c) -> {step}, s -> s.all)")
