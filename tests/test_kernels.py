"""Kernels against dynamic programs, and against each other."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandscan.functions import sqlkernel
from bandscan.functions.lockstep import Patterns, lane_scores, symbols
from bandscan.functions.metrics import ANCHORS, METRICS, scores, summary


def program(p, t, swaps, anchored):
    """Last row of the alignment table; swaps of neighbours cost one."""
    rows = [[j if anchored else 0 for j in range(len(t) + 1)]]
    for i in range(1, len(p) + 1):
        row = [i]
        for j in range(1, len(t) + 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (p[i - 1] != t[j - 1]))
            if swaps and i > 1 and j > 1 and p[i - 1] == t[j - 2] and p[i - 2] == t[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][1:]


words = st.text("abc", min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(words, st.text("abcd", max_size=25))
def test_metrics_against_programs(p, t):
    assert scores(p, t, "levenshtein") == program(p, t, False, False)
    assert scores(p, t, "osa") == program(p, t, True, False)
    assert scores(p, t, "levenshtein", "start") == program(p, t, False, True)
    assert all(a <= b for a, b in zip(scores(p, t), scores(p, t, "osa")))


#: Known score vectors, equal for compat and osa but for the last two pairs.
KNOWN = [
    ("MATCH", "REMACHINE", [5, 5, 4, 3, 2, 1, 2, 3, 4]),
    ("ANNUAL", "ANNEALING", [5, 4, 3, 3, 2, 1, 2, 3, 4]),
    ("SURVEY", "SURGERY", [5, 4, 3, 3, 2, 2, 2]),
    ("JAAAT", "TAAAJ", [4, 4, 3, 2, 2]),
    ("CA", "ABC", [1, 2, 1]),
    ("CACC", "CAGCACGAA", [3, 2, 2, 1, 2, 1, 1, 2, 2]),
    ("GAG", "GGTTATACGGAGTAT", [2, 1, 2, 2, 2, 2, 2, 2, 2, 1, 1, 0, 1, 1, 2]),
]


@pytest.mark.parametrize("p,t,want", KNOWN)
def test_known_vectors(p, t, want):
    assert scores(p, t) == want


@pytest.mark.parametrize("m", [1, 2, 63, 64, 65, 127, 128, 129, 192, 255, 256, 257, 394])
def test_lockstep_equals_plain(m):
    rng = random.Random(m)
    make = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    ps = [make(m), make(max(1, m - 1))]
    ts = ["", make(1), make(m + 3), make(5) + ps[0] + make(4), make(2 * m)]
    w, o = np.array([0, 1] * 5), np.repeat(np.arange(5), 2)
    for metric in METRICS:
        for anchor in ANCHORS:
            got = lane_scores(Patterns(symbols(ps, "byte")), w, symbols(ts, "byte"), o, metric, anchor)
            for k in range(10):
                assert got[: len(ts[o[k]]), k].tolist() == scores(ps[w[k]], ts[o[k]], metric, anchor)


def test_bytes_and_characters():
    p = Patterns(symbols(["né"], "byte"))
    assert p.lengths.tolist() == [3]
    assert Patterns(symbols(["né"], "char")).lengths.tolist() == [2]


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("anchor", ANCHORS)
def test_sql_kernel_equals_plain(spark, metric, anchor):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abé") for _ in range(n))
    rows = [(make(rng.choice([1, 2, 7, 31, 59, 60])), make(rng.randint(0, 70))) for _ in range(40)]
    df = spark.createDataFrame(rows, "p string, t string").withColumn("eq", sqlkernel.match_masks("p")).withColumn("m", F.char_length("p"))
    for r in df.select("p", "t", sqlkernel.score_array("eq", "m", "t", metric, anchor).alias("s")).collect():
        assert r["s"] == scores(r["p"], r["t"], metric, anchor)


def test_summary_and_errors():
    assert summary([3, 2, 2], 3) == ([], 2, [1, 2], 2)
    assert summary([], 3) == ([], 3, [], None)
    with pytest.raises(ValueError):
        scores("", "a")
    with pytest.raises(ValueError):
        scores("a", "a", "other")
