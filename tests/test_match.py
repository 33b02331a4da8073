"""Pairing, chunks and merges against the plain scan."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandscan.functions.metrics import METRICS, scores, summary
from bandscan.operators import compare
from bandscan.plans import match as plan
from bandscan.plans import queries
from bandscan.plans.chunking import chunk_size_by_memory, chunk_size_by_work, with_chunks, with_ratio_split
from bandscan.plans.match import alike, gathered, match, merged, reported, scanned


def data(spark, seed, alphabet="acgt"):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    ps = [(k, make(n)) for k, n in enumerate([1, 3, 8, 12, 40, 70])] + [(90, ""), (91, None)]
    ts = [(k, make(n)) for k, n in enumerate([1, 5, 30, 200, 333])] + [(7, ""), (8, None), (9, make(20) + ps[4][1] + make(20) + ps[2][1]), (10, "ac" * 600)]
    return ps, ts, spark.createDataFrame(ps, "pattern_id long, pattern string"), spark.createDataFrame(ts, "text_id long, text string")


def expected(ps, ts, metric="compat", anchor="any"):
    out = {}
    for i, p in ps:
        for j, t in ts:
            if p and t is not None:
                p_, t_ = p.encode(), t.encode()
                hits, low, at, last = summary(scores(p_, t_, metric, anchor), len(p_))
                out[i, j] = (len(p_), len(t_), len(hits), hits, low, at, -1 if last is None else last)
    return out


def rows(df):
    return {(r["pattern_id"], r["text_id"]): tuple(r)[2:9] for r in df.collect()}


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("chunk", [1, 7, 64, 100_000])
def test_chunked_equals_whole(spark, metric, chunk):
    ps, ts, p, t = data(spark, 4)
    assert rows(match(p, t, metric, chunk=chunk)) == expected(ps, ts, metric)


def test_anchor_unicode_and_caps(spark):
    ps, ts, p, t = data(spark, 5, "aé¢")
    assert rows(match(p, t, "levenshtein", anchor="start")) == expected(ps, ts, "levenshtein", "start")
    assert rows(match(p, t)) == expected(ps, ts)
    capped = match(p, t, max_positions=2).collect()
    assert max(len(r["lowest_indexes"]) for r in capped) == 2


def test_joined_pattern_blocks(spark, monkeypatch):
    monkeypatch.setattr(plan, "CLOSURE_BYTES", 0)
    monkeypatch.setattr(plan, "BLOCK_BYTES", 50)
    ps, ts, p, t = data(spark, 6)
    assert rows(match(p, t, chunk=50)) == expected(ps, ts)


def test_sql_engine_and_scores(spark):
    ps, ts, p, t = data(spark, 7)
    small = p.where("length(pattern) <= 60")
    got = match(small, t, engine="sql", scores=True)
    assert rows(got) == {k: v for k, v in expected(ps, ts).items() if v[0] <= 60}
    whole = {(r["pattern_id"], r["text_id"]): r["scores"] for r in match(small, t, chunk=9, scores=True).collect()}
    assert whole == {(r["pattern_id"], r["text_id"]): r["scores"] for r in got.collect()}


def test_ratio_split_and_report(spark):
    ps, ts, p, t = data(spark, 8)
    parts = with_ratio_split(t.where("text IS NOT NULL").withColumn("n", t.text.isNotNull().cast("long") * 0 + __import__("pyspark").sql.functions.octet_length("text")), "n", 0.6, least=10, most=100).drop("n", "part")
    assert rows(merged(scanned(p, parts))) == expected(ps, ts)
    for r in reported(match(p, t)).collect():
        assert (r["lowest_score"] is None) == (r["num_hits"] > 0)


def test_empty_sides(spark):
    ps, ts, p, t = data(spark, 9)
    assert match(p.limit(0), t).count() == 0
    assert match(p, t.limit(0)).count() == 0


def test_chunk_plans(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 11)], "id long, n long")
    got = [tuple(r) for r in with_chunks(df, "n", 5).orderBy("id", "start").select("id", "start", "own_len").collect()]
    assert got == [(1, 0, 0), (2, 0, 5), (2, 5, 5), (3, 0, 5), (3, 5, 5), (3, 10, 1)]
    assert tuple(chunk_size_by_work(df.selectExpr("n * 100000000 AS n"), "n", 10).first()) == (700000000, 77, 400000)
    assert chunk_size_by_memory(1, 1) == 5000


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_counts_equal_lists(spark, monkeypatch, chunk):
    monkeypatch.setattr(plan, "PIECE", 16)
    ps, ts, p, t = data(spark, 10)
    want = {k: (v[0], v[1], v[2], v[4], len(v[5]), v[6]) for k, v in expected(ps, ts).items()}
    assert {(r["pattern_id"], r["text_id"]): tuple(r)[2:] for r in match(p, t, chunk=chunk, counts=True).collect()} == want


def test_pieces_equal_whole(spark):
    rng = random.Random(12)
    text = "".join(rng.choice("acgt") for _ in range(5000)) + "ac" * 700
    ps = [(1, "ac"), (2, text[1000:1030]), (3, text[2040:2140]), (4, text[3000:3256])]
    got = match(spark.createDataFrame(ps, "pattern_id long, pattern string"), spark.createDataFrame([(1, text)], "text_id long, text string"))
    assert rows(got) == expected(ps, [(1, text)])


def test_chunks_of_a_long_text_are_dealt_out(spark):
    from pyspark.sql import functions as F

    ps, ts, p, t = data(spark, 11)
    long = spark.createDataFrame([(1, "acgt" * 500)], "text_id long, text string")
    parts = plan.chunk_matches(p, long, chunk=20)
    assert parts.select("start").distinct().count() == 100
    assert parts.select(F.spark_partition_id().alias("k")).distinct().count() > 1


def test_a_short_text_needs_no_shuffle(spark):
    ps, ts, p, t = data(spark, 11)
    plan_text = scanned(p, t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_text


def test_equal_texts_and_patterns(spark):
    ps, ts = [(k, ("abc", "xyz")[k % 2]) for k in range(2500)], [(k, ("abcd", "b")[k % 2]) for k in (0, 1, 2, 3, 70_000, 70_001)]
    p, t = spark.createDataFrame(ps, "pattern_id long, pattern string"), spark.createDataFrame(ts, "text_id long, text string")
    want = {(i % 2, k % 2): tuple(r)[2:] for r in match(p.limit(2), t.limit(2)).collect() for i, k in [(r["pattern_id"], r["text_id"])]}
    got = match(p, t).collect()
    assert {(r["pattern_id"], r["text_id"]) for r in got} == {(i, k) for i, _ in ps for k, _ in ts} and len(got) == len(ps) * len(ts)
    assert all(tuple(r)[2:] == want[r["pattern_id"] % 2, r["text_id"] % 2] for r in got)
    # two texts in two ranges of ids, two patterns in two lists of 1,000 at most: few rows are scanned and dealt out
    assert sorted(len(r["ids"]) for r in alike(t).collect()) == [1, 1, 2, 2]
    plan = match(p, t)._jdf.queryExecution().toString()
    assert "text" in plan and "REPARTITION_BY_NUM" in plan and "Generate explode" in plan


def test_a_rare_text_is_scanned_once_for_many_ranges(spark, monkeypatch):
    ts = [(k * plan.RANGE + i, "abcd") for k in range(5) for i in range(3 if k == 2 else 1)] + [(plan.SPAN + 1, "abcd"), (7, "b"), (-1, "b")]
    t = spark.createDataFrame(ts, "text_id long, text string")
    assert sorted(len(r["ids"]) for r in gathered(alike(t)).collect()) == [1, 1, 1, 7]
    monkeypatch.setattr(plan, "FEW", 3)
    got = gathered(alike(t)).collect()
    assert sorted(len(r["ids"]) for r in got) == [1, 1, 1, 3, 4] and sorted((i, r["text"]) for r in got for i in r["ids"]) == sorted(ts)
    p = spark.createDataFrame([(1, "bc"), (2, "bc"), (3, "x")], "pattern_id long, pattern string")
    assert rows(match(p, t)) == expected([tuple(r) for r in p.collect()], ts) and match(p, t).count() == 3 * len(ts)


def test_rows_of_lists_stand_for_a_bounded_number_of_pairs(monkeypatch):
    monkeypatch.setattr(plan, "PAIRS", 12)
    monkeypatch.setattr(plan, "BATCH_IDS", 40)
    kind = pa.list_(pa.int64())
    patterns, texts = pa.array([[1, 2, 3, 4], [5]], kind), pa.array([[0], list(range(100, 150)), [7, 8, 9], [10, 11, 12, 13]], kind).slice(1)
    scan = pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1, 1]), pa.array([0, 1, 0, 1, 2]), pa.array(list("abcde"))], names=["pattern_id", "text_id", "x"])
    got = [r for b in plan._with_ids(scan, (patterns, texts)) for r in b.to_pylist()]
    assert max(len(r["pattern_id"]) * len(r["text_id"]) for r in got) == 12
    pairs = sorted((i, k, r["x"]) for r in got for i in r["pattern_id"] for k in r["text_id"])
    assert pairs == sorted((i, k, x["x"]) for x in scan.to_pylist() for i in patterns[x["pattern_id"]].as_py() for k in texts[x["text_id"]].as_py())


def test_a_count_of_pairs_makes_no_rows(spark):
    """Below a union each row would be copied; above it, they are counted within the loop over the lists."""
    ps, ts, p, t = data(spark, 12)
    counted = match(p, t, listed=True).groupBy().count()
    steps = counted._jdf.queryExecution().optimizedPlan().toString()
    assert steps.split("Union")[0].count("Generate explode") == 2
    assert counted.first()[0] == len(expected(ps, ts))


def test_equal_texts_in_sql(spark):
    p = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "b")], "pattern_id long, pattern string")
    t = spark.createDataFrame([(k, "abab" if k % 3 else "") for k in range(40)] + [(40, "ab" * 200), (41, None)], "text_id long, text string")
    for options in ({}, {"anchor": "start"}, {"metric": "osa", "scores": True}):
        want = sorted(map(str, match(p, t, unit="char", listed=True, **options).collect()))
        scanned_sql = match(p, t, engine="sql", listed=True, **options)
        assert sorted(map(str, scanned_sql.collect())) == want and len(want) == 3 * 41
    assert "collect_list" in match(p, t, engine="sql")._jdf.queryExecution().toString().split("Union")[1]


def test_runs_are_not_broadcast(spark):
    """A scan's output is far larger than Spark's estimate, which small inputs would have broadcast."""
    p = spark.createDataFrame([(1, "ab"), (2, "b")], "pattern_id long, pattern string")
    rows = match(p, p.select(F.col("pattern_id").alias("text_id"), F.col("pattern").alias("text"))).select(F.col("pattern_id").alias("query_file"), F.col("text_id").alias("ref_file"), *compare.FIELDS)
    compared = compare.compare_runs(rows, rows)
    assert "SortMergeJoin" in compared._jdf.queryExecution().executedPlan().toString() and compared.where("matched").count() == 4


def test_equal_names_are_compared_once(spark, tmp_path):
    names = ["red pin", "red pin", "blue nut", "red pin", None]
    spark.createDataFrame([(k, n) for k, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.compare_runs(spark, str(tmp_path))
    plain = compare.compare_runs(*queries._runs(spark, str(tmp_path)))
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 8
    assert "Generate explode(ids" in got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
