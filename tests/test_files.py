"""FASTA and result files, comparisons, schedules and streams."""

import math

import pytest
from pyspark.sql import functions as F

from bandscan.functions import bits, text
from bandscan.operators import compare, schedule
from bandscan.plans.match import match
from bandscan.sources import fasta, results


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


def test_fasta_reading(spark, tmp_path):
    d = tmp_path / "in"
    put(d, "a.fasta", b"junk\nlines\n>one x\r\nACG\r\nT\r\n>empty\n\n>two\nAC\n\nGT")
    put(d, "b.fa", b">only\nTTTT\n")
    put(d, "c.txt", b">no\nA\n")
    rows = lambda **o: sorted(tuple(r) for r in fasta.read_fasta(spark, str(d), **o).collect())
    assert rows() == [("a.fasta", 0, "one x", "ACGT", 4), ("a.fasta", 1, "two", "ACGT", 4), ("b.fa", 0, "only", "TTTT", 4)]
    kept = rows(headerless="keep", max_len=3)
    assert ("a.fasta", 0, None, "jun", 3) in kept or ("a.fasta", 0, None, "junklines"[:3], 3) in kept
    assert len(kept) == 4
    assert len(rows(first_only=True)) == 2
    with pytest.raises(ValueError):
        fasta.read_fasta(spark, str(d), headerless="x")
    assert [r["file"] for r in fasta.listed_files(spark, str(d)).collect()] == ["a.fasta", "b.fa", "c.txt"]
    assert fasta.whole_files(spark, str(d)).count() == 3


def test_fasta_split_file(spark, tmp_path):
    d = tmp_path / "in"
    put(d, "big.fasta", b"".join(b">r%d\n%s\n" % (k, b"ACGT" * (k % 50 + 1)) for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = fasta.read_fasta(spark, str(d)).orderBy("record_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["header"] for r in got] == [f"r{k}" for k in range(3000)]
    assert [r["record_idx"] for r in got] == list(range(3000))
    assert all(r["len"] == 4 * (k % 50 + 1) for k, r in enumerate(got))


def test_fasta_round_trip(spark, tmp_path):
    recs = spark.createDataFrame([("h1", "ACGT" * 40), ("h2", "A" * 60), (None, "C")], "header string, seq string")
    fasta.write_fasta(recs, str(tmp_path / "out"))
    back = fasta.read_fasta(spark, str(tmp_path / "out"), glob=None)
    assert sorted((r["header"], r["seq"]) for r in back.collect()) == [("", "C"), ("h1", "ACGT" * 40), ("h2", "A" * 60)]
    lines = "\n".join(r["value"] for r in fasta.fasta_lines(recs).collect()).split("\n")
    assert max(map(len, lines)) == 60
    fasta.write_split(recs.withColumn("part", F.lit("first")), str(tmp_path / "split"))
    chunks = spark.createDataFrame([(3, 20, "AC")], "text_id long, start long, piece string")
    assert tuple(fasta.chunk_records(chunks).first()) == ("3_20", "AC")


def test_result_files(spark, tmp_path):
    schema = "query_file string, query_len int, ref_file string, ref_len int, num_hits int, hit_indexes array<int>, lowest_score int, lowest_indexes array<int>, last_score int"
    rows = [("q.fa", 4, "r.fa", 9, 0, [], 1, [3, 5], 2), ('a,"b".fa', 4, "r2.fa", 9, 2, [1, 2], None, None, -1)]
    df = spark.createDataFrame(rows, schema)
    results.write_results(df, str(tmp_path / "res"), "some label")
    first = sorted((tmp_path / "res").glob("part-*"))[0].read_text().split("\n")
    assert first[0] == "some label" and first[1] == results.HEADER
    back = sorted(map(tuple, results.read_results(spark, str(tmp_path / "res")).collect()))
    assert back == [('a,"b".fa', 4, "r2.fa", 9, 2, [1, 2], None, None, -1), ("q.fa", 4, "r.fa", 9, 0, None, 1, [3, 5], 2)]
    assert "q.fa x r.fa: hits 0, lowest 1 at 3,5, last 2" in results.console_report(df)
    same = compare.compare_runs(df, results.read_results(spark, str(tmp_path / "res")))
    assert tuple(compare.comparison_summary(same).first()) == (2, 2, 0, 0, 100.0)
    other = df.where("query_len = 4 AND ref_file = 'r.fa'").withColumn("lowest_indexes", F.array(F.lit(5), F.lit(3))).withColumn("last_score", F.lit(7))
    got = {r["ref_file"]: r for r in compare.compare_runs(df, other.unionAll(other)).collect()}
    assert got["r.fa"]["same_lowest_indexes"] and not got["r.fa"]["same_last_score"] and not got["r.fa"]["matched"] and not got["r2.fa"]["found"]
    results.write_power_log(spark.createDataFrame([(1.0, 18.61), (2.03, 12.93), (2.5, 0.0)], "t double, watts double"), str(tmp_path / "power"))
    lines = [x for f in sorted((tmp_path / "power").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:5] == ["Time_s,Power_W", "1.00,18.61", "2.03,12.93", "", ""] and lines[5:7] == ["---,SUMMARY STATISTICS,---", "Metric,Value,Unit"]
    assert lines[7:] == ["Duration,1.0300,s", "Average Power,15.7700,W", "Peak Power,18.6100,W", "Total Energy,16.2431,J"]


def test_power_lines_print_exact_values(spark):
    samples = [(1704096628.715, 66.78), (2.125, 0.285), (2.375, 1.005), (None, 3.0)]
    lines = [r["value"] for r in results.power_lines(spark.createDataFrame(samples, "t double, watts double")).orderBy("place").collect()]
    assert lines[0] == "Time_s,Power_W" and sorted(map(str, lines[1:5])) == sorted(["None", "2.12,0.28", "2.38,1.00", "1704096628.71,66.78"])


def test_partition_files(spark, tmp_path):
    text = "".join(chr(97 + k % 26) for k in range(250))
    fasta.write_partitions(spark.createDataFrame([(1, text), (2, None), (3, "")], "text_id long, text string"), str(tmp_path / "cut"), longest=5, size=100)
    got = fasta.read_fasta(spark, str(tmp_path / "cut"), glob="part-*").collect()
    assert sorted((r["header"], r["seq"]) for r in got) == [("0_0", text[:100]), ("1_96", text[96:196]), ("2_192", text[192:])]


def test_shared_folders(spark, monkeypatch):
    from bandscan.sources import shared

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext = type("C", (), {"master": master})
            self.conf = type("F", (), {"get": staticmethod(lambda key, other=None: folder)})

    monkeypatch.setattr(shared, "_MADE", [])
    assert shared.shared_dir(Session("local[4]")).startswith("file:")
    assert shared.shared_dir(Session("spark://host:7077", "hdfs://x/y/")).startswith("hdfs://x/y/bandscan-")
    with pytest.raises(RuntimeError):
        shared.shared_dir(Session("spark://host:7077"))


def test_schedule(spark):
    df = spark.createDataFrame([(1, 1, 1.7403, 1.8367), (1, 2, 1.0, 1.01), (1, 3, 0.0, 1.0), (2, 1, 0.0146, 0.0245)], "g int, k int, f double, s double")
    one = df.select(F.lit(0.7).alias("r"), "f", "s").withColumn("n", schedule.ratio_update("r", "f", "s", 0.5, None)).collect()
    assert round(one[0]["n"], 3) == 0.710 and round(one[3]["n"], 3) == 0.803
    got = [tuple(r) for r in schedule.ratio_trace(df, "g", "k", "f", "s", start=0.7).orderBy("g", "step").collect()]
    a = 0.75 * 0.7 + 0.25 * 0.7 * math.sqrt(1.8367 / 1.7403)
    assert [x[1] for x in got] == [0, 1, 2, 0] and math.isclose(got[0][3], a) and got[1][3] == got[1][2] == got[2][3]
    trace = spark.createDataFrame([(1, k, r) for k, r in enumerate([0.1, 0.5, 0.51, 0.515, 0.516])] + [(2, 0, 0.1)], "g int, step int, ratio double")
    assert dict(map(tuple, schedule.convergence(trace, "g", "step", "ratio").collect())) == {1: 4, 2: None}
    p = spark.createDataFrame([(2.0, 18.61), (3.03, 12.93), (4.0, 0.0)], "t double, w double")
    r = schedule.power_stats(p, "t", "w").first()
    assert r["n"] == 2 and math.isclose(r["mean_w"], 15.77) and math.isclose(r["energy_j"], 15.77 * 1.03)


def test_helpers(spark):
    df = spark.createDataFrame([("[1, 2]",), ("3,4",), ("N/A",), ("[]",), (None,)], "s string")
    assert [r[0] for r in df.select(text.list_parsed(F.col("s"))).collect()] == [[1, 2], [3, 4], None, [], None]
    t = spark.createDataFrame([(2.5,), (0.002,), (3e-6,), (5e-9,)], "x double").select(text.time_text(F.col("x")))
    assert [r[0] for r in t.collect()] == ["2.500 s", "2.000 ms", "3.000 us", "5.000 ns"]
    b = spark.range(1).select(F.array(F.lit((1 << 59) + 1), F.lit(3)).alias("v"))
    assert b.select(bits.shifted_left(F.col("v"))).first()[0] == [2, 7]
    assert b.select(bits.shifted_right(F.col("v"))).first()[0] == [(1 << 58) + (1 << 59), 1]
    assert spark.range(1).select(bits.padded_left(F.lit("1"), 3)).first()[0] == "0001"
    assert spark.range(1).select(bits.padded_right(F.lit("1"), 3)).first()[0] == "1000"
    assert spark.range(1).select(bits.rotated_right(F.lit("100110"), 2)).first()[0] == "101001"


def test_stream(spark, tmp_path):
    from bandscan.streaming.scan import start_matching

    texts = spark.createDataFrame([(k, f"text {k} acgt") for k in range(20)], "text_id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    patterns = spark.createDataFrame([(1, "acgt"), (2, "tx")], "pattern_id long, pattern string")
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    start_matching(patterns, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, match(patterns, texts).collect()))
