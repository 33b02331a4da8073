"""FASTA records as rows, and rows as FASTA files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions taken for FASTA files.
EXTENSIONS = "*.{fasta,fas,fa}"
WIDTH = 60


def read_fasta(spark: SparkSession, path: str, headerless: str = "drop", glob: str | None = EXTENSIONS, max_len: int | None = None, first_only: bool = False) -> DataFrame:
    """(file, record_idx, header, seq, len) of all records.

    A line that begins with > starts a record; line ends are taken out; empty
    records are dropped. Lines before the first record are dropped, or kept as
    a record without a header (headerless='keep'). Files are split at records,
    so one large file is read by many tasks. Records are numbered from a small
    table of the splits (rows, and which of them are no records), which a first
    pass makes; sequences are read once more and never shuffled, if that table
    may be broadcast. max_len cuts sequences, first_only keeps record 0.
    """
    if headerless not in ("drop", "keep"):
        raise ValueError("headerless must be 'drop' or 'keep'")
    reader = spark.read.option("lineSep", "\n>")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    bare = ~F.expr("startswith(value, '>')")  # of a file's first row: text in front of the first record
    lines = lambda body: F.regexp_replace(F.regexp_extract(body, r"(?s)^[^\n]*\n?(.*)$", 1), r"[\r\n]", "")
    first_seq = F.when(bare, F.regexp_replace("value", r"[\r\n]", "")).otherwise(lines(F.expr("substring(value, 2)")))
    rows = raw.select("path", "block", "id", bare.alias("bare"), "value", lines(F.col("value")).alias("seq"), first_seq.alias("first_seq"))
    first_bad = (F.length("first_seq") == 0) | (F.col("bare") if headerless == "drop" else F.lit(False))
    # ids rise by one within a split
    splits = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("from"), F.min_by(first_bad, "id").alias("first_bad"), F.collect_list(F.when(F.length("seq") == 0, F.col("id"))).alias("empty"))
    bad = F.expr("IF(block = 0, concat(filter(empty, x -> x != from), IF(first_bad, array(from), cast(array() AS array<bigint>))), empty)")
    splits = splits.select("path", "block", "from", "n", bad.alias("bad"))
    splits = splits.withColumn("before", F.expr("coalesce(sum(n - size(bad)) OVER (PARTITION BY path ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    dense = rows.join(splits, ["path", "block"]).where("NOT array_contains(bad, id)").withColumn("is_first", F.expr("block = 0 AND id = from"))
    header = F.when(F.col("is_first") & F.col("bare"), F.lit(None)).otherwise(F.regexp_extract(F.when(F.col("is_first"), F.expr("substring(value, 2)")).otherwise(F.col("value")), r"^([^\r\n]*)", 1))
    seq = F.when(F.col("is_first"), F.col("first_seq")).otherwise(F.col("seq"))
    seq = F.substring(seq, 1, max_len) if max_len else seq
    idx = F.expr("cast(before + id - from - size(filter(bad, x -> x < id)) AS int)")
    out = dense.select(F.element_at(F.split("path", "/"), -1).alias("file"), idx.alias("record_idx"), header.alias("header"), seq.alias("seq")).withColumn("len", F.octet_length("seq"))
    return out.where("record_idx = 0") if first_only else out


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of all files of a folder."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("content"))


def listed_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file) of a folder's regular files in order of name; contents are not read."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("file")).orderBy("file")


def wrapped(seq: Column, width: int = WIDTH) -> Column:
    """A sequence in lines of a width."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_lines(records: DataFrame, header: str = "header", seq: str = "seq", width: int = WIDTH) -> DataFrame:
    """(value): each record as its header line and sequence lines."""
    return records.select(F.concat(F.lit(">"), F.coalesce(F.col(header), F.lit("")), F.lit("\n"), wrapped(F.col(seq), width)).alias("value"))


def write_fasta(records: DataFrame, path: str, header: str = "header", seq: str = "seq", width: int = WIDTH, mode: str = "error") -> None:
    """A folder of FASTA part files."""
    lines = fasta_lines(records, header, seq, width)
    lines.write.mode(mode).option("lineSep", "\n").text(path)


def write_split(records: DataFrame, path: str, part: str = "part", mode: str = "error") -> None:
    """Records of each device's share in a folder of its own."""
    lines = records.select(F.concat(F.lit(">"), F.coalesce("header", F.lit("")), F.lit("\n"), wrapped(F.col("seq"))).alias("value"), F.col(part))
    lines.write.mode(mode).partitionBy(part).text(path)


def chunk_records(chunks: DataFrame) -> DataFrame:
    """(header, seq) of chunk rows (text_id, start, piece): the header names text and start."""
    return chunks.select(F.concat_ws("_", F.col("text_id").cast("string"), F.col("start").cast("string")).alias("header"), F.col("piece").alias("seq"))


#: Fixed value: the chunk length of partition files.
PARTITION = 10_700


def write_partitions(texts: DataFrame, path: str, longest: int, size: int = PARTITION, mode: str = "error") -> None:
    """Texts (text_id, text) cut into FASTA records of `size` symbols and an overlap of longest - 1, headed k_start."""
    step = max(1, size - (longest - 1))
    cut = texts.where("text IS NOT NULL AND text != ''").select("text", F.posexplode(F.expr(f"sequence(0, greatest(0, char_length(text) - {longest}), {step})")).alias("k", "start"))
    records = cut.select(F.concat_ws("_", F.col("k").cast("string"), F.col("start").cast("string")).alias("header"), F.expr(f"substring(text, start + 1, {size})").alias("seq"))
    write_fasta(records, path, mode=mode)
