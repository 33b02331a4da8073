"""The registered queries of the llm operators: thin callables (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscan.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.pii import pseudonymised

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, count_col="n_found")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.chat import digests, formatted

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", r"r'\### Assistant: </turn> ok' AS text")
    return digests(formatted(turns.unionByName(planted)))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bandscan.llm.byte_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.decontam import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.repeats import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandscan.llm.toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_chat_format": op2_chat_format,
        "op3_license_scan": op3_license_scan,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_token_counts": op5_token_counts,
        "op6_top_k": op6_top_k,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_decontamination": op8_decontamination,
        "op9_repeats": op9_repeats,
        "op10_toxicity": op10_toxicity,
    }
