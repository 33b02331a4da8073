"""A cleaning pipeline over `documents`: toxic documents go, one of each group of
near-duplicates stays, documents with benchmark passages go, personal values
become pseudonyms, and what remains is encoded.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet to the shared folder and read again as the next one's docs. All but the
last keep the columns of documents, and extra columns, whatever their names.

Defined results: a null or empty text is not toxic, has no near-duplicate and no
benchmark passage, stays as it is and has no tokens; a row without an id goes
through all stages on its own text; exact repeated rows of one id are all kept,
as one document; an empty table gives an empty result; texts of any length are
read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bandscan.llm import byte_codec, decontam, near_dup, pii, toxicity
from bandscan.llm.common import shared_dir, stored, table, tuned
from bandscan.llm.queries import BYTE_RANKS, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of toxicity is below one half."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; rows without an id stay, and so do repeated rows of a kept id."""
    tuned(spark)
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item, or a whole shorter one."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced by pseudonyms of the same format."""
    return pii.pseudonymised(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of all documents."""
    tuned(spark)
    return byte_codec.tokenised(docs, tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", encoding_stage),
]

#: The pseudonyms and the classifier are not expressible in SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
