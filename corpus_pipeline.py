"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as Parquet and read again.
docs has the columns of documents, and may have others of any name: all stages but the last keep them. Every stage takes null texts as
empty ones, texts of any length whole, and an empty table (it gives none). Rows that share a doc_id, or have none, are told apart by
their texts, in any order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm.bpe import encode_documents
from tidewave.llm.common import cut
from tidewave.llm.decontamination import clean_documents
from tidewave.llm.minhash import without_near_copies
from tidewave.llm.quality_rules import good_documents
from tidewave.llm.queries import tokenizer_path
from tidewave.llm.suffix_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row is judged by its own text. Empty texts go: they have too few words."""
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group linked at a similarity of 0.8 or more on five words. Rows that share id and text
    are one document; rows without an id or without words are linked with nothing and stay."""
    return without_near_copies(docs, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that start earlier in the corpus. Each row stays, with what is left of its text; rows
    without an id stay whole."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; each row is judged by its own text, also where it has no id."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of the ids and of the text decoded from them: a row for each row, without other columns."""
    return encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: No SQL: the first stage's verdict and the last stage's merges can't be written in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the tables between stages stay in the shared folder, as the result is read from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
