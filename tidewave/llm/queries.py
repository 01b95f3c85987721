"""The registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", folds=3, held_out=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", folds=5, held_out=0)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.quality_rules import quality_rules

    rules = quality_rules(table(spark, sf_dir, "documents"))
    return rules.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm import chat

    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.HARD).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.digests(chat.render(chat.fold(chat.streamed(chat.events_of_rows(rows)))))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.alignment import alignments

    return alignments(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewave.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_quality, op4_token_files, op5_toxicity, op6_bpe, op7_chat, op8_html_text, op9_minhash, op10_rules, op11_alignment, op12_vector_codes, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    from tidewave.llm import chat, decontamination, minhash, quality_rules, suffix_dedup, vector_codes

    return {"op1_suffix_dedup": suffix_dedup.ORACLE_SQL, "op9_minhash": minhash.ORACLE_SQL, "op2_decontamination": decontamination.ORACLE_SQL, "op7_chat": chat.ORACLE_SQL, "op10_rules": quality_rules.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL}
