"""The thin query of each operator, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_documents

    return count_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learn = remainder("doc_id", 5) != 0
    model = train(docs.filter(learn), labels.filter(learn))
    return score_documents(docs.withColumn("held_out", ~learn), model)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .egojoin import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_profiles, predict_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 3) == 1
    profiles = learn_profiles(docs.filter(~held).select("text", "lang"))
    return predict_documents(docs.select("doc_id", "text", held.alias("held_out")), profiles)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_duplicate_groups

    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lmscore import score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 10) == 0
    out = score_documents(docs.withColumns({"held_out": held, "learn": ~held}), "learn", public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.drop("learn")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_secret_scan, op3_token_counts, op4_toxicity, op5_bpe_codec, op6_embedding_near_dedup, op7_language_id, op8_substring_dedup, op9_simhash_near_dedup, op10_lm_score)}
ORACLES: dict[str, str] = {}
