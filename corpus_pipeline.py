"""A corpus pipeline of five stages: toxicity, SimHash near-dedup, decontamination, secret scan, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``.  ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
No stage is expressible in SQL as it is (trained classifier, Golay keys, latent search, entropy, merges): see tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwalk.llm.common import dropped, packed, remainder, stored, table, unpacked


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it learns from the labels of what is there, held-out ids apart.

    Null texts count as empty and stay; without labels all stay; repeated rows share their fate.
    """
    from braidwalk.llm.toxicity import score_documents, train

    learn = remainder("doc_id", 5) != 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.select("doc_id", "text").filter(learn), labels.filter(learn))
    rows = score_documents(packed(docs), model, fields=("score", "predicted"), keep_text=True)
    return unpacked(rows.filter("predicted = 0"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the smallest id (nulls last); ids may repeat or be null.

    Near: a Jaccard similarity of 0.8 or more of the sets of five-word shingles, verified; SimHash at 4 of 64 bits and
    minima of the sets propose the pairs.  Texts without words are one group.
    """
    from braidwalk.llm.nearcopies import one_of_each

    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, row by row: ids may repeat or be null.  Null texts hold none."""
    from braidwalk.llm.decontam import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; no document goes, a null text stays null."""
    from braidwalk.llm.secrets import redact_documents

    out = redact_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    import public_tokenizers

    from braidwalk.llm.bpe import encode_documents

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("bpe_encode", bpe_encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
