"""Cleaning of ``documents`` in five stages, each over all that the one before kept.

1. quality_rules: documents that the line-first rules reject go.
2. ngram_jaccard_join: of every class of near copies the smallest doc_id stays.
3. decontamination: documents that overlap a benchmark item go.
4. secret_scans: every secret in the texts that remain is replaced by a mark.
5. sentencepiece: the texts become token ids.

All stages but the last return the columns of their input, whatever those are
called.  Rows that share a doc_id are one document to the second stage and stay
or go together; a row with a null doc_id cannot stand for a class, and passes
it; to the other stages every row is judged by its text.  A null text is
rejected by the first stage, and empty to the others.  Texts are judged whole,
and an empty table gives an empty result.  SQL cannot express the decontamination, the trained models or the tokenizer, so there is
no oracle; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, jaccard, pieces, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the line-first rules keep; the text stays as it is."""
    return docs.where(quality.keeps(F.col("text")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every component of near copies, the one with the smallest id."""
    classes = jaccard.link_classes(docs.select("doc_id", "text"))
    gone = classes.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap an item of the benchmark table."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, tests)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text."""
    text = secrets.redacted(F.coalesce("text", F.lit("")), secrets.default_model(docs))
    return docs.select(*(c for c in docs.columns if c not in ("text", "n_chars")), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    from pathloom.llm.storage import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
