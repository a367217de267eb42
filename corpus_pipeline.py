"""From raw documents to token ids: language, repeated lines, near copies, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm.bpe import encode_texts
from caselens.llm.decontaminate import contamination
from caselens.llm.language_id import UNDETERMINED, fit_language_model, held_out, identify
from caselens.llm.lines import drop_repeated_lines
from caselens.llm.minhash import near_components
from caselens.llm.store import Scratch

#: Documents whose language is less certain than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: The vocabulary of the token ids, a file that every executor has.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Near copies share at least so many hundredths of their shingles.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts of no certain language (operator 4)."""
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    names = docs.columns
    told = identify(docs.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(names)), F.col("text").alias("read")), model, "own_0", "read", tuple(f"own_{i}" for i in range(1, len(names))))
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return told.where(sure).select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(names)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that an earlier line is similar to, short ones that equal an earlier one, and documents of which nothing is left (operator 8)."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest id (operator 6)."""
    kept = near_components(docs, percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark (operator 5)."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]), "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digest and that of the bytes they decode to (operator 2)."""
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Not every stage can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
