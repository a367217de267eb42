"""Locale tagging and sentence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language as lang


def tag_locale(texts: DataFrame, text: str = "text", hint: str | None = None) -> DataFrame:
    return texts.withColumn("locale", lang.detect_locale(text, F.col(hint) if hint else None))


def locale_confusion(tagged: DataFrame, label: str) -> DataFrame:
    """Tag counts against a label."""
    return tagged.groupBy(label, "locale").agg(F.count(F.lit(1)).alias("n"))


def canonical_locales(rows: DataFrame, column: str) -> DataFrame:
    """``locale`` from a hint, ``provider`` from a provider tag, ``profile`` with fallback,
    ``chinese`` flag."""
    return rows.select(
        "*",
        lang.canonical_locale(column).alias("locale"),
        lang.provider_locale(column).alias("provider"),
        lang.profile_code(column).alias("profile"),
        lang.is_chinese(column).alias("chinese"),
    )


def _split(texts: DataFrame, text: str) -> DataFrame:
    parted = texts.withColumn("_parts", lang.sentence_parts(text))
    return parted.withColumn("_done", lang.completed_sentences(F.col("_parts")))


def sentences(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, sentence) of the completed sentences."""
    # the outer form keeps Spark from adding a size filter that would split every text twice
    rows = _split(texts, text).select(*keys, F.posexplode_outer("_done").alias("_p", "sentence"))
    return rows.where("sentence IS NOT NULL").select(*keys, (F.col("_p") + 1).alias("pos"), "sentence")


def first_and_rest(texts: DataFrame, keys: list[str], text: str, locale: str) -> DataFrame:
    return _split(texts, text).select(
        *keys,
        F.coalesce(F.get("_done", F.lit(0)), F.lit("")).alias("first"),
        lang.rest_of_text(F.col("_done"), F.col("_parts"), F.col(locale)).alias("rest"),
    )
