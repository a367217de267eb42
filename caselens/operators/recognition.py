"""Recognition-result and chat-chunk logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scan import Max, ordered_scan
from ..schema import PIECE_SCHEMA

DELTA_SCHEMA = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("delta", T.StructType([T.StructField("content", T.StringType())])),
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
    ]))),
])


def chunk_log_to_deltas(
    lines: DataFrame, key: str = "stream", order: str = "line_no", text: str = "line"
) -> DataFrame:
    """(key, order, delta): content of each data line before the stream's ``[DONE]``."""
    body = F.when(F.col(text).startswith("data:"), F.trim(F.substring(F.col(text), 6, 1 << 30))).otherwise(F.col(text))
    kept = lines.where((F.coalesce(F.col(text), F.lit("")) != "") & ~F.col(text).startswith(":")).withColumn("_body", body)
    ended = ordered_scan(kept, [key], order, {"_done": Max(F.when(F.col("_body") == "[DONE]", 1))})
    choice = F.get(F.from_json("_body", DELTA_SCHEMA)["choices"], F.lit(0))
    delta = F.coalesce(choice["delta"]["content"], choice["message"]["content"], F.lit(""))
    return (
        ended.where("_done IS NULL AND _body <> '[DONE]'")
        .withColumn("delta", delta).where("delta <> ''")
        .select(key, order, "delta")
    )


def parse_recognition_log(lines: DataFrame, text: str = "payload") -> DataFrame:
    """Adds ``result``, the nested word lattice of a base64 JSON payload."""
    return lines.withColumn("result", F.from_json(F.unbase64(text).cast("string"), PIECE_SCHEMA))


def _segments(result: Column) -> Column:
    """Non-empty words per segment."""
    words = F.transform(
        F.coalesce(result["ws"], F.array().cast(PIECE_SCHEMA["ws"].dataType)),
        lambda s: F.filter(F.transform(s["cw"], lambda c: F.coalesce(c["w"], F.lit(""))), lambda w: w != ""),
    )
    return F.filter(words, lambda w: F.size(w) > 0)


def piece_candidates(result: Column) -> Column:
    """Full-text hypotheses of one result: alternative i of every segment, the first where
    a segment has fewer."""
    segments = _segments(result)
    count = F.array_max(F.transform(segments, F.size))
    texts = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.array_join(F.transform(segments, lambda w: F.coalesce(F.get(w, i), F.get(w, F.lit(0)))), ""),
    )
    return F.when(F.size(segments) > 0, F.array_distinct(F.filter(texts, lambda t: t != ""))).otherwise(
        F.array().cast("array<string>")
    )


def piece_language(result: Column) -> Column:
    """Most frequent first language tag over the segments, the earliest on ties."""
    first_tags = F.filter(
        F.transform(
            result["ws"],
            lambda s: F.get(
                F.filter(
                    F.transform(s["cw"], lambda c: F.lower(F.trim(F.coalesce(c["lg"], F.lit(""))))),
                    lambda g: g != "",
                ),
                F.lit(0),
            ),
        ),
        lambda g: g.isNotNull(),
    )
    counted = F.transform(
        F.array_distinct(first_tags),
        lambda g: F.struct(
            F.size(F.filter(first_tags, lambda x: x == g)).alias("n"),
            (-F.array_position(first_tags, g)).alias("at"), g.alias("tag"),
        ),
    )
    return F.coalesce(F.array_max(counted)["tag"], F.lit(""))


def surviving_pieces(
    pieces: DataFrame, keys: Sequence[str] = ("stream",), filled: str = "word <> ''"
) -> DataFrame:
    """Pieces left after range replacements and overwrites, with ``placed``, the arrival
    that opened their place.

    A replacement of [a, b] removes pieces with ``sn`` in the range that arrived before it;
    among filled pieces with the same ``sn`` the last arrival stays. Replacement ranges
    become one row per covered ``sn``, so both rules are equi-joins. Columns: keys,
    arrival, sn, pgs, rg_start, rg_end.
    """
    keys = list(keys)
    cuts = (
        pieces.where("pgs = 'rpl' AND rg_start IS NOT NULL AND rg_end >= rg_start")
        .select(*keys, "arrival", F.explode(F.sequence(F.col("rg_start").cast("int"), F.col("rg_end").cast("int"))).alias("sn"))
        .groupBy(*keys, "sn").agg(F.max("arrival").alias("_cut"))
    )
    others = [c for c in pieces.columns if c not in [*keys, "sn"]]
    left = pieces.where(filled).join(cuts, [*keys, "sn"], "left").where("_cut IS NULL OR _cut <= arrival")
    newest = left.groupBy(*keys, "sn").agg(
        F.max_by(F.struct(*others), "arrival").alias("_p"), F.min("arrival").alias("placed")
    )
    return newest.select(*keys, "sn", *[F.col(f"_p.{c}").alias(c) for c in others], "placed")


def dominant_language(pieces: DataFrame, keys: Sequence[str] = ("stream",), tag: str = "lg", order: str = "arrival") -> DataFrame:
    """Most frequent non-blank tag per key; on ties the one seen first."""
    counts = pieces.where(F.col(tag) != "").groupBy(*keys, tag).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")
    )
    return counts.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(tag).alias("language"), "n"), F.struct("n", -F.col("_first"))).alias("_top")
    ).select(*keys, "_top.language", "_top.n")


def nbest(pieces: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """(keys, rank, text): distinct full transcripts, alternative i of every piece, with
    the top transcript in front if it is not among them. ``pieces``: keys, sn, candidates
    (non-empty array). A key is one utterance."""
    keys = list(keys)
    ordered = F.array_sort(F.collect_list(F.struct("sn", "candidates")))
    rows = pieces.where(F.size("candidates") > 0).groupBy(*keys).agg(
        F.max(F.size("candidates")).alias("_n"), ordered.alias("_pieces")
    )
    texts = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.trim(F.array_join(
            F.transform("_pieces", lambda p: F.coalesce(F.get(p["candidates"], i), F.get(p["candidates"], F.lit(0)))), ""
        )),
    )
    distinct = F.array_distinct(F.filter(texts, lambda t: t != ""))
    found = rows.select(*keys, F.posexplode_outer(distinct).alias("_p", "text")).where("text IS NOT NULL")
    return found.select(
        *keys, (F.col("_p") + 1).alias("rank"), "text"
    )
