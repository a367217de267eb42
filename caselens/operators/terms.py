"""Domain-term correction of transcripts against the catalogue vocabulary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE_CLASS, bind, casefold
from ..plans.match import FLUSH_ROWS, find_terms
from ..session import pinned

# Common terms, weights and acceptance limits.
COMMON_TERMS = (
    "验证码", "共享屏幕", "远程控制", "安全账户", "刷单返利", "杀猪盘", "冒充客服",
    "冒充公检法", "网络投资理财", "虚假购物", "贷款诈骗", "游戏交易", "诱导转账",
    "陌生链接", "陌生App", "止付", "冻结", "96110",
)
HAN_RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
CHINESE_TAGS = ("zh", "cn", "zh_cn", "cn_cbm", "chinese")
SOUND_WEIGHT, SHAPE_WEIGHT = 0.52, 0.48
CATEGORY_BONUS, CONTEXT_BONUS = 0.10, 0.12
MIN_SCORE, MIN_MARGIN = 0.88, 0.12
TRUSTED_KINDS = ("common", "category", "channel")
BUCKET = 32

KeyFn = Callable[[Column], Column]


@F.pandas_udf(T.DoubleType())
def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two short texts, or of two lists element by element."""
    return pd.Series([
        SequenceMatcher(None, *(x if isinstance(x, str) else list(x) for x in pair)).ratio() for pair in zip(left, right)
    ])


def _squeezed(text: Column) -> Column:
    return casefold(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", ""))


def build_vocabulary(cases: DataFrame, run: str = HAN_RUN, order: str = "input_pos") -> DataFrame:
    """(canonical, kind, category, forms, place): entries of titles, categories, channels,
    subcategories and the common terms. For one (canonical, kind) the last record's
    category counts; ``place`` is where the entry came up first."""
    aliases = [c for c in ("aliases", "alternate_names") if c in cases.columns]
    none = F.array().cast("array<string>")
    extra = F.concat(*[F.col(c) for c in aliases]) if aliases else none

    def entry(kind: str, slot: int, value: Column, forms: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(slot).alias("slot"), F.trim(value).alias("canonical"),
            forms.alias("forms"),
        )

    title, category, sub = F.col("title"), F.col("ccl2023_category"), F.col("custom_subcategory")
    entries = F.concat(
        F.array(
            entry("title", 0, title, F.concat(F.array(title), extra)),
            entry("category", 1, category, F.array(category)),
            entry("subcategory", 3, sub, F.array(sub)),
        ),
        F.transform(
            F.filter("entry_channels", lambda c: F.length(c) >= 2),
            lambda c: entry("channel", 2, c, F.array(c)),
        ),
    )
    tall = cases.select(F.col(order).alias("_o"), category.alias("category"), F.inline(entries)).where("canonical <> ''")
    at = F.struct("_o", "slot")
    named = tall.groupBy("canonical", "kind").agg(
        F.max_by("category", at).alias("category"), F.max_by("forms", at).alias("forms"), F.min(at).alias("place")
    )
    spark = cases.sparkSession
    common = spark.createDataFrame([(t, i) for i, t in enumerate(COMMON_TERMS)], "canonical string, i int").select(
        "canonical", F.lit("common").alias("kind"), F.lit("").alias("category"), F.array("canonical").alias("forms"),
        F.struct(F.lit((1 << 62)).alias("_o"), F.col("i").alias("slot")).alias("place"),
    )
    return named.unionByName(common).withColumn(
        "forms", F.array_distinct(F.filter(F.transform("forms", lambda f: F.trim(f)), lambda f: f != ""))
    )


def vocabulary_forms(vocabulary: DataFrame, run: str = HAN_RUN) -> DataFrame:
    """One row per form made of run characters only, with its first-character key."""
    rows = vocabulary.select("canonical", "kind", "category", "place", F.explode("forms").alias("form"))
    return rows.where(F.col("form").rlike(f"^(?:{run})$")).select(
        "*", F.length("form").alias("size"), F.substring("form", 1, 1).alias("first")
    )


def term_candidates(raws: DataFrame, forms: DataFrame, key_fn: KeyFn | None = None) -> DataFrame:
    """(raw, canonical, kind, category): entries whose sound key equals that of ``raw``;
    where there are none, entries of the same length and first character. One entry per
    canonical text, the one that came up last. Without ``key_fn`` the key is the text."""
    key = key_fn or (lambda text: text)
    rows = raws.select("raw").distinct()
    entry = ["canonical", "kind", "category", "place"]
    by_key = rows.withColumn("_k", key(F.col("raw"))).join(
        forms.select(key(F.col("form")).alias("_k"), *entry).distinct(), "_k"
    ).drop("_k")
    # the length has to be one the vocabulary has
    sizes = forms.select(F.col("size")).distinct()
    by_key = by_key.withColumn("size", F.length("raw")).join(sizes, "size", "left_semi").drop("size")
    left = rows.join(by_key.select("raw"), "raw", "left_anti")
    by_first = left.select("raw", F.length("raw").alias("size"), F.substring("raw", 1, 1).alias("first")).join(
        forms.select("size", "first", *entry).distinct(), ["size", "first"]
    ).drop("size", "first")
    return by_key.unionByName(by_first).groupBy("raw", "canonical").agg(
        F.max_by(F.struct("kind", "category"), "place").alias("_e")
    ).select("raw", "canonical", "_e.kind", "_e.category")


def base_scores(candidates: DataFrame, vocabulary: DataFrame, key_fn: KeyFn | None = None) -> DataFrame:
    """Adds ``base``, the sound and shape similarity of the entry's closest form.

    A ``key_fn`` that gives an array of syllables has sounds compared syllable by syllable, so
    two that differ share nothing; one that gives a text has them compared by letters.
    """
    key = key_fn or (lambda text: text)
    forms = vocabulary.select("canonical", "kind", F.explode("forms").alias("form"))
    pairs = candidates.join(forms, ["canonical", "kind"])
    same = F.size(F.filter(
        F.arrays_zip(F.split("raw", "").alias("a"), F.split("form", "").alias("b")),
        lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)) & (p["a"] != ""),
    )) / F.greatest(F.length("raw"), F.length("form"))
    measured = pairs.withColumn("_ratio", block_ratio("raw", "form")).withColumn(
        "_sound", F.col("_ratio") if key_fn is None else block_ratio(key(F.col("raw")), key(F.col("form")))
    ).withColumn("_shape", (same + F.col("_ratio")) / 2)
    best = measured.groupBy(*candidates.columns).agg(
        F.max_by(F.struct("_sound", "_shape"), F.struct(F.col("_sound") + F.col("_shape"), "form")).alias("_m")
    )
    return best.withColumn(
        "base", SOUND_WEIGHT * F.col("_m._sound") + SHAPE_WEIGHT * F.col("_m._shape")
    ).drop("_m")


def text_windows(texts: DataFrame, keys: list[str], text: str, forms: DataFrame, run: str, all_sizes: bool) -> DataFrame:
    """(keys, start, raw): substrings inside runs that a vocabulary length and first
    character allow (every vocabulary length with ``all_sizes``). ``start`` is 0-based.

    ``run`` is a repeated class of characters. The lengths that each first character goes
    with are shipped, at most the characters of the class times the vocabulary's lengths.
    """
    pairs = forms.where("size >= 2").select(F.lit("") if all_sizes else "first", "size").distinct().collect()
    lengths: dict[str, list[int]] = {}
    for first, size in sorted(map(tuple, pairs)):
        lengths.setdefault(first, []).append(size)
    shipped = texts.sparkSession.sparkContext.broadcast(lengths)
    # the class is written as the JVM reads it
    pattern = re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", run)
    schema = T.StructType([
        *[texts.schema[name] for name in keys], T.StructField("start", T.IntegerType()), T.StructField("raw", T.StringType())
    ])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, sizes = re.compile(pattern), shipped.value
        always = sizes.get("", ())
        for batch in batches:
            rows: list[int] = []
            places: list[int] = []
            words: list[str] = []

            def made(batch: pa.RecordBatch = batch, rows: list = rows, places: list = places, words: list = words) -> pa.RecordBatch:
                taken = pa.array(rows, pa.int32())
                out = [batch.column(i).take(taken) for i in range(len(keys))] + [pa.array(places, pa.int32()), pa.array(words, pa.string())]
                for each in (rows, places, words):
                    each.clear()
                return pa.RecordBatch.from_arrays(out, names=[*keys, "start", "raw"])

            for row, body in enumerate(batch.column(len(keys))):
                body = body.as_py() or ""
                for span in runs.finditer(body):
                    stop = span.end()
                    for at in range(span.start(), stop):
                        for size in always or sizes.get(body[at], ()):
                            if at + size > stop:
                                break
                            rows.append(row)
                            places.append(at)
                            words.append(body[at : at + size])
                    if len(rows) >= FLUSH_ROWS:
                        yield made()
            if rows:
                yield made()

    return texts.select(*keys, F.col(text).alias("_scanned")).mapInArrow(windows, schema)


def exclude_spans(windows: DataFrame, exact: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Windows that overlap no exact vocabulary hit. ``exact``: keys, l, r (0-based, end
    open). Both sides meet in buckets of positions, so one long text has many join keys."""
    spread = exact.select(
        *keys, "l", "r",
        F.explode(F.sequence(F.floor((F.col("l") - longest) / BUCKET), F.floor((F.col("r") - 1) / BUCKET))).alias("_b"),
    )
    placed = windows.withColumn("_b", F.floor(F.col("start") / BUCKET))
    w, x = placed.alias("w"), spread.alias("x")
    same = F.col("w._b") == F.col("x._b")
    for name in keys:
        same = same & (F.col(f"w.{name}") == F.col(f"x.{name}"))
    overlap = (F.col("w.start") < F.col("x.r")) & (F.col("w.start") + F.length("w.raw") > F.col("x.l"))
    return w.join(x, same & overlap, "left_anti").drop("_b")


def exact_hits(texts: DataFrame, keys: list[str], text: str, forms: DataFrame) -> DataFrame:
    found = find_terms(texts, keys, text, forms, "form")
    return found.select(*keys, (F.col("pos") - 1).alias("l"), (F.col("pos") - 1 + F.length("term")).alias("r"))


def nonoverlap_spans(spans: Column) -> Column:
    """Greedy choice over spans sorted by start, longer first, higher score first: a span
    stays if it starts at or after the end of the last kept one."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), (-(s["end"] - s["start"])).alias("_len"), (-s["score"]).alias("_score"),
            s["end"].alias("end"), s["raw"].alias("raw"), s["canonical"].alias("canonical"),
            s["score"].alias("score"), s["reason"].alias("reason"),
        ))
    )

    def keep(kept: Column, s: Column) -> Column:
        clear = s["start"] >= F.element_at(kept, -1)["end"]
        return F.when(clear, F.concat(kept, F.array(s))).otherwise(kept)

    return bind(
        ordered,
        lambda row: F.aggregate(
            F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), F.slice(row, 1, 1), keep
        ),
    )


def correct_terms(
    texts: DataFrame, vocabulary: DataFrame, keys: list[str], text: str = "text", *, run: str = HAN_RUN,
    key_fn: KeyFn | None = None, min_score: float = MIN_SCORE, margin: float = MIN_MARGIN,
) -> DataFrame:
    """(keys, raw_text, canonical_text, spans).

    Optional columns of ``texts``: category, context (array of recent titles and
    alternative transcripts), language. Rows in another language pass unchanged.
    Similarity is measured once per distinct substring and entry; the bonuses of the row
    come on top.
    """
    entries = pinned(vocabulary)
    forms = pinned(vocabulary_forms(entries, run))
    longest = int(forms.agg(F.max("size")).first()[0] or 0)
    rows = texts
    if "category" not in rows.columns:
        rows = rows.withColumn("category", F.lit(""))
    if "context" not in rows.columns:
        rows = rows.withColumn("context", F.array().cast("array<string>"))
    if "language" in rows.columns:
        tag = F.replace(casefold(F.trim(F.coalesce("language", F.lit("")))), F.lit("-"), F.lit("_"))
        spoken = rows.where(tag.isin(list(CHINESE_TAGS)))
    else:
        spoken = rows
    windows = text_windows(spoken, keys, text, forms, run, key_fn is not None)
    free = pinned(exclude_spans(windows, exact_hits(spoken, keys, text, forms), keys, longest))
    measured = base_scores(term_candidates(free, forms, key_fn), entries, key_fn)
    # a rival this weak cannot come within the margin of an accepted score, bonuses included
    floor = min_score - margin - CATEGORY_BONUS - CONTEXT_BONUS
    rated = pinned(measured.where(F.col("base") >= floor)).withColumnRenamed("category", "_category")

    named = entries.select("canonical", "kind", F.col("forms").alias("_forms"))
    joined = (
        free.join(rated, "raw").join(named, ["canonical", "kind"])
        .join(rows.select(*keys, "category", "context"), keys)
    )
    wanted = _squeezed(F.col("category"))
    in_category = (wanted != "") & (wanted == _squeezed(F.col("_category")))
    in_context = F.exists(
        "context",
        lambda v: v.contains(F.col("canonical")) | F.exists("_forms", lambda f: v.contains(f)),
    )
    scored = joined.select(
        *keys, "start", "raw", "canonical", "kind",
        F.least(
            F.lit(1.0),
            F.col("base") + F.when(in_category, CATEGORY_BONUS).otherwise(0.0)
            + F.when(in_context, CONTEXT_BONUS).otherwise(0.0),
        ).alias("score"),
        F.concat_ws("; ", F.when(in_category, "category"), F.when(in_context, "asr-context")).alias("_why"),
    )
    spot = [*keys, "start", "raw"]
    # the two best of a window are enough; they are kept by a bounded aggregate
    best = scored.groupBy(*spot).agg(
        F.max(F.struct("score", "canonical", "kind", "_why")).alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    rivals = scored.join(best.select(*spot, F.col("_b.canonical").alias("_top")), spot).where(
        "canonical <> _top"
    ).groupBy(*spot).agg(F.max("score").alias("_second"))
    accepted = best.join(rivals, spot, "left").where(
        (F.col("_b.canonical") != F.col("raw"))
        & (F.col("_b.score") >= min_score)
        & (F.col("_b.score") - F.coalesce("_second", F.lit(0.0)) >= margin)
        & ((F.col("_b._why") != "") | F.col("_b.kind").isin(list(TRUSTED_KINDS)))
    )
    why = F.when(F.col("_b._why") == "", "vocabulary").otherwise(F.col("_b._why"))
    spans = accepted.select(
        *keys,
        F.struct(
            "start", (F.col("start") + F.length("raw")).alias("end"), "raw", F.col("_b.canonical").alias("canonical"),
            F.col("_b.score").alias("score"), why.alias("reason"),
        ).alias("_s"),
    ).groupBy(*keys).agg(nonoverlap_spans(F.collect_list("_s")).alias("_kept"))
    return rows.join(spans, keys, "left").select(
        *keys,
        F.col(text).alias("raw_text"),
        F.when(F.col("_kept").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_kept"))).alias("canonical_text"),
        F.when(F.col("_kept").isNotNull(), F.transform("_kept", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"),
            s["canonical"].alias("canonical"), F.round(s["score"], 6).alias("score"), s["reason"].alias("reason"),
        ))).alias("spans"),
    )


def splice(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its canonical form."""
    def piece(span: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, before + 1, span["start"] - before), span["canonical"])

    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    return F.concat(F.array_join(F.transform(spans, piece), ""), tail)
