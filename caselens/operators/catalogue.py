"""Catalogue ETL: normalise, check, derive text, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_text, multi_values, norm, shorten
from ..plans.scan import numbered
from ..schema import CORE_FIELDS, MULTI_VALUE_FIELDS, NO_CATEGORY, REQUIRED_FIELDS, RISK_ORDER


def _is_array(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "array"


def _value_list(df: DataFrame, name: str) -> Column:
    """Builder rule: a list or a ``;`` text becomes trimmed, distinct, non-blank values."""
    if not _is_array(df, name):
        return multi_values(F.col(name).cast("string"))
    parts = F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), line_text)
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def _loaded_list(df: DataFrame, name: str) -> Column:
    """Loader rule: a bare text stays one untouched value; lists are normalised, not deduplicated."""
    if _is_array(df, name):
        parts = F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), norm)
        return F.filter(parts, lambda part: part != "")
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.when(norm(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def normalize_cases(raw: DataFrame, order: str | None = None, mode: str = "builder") -> DataFrame:
    """All 31 fields in file order; unknown columns go, missing ones become ''/[].

    In builder mode a missing id becomes ``FZ-<position>`` by the integer column ``order``.
    """
    text, values = (line_text, _value_list) if mode == "builder" else (norm, _loaded_list)
    kept = []
    for name in CORE_FIELDS:
        if name not in raw.columns:
            empty = F.array().cast("array<string>") if name in MULTI_VALUE_FIELDS else F.lit("")
            kept.append(empty.alias(name))
        elif name in MULTI_VALUE_FIELDS:
            kept.append(values(raw, name).alias(name))
        else:
            kept.append(text(F.col(name).cast("string")).alias(name))
    if order is None:
        return raw.select(*kept)
    placed = numbered(raw.select(*kept, F.col(order)), [], order, "_position")
    surrogate = F.format_string("FZ-%03d", F.col("_position"))
    return placed.withColumn(
        "case_id", F.when(F.col("case_id") == "", surrogate).otherwise(F.col("case_id"))
    ).drop("_position")


def category_of() -> Column:
    return F.when(F.col("ccl2023_category") != "", F.col("ccl2023_category")).otherwise(
        F.col("custom_subcategory")
    )


def with_search_text(cases: DataFrame) -> DataFrame:
    content = norm(
        F.concat_ws(" ", "summary", "judgment_reason", "risk_signals", "prevention_advice")
    )
    return cases.withColumn("content", content).withColumn(
        "search_text",
        norm(
            F.concat_ws(
                " ", "title", "ccl2023_category", "custom_subcategory", "tags",
                "entry_channels", "key_methods", "victim_group", "content",
            )
        ),
    )


def project_cases(cases: DataFrame, detail: bool) -> DataFrame:
    """List rows carry the record and its category; detail rows add ``content``."""
    rows = cases.withColumn("category", category_of())
    return rows.select(*CORE_FIELDS, "category", *(["content"] if detail else []))


def _labelled(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), value))


def embedding_text(max_chars: int = 1400) -> Column:
    joined = F.concat_ws(
        "\n",
        F.concat(F.lit("案例："), F.col("title")),
        F.concat(F.lit("类别："), category_of()),
        _labelled("入口渠道：", F.array_join("entry_channels", "、")),
        _labelled("受害人群：", F.col("victim_group")),
        _labelled("关键手法：", F.array_join("key_methods", "、")),
        _labelled("风险等级：", F.col("risk_level")),
        _labelled("风险信号：", F.col("risk_signals")),
        _labelled("防范建议：", F.col("prevention_advice")),
        F.concat(F.lit("事实："), F.col("content")),
    )
    return shorten(norm(joined), max_chars)


def with_embedding_text(cases: DataFrame, max_chars: int = 1400) -> DataFrame:
    return cases.withColumn("embedding_text", embedding_text(max_chars))


def evidence_block() -> Column:
    """Seven labelled lines; long fields are cut."""
    def line(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return F.concat_ws(
        "\n",
        line("[", F.col("case_id"), "] ", F.col("title")),
        line(
            "类别：", category_of(), "；风险等级：", F.col("risk_level"),
            "；受害人群：", F.col("victim_group"),
        ),
        line(
            "入口渠道：", F.array_join("entry_channels", "、"),
            "；关键手法：", F.array_join("key_methods", "、"),
        ),
        line("风险信号：", F.substring("risk_signals", 1, 300)),
        line("防范建议：", F.substring("prevention_advice", 1, 360)),
        line("来源：", F.col("source_name")),
        line("事实：", F.substring("content", 1, 560)),
    )


def evidence_blocks(cases: DataFrame) -> DataFrame:
    return cases.withColumn("block", evidence_block())


def lookup(cases: DataFrame, ids: DataFrame, key: str = "case_id") -> DataFrame:
    """Every requested id with its record, or ``found = false``."""
    hits = cases.withColumn("found", F.lit(True))
    return ids.join(hits, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_missing_fields(cases: DataFrame) -> DataFrame:
    checks = [F.when(F.col(name) == "", F.lit(name)) for name in REQUIRED_FIELDS]
    missing = F.array_sort(F.filter(F.array(*checks), lambda name: name.isNotNull()))
    return cases.withColumn("missing", missing)


def split_rejects(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = with_missing_fields(cases)
    return checked.where(F.size("missing") == 0).drop("missing"), checked.where(F.size("missing") > 0)


def duplicate_ids(cases: DataFrame, key: str = "case_id") -> DataFrame:
    return cases.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def category_summary(cases: DataFrame, mode: str = "builder") -> DataFrame:
    """(id, name, item_count); the summary itself has one row per category."""
    if mode == "builder":
        first_official = F.when(F.size("official_category") > 0, F.get("official_category", F.lit(0)))
        name = F.coalesce(
            F.nullif(F.col("ccl2023_category"), F.lit("")), first_official, F.lit(NO_CATEGORY)
        )
        order = [F.desc("item_count"), F.asc("name")]
    else:
        cases = cases.where("ccl2023_category <> ''")
        name, order = F.col("ccl2023_category"), [F.asc("name")]
    counted = cases.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("item_count"))
    return counted.select(
        F.row_number().over(Window.orderBy(*order)).alias("id"), "name", "item_count"
    )


def facet_metadata(cases: DataFrame) -> DataFrame:
    """(kind, pos, value): counts, risk levels in their own order, channels by name."""
    tall = cases.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("item").alias("kind"), F.lit("").alias("value"))),
                F.array(F.struct(F.lit("category").alias("kind"), F.col("ccl2023_category").alias("value"))),
                F.array(F.struct(F.lit("risk_level").alias("kind"), F.col("risk_level").alias("value"))),
                F.transform("entry_channels", lambda c: F.struct(F.lit("entry_channel").alias("kind"), c.alias("value"))),
            )
        ).alias("f")
    )
    facets = (
        tall.groupBy("f.kind", "f.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("kind") == "item") | (F.trim("value") != ""))
    )
    counts = facets.groupBy().agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "item", F.col("n"))), F.lit(0)).alias("items"),
        F.count(F.when(F.col("kind") == "category", 1)).alias("categories"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("item_count").alias("kind"), F.lit(1).alias("pos"),
                         F.col("items").cast("string").alias("value")),
                F.struct(F.lit("category_count").alias("kind"), F.lit(1).alias("pos"),
                         F.col("categories").cast("string").alias("value")),
            )
        )
    )
    ranks = F.create_map(*[F.lit(x) for pair in RISK_ORDER.items() for x in pair])
    place = F.coalesce(F.try_element_at(ranks, F.col("value")), F.lit(99))
    listed = facets.where("kind IN ('risk_level', 'entry_channel')").select(
        "kind",
        F.row_number().over(
            Window.partitionBy("kind").orderBy(
                F.when(F.col("kind") == "risk_level", place).otherwise(0), "value"
            )
        ).alias("pos"),
        "value",
    )
    return counts.unionByName(listed)


def contract_checks(cases: DataFrame, categories: DataFrame, allowed: list[str]) -> DataFrame:
    """One row per check: (check, expected, actual, ok)."""
    fields = [name for name in cases.columns if name in CORE_FIELDS]
    ids = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids")
    )
    names = categories.agg(
        F.sum("item_count").alias("counted"), F.count(F.when(~F.col("name").isin(allowed), 1)).alias("foreign")
    )
    both = ids.unionByName(names, allowMissingColumns=True)
    one = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "ids", "counted", "foreign")])

    def check(name: str, expected: Column, actual: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), expected.cast("bigint").alias("expected"),
            actual.cast("bigint").alias("actual"), (expected == actual).alias("ok"),
        )

    return one.select(
        F.inline(
            F.array(
                check("distinct_ids", F.col("rows"), F.col("ids")),
                check("field_set", F.lit(len(CORE_FIELDS)), F.lit(len(fields))),
                check("category_counts", F.col("rows"), F.col("counted")),
                check("category_domain", F.lit(0), F.col("foreign")),
            )
        )
    )
