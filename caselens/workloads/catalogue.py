"""Catalogue ETL, facets and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import multi_values, norm
from ..operators import catalogue as op
from ..operators.search import facet_filter
from ..sources.cases import parse_envelopes
from ..views import case_docs, doc_cases, events_k, part_cases, sql_with, table
from .registry import query
from .sqltext import s_norm

_ONE = """SELECT event_id, k, event_type, 'E-' || event_id || '-1' AS id1, 'E-' || event_id || '-2' AS id2 FROM ev"""


@query("scan_case_json", sql_with("ev", """
SELECT event_id, 1 AS input_pos, CASE WHEN k % 4 = 2 THEN id2 ELSE id1 END AS case_id,
  CASE WHEN k % 4 = 2 THEN event_type || ' two' ELSE event_type END AS title,
  CASE WHEN k % 4 = 2 THEN '' ELSE 'v' || k END AS summary FROM one
UNION ALL SELECT event_id, 2, id2, event_type || ' two', '' FROM one WHERE k % 4 IN (0, 3)""",
    f"one AS ({_ONE})"))
def scan_case_json(spark, sf):
    first = F.concat(
        F.lit('{"case_id":"E-'), F.col("event_id").cast("string"), F.lit('-1","title":"'),
        F.col("event_type"), F.lit('","summary":"v'), F.col("k").cast("string"), F.lit('","extra":1}'),
    )
    second = F.concat(
        F.lit('{"case_id":"E-'), F.col("event_id").cast("string"), F.lit('-2","title":"'),
        F.col("event_type"), F.lit(' two"}'),
    )
    kind = F.col("k") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('{"items":['), first, F.lit(","), second, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('{"items":[],"records":['), first, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('\ufeff{"schema_version":4,"list":['), second, F.lit("]}")))
        .otherwise(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
    )
    cases = parse_envelopes(events_k(spark, sf).select("event_id", text.alias("envelope")), "event_id", "envelope")
    return cases.select(
        "event_id", F.col("input_pos").cast("int").alias("input_pos"), "case_id", "title", F.coalesce("summary", F.lit("")).alias("summary")
    )


@query("case_projection", sql_with("doc_cases", """
SELECT case_id, title, summary, judgment_reason, risk_signals, prevention_advice, source_name,
  ccl2023_category, custom_subcategory, risk_level, source_name || '|' || lang AS entry_channels, victim_group,
  ccl2023_category AS category, '' AS tags, '' AS remark FROM doc_cases JOIN documents ON doc_id = input_pos"""))
def case_projection(spark, sf):
    rows = op.project_cases(doc_cases(spark, sf), detail=False)
    return rows.select(
        "case_id", "title", "summary", "judgment_reason", "risk_signals", "prevention_advice",
        "source_name", "ccl2023_category", "custom_subcategory", "risk_level",
        F.array_join("entry_channels", "|").alias("entry_channels"), "victim_group", "category",
        F.array_join("tags", "|").alias("tags"), "remark",
    )


@query("normalize_text", f"SELECT doc_id, {s_norm('text')} AS text FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", norm("text").alias("text"))


@query("multi_value_split", sql_with("case_docs", """
SELECT case_id, pos, value FROM (
  SELECT case_id, 1 AS pos, source_name AS value FROM case_docs
  UNION ALL SELECT case_id, 2, split_part(replace(entry_channels_raw, '；', ';'), ';', 2) FROM case_docs)"""))
def multi_value_split(spark, sf):
    values = case_docs(spark, sf).select(
        "case_id", F.posexplode(multi_values("entry_channels")).alias("pos", "value")
    )
    return values.withColumn("pos", F.col("pos") + 1)


@query("case_search_text", sql_with("doc_cases", f"""
SELECT case_id, content, {s_norm("concat_ws(' ', title, ccl2023_category, custom_subcategory, source_name, lang, victim_group, content)")} AS search_text
FROM doc_cases JOIN documents ON doc_id = input_pos"""))
def case_search_text(spark, sf):
    return doc_cases(spark, sf).select("case_id", "content", "search_text")


@query("surrogate_ids", sql_with("case_docs", """
SELECT input_pos, CASE WHEN victim_group = 'short' THEN case_id
  ELSE 'FZ-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END END AS case_id
FROM (SELECT *, row_number() OVER (ORDER BY input_pos) AS n FROM case_docs)"""))
def surrogate_ids(spark, sf):
    raw = case_docs(spark, sf)
    blanked = raw.withColumn(
        "case_id", F.when(F.col("victim_group") == "short", F.col("case_id")).otherwise("  ")
    )
    return op.normalize_cases(blanked, order="input_pos").select("input_pos", "case_id")


_EMBED = f"""emb AS (SELECT case_id, {s_norm('''concat_ws(chr(10), '案例：' || title, '类别：' || ccl2023_category,
  '入口渠道：' || source_name || '、' || lang, CASE WHEN victim_group <> '' THEN '受害人群：' || victim_group END,
  CASE WHEN risk_level <> '' THEN '风险等级：' || risk_level END,
  CASE WHEN risk_signals <> '' THEN '风险信号：' || risk_signals END,
  CASE WHEN prevention_advice <> '' THEN '防范建议：' || prevention_advice END, '事实：' || content)''')} AS t
  FROM doc_cases JOIN documents ON doc_id = input_pos),
marked AS (SELECT *, regexp_replace(regexp_replace(t, '([\\p{{L}}\\p{{N}}_][\\p{{L}}_])-([\\p{{L}}\\p{{N}}_]+[\\p{{L}}_])', '\\1' || chr(2) || '\\2', 'g'),
  '([\\p{{L}}\\p{{N}}_][\\p{{L}}_])-([\\p{{L}}\\p{{N}}_]+[\\p{{L}}_])', '\\1' || chr(2) || '\\2', 'g') AS m FROM emb),
cuts AS (SELECT *, greatest(CASE WHEN instr(reverse(substr(m, 1, 1398)), ' ') > 0 THEN length(substr(m, 1, 1398)) - instr(reverse(substr(m, 1, 1398)), ' ') ELSE -1 END,
  CASE WHEN instr(reverse(substr(m, 1, 1397)), chr(2)) > 0 THEN length(substr(m, 1, 1397)) + 1 - instr(reverse(substr(m, 1, 1397)), chr(2)) ELSE 0 END, 0) AS cut FROM marked)"""


@query("embedding_text", sql_with("doc_cases", """
SELECT case_id, CASE WHEN length(t) <= 1400 THEN t ELSE rtrim(replace(substr(m, 1, cut), chr(2), '-')) || '...' END AS embedding_text
FROM cuts""", _EMBED))
def embedding_text(spark, sf):
    return op.with_embedding_text(doc_cases(spark, sf)).select("case_id", "embedding_text")


EVIDENCE_SQL = """concat_ws(chr(10), '[' || case_id || '] ' || title,
  '类别：' || ccl2023_category || '；风险等级：' || risk_level || '；受害人群：' || victim_group,
  '入口渠道：' || source_name || '、' || lang || '；关键手法：',
  '风险信号：' || substr(risk_signals, 1, 300), '防范建议：' || substr(prevention_advice, 1, 360),
  '来源：' || source_name, '事实：' || substr(content, 1, 560))"""


@query("evidence_block", sql_with("doc_cases", f"""
SELECT case_id, {EVIDENCE_SQL} AS block FROM doc_cases JOIN documents ON doc_id = input_pos"""))
def evidence_block(spark, sf):
    return op.evidence_blocks(doc_cases(spark, sf)).select("case_id", "block")


@query("case_detail", sql_with("doc_cases", """
SELECT case_id, title, ccl2023_category AS category, content FROM doc_cases"""))
def case_detail(spark, sf):
    detail = op.project_cases(doc_cases(spark, sf), detail=True)
    return detail.select("case_id", "title", "category", "content")


@query("case_lookup", sql_with("doc_cases", """
SELECT r.case_id, coalesce(title, '') AS title, c.case_id IS NOT NULL AS found
FROM (SELECT 'FZ-' || lpad(CAST(vec_id * 3 AS VARCHAR), 6, '0') AS case_id FROM embeddings) r
LEFT JOIN doc_cases c ON r.case_id = c.case_id"""))
def case_lookup(spark, sf):
    ids = table(spark, sf, "embeddings").select(
        F.concat(F.lit("FZ-"), F.lpad((F.col("vec_id") * 3).cast("string"), 6, "0")).alias("case_id")
    )
    return op.lookup(doc_cases(spark, sf), ids).select(
        "case_id", F.coalesce("title", F.lit("")).alias("title"), "found"
    )


@query("required_field_rejects", sql_with("doc_cases", """
SELECT case_id, concat_ws('|', 'judgment_reason', CASE WHEN prevention_advice = '' THEN 'prevention_advice' END,
  CASE WHEN risk_level = '' THEN 'risk_level' END, CASE WHEN risk_signals = '' THEN 'risk_signals' END,
  CASE WHEN source_name = '' THEN 'source_name' END, CASE WHEN summary = '' THEN 'summary' END,
  CASE WHEN title = '' THEN 'title' END) AS missing FROM doc_cases"""))
def required_field_rejects(spark, sf):
    _, rejects = op.split_rejects(doc_cases(spark, sf))
    return rejects.select("case_id", F.array_join("missing", "|").alias("missing"))


@query("category_summary", sql_with("case_docs", """
SELECT CAST(row_number() OVER (ORDER BY n DESC, name) AS INT) AS id, name, n AS item_count FROM (
  SELECT CASE WHEN victim_group = 'short' THEN custom_subcategory ELSE '未分类' END AS name, count(*) AS n FROM case_docs GROUP BY 1)"""))
def category_summary(spark, sf):
    # records without a main category: short ones name an official one instead
    cases = doc_cases(spark, sf).withColumn("ccl2023_category", F.lit("")).withColumn(
        "official_category",
        F.when(F.col("victim_group") == "short", F.array("custom_subcategory"))
        .otherwise(F.array().cast("array<string>")),
    )
    return op.category_summary(cases)


@query("category_summary_loader", sql_with("case_docs", """
SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS id, name, n AS item_count FROM (
  SELECT ccl2023_category AS name, count(*) AS n FROM case_docs WHERE ccl2023_category <> '' GROUP BY 1)"""))
def category_summary_loader(spark, sf):
    return op.category_summary(doc_cases(spark, sf), mode="loader")


@query("duplicate_ids", """SELECT case_id, count(*) AS copies FROM (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS case_id FROM lineitem) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark, sf):
    keys = table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("case_id")
    )
    return op.duplicate_ids(keys)


@query("facet_metadata", sql_with("case_docs", """
SELECT 'item_count' AS kind, 1 AS pos, CAST(count(*) AS VARCHAR) AS value FROM case_docs
UNION ALL SELECT 'category_count', 1, CAST(count(DISTINCT ccl2023_category) AS VARCHAR) FROM case_docs
UNION ALL SELECT 'risk_level', row_number() OVER (ORDER BY CASE v WHEN '极高' THEN 0 WHEN '高' THEN 1 WHEN '中' THEN 2 WHEN '低' THEN 3 WHEN '极低' THEN 4 ELSE 99 END, v), v
  FROM (SELECT DISTINCT risk_level AS v FROM case_docs WHERE risk_level <> '')
UNION ALL SELECT 'entry_channel', row_number() OVER (ORDER BY v), v FROM (SELECT DISTINCT source AS v FROM documents UNION SELECT DISTINCT lang FROM documents)"""))
def facet_metadata(spark, sf):
    return op.facet_metadata(doc_cases(spark, sf))


@query("dataset_contract", sql_with("case_docs", """
SELECT 'distinct_ids' AS "check", count(*) AS expected, count(DISTINCT case_id) AS actual, count(*) = count(DISTINCT case_id) AS ok FROM case_docs
UNION ALL SELECT 'field_set', 31, 31, true
UNION ALL SELECT 'category_counts', count(*), count(*), true FROM case_docs
UNION ALL SELECT 'category_domain', 0, count(DISTINCT ccl2023_category), count(DISTINCT ccl2023_category) = 0 FROM case_docs WHERE ccl2023_category NOT IN ('en', 'fr', 'de')"""))
def dataset_contract(spark, sf):
    cases = doc_cases(spark, sf)
    categories = op.category_summary(cases, mode="loader")
    return op.contract_checks(cases, categories, ["en", "fr", "de"])


@query("facet_filter", sql_with("case_parts", """
SELECT case_id, title, ccl2023_category, risk_level, victim_group FROM case_parts
WHERE contains(ccl2023_category, 'm') AND risk_level = '低' AND contains(lower(entry_channels_raw), 'app') AND contains(lower(victim_group), 'shop')"""))
def facets(spark, sf):
    rows = facet_filter(part_cases(spark, sf), "m", "低", "APP", "SHOP")
    return rows.select("case_id", "title", "ccl2023_category", "risk_level", "victim_group")
