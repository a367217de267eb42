"""Input views over the shared tables, on Spark and as SQL for the twin queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.catalogue import normalize_cases, with_search_text
from .plans.scan import Next, Sum, numbered, ordered_scan
from .session import pinned


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input has fewer files than cores; otherwise unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _props_k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def events_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", _props_k())


def case_docs(spark: SparkSession, sf: str) -> DataFrame:
    d, l = spread(table(spark, sf, "documents")), table(spark, sf, "labels")
    risk = (
        F.when(F.col("toxic") == 1, "极高").when(F.col("quality") == 0, "高")
        .when(F.col("quality") == 1, "中").otherwise("")
    )
    return d.join(l, "doc_id", "left").select(
        F.concat(F.lit("FZ-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("case_id"),
        F.col("doc_id").alias("input_pos"),
        F.substring("text", 1, 60).alias("title"),
        F.substring("text", 1, 200).alias("summary"),
        F.lit("").alias("judgment_reason"),
        F.substring("text", 201, 300).alias("risk_signals"),
        F.expr("substring(text, 501)").alias("prevention_advice"),
        F.col("source").alias("source_name"),
        F.lower("lang").alias("ccl2023_category"),
        F.col("source").alias("custom_subcategory"),
        risk.alias("risk_level"),
        F.concat_ws("", "source", F.lit(";"), "lang", F.lit("；"), "source").alias("entry_channels"),
        F.when(F.col("n_chars") < 500, "short").otherwise("").alias("victim_group"),
    )


def doc_cases(spark: SparkSession, sf: str) -> DataFrame:
    """``case_docs`` as full records with derived text, plus ``input_pos``."""
    raw = case_docs(spark, sf)
    return with_search_text(keep_position(raw))


def keep_position(raw: DataFrame) -> DataFrame:
    fields = normalize_cases(raw.withColumn("remark", F.col("input_pos").cast("string")))
    return fields.withColumn("input_pos", F.col("remark").cast("bigint")).withColumn(
        "remark", F.lit("")
    )


def case_parts(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    price = F.col("p_retailprice")
    return spread(table(spark, sf, "part")).select(
        F.concat(F.lit("P-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("case_id"),
        F.col("p_partkey").alias("input_pos"),
        F.col("p_name").alias("title"),
        F.lower("p_type").alias("ccl2023_category"),
        F.lower("p_brand").alias("custom_subcategory"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("size"), size.cast("string")).alias("summary"),
        F.concat_ws(" ", F.lit("price"), F.floor(price).cast("string"), "p_name").alias("risk_signals"),
        F.when(size % 4 == 0, "phone;app").when(size % 4 == 1, "WeChat")
        .when(size % 4 == 2, "App;web").otherwise("web").alias("entry_channels"),
        F.when(size < 15, "students").when(size < 30, "Shoppers").otherwise("").alias("victim_group"),
        F.when(price < 1000, "低").when(price < 1400, "中").when(price < 1700, "高")
        .otherwise("极高").alias("risk_level"),
        F.split("p_name", " ").alias("key_methods"),
        F.split("p_name", " ").alias("tags"),
    )


def part_cases(spark: SparkSession, sf: str) -> DataFrame:
    return with_search_text(keep_position(case_parts(spark, sf)))


def part_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """``part_cases`` as a written catalogue table, for jobs that read it in several places."""
    return pinned(part_cases(spark, sf))


def doc_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return pinned(doc_cases(spark, sf))


QUERY_ROWS = (
    (1, "red plate"), (2, "Small Widget?"), (3, "推荐5个 economy"), (4, "hot ring promo"),
    (5, "large gear brand#2"), (6, "有哪些案例"), (7, "students 的 blue ring"), (8, "size 30"),
    (9, "zzz nothing"), (10, "  "), (11, "3 items medium"), (12, "App"),
)


def query_set(spark: SparkSession, sf: str = "") -> DataFrame:
    return spark.createDataFrame(list(QUERY_ROWS), "query_id int, query string")


def convo(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    paired = ordered_scan(
        rows, ["conv_id"], "turn", {"_next": Next(F.struct("role", F.col("text").alias("answer")))}
    )
    return paired.where("role = 'user' AND _next.role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("_next.answer").alias("answer")
    )


def partials(spark: SparkSession, sf: str) -> DataFrame:
    placed = numbered(events_k(spark, sf), ["user_id"], "event_id", "_rn")
    in_session = F.col("_rn") - 1 - F.col("k") % 3
    return placed.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("arrival"),
        (1 + F.floor(in_session / 4.0).cast("int")).alias("utterance_id"),
        (F.col("k") % 5).alias("revision"),
        (F.col("event_type") == "purchase").alias("is_final"),
        F.col("event_type").alias("text"),
        micros().alias("t_us"),
    )


def asr_log(spark: SparkSession, sf: str) -> DataFrame:
    placed = numbered(events_k(spark, sf), ["user_id"], "event_id", "sn")
    rpl = (F.col("k") % 7 == 0) & (F.col("sn") > 2)
    return placed.select(
        F.col("user_id").alias("stream"),
        F.col("sn").alias("arrival"),
        F.col("sn").cast("int").alias("sn"),
        F.col("event_type").alias("word"),
        F.when(F.col("k") % 3 == 0, "en").when(F.col("k") % 3 == 1, "zh").otherwise("").alias("lg"),
        F.when(rpl, "rpl").otherwise("apd").alias("pgs"),
        F.when(rpl, F.col("sn") - 2).cast("int").alias("rg_start"),
        F.when(rpl, F.col("sn") - 1).cast("int").alias("rg_end"),
        micros().alias("t_us"),
    )


def chunk_log(spark: SparkSession, sf: str) -> DataFrame:
    placed = numbered(events_k(spark, sf), ["user_id"], "event_id", "line_no")
    delta = F.concat(
        F.lit('data: {"choices":[{"delta":{"content":"'), F.col("event_type"),
        F.col("k").cast("string"), F.lit(' "}}]}'),
    )
    return placed.select(
        F.col("user_id").alias("stream"),
        "line_no",
        F.when(F.col("k") == 99, "data: [DONE]").when(F.col("k") % 13 == 0, "data: {broken")
        .when(F.col("k") % 11 == 0, ": keep-alive").otherwise(delta).alias("line"),
    )


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    placed = numbered(events_k(spark, sf), ["user_id"], "event_id", "utterance_id")
    start = micros()
    return placed.select(
        F.col("user_id").alias("session_id"),
        "utterance_id",
        start.alias("start_us"),
        (start + F.floor(F.col("value") * 600).cast("bigint") * 1000000).alias("end_us"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.col("event_type")).alias("text"),
    )


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return events_k(spark, sf).select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("pos"),
        micros().alias("t_us"),
        F.col("k").alias("dur_ms"),
        F.col("value").alias("level"),
        (F.col("value") >= 20).alias("above"),
    )


def turn_events(spark: SparkSession, sf: str) -> DataFrame:
    """Adds ``pos``, the arrival number, to the shared columns."""
    kind = (
        F.when(F.col("event_type") == "click", "turn.started")
        .when(F.col("event_type") == "view", "response.text.delta")
        .when(F.col("event_type") == "purchase", "turn.completed")
        .when(F.col("event_type") == "error", "turn.failed")
        .otherwise("turn.cancelled")
    )
    rows = events_k(spark, sf).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"),
        micros().alias("t_us"), "k", kind.alias("type"),
    )
    started = F.when(F.col("type") == "turn.started", 1).otherwise(0).cast("bigint")
    return ordered_scan(rows, ["session_id"], "pos", {"turn_no": Sum(started)})


# ---------------------------------------------------------------------------------------
# The same views as SQL, inlined as common table expressions by the twin queries.

_EV = "SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, epoch_us(ts) AS t_us FROM events"

SQL_VIEWS = {
    "ev": _EV,
    "case_docs": """SELECT 'FZ-' || lpad(CAST(d.doc_id AS VARCHAR), 6, '0') AS case_id, d.doc_id AS input_pos,
  substr(d.text, 1, 60) AS title_raw, substr(d.text, 1, 200) AS summary_raw, '' AS judgment_reason,
  substr(d.text, 201, 300) AS risk_raw, substr(d.text, 501) AS advice_raw,
  d.source AS source_name, lower(d.lang) AS ccl2023_category, d.source AS custom_subcategory,
  CASE WHEN l.toxic = 1 THEN '极高' WHEN l.quality = 0 THEN '高' WHEN l.quality = 1 THEN '中' ELSE '' END AS risk_level,
  d.source || ';' || d.lang || '；' || d.source AS entry_channels_raw,
  CASE WHEN d.n_chars < 500 THEN 'short' ELSE '' END AS victim_group
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "doc_cases": r"""SELECT *,
  regexp_replace(concat_ws(' ', summary, judgment_reason, risk_signals, prevention_advice), '[\s\p{Z}\x0B\x1C-\x1F\x{85}]+', ' ', 'g').trim() AS content
FROM (SELECT *, regexp_replace(regexp_replace(title_raw, '\r\n?', chr(10), 'g'), '^[\s\p{Z}\x0B\x1C-\x1F\x{85}]+|[\s\p{Z}\x0B\x1C-\x1F\x{85}]+$', '', 'g') AS title,
  regexp_replace(regexp_replace(summary_raw, '\r\n?', chr(10), 'g'), '^[\s\p{Z}\x0B\x1C-\x1F\x{85}]+|[\s\p{Z}\x0B\x1C-\x1F\x{85}]+$', '', 'g') AS summary,
  regexp_replace(regexp_replace(risk_raw, '\r\n?', chr(10), 'g'), '^[\s\p{Z}\x0B\x1C-\x1F\x{85}]+|[\s\p{Z}\x0B\x1C-\x1F\x{85}]+$', '', 'g') AS risk_signals,
  regexp_replace(regexp_replace(advice_raw, '\r\n?', chr(10), 'g'), '^[\s\p{Z}\x0B\x1C-\x1F\x{85}]+|[\s\p{Z}\x0B\x1C-\x1F\x{85}]+$', '', 'g') AS prevention_advice
  FROM case_docs)""",
    "case_parts": """SELECT 'P-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS case_id, p_partkey AS input_pos,
  p_name AS title, lower(p_type) AS ccl2023_category, lower(p_brand) AS custom_subcategory,
  p_name || ' ' || lower(p_type) || ' size ' || CAST(p_size AS VARCHAR) AS summary,
  'price ' || CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR) || ' ' || p_name AS risk_signals,
  CASE WHEN p_size % 4 = 0 THEN 'phone;app' WHEN p_size % 4 = 1 THEN 'WeChat' WHEN p_size % 4 = 2 THEN 'App;web' ELSE 'web' END AS entry_channels_raw,
  CASE WHEN p_size < 15 THEN 'students' WHEN p_size < 30 THEN 'Shoppers' ELSE '' END AS victim_group,
  CASE WHEN p_retailprice < 1000 THEN '低' WHEN p_retailprice < 1400 THEN '中' WHEN p_retailprice < 1700 THEN '高' ELSE '极高' END AS risk_level
FROM part""",
    "query_set": "SELECT query_id, query FROM (VALUES "
    + ", ".join(f"({i}, '{q}')" for i, q in QUERY_ROWS) + ") AS q(query_id, query)",
    "convo": """SELECT conv_id, turn, text AS question, answer FROM (SELECT conv_id, turn, role, text,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) t
WHERE role = 'user' AND nrole = 'assistant'""",
    "partials": """SELECT user_id AS session_id, event_id AS arrival, 1 + CAST(floor(arr_in_session / 4.0) AS INT) AS utterance_id, k % 5 AS revision,
  event_type = 'purchase' AS is_final, event_type AS text FROM (SELECT user_id, event_id, event_type, k,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 - (k % 3) AS arr_in_session FROM ev) t""",
    "asr_log": """SELECT user_id AS stream, sn AS arrival, CAST(sn AS INT) AS sn, event_type AS word,
  CASE WHEN k % 3 = 0 THEN 'en' WHEN k % 3 = 1 THEN 'zh' ELSE '' END AS lg,
  CASE WHEN k % 7 = 0 AND sn > 2 THEN 'rpl' ELSE 'apd' END AS pgs,
  CASE WHEN k % 7 = 0 AND sn > 2 THEN sn - 2 END AS rg_start, CASE WHEN k % 7 = 0 AND sn > 2 THEN sn - 1 END AS rg_end
FROM (SELECT user_id, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sn FROM ev) t""",
    "chunk_log": """SELECT user_id AS stream, line_no, CASE WHEN k = 99 THEN 'data: [DONE]' WHEN k % 13 = 0 THEN 'data: {broken'
  WHEN k % 11 = 0 THEN ': keep-alive' ELSE 'data: {"choices":[{"delta":{"content":"' || event_type || CAST(k AS VARCHAR) || ' "}}]}' END AS line
FROM (SELECT user_id, event_type, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no FROM ev) t""",
    "utterances": """SELECT user_id AS session_id, utterance_id, t_us AS start_us, t_us + CAST(floor(value * 600) AS BIGINT) * 1000000 AS end_us,
  CASE WHEN k % 5 = 0 THEN '' ELSE event_type END AS text FROM (SELECT user_id, event_type, value, k, t_us,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS utterance_id FROM ev) t""",
    "activity": "SELECT user_id AS session_id, event_id AS pos, t_us, k AS dur_ms, value AS level, value >= 20 AS above FROM ev",
    "turn_events": """SELECT session_id, pos, turn_no, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY pos) - 1 AS seq, type, t_us, k FROM (
  SELECT user_id AS session_id, event_id AS pos, t_us, k, CASE event_type WHEN 'click' THEN 'turn.started' WHEN 'view' THEN 'response.text.delta'
  WHEN 'purchase' THEN 'turn.completed' WHEN 'error' THEN 'turn.failed' ELSE 'turn.cancelled' END AS type,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS turn_no FROM ev) t""",
}
_NEEDS = {
    "doc_cases": ["case_docs"], "partials": ["ev"], "asr_log": ["ev"], "chunk_log": ["ev"],
    "utterances": ["ev"], "activity": ["ev"], "turn_events": ["ev"],
}


def sql_with(views: str, body: str, extra: str = "") -> str:
    """Prefix ``body`` with the named views (blank separated) and further CTE text."""
    ordered: list[str] = []
    for name in views.split():
        for part in [*_NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    ctes = [f"{name} AS ({SQL_VIEWS[name]})" for name in ordered]
    if extra:
        ctes.append(extra)
    head = "WITH " + ("RECURSIVE " if "/*recursive*/" in extra else "")
    return head + ",\n".join(ctes) + "\n" + body
