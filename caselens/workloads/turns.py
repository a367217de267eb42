"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm
from ..operators import turns as op
from ..operators.catalogue import evidence_blocks
from ..session import pinned
from ..views import convo, doc_cases, part_cases, query_set, sql_with, table, turn_events
from .catalogue import EVIDENCE_SQL
from .registry import query
from .sqltext import s_any, s_fold, s_norm

# Phrase lists remapped to words of the shared conversations.
INCIDENT = {
    "direct": ("theation", "une le"), "sensitive": ("tion", "ung", "ment"), "cues": ("the ", "der ", "le "),
    "screen": ("tion", "ung"), "transfer": ("ing",),
}
LOCALE_SQL = "CASE WHEN contains(question, 'ç') THEN 'ja-JP' WHEN contains(question, 'ö') THEN 'ko-KR' ELSE 'en-US' END"


def _located(spark, sf):
    q = F.col("question")
    return convo(spark, sf).withColumn(
        "locale", F.when(q.contains("ç"), "ja-JP").when(q.contains("ö"), "ko-KR").otherwise("en-US")
    )


def _incident_sql(text: str) -> str:
    return (
        f"({s_any(text, INCIDENT['direct'])} OR ({s_any(text, INCIDENT['sensitive'])} "
        f"AND {s_any(text, INCIDENT['cues'])}))"
    )


@query("incident_flag", sql_with("convo", f"""
SELECT conv_id, turn, active, CASE WHEN active THEN concat_ws('|', CASE WHEN {s_any('t', INCIDENT['screen'])} THEN 'screen' END,
  CASE WHEN {s_any('t', INCIDENT['transfer'])} THEN 'transfer' END, 'evidence') ELSE '' END AS actions
FROM (SELECT *, {_incident_sql('t')} AS active FROM (SELECT *, {s_fold(s_norm('question'))} AS t FROM convo))"""))
def incident_flag(spark, sf):
    rows = op.flag_incidents(convo(spark, sf), **INCIDENT)
    return rows.select("conv_id", "turn", "active", F.array_join("actions", "|").alias("actions"))


# All short user messages of the corpus serve as phrases; their length decides the kind.
_ROUTE = f"""msg AS (SELECT conv_id, turn, text AS question, {LOCALE_SQL.replace('question', 'text')} AS locale FROM conversations),
keyed AS (SELECT *, {s_norm('question')} AS w, trim({s_fold(s_norm('question'))}, '{op.GREETING_TRIM}') AS g, trim(lower({s_norm('question')}), '{op.REPLY_TRIM}') AS r FROM msg),
short AS (SELECT DISTINCT r AS phrase, length(r) % 4 AS m FROM keyed WHERE length(r) BETWEEN 1 AND 90),
flagged AS (SELECT *, {_incident_sql(s_fold('w'))} AS active FROM keyed)"""


@query("turn_routing", sql_with("convo", """
SELECT conv_id, turn, CASE WHEN w = '' THEN 'empty' WHEN length(w) > 4000 THEN 'too_long'
  WHEN g IN (SELECT phrase FROM short WHERE m = 0) THEN 'greeting'
  WHEN locale = 'en-US' AND g IN (SELECT phrase FROM short WHERE m = 1) THEN 'greeting'
  WHEN active THEN 'urgent' WHEN r IN (SELECT phrase FROM short WHERE m = 2) THEN 'continuation'
  WHEN r IN (SELECT phrase FROM short WHERE m = 3) THEN 'pause' ELSE 'retrieve' END AS route FROM flagged""", _ROUTE))
def turn_routing(spark, sf):
    t = F.col("text")
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", t.alias("question"),
        F.when(t.contains("ç"), "ja-JP").when(t.contains("ö"), "ko-KR").otherwise("en-US").alias("locale"),
    )
    short = turns.select(F.btrim(F.lower(norm("question")), F.lit(op.REPLY_TRIM)).alias("phrase")).where(
        F.length("phrase").between(1, 90)
    ).distinct()
    m = F.length("phrase") % 4
    phrases = short.select(
        F.when(m <= 1, "greeting").when(m == 2, "continuation").otherwise("pause").alias("kind"),
        F.when(m == 1, "en-US").otherwise("").alias("locale"), "phrase",
    )
    return op.route_turns(turns, phrases, **INCIDENT).select("conv_id", "turn", "route")


ANCHORS_SQL = f"""anchors AS (SELECT DISTINCT kind, anchor FROM (
  SELECT 'item_name' AS kind, lower(title) AS anchor FROM case_parts UNION ALL SELECT 'item_name', custom_subcategory FROM case_parts
  UNION ALL SELECT 'item_name', unnest(string_split(lower(title), ' ')) FROM case_parts
  UNION ALL SELECT 'category', ccl2023_category FROM case_parts
  UNION ALL SELECT 'channel', lower(unnest(string_split(entry_channels_raw, ';'))) FROM case_parts) WHERE length(anchor) >= 2)"""


@query("catalogue_anchors", sql_with("case_parts", "SELECT kind, anchor FROM anchors", ANCHORS_SQL))
def catalogue_anchors(spark, sf):
    return op.catalogue_anchors(part_cases(spark, sf))


_BASIS = f"""{ANCHORS_SQL},
asked AS (SELECT 'q' || query_id AS id, query AS question, 'en-US' AS locale FROM query_set
  UNION ALL SELECT 'c' || conv_id || '-' || turn, question, {LOCALE_SQL} FROM convo),
t AS (SELECT *, {s_fold(s_norm('question'))} AS f FROM asked),
p AS (SELECT id, min(CASE kind WHEN 'item_name' THEN 1 WHEN 'category' THEN 2 ELSE 3 END) AS p FROM t JOIN anchors ON contains(f, anchor) GROUP BY 1)"""
_DOMAIN, _FOREIGN = ("ition", "wie"), {"en-US": ("with", "que la"), "ja-JP": ("ment",)}


@query("retrieval_basis", sql_with("query_set case_parts convo", f"""
SELECT id, CASE WHEN f = '' THEN 'none' WHEN p = 1 THEN 'item_name' WHEN p = 2 THEN 'category' WHEN p = 3 THEN 'channel'
  WHEN {s_any('f', _DOMAIN)} THEN 'fraud_domain'
  WHEN (locale = 'en-US' AND {s_any('f', _FOREIGN['en-US'])}) OR (locale = 'ja-JP' AND {s_any('f', _FOREIGN['ja-JP'])}) THEN 'multilingual_catalogue'
  WHEN {s_any('f', op.BROWSE_ACTIONS)} AND {s_any('f', op.BROWSE_OBJECTS)} THEN 'catalogue_browse' ELSE 'none' END AS basis
FROM t LEFT JOIN p USING (id)""", _BASIS))
def retrieval_basis(spark, sf):
    listed = query_set(spark, sf).select(
        F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"),
        F.col("query").alias("question"), F.lit("en-US").alias("locale"),
    )
    turns = _located(spark, sf).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        "question", "locale",
    )
    anchors = op.catalogue_anchors(part_cases(spark, sf))
    rows = op.retrieval_basis(listed.unionByName(turns), anchors, domain=_DOMAIN, foreign=_FOREIGN)
    return rows.select("id", "basis")


_GLOSS = (("en-US", 0, "the ", "alpha"), ("en-US", 0, "und", "alpha"), ("en-US", 1, "que", "beta"),
          ("ja-JP", 0, "Ment", "gamma"), ("ja-JP", 1, "tion", "delta"), ("ko-KR", 0, "der", "epsilon"), ("ko-KR", 1, "ung", "zeta"))


@query("gloss_query", sql_with("convo", f"""
SELECT conv_id, turn, locale, coalesce((SELECT arg_min(canonical, ord) FROM g WHERE g.locale = c.locale AND contains({s_fold(s_norm('question'))}, lower(phrase))), '') AS canonical
FROM (SELECT *, {LOCALE_SQL} AS locale FROM convo) c""",
    "g AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in _GLOSS) + ") AS g(locale, ord, phrase, canonical))"))
def gloss_query(spark, sf):
    glosses = spark.createDataFrame(list(_GLOSS), "locale string, ord int, phrase string, canonical string")
    rows = op.translate_queries(_located(spark, sf), glosses)
    return rows.select("conv_id", "turn", "locale", "canonical")


def _doc_candidates(spark, sf):
    """Twelve catalogue entries per turn, by a fixed spread over the ids."""
    spots = convo(spark, sf).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("rank"))
    return spots.withColumn("input_pos", F.col("conv_id") * 3 + F.col("turn") + F.col("rank") * 37)


_CAND = """cand AS (SELECT conv_id, turn, CAST(r AS INT) AS rank, conv_id * 3 + turn + r * 37 AS input_pos FROM convo, range(0, 12) AS x(r))"""
_PACK = f"""{_CAND},
blocks AS (SELECT c.conv_id, c.turn, c.rank, case_id, {EVIDENCE_SQL} AS block FROM cand c JOIN doc_cases USING (input_pos) JOIN documents ON doc_id = input_pos),
packed AS (SELECT *, row_number() OVER w AS rn, CAST(sum(length(block)) OVER w AS BIGINT) AS used FROM blocks WINDOW w AS (PARTITION BY conv_id, turn ORDER BY rank))"""


def _packed(spark, sf):
    blocks = _doc_candidates(spark, sf).join(
        evidence_blocks(doc_cases(spark, sf)).select("input_pos", "case_id", "block"), "input_pos"
    )
    return op.pack_evidence(blocks, ["conv_id", "turn"])


@query("evidence_packing", sql_with("convo doc_cases", """
SELECT conv_id, turn, rank, case_id, used FROM packed WHERE rn = 1 OR used <= 5200""", _PACK))
def evidence_packing(spark, sf):
    return _packed(spark, sf).select("conv_id", "turn", "rank", "case_id", "used")


@query("digest_selection", sql_with("doc_cases", """
SELECT source_name, ccl2023_category, case_id, spent FROM (
  SELECT *, CAST(sum(greatest(80, least(length(n), 180))) OVER w AS BIGINT) AS spent, row_number() OVER w AS rn
  FROM (SELECT *, @SUMMARY@ AS n, CASE WHEN ccl2023_category = 'de' THEN 2 WHEN ccl2023_category = 'fr' THEN 9 END AS wanted FROM doc_cases)
  WINDOW w AS (PARTITION BY source_name, ccl2023_category ORDER BY input_pos))
WHERE rn <= 6 AND CASE WHEN wanted IS NULL THEN rn = 1 OR spent <= 760 ELSE rn <= wanted END""".replace("@SUMMARY@", s_norm("summary"))))
def digest_selection(spark, sf):
    wanted = F.when(F.col("ccl2023_category") == "de", 2).when(F.col("ccl2023_category") == "fr", 9)
    rows = op.select_digest(doc_cases(spark, sf), ["source_name", "ccl2023_category"], "input_pos", wanted)
    return rows.select("source_name", "ccl2023_category", "case_id", "spent")


_PART_CAND = """pc AS (SELECT conv_id, turn, CAST(r AS INT) AS rank, 'P-' || lpad(CAST(conv_id * 5 + turn + r * 11 AS VARCHAR), 7, '0') AS case_id FROM convo, range(0, 6) AS x(r)),
cc AS (SELECT conv_id, turn, rank, case_id, title, custom_subcategory AS sub FROM pc JOIN case_parts USING (case_id)),
ans AS (SELECT v.conv_id, v.turn, answer || CASE WHEN v.turn % 4 = 0 THEN coalesce(' ' || a.title || ' / ' || b.sub, '') WHEN v.turn % 4 = 2 THEN coalesce(' ' || b.sub, '') ELSE '' END AS answer
  FROM convo v LEFT JOIN cc a ON a.conv_id = v.conv_id AND a.turn = v.turn AND a.rank = 3 LEFT JOIN cc b ON b.conv_id = v.conv_id AND b.turn = v.turn AND b.rank = 1),
nm AS (SELECT conv_id, turn, rank, case_id, title AS name FROM cc UNION ALL
  SELECT conv_id, turn, min(rank), min(case_id), alias FROM (SELECT DISTINCT conv_id, turn, rank, case_id, alias FROM (
    SELECT conv_id, turn, rank, case_id, sub AS alias FROM cc UNION ALL SELECT conv_id, turn, rank, case_id, unnest(string_split(title, ' ')) FROM cc) WHERE length(alias) >= 3)
  GROUP BY conv_id, turn, alias HAVING count(*) = 1),
hits AS (SELECT conv_id, turn, rank, case_id, min(hp) AS hp FROM (
  SELECT nm.*, instr(@TEXT@, name) AS hp FROM nm JOIN ans USING (conv_id, turn)) WHERE hp > 0 GROUP BY ALL),
cites AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hp, rank) AS ord, case_id FROM (
  SELECT conv_id, turn, rank, case_id, hp FROM hits UNION ALL
  SELECT conv_id, turn, rank, case_id, 0 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank) AS f FROM cc) WHERE f = 1
    AND (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM hits)))""".replace("@TEXT@", s_fold(s_norm("answer")))


def _part_candidates(spark, sf):
    spots = convo(spark, sf).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("rank"))
    number = F.col("conv_id") * 5 + F.col("turn") + F.col("rank") * 11
    keyed = spots.withColumn("case_id", F.concat(F.lit("P-"), F.lpad(number.cast("string"), 7, "0")))
    cases = part_cases(spark, sf).select("case_id", "title", "custom_subcategory", "tags")
    return pinned(keyed.join(cases, "case_id"))


def _answers(spark, sf, candidates):
    keys = ["conv_id", "turn"]
    third = candidates.where("rank = 3").select(*keys, F.col("title").alias("_t"))
    second = candidates.where("rank = 1").select(*keys, F.col("custom_subcategory").alias("_s"))
    rows = convo(spark, sf).join(third, keys, "left").join(second, keys, "left")
    tail = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" "), "_t", F.lit(" / "), "_s"))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit(" "), "_s"))
    )
    return rows.select(*keys, F.concat("answer", F.coalesce(tail, F.lit(""))).alias("answer"))


@query("citation_attribution", sql_with("convo case_parts", "SELECT conv_id, turn, ord, case_id FROM cites", _PART_CAND))
def citation_attribution(spark, sf):
    candidates = _part_candidates(spark, sf)
    return op.attribute_citations(_answers(spark, sf, candidates), candidates, ["conv_id", "turn"])


@query("answer_confidence", sql_with("convo case_parts", """
SELECT conv_id, turn, count(case_id) AS cited, CAST(CASE WHEN count(case_id) = 0 THEN 0.2 ELSE 0.85 END AS DOUBLE) AS confidence
FROM ans LEFT JOIN cites USING (conv_id, turn) GROUP BY 1, 2""", _PART_CAND))
def answer_confidence(spark, sf):
    candidates = _part_candidates(spark, sf)
    answers = _answers(spark, sf, candidates)
    cites = op.attribute_citations(answers, candidates, ["conv_id", "turn"])
    return op.answer_confidence(answers, cites, ["conv_id", "turn"]).select(
        "conv_id", "turn", "cited", "confidence"
    )


_PROMPT_SQL = "pt AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{t}', ['{b[0]}', '{b[1]}'], ['{o[0]}', '{o[1]}', '{s}'])" for c, (t, b, o, s) in op.PROMPTS.items()
) + ") AS p(locale, template, browse, opening))"


@query("followup_prompts", sql_with("case_parts", """
SELECT custom_subcategory, pos, prompt FROM (SELECT custom_subcategory, unnest(prompts) AS prompt, generate_subscripts(prompts, 1) AS pos FROM (
  SELECT custom_subcategory, CASE WHEN heads IS NULL THEN opening ELSE list_concat(list_transform(heads, lambda h: replace(template, '%s', h)), browse)[1:3] END AS prompts
  FROM k LEFT JOIN h USING (custom_subcategory) JOIN pt USING (locale)))""", f"""{_PROMPT_SQL},
k AS (SELECT custom_subcategory, CASE length(custom_subcategory) WHEN 7 THEN 'ja-JP' ELSE 'en-US' END AS locale FROM case_parts GROUP BY 1),
once AS (SELECT custom_subcategory, title, min(input_pos) AS o FROM case_parts WHERE ccl2023_category = 'promo' AND victim_group = 'students' AND starts_with(title, 'hot') GROUP BY 1, 2),
h AS (SELECT custom_subcategory, list(title ORDER BY o) AS heads FROM (SELECT *, row_number() OVER (PARTITION BY custom_subcategory ORDER BY o) AS rn FROM once) WHERE rn <= 3 GROUP BY 1)"""))
def followup_prompts(spark, sf):
    cases = part_cases(spark, sf)
    answers = cases.select("custom_subcategory").distinct().withColumn(
        "locale", F.when(F.length("custom_subcategory") == 7, "ja-JP").otherwise("fr-FR")
    )
    cited = cases.where(
        "ccl2023_category = 'promo' AND victim_group = 'students' AND startswith(title, 'hot')"
    ).select("custom_subcategory", F.col("input_pos").alias("ord"), "title")
    return op.followup_prompts(answers, cited, ["custom_subcategory"])


@query("bounded_history", sql_with("convo", """
SELECT conv_id, turn, question, substr(answer, 1, 500) AS answer, back, back <= 5 AS in_context FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM convo) WHERE back <= 20"""))
def bounded_history(spark, sf):
    return op.context_history(convo(spark, sf), "conv_id", "turn")


@query("recent_evidence", sql_with("convo case_docs", """
SELECT conv_id, rank, case_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC, i DESC) AS rank FROM (
  SELECT conv_id, case_id, max(turn) AS t, arg_max(i, turn * 10 + i) AS i FROM s WHERE case_id IN (SELECT case_id FROM case_docs) GROUP BY 1, 2)) WHERE rank <= 8""",
    """s AS (SELECT conv_id, turn, i, 'FZ-' || lpad(CAST(CASE i WHEN 0 THEN conv_id * 3 + turn WHEN 1 THEN conv_id + turn * 5 ELSE conv_id * 3 + 2 END AS VARCHAR), 6, '0') AS case_id FROM convo, range(0, 3) AS x(i))"""))
def recent_evidence(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    ids = F.transform(F.array(c * 3 + t, c + t * 5, c * 3 + 2),
                      lambda n: F.concat(F.lit("FZ-"), F.lpad(n.cast("string"), 6, "0")))
    history = op.bounded_history(convo(spark, sf).withColumn("source_ids", ids), "conv_id", "turn")
    return op.recent_evidence(history, doc_cases(spark, sf), "conv_id", "turn")


@query("context_titles", sql_with("convo", r"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS pos, substr(title, 1, 200) AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS rn FROM (SELECT conv_id, turn, title, min(o) AS o FROM (
    SELECT conv_id, turn, 0 AS o, regexp_replace(question, '^[\s\p{Z}\x0B\x1C-\x1F\x{85}]+|[\s\p{Z}\x0B\x1C-\x1F\x{85}]+$', '', 'g') AS title FROM convo
    UNION ALL SELECT conv_id, turn, o, regexp_replace(regexp_replace(raw, '\r\n?', chr(10), 'g'), '^[\s\p{Z}\x0B\x1C-\x1F\x{85}]+|[\s\p{Z}\x0B\x1C-\x1F\x{85}]+$', '', 'g') FROM (
      SELECT conv_id, turn, unnest(string_split(answer, '.')) AS raw, generate_subscripts(string_split(answer, '.'), 1) AS o FROM convo)) WHERE title <> '' GROUP BY 1, 2, 3)) WHERE rn <= 8"""))
def context_titles(spark, sf):
    rows = convo(spark, sf).select(
        "conv_id", "turn", F.array("question").alias("selected"), F.split("answer", "[.]").alias("visible")
    )
    return rows.select("conv_id", "turn", F.posexplode(op.context_titles()).alias("_p", "title")).select(
        "conv_id", "turn", (F.col("_p") + 1).alias("pos"), "title"
    )


@query("byte_budget_terms", sql_with("case_parts", """
SELECT custom_subcategory, pos, term FROM (SELECT *, sum(strlen(term) + CASE WHEN pos > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY custom_subcategory ORDER BY pos) AS used FROM (
  SELECT custom_subcategory, term, row_number() OVER (PARTITION BY custom_subcategory ORDER BY min(input_pos * 10 + i)) AS pos FROM (
    SELECT custom_subcategory, input_pos, 0 AS i, replace(summary, ' ', '') AS term FROM case_parts
    UNION ALL SELECT custom_subcategory, input_pos, 1, risk_level || replace(title, ' ', '') FROM case_parts) GROUP BY 1, 2)) WHERE used <= 1018"""))
def byte_budget_terms(spark, sf):
    terms = part_cases(spark, sf).withColumn("_terms", F.concat("summary", F.lit("、|"), "risk_level", "title"))
    return op.byte_budget_terms(terms, ["custom_subcategory"], "input_pos", "_terms")


_TEXTS = {
    "system": "S", "no_evidence": "no evidence", "evidence_intro": "evidence: ",
    "continuation": "go on from the last answer", "pause": "stay short", "closing": "the next row is the user",
}


@query("grounded_prompt_rows", sql_with("convo doc_cases", """
SELECT conv_id, turn, ord, role, content FROM (
  SELECT conv_id, turn, 1 AS ord, 'system' AS role, 'S' AS content FROM t
  UNION ALL SELECT b.conv_id, b.turn, 2 + (5 - (b.n - a.n)) * 2, 'user', a.question FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.n - a.n BETWEEN 1 AND 5
  UNION ALL SELECT b.conv_id, b.turn, 3 + (5 - (b.n - a.n)) * 2, 'assistant', substr(a.answer, 1, 500) FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.n - a.n BETWEEN 1 AND 5
  UNION ALL SELECT conv_id, turn, 20, 'system', CASE WHEN length(question) % 3 = 0 THEN 'no evidence' ELSE 'evidence: ' || coalesce(ids, '未检索到匹配资料。涉及具体事实时请说明资料库暂无对应条目。') END FROM t LEFT JOIN e USING (conv_id, turn)
  UNION ALL SELECT conv_id, turn, 21, 'system', CASE length(question) % 4 WHEN 0 THEN 'go on from the last answer' ELSE 'stay short' END FROM t WHERE length(question) % 4 < 2
  UNION ALL SELECT conv_id, turn, 22, 'system', 'the next row is the user' FROM t
  UNION ALL SELECT conv_id, turn, 23, 'user', question FROM t)""", f"""{_PACK},
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM convo),
e AS (SELECT conv_id, turn, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS ids FROM packed WHERE rn = 1 OR used <= 5200 GROUP BY 1, 2)"""))
def grounded_prompt_rows(spark, sf):
    size = F.length("question")
    turns = convo(spark, sf).withColumn(
        "basis", F.when(size % 3 == 0, "none").otherwise("item_name")
    ).withColumn("mode", F.when(size % 4 == 0, "continuation").when(size % 4 == 1, "pause"))
    context = op.assemble_text(_packed(spark, sf), ["conv_id", "turn"], "rank", "block", "\n\n", "context")
    return op.prompt_rows(turns, context, "conv_id", "turn", **_TEXTS)


@query("event_sequence", sql_with("turn_events", """
SELECT session_id, pos, turn_no, seq, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS wire_seq FROM turn_events"""))
def event_sequence(spark, sf):
    per_turn = op.number_events(turn_events(spark, sf), ["session_id", "turn_no"], "pos")
    per_wire = op.number_events(
        per_turn.withColumnRenamed("seq", "turn_seq"), ["session_id"], "pos", start=1
    )
    return per_wire.select(
        "session_id", "pos", "turn_no", F.col("turn_seq").alias("seq"), F.col("seq").alias("wire_seq")
    )


@query("turn_outcome", sql_with("turn_events", """
SELECT session_id, turn_no, terminals, outcome, terminals = 1 AS single, outcome = 'turn.completed' AS in_history FROM (
  SELECT session_id, turn_no, count(*) FILTER (f) AS terminals, coalesce(arg_max(type, pos) FILTER (f), '') AS outcome
  FROM (SELECT *, type IN ('turn.completed', 'turn.failed', 'turn.cancelled') AS f FROM turn_events) GROUP BY 1, 2)"""))
def turn_outcome(spark, sf):
    return op.turn_outcomes(turn_events(spark, sf), ["session_id", "turn_no"], "pos")


@query("turn_ownership", sql_with("turn_events", """
SELECT session_id, pos, turn_id, coalesce(cur = turn_id, false) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.session_id = e.session_id
  AND x.turn_id = e.turn_id AND x.type = 'turn.cancelled' AND x.pos < e.pos) AS accepted FROM e""",
    """e AS (SELECT *, last_value(CASE WHEN type = 'turn.started' THEN turn_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos) AS cur
  FROM (SELECT *, CASE WHEN type <> 'turn.started' AND k % 5 = 0 THEN turn_no - 1 ELSE turn_no END AS turn_id FROM turn_events))"""))
def turn_ownership(spark, sf):
    late = (F.col("type") != "turn.started") & (F.col("k") % 5 == 0)
    events = turn_events(spark, sf).withColumn(
        "turn_id", F.when(late, F.col("turn_no") - 1).otherwise(F.col("turn_no"))
    )
    return op.owned_events(events, "session_id", "pos").select("session_id", "pos", "turn_id", "accepted")


@query("assemble_text", sql_with("convo", """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1"""))
def assemble_text(spark, sf):
    return op.assemble_text(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", "\n")
