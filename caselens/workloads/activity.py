"""Event-log and recognition-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as op
from ..operators import recognition as rec
from ..operators.turns import assemble_text
from ..views import activity, asr_log, chunk_log, events_k, partials, sql_with, turn_events, utterances
from .registry import query

HOUR = 3600 * 1_000_000


# --- sessions and turns ----------------------------------------------------------------


def _turns(spark, sf):
    final = F.col("type").isin("turn.completed", "turn.failed", "turn.cancelled")
    return turn_events(spark, sf).where("turn_no > 0").groupBy("session_id", "turn_no").agg(
        F.min("t_us").alias("start_us"),
        F.min(F.when(final, F.col("t_us"))).alias("end_us"),
        F.coalesce(F.max(F.col("type") == "turn.cancelled"), F.lit(False)).alias("cancelled"),
    )


_TURNS = """t AS (SELECT session_id, turn_no, min(t_us) AS start_us, min(t_us) FILTER (type IN ('turn.completed', 'turn.failed', 'turn.cancelled')) AS end_us,
  bool_or(type = 'turn.cancelled') AS cancelled FROM turn_events WHERE turn_no > 0 GROUP BY 1, 2),
nx AS (SELECT *, lead(start_us) OVER (PARTITION BY session_id ORDER BY turn_no) AS n FROM t)"""


@query("turn_supersession", sql_with("turn_events", """
SELECT session_id, turn_no, CASE WHEN n IS NOT NULL AND (end_us IS NULL OR n < end_us) THEN 'superseded' WHEN cancelled THEN 'client_cancelled' ELSE '' END AS reason FROM nx""", _TURNS))
def turn_supersession(spark, sf):
    return op.supersede(_turns(spark, sf)).select("session_id", "turn_no", "reason")


@query("session_expiry", sql_with("turn_events", f"""
SELECT session_id, pos, CAST(sum(CASE WHEN p IS NULL OR (t_us - p >= {6 * HOUR} AND NOT held) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS session_no
FROM (SELECT *, lag(t_us) OVER (PARTITION BY session_id ORDER BY pos) AS p, coalesce(last_value(CASE WHEN type <> 'response.text.delta' THEN type END IGNORE NULLS) OVER w = 'turn.started', false) AS held
  FROM turn_events WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def session_expiry(spark, sf):
    # outputs of a turn neither begin nor end it
    active = F.when(F.col("type") != "response.text.delta", F.col("type") == "turn.started")
    rows = op.expire_sessions(turn_events(spark, sf), "session_id", "pos", "t_us", 6 * HOUR, active=active)
    return rows.select("session_id", "pos", "session_no")


@query("session_lru", sql_with("turn_events", """
SELECT session_id, last_seen, active, row_number() OVER (ORDER BY active DESC, last_seen DESC, session_id) > 60 AND NOT active AS evicted
FROM (SELECT session_id, max(t_us) AS last_seen, arg_max(type, pos) IN ('turn.started', 'response.text.delta') AS active FROM turn_events GROUP BY 1)"""))
def session_lru(spark, sf):
    last = turn_events(spark, sf).groupBy("session_id").agg(
        F.max("t_us").alias("last_seen"),
        F.max_by("type", "pos").isin("turn.started", "response.text.delta").alias("active"),
    )
    return op.lru(last, "session_id", "last_seen", "active", cap=60)


@query("generation_filter", sql_with("turn_events", """
SELECT session_id, pos, generation, type IN ('turn.completed', 'turn.failed') AND coalesce(begun = generation, false) AS kept FROM (
  SELECT *, last_value(CASE WHEN type = 'turn.started' THEN generation END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begun FROM (
    SELECT *, CAST(sum(CASE WHEN type = 'turn.cancelled' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS generation FROM turn_events))"""))
def generation_filter(spark, sf):
    rows = op.apply_generation(
        turn_events(spark, sf), "session_id", "pos", ["turn.cancelled"], ["turn.started"],
        ["turn.completed", "turn.failed"],
    )
    return rows.select("session_id", "pos", "generation", "kept")


# --- utterances ------------------------------------------------------------------------


@query("utterance_commit", sql_with("utterances", """
SELECT session_id, batch, max(utterance_id) AS committed_id, count(*) AS utterances,
  coalesce(string_agg(text, ' ' ORDER BY utterance_id) FILTER (text <> ''), '') AS text, count(*) FILTER (text <> '') = 0 AS rejected
FROM (SELECT *, CAST(sum(CASE WHEN o IS NULL OR start_us > o THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY utterance_id) AS BIGINT) AS batch
  FROM (SELECT *, max(end_us) OVER (PARTITION BY session_id ORDER BY utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM utterances)) GROUP BY 1, 2"""))
def utterance_commit(spark, sf):
    return op.commit_batches(utterances(spark, sf))


@query("implicit_close", sql_with("utterances", """
SELECT session_id, utterance_id, start_us, CASE WHEN e IS NULL THEN n WHEN n IS NULL THEN e ELSE least(e, n) END AS closed_us FROM (
  SELECT *, CASE WHEN text <> '' THEN end_us END AS e, lead(start_us) OVER (PARTITION BY session_id ORDER BY utterance_id) AS n FROM utterances)"""))
def implicit_close(spark, sf):
    rows = utterances(spark, sf).withColumn("end_us", F.when(F.col("text") != "", F.col("end_us")))
    return op.close_implicitly(rows).select("session_id", "utterance_id", "start_us", "closed_us")


@query("revision_filter", sql_with("partials", """
SELECT session_id, arrival, utterance_id, revision, utterance_id > 0 AND (b IS NULL OR utterance_id * 1000 + revision > b) AND (c IS NULL OR utterance_id > c) AS accepted
FROM (SELECT *, max(CASE WHEN utterance_id > 0 THEN utterance_id * 1000 + revision END) OVER w AS b, max(CASE WHEN is_final AND utterance_id > 0 THEN utterance_id END) OVER w AS c
  FROM partials WINDOW w AS (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def revision_filter(spark, sf):
    return op.latest_revisions(partials(spark, sf)).select(
        "session_id", "arrival", "utterance_id", "revision", "accepted"
    )


@query("partial_stability", sql_with("partials", """
SELECT session_id, arrival, CAST((SELECT max(n) FROM range(0, 40) AS r(n) WHERE n <= length(text) AND n <= length(b) AND left(text, n) = left(b, n)) AS INT) AS stable
FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY session_id ORDER BY arrival), '') AS b FROM partials)"""))
def partial_stability(spark, sf):
    return op.partial_stability(partials(spark, sf)).select("session_id", "arrival", "stable")


_MARK_PARTIALS = """u AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS utterance_id, t_us, k, value, event_type FROM ev),
pp AS (SELECT session_id, utterance_id, t_us + (k % 7 - 2) * 1000000 AS p_us, CASE WHEN k % 3 = 0 THEN '...' ELSE event_type END AS text FROM u
  UNION ALL SELECT session_id, utterance_id, t_us + 10000000, CASE WHEN k % 2 = 0 THEN '!?' ELSE '停' END FROM u)"""


def _numbered_events(spark, sf):
    from ..plans.scan import numbered
    from ..views import micros

    placed = numbered(events_k(spark, sf), ["user_id"], "event_id", "utterance_id")
    return placed.select(
        F.col("user_id").alias("session_id"), "utterance_id", micros().alias("t_us"), "k", "value", "event_type"
    )


@query("barge_in_confirm", sql_with("ev", """
SELECT session_id, utterance_id, min(p_us) FILTER (regexp_matches(pp.text, '[\\p{L}\\p{N}]') AND p_us >= t_us) AS confirmed_us,
  count(*) FILTER (regexp_matches(pp.text, '[\\p{L}\\p{N}]') AND p_us >= t_us) > 0 AS confirmed
FROM u JOIN pp USING (session_id, utterance_id) GROUP BY session_id, utterance_id, t_us""", _MARK_PARTIALS))
def barge_in_confirm(spark, sf):
    rows = _numbered_events(spark, sf)
    said = rows.select(
        "session_id", "utterance_id",
        F.inline(F.array(
            F.struct((F.col("t_us") + (F.col("k") % 7 - 2) * 1000000).alias("t_us"),
                     F.when(F.col("k") % 3 == 0, "...").otherwise(F.col("event_type")).alias("text")),
            F.struct((F.col("t_us") + 10000000).alias("t_us"),
                     F.when(F.col("k") % 2 == 0, "!?").otherwise("停").alias("text")),
        )),
    )
    confirmed = op.confirm_barge_in(
        rows.select("session_id", "utterance_id", "t_us"), said, ["session_id", "utterance_id"]
    )
    return confirmed.select("session_id", "utterance_id", "confirmed_us", "confirmed")


@query("attempt_outcome", sql_with("ev", """
SELECT session_id, utterance_id, attempt, outcome, outcome <> 'completed' AND attempt < 2 AS retried FROM (
  SELECT *, 1 + k % 2 AS attempt, CASE WHEN k % 5 <> 0 AND CAST(floor(value * 500000) AS BIGINT) <= 8000000 THEN 'completed'
    WHEN k % 5 = 0 AND CAST(floor(value * 400000) AS BIGINT) <= 8000000 THEN 'empty_stream' ELSE 'first_token_timeout' END AS outcome FROM u)""", _MARK_PARTIALS))
def attempt_outcome(spark, sf):
    rows = _numbered_events(spark, sf).withColumn("attempt", 1 + F.col("k") % 2)
    starts = rows.select(
        "session_id", "utterance_id", "attempt", F.col("t_us").alias("start_us"),
        (F.col("t_us") + F.floor(F.col("value") * 400000)).alias("end_us"),
    )
    deltas = rows.select(
        "session_id", "utterance_id", "attempt",
        (F.col("t_us") + F.floor(F.col("value") * 500000)).alias("t_us"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.col("event_type")).alias("text"),
    )
    return op.attempt_outcomes(starts, deltas, ["session_id", "utterance_id"]).select(
        "session_id", "utterance_id", "attempt", "outcome", "retried"
    )


# --- sampled activity ------------------------------------------------------------------

_ONSET = """s AS (SELECT *, CAST(sum(d) OVER w AS BIGINT) AS cum FROM (SELECT *, above AND dur_ms > 0 AS loud, CASE WHEN above AND dur_ms > 0 THEN dur_ms ELSE 0 END AS d FROM activity) WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
onset AS (SELECT *, held, loud AND held - d < 60 AND held >= 60 AS fired FROM (SELECT *, cum - coalesce(max(CASE WHEN NOT loud THEN cum END) OVER (PARTITION BY session_id ORDER BY pos), 0) AS held FROM s))"""


@query("sustained_onset", sql_with("activity", "SELECT session_id, pos, held AS above_ms, fired AS onset FROM onset", _ONSET))
def sustained_onset(spark, sf):
    return op.sustained_onsets(activity(spark, sf), "session_id", "pos").select(
        "session_id", "pos", "above_ms", "onset"
    )


@query("activity_segments", sql_with("activity", f"""
SELECT session_id, segment, min(t_us) AS start, max(t_us) AS "end", count(*) AS blocks FROM (
  SELECT *, CAST(sum(CASE WHEN p IS NULL OR t_us - p > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS segment
  FROM (SELECT *, lag(t_us) OVER (PARTITION BY session_id ORDER BY pos) AS p FROM activity)) GROUP BY 1, 2"""))
def activity_segments(spark, sf):
    rows = op.activity_segments(activity(spark, sf), "session_id", "pos", "t_us", 6 * HOUR)
    return op.segment_table(rows, "session_id", "t_us")


@query("activity_segments_capped", sql_with("activity", """
SELECT session_id, segment, min(t_us) AS start, max(t_us) AS "end", count(*) AS blocks FROM walk GROUP BY 1, 2""", f"""/*recursive*/
r AS (SELECT session_id, t_us, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS rn FROM activity),
walk AS (SELECT session_id, t_us, rn, t_us AS seg_start, CAST(1 AS BIGINT) AS segment FROM r WHERE rn = 1
  UNION ALL SELECT r.session_id, r.t_us, r.rn, CASE WHEN r.t_us - w.t_us > {12 * HOUR} OR r.t_us - w.seg_start >= {20 * HOUR} THEN r.t_us ELSE w.seg_start END,
    w.segment + CASE WHEN r.t_us - w.t_us > {12 * HOUR} OR r.t_us - w.seg_start >= {20 * HOUR} THEN 1 ELSE 0 END
  FROM walk w JOIN r ON r.session_id = w.session_id AND r.rn = w.rn + 1)"""))
def activity_segments_capped(spark, sf):
    rows = op.activity_segments(activity(spark, sf), "session_id", "pos", "t_us", 12 * HOUR, cap=20 * HOUR)
    return op.segment_table(rows, "session_id", "t_us")


@query("preroll_lookback", sql_with("activity", f"""
SELECT o.session_id, o.t_us AS onset_us, greatest(b.t_us - b.dur_ms::BIGINT * 60000000, o.t_us - {24 * HOUR}) AS start_us, b.t_us AS end_us
FROM onset o JOIN activity b ON b.session_id = o.session_id AND b.dur_ms > 0 AND b.t_us <= o.t_us AND b.t_us > o.t_us - {24 * HOUR} WHERE o.fired""", _ONSET))
def preroll_lookback(spark, sf):
    blocks = activity(spark, sf)
    onsets = op.sustained_onsets(blocks, "session_id", "pos").where("onset")
    sized = blocks.withColumn("len_us", F.col("dur_ms") * F.lit(60000000).cast("bigint"))
    return op.lookback_before(onsets, sized, "session_id", 24 * HOUR)


@query("resample_linear", sql_with("activity", f"""
SELECT session_id, t0 + n * {6 * HOUR} AS grid, round(CASE WHEN t1 IS NULL THEN level ELSE level * (1 - (t0 + n * {6 * HOUR} - t_us) / (t1 - t_us)::DOUBLE) + v1 * ((t0 + n * {6 * HOUR} - t_us) / (t1 - t_us)::DOUBLE) END, 6) AS value
FROM (SELECT *, unnest(range(lo, hi)) AS n FROM (SELECT *, CAST(ceil((t_us - t0) / {6 * HOUR}.0::DOUBLE) AS BIGINT) AS lo, CAST(ceil((coalesce(t1, t_us + 1) - t0) / {6 * HOUR}.0::DOUBLE) AS BIGINT) AS hi FROM (
  SELECT *, min(t_us) OVER (PARTITION BY session_id) AS t0, lead(t_us) OVER w AS t1, lead(level) OVER w AS v1 FROM activity WINDOW w AS (PARTITION BY session_id ORDER BY pos))))"""))
def resample_linear(spark, sf):
    rows = op.resample_linear(activity(spark, sf), "session_id", "pos", "t_us", "level", 6 * HOUR)
    return rows.select("session_id", "grid", F.round("value", 6).alias("value"))


# --- recognition and chunk logs --------------------------------------------------------

_LEFT = """cut AS (SELECT stream, sn, max(arrival) AS c FROM (SELECT stream, arrival, unnest(range(rg_start, rg_end + 1)) AS sn FROM asr_log WHERE pgs = 'rpl') GROUP BY 1, 2),
alive AS (SELECT a.* FROM asr_log a LEFT JOIN cut USING (stream, sn) WHERE c IS NULL OR c <= arrival)"""


@query("range_replace", sql_with("asr_log", "SELECT stream, sn, word FROM alive", _LEFT))
def range_replace(spark, sf):
    return rec.surviving_pieces(asr_log(spark, sf)).select("stream", "sn", "word")


@query("dominant_language", sql_with("asr_log", """
SELECT stream, lg AS language, n FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n DESC, f) AS rn FROM (
  SELECT stream, lg, count(*) AS n, min(arrival) AS f FROM alive WHERE lg <> '' GROUP BY 1, 2)) WHERE rn = 1""", _LEFT))
def dominant_language(spark, sf):
    pieces = rec.surviving_pieces(asr_log(spark, sf), filled="lg <> ''")
    return rec.dominant_language(pieces, order="placed")


_ALTS = """alts AS (SELECT stream, sn // 8 AS utt, sn, CASE lg WHEN 'en' THEN [word, upper(word)] WHEN 'zh' THEN [word, word || '2', word] ELSE [word] END AS c FROM alive),
dd AS (SELECT stream, utt, sn, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM alts),
i AS (SELECT stream, utt, unnest(range(1, max(len(c)) + 1)) AS i FROM dd GROUP BY 1, 2),
tx AS (SELECT stream, utt, i, string_agg(coalesce(c[i], c[1]), '' ORDER BY sn) AS text FROM i JOIN dd USING (stream, utt) GROUP BY 1, 2, 3)"""


@query("nbest_texts", sql_with("asr_log", """
SELECT stream, utt, row_number() OVER (PARTITION BY stream, utt ORDER BY min(i)) AS rank, text FROM tx GROUP BY stream, utt, text""", _LEFT + ",\n" + _ALTS))
def nbest_texts(spark, sf):
    word = F.col("word")
    alternatives = (
        F.when(F.col("lg") == "en", F.array(word, F.upper(word)))
        .when(F.col("lg") == "zh", F.array(word, F.concat(word, F.lit("2")), word))
        .otherwise(F.array(word))
    )
    pieces = rec.surviving_pieces(asr_log(spark, sf)).withColumn(
        "candidates", F.array_distinct(alternatives)
    ).withColumn("utt", F.floor(F.col("sn") / 8))
    return rec.nbest(pieces, ["stream", "utt"])


@query("asr_log_scan", sql_with("asr_log", """
SELECT stream, arrival, sn, pgs, coalesce(rg_start, -1) AS rg_start, word || '+' AS text, CASE WHEN lg = 'zh' THEN 2 ELSE 1 END AS alternatives,
  CASE WHEN lg <> '' THEN lg ELSE 'ja' END AS language FROM asr_log"""))
def asr_log_scan(spark, sf):
    log = asr_log(spark, sf)
    ranged = F.when(
        F.col("rg_start").isNotNull(),
        F.concat(F.lit(',"rg":['), F.col("rg_start").cast("string"), F.lit(","), F.col("rg_end").cast("string"), F.lit("]")),
    ).otherwise("")
    more = F.when(F.col("lg") == "zh", F.concat(F.lit(',{"w":"'), F.upper("word"), F.lit('"}'))).otherwise("")
    text = F.concat(
        F.lit('{"sn":'), F.col("sn").cast("string"), F.lit(',"pgs":"'), F.col("pgs"), F.lit('"'), ranged,
        F.lit(',"ls":false,"ws":[{"cw":[{"w":"'), F.col("word"), F.lit('","lg":"'), F.col("lg"), F.lit('"}'), more,
        F.lit(']},{"cw":[{"w":"+","lg":"JA "}]},{"cw":[{"w":""}]}]}'),
    )
    parsed = rec.parse_recognition_log(log.select("stream", "arrival", F.base64(text.cast("binary")).alias("payload")))
    candidates = rec.piece_candidates(F.col("result"))
    return parsed.select(
        "stream", "arrival", "result.sn", "result.pgs",
        F.coalesce(F.get("result.rg", F.lit(0)), F.lit(-1)).alias("rg_start"),
        F.get(candidates, F.lit(0)).alias("text"), F.size(candidates).alias("alternatives"),
        rec.piece_language(F.col("result")).alias("language"),
    )


@query("chunk_log_deltas", sql_with("chunk_log ev", """
SELECT stream, line_no, delta FROM (SELECT c.stream, c.line_no, line, regexp_extract(line, '"content":"([^"]*)"', 1) AS delta,
  min(CASE WHEN line = 'data: [DONE]' THEN line_no END) OVER (PARTITION BY stream) AS done FROM chunk_log c)
WHERE (done IS NULL OR line_no < done) AND delta <> ''"""))
def chunk_log_deltas(spark, sf):
    return rec.chunk_log_to_deltas(chunk_log(spark, sf))


@query("answer_log_text", sql_with("chunk_log", """
SELECT stream, string_agg(delta, '' ORDER BY line_no) AS answer FROM (SELECT c.stream, c.line_no, regexp_extract(line, '"content":"([^"]*)"', 1) AS delta,
  min(CASE WHEN line = 'data: [DONE]' THEN line_no END) OVER (PARTITION BY stream) AS done FROM chunk_log c)
WHERE (done IS NULL OR line_no < done) AND delta <> '' GROUP BY 1"""))
def answer_log_text(spark, sf):
    deltas = rec.chunk_log_to_deltas(chunk_log(spark, sf))
    return assemble_text(deltas, ["stream"], "line_no", "delta", "", "answer")
