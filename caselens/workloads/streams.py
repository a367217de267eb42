"""Streaming jobs replayed over the shared tables in several triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.activity import FIRST_OUTPUT_US
from ..plans.scan import Sum, numbered, ordered_scan
from ..streaming import jobs
from ..views import activity, asr_log, events_k, micros, partials, sql_with, turn_events, utterances
from .activity import HOUR, _LEFT, _MARK_PARTIALS, _numbered_events
from .registry import query


def _replay(spark, log, order, slices=3):
    path, files = jobs.stage_log(log, order, slices)
    return jobs.open_log(spark, path, log.schema, files)


def _timed(log):
    return log.withColumn("ts", F.timestamp_micros("t_us"))


def _with_beat(log, key, order, after):
    """A last event of nobody, so much later that the watermark passes all others."""
    last = log.agg(F.max("t_us").alias("t"), F.max(order).alias("o"))
    values = {key: F.lit(-1), "t_us": F.col("t") + after} | ({order: F.col("o") + after} if order != "t_us" else {})
    beat = last.where("t IS NOT NULL").select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema])
    return log.unionByName(beat)


_STORE = f"""held AS (SELECT *, coalesce(last_value(CASE WHEN type <> 'response.text.delta' THEN type END IGNORE NULLS) OVER w, '') = 'turn.started' AS held,
  last_value(CASE WHEN type <> 'response.text.delta' THEN type END IGNORE NULLS) OVER b = 'turn.started' AS was, last_value(CASE WHEN type = 'turn.started' THEN turn_no END IGNORE NULLS) OVER b AS prior, lag(t_us) OVER (PARTITION BY session_id ORDER BY pos) AS p
  FROM turn_events WINDOW w AS (PARTITION BY session_id ORDER BY pos), b AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sess AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR (t_us - p >= {6 * HOUR} AND NOT coalesce(was, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS session_no FROM held)"""


@query("stream_session_store", sql_with("turn_events", """
SELECT session_id, pos, session_no, least(20, count(*) FILTER (type = 'turn.completed') OVER (PARTITION BY session_id, session_no ORDER BY pos)) AS history,
  CASE WHEN type = 'turn.started' AND coalesce(was, false) THEN prior ELSE -1 END AS superseded FROM sess""", _STORE))
def stream_session_store(spark, sf):
    log = _timed(turn_events(spark, sf).select("session_id", "pos", "t_us", "type", "turn_no"))
    out = jobs.run_to_table(jobs.session_stream(_replay(spark, log, "pos"), 6 * HOUR))
    first = out.withColumn("_new", (F.col("pos") == F.col("opened")).cast("bigint"))
    return ordered_scan(first, ["session_id"], "pos", {"session_no": Sum(F.col("_new"))}).select("session_id", "pos", "session_no", "history", "superseded")


@query("stream_revision_filter", sql_with("partials", """
SELECT session_id, arrival, utterance_id, revision, utterance_id > 0 AND (b IS NULL OR utterance_id * 1000 + revision > b) AND (c IS NULL OR utterance_id > c) AS accepted
FROM (SELECT *, max(CASE WHEN utterance_id > 0 THEN utterance_id * 1000 + revision END) OVER w AS b, max(CASE WHEN is_final AND utterance_id > 0 THEN utterance_id END) OVER w AS c
  FROM partials WINDOW w AS (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def stream_revision_filter(spark, sf):
    return jobs.run_to_table(jobs.revision_stream(_replay(spark, _timed(partials(spark, sf)), "arrival"), jobs.IDLE_US))


@query("stream_utterance_commit", sql_with("utterances", """
SELECT session_id, max(utterance_id) AS committed_id, count(*) AS utterances,
  coalesce(string_agg(text, ' ' ORDER BY utterance_id) FILTER (text <> ''), '') AS text, count(*) FILTER (text <> '') = 0 AS rejected
FROM (SELECT *, CAST(sum(CASE WHEN o IS NULL OR start_us > o THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY utterance_id) AS BIGINT) AS batch
  FROM (SELECT *, max(end_us) OVER (PARTITION BY session_id ORDER BY utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM utterances)) GROUP BY session_id, batch"""))
def stream_utterance_commit(spark, sf):
    log = utterances(spark, sf).select(
        "session_id", "utterance_id",
        F.inline(F.array(
            F.struct(F.lit("start").alias("kind"), F.lit(0).alias("kind_order"), F.col("start_us").alias("t_us"), F.lit("").alias("text")),
            F.struct(F.lit("final").alias("kind"), F.lit(1).alias("kind_order"), F.col("end_us").alias("t_us"), F.col("text").alias("text")),
        )),
    )
    committed = jobs.run_to_table(jobs.commit_stream(_replay(spark, _timed(log), "t_us"), jobs.IDLE_US))
    return committed.select("session_id", "committed_id", "utterances", "text", "rejected")


@query("stream_transcript", sql_with("asr_log", """
SELECT stream, string_agg(word, '' ORDER BY sn) AS text FROM alive GROUP BY 1""", _LEFT))
def stream_transcript(spark, sf):
    latest = jobs.run_to_table(jobs.transcript_stream(_replay(spark, _timed(asr_log(spark, sf)), "t_us"), jobs.IDLE_US), "update")
    return latest.groupBy("stream").agg(F.max_by("text", "arrival").alias("text"))


@query("stream_answers", sql_with("turn_events", """
SELECT t.session_id, t.turn_no, arg_min(type, pos) FILTER (type IN ('turn.completed', 'turn.failed', 'turn.cancelled')) AS outcome,
  coalesce(string_agg('d' || k, '' ORDER BY pos) FILTER (type = 'response.text.delta' AND pos < f), '') AS answer
FROM turn_events t JOIN (SELECT session_id, turn_no, min(pos) AS f FROM turn_events WHERE type IN ('turn.completed', 'turn.failed', 'turn.cancelled') GROUP BY 1, 2) x
  ON x.session_id = t.session_id AND x.turn_no = t.turn_no GROUP BY 1, 2"""))
def stream_answers(spark, sf):
    log = turn_events(spark, sf).select(
        "session_id", "turn_no", "pos", "t_us", "type", F.concat(F.lit("d"), F.col("k").cast("string")).alias("delta")
    )
    return jobs.run_to_table(jobs.answers_stream(_replay(spark, _timed(log), "pos"), jobs.IDLE_US))


@query("stream_capped_segments", sql_with("activity", """
SELECT session_id, min(t_us) AS start, max(t_us) AS "end", count(*) AS blocks FROM walk GROUP BY session_id, segment""", f"""/*recursive*/
r AS (SELECT session_id, t_us, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS rn FROM activity),
walk AS (SELECT session_id, t_us, rn, t_us AS seg_start, CAST(1 AS BIGINT) AS segment FROM r WHERE rn = 1
  UNION ALL SELECT r.session_id, r.t_us, r.rn, CASE WHEN r.t_us - w.t_us > {12 * HOUR} OR r.t_us - w.seg_start >= {20 * HOUR} THEN r.t_us ELSE w.seg_start END,
    w.segment + CASE WHEN r.t_us - w.t_us > {12 * HOUR} OR r.t_us - w.seg_start >= {20 * HOUR} THEN 1 ELSE 0 END
  FROM walk w JOIN r ON r.session_id = w.session_id AND r.rn = w.rn + 1)"""))
def stream_capped_segments(spark, sf):
    log = _with_beat(activity(spark, sf).select("session_id", "pos", "t_us"), "session_id", "pos", 48 * HOUR)
    stream = jobs.capped_segment_stream(_replay(spark, _timed(log), "pos"), 12 * HOUR, 20 * HOUR, "1 hour")
    return jobs.run_to_table(stream).where("session_id <> -1")


@query("stream_segments", sql_with("activity", f"""
SELECT session_id, min(t_us) AS start, max(t_us) AS "end", count(*) AS blocks FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR t_us - p >= {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS segment
  FROM (SELECT *, lag(t_us) OVER (PARTITION BY session_id ORDER BY pos) AS p FROM activity)) GROUP BY session_id, segment"""))
def stream_segments(spark, sf):
    log = _timed(_with_beat(activity(spark, sf).select("session_id", "pos", "t_us"), "session_id", "pos", 48 * HOUR))
    return jobs.run_to_table(jobs.segment_stream(_replay(spark, log, "pos"), "6 hours", "1 hour")).where("session_id <> -1")


@query("stream_event_dedup", sql_with("turn_events", "SELECT session_id, turn_no, seq, type, t_us FROM turn_events"))
def stream_event_dedup(spark, sf):
    rows = numbered(turn_events(spark, sf), ["session_id", "turn_no"], "pos", "seq").withColumn("seq", F.col("seq") - 1)
    twice = rows.select("session_id", "turn_no", "seq", "type", "t_us", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    stream = _replay(spark, _timed(twice), "t_us")
    kept = jobs.dedup_stream(stream, ["session_id", "turn_no", "seq"], "1 hour")
    return jobs.run_to_table(kept).select("session_id", "turn_no", "seq", "type", "t_us")


@query("stream_barge_in", sql_with("ev", """
SELECT session_id, utterance_id, t_us AS onset_us, p_us AS partial_us FROM u JOIN pp USING (session_id, utterance_id)
WHERE regexp_matches(pp.text, '[\\p{L}\\p{N}]') AND p_us >= t_us AND p_us <= t_us + 60000000""", _MARK_PARTIALS))
def stream_barge_in(spark, sf):
    rows = _numbered_events(spark, sf)
    onsets = rows.select("session_id", "utterance_id", F.timestamp_micros("t_us").alias("onset_ts"), "t_us")
    said = rows.select(
        "session_id", "utterance_id",
        F.inline(F.array(
            F.struct((F.col("t_us") + (F.col("k") % 7 - 2) * 1000000).alias("t_us"),
                     F.when(F.col("k") % 3 == 0, "...").otherwise(F.col("event_type")).alias("text")),
            F.struct((F.col("t_us") + 10000000).alias("t_us"),
                     F.when(F.col("k") % 2 == 0, "!?").otherwise("停").alias("text")),
        )),
    ).withColumn("partial_ts", F.timestamp_micros("t_us"))
    joined = jobs.barge_in_stream(
        _replay(spark, onsets, "t_us").drop("t_us"), _replay(spark, said, "t_us").drop("t_us"),
        ["session_id", "utterance_id"], "60 SECONDS", "1 hour",
    )
    return jobs.run_to_table(joined).select(
        "session_id", "utterance_id", F.unix_micros("onset_ts").alias("onset_us"),
        F.unix_micros("partial_ts").alias("partial_us"),
    )


@query("stream_attempts", sql_with("ev", """
SELECT session_id, utterance_id, attempt, start_us, outcome, outcome <> 'completed' AND attempt < 2 AS retried FROM (
  SELECT session_id, utterance_id, t_us AS start_us, 1 + k % 2 AS attempt, CASE WHEN k % 5 <> 0 AND CAST(floor(value * 500000) AS BIGINT) <= 8000000 THEN 'completed'
    WHEN k % 5 = 0 AND CAST(floor(value * 400000) AS BIGINT) <= 8000000 THEN 'empty_stream' ELSE 'first_token_timeout' END AS outcome FROM u)""", _MARK_PARTIALS))
def stream_attempts(spark, sf):
    rows = _numbered_events(spark, sf)
    silent = F.col("k") % 5 == 0
    spoke = F.col("t_us") + F.floor(F.col("value") * 500000)

    def event(kind, order, t_us, text):
        return F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), t_us.alias("t_us"), text.alias("text"))

    log = rows.select(
        "session_id", "utterance_id", (1 + F.col("k") % 2).cast("int").alias("attempt"),
        F.inline(F.array(
            event("start", 0, F.col("t_us"), F.lit("")),
            event("delta", 1, spoke, F.when(silent, "").otherwise(F.col("event_type"))),
            event("end", 2, F.when(silent, F.col("t_us") + F.floor(F.col("value") * 400000)).otherwise(spoke + 1), F.lit("")),
        )),
    )
    stream = _replay(spark, _timed(_with_beat(log, "session_id", "t_us", 2 * HOUR)), "t_us")
    return jobs.run_to_table(jobs.attempt_stream(stream, ["session_id", "utterance_id"], FIRST_OUTPUT_US, "1 hour"))
