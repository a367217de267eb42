"""Streams replayed in several triggers give what the batch form gives."""

import random
import uuid

import pandas as pd
from pyspark.sql import functions as F

from caselens.operators.activity import activity_segments, attempt_outcomes, segment_table
from caselens.session import ensure_checkpoint_dir
from caselens.streaming import jobs
from caselens.streaming.processors import AnswerAssembly, Attempts, BatchCommit, CappedSegments, SessionStore, unpacked


def replay(spark, rows, schema, order, slices):
    log = spark.createDataFrame(rows, schema)
    path, files = jobs.stage_log(log, order, slices)
    return jobs.open_log(spark, path, log.schema, files)


def left_states(spark, stream, names):
    """Rows of the named states when the stream has nothing more to read."""
    base = f"{ensure_checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
    jobs.start(stream, f"{base}/table", f"{base}/state").awaitTermination()
    table = spark.read.schema(stream.schema).parquet(f"{base}/table")
    read = lambda n: spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", n).load().count()
    return table, [read(n) for n in names]


def test_commit_drops_older_generations_and_keeps_late_finals(spark):
    rows = [
        (1, 1, "start", 0, 10, ""), (1, 2, "start", 0, 20, ""), (1, 2, "final", 1, 30, "新句"), (1, 1, "final", 1, 40, "旧句"),
        (1, 3, "start", 0, 50, ""), (1, 0, "reset", 2, 60, ""), (1, 3, "final", 1, 70, "丢弃"),
        (1, 4, "start", 0, 80, ""), (1, 4, "final", 1, 90, "  "),
    ]
    schema = "session_id bigint, utterance_id bigint, kind string, kind_order int, t_us bigint, text string"
    for slices in (1, 4):
        out = jobs.run_to_table(jobs.commit_stream(replay(spark, rows, schema, "t_us", slices)))
        got = sorted((r.generation, r.committed_id, r.utterances, r.text, r.rejected) for r in out.collect())
        assert got == [(0, 2, 2, "旧句 新句", False), (1, 4, 1, "", True)]


def test_silent_sessions_lose_their_state_unless_active(spark):
    rows = [
        (1, 1, 0, "turn.started", 1), (1, 2, 10_000_000, "turn.completed", 1), (1, 3, 500_000_000, "turn.started", 2),
        (2, 4, 0, "turn.started", 1), (2, 5, 600_000_000, "turn.completed", 1),
    ]
    # times start after the epoch, which is where a new watermark stands
    log = [(s, p, t + 10**9, k, n) for s, p, t, k, n in sorted(rows, key=lambda r: r[2])]
    stream = replay(spark, log, "session_id bigint, pos bigint, t_us bigint, type string, turn_no bigint", "t_us", 3)
    timed = stream.withColumn("ts", F.timestamp_micros("t_us"))
    out = jobs.run_to_table(jobs.session_stream(timed, 60_000_000, "1 second")).collect()
    assert {(r.session_id, r.pos): (r.opened, r.history) for r in out} == {
        (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (3, 0), (2, 4): (4, 0), (2, 5): (4, 1),
    }


def test_capped_segments_stream_equals_batch(spark):
    rows = [(k, n, n * 9 + n // 5 * 4 * k + n // 13 * 11) for k in (1, 2) for n in range(60)]
    schema = "session_id bigint, pos bigint, t_us bigint"
    batch = segment_table(
        activity_segments(spark.createDataFrame(rows, schema), "session_id", "pos", "t_us", 15, cap=50), "session_id", "t_us"
    ).collect()
    last = {k: max(r.segment for r in batch if r.session_id == k) for k in (1, 2)}
    out = jobs.run_to_table(jobs.capped_segment_stream(replay(spark, rows, schema, "pos", 4), 15, 50))
    assert sorted(tuple(r) for r in out.collect()) == sorted(
        (r.session_id, r.start, r.end, r.blocks) for r in batch if r.segment < last[r.session_id]
    )


def test_timed_capped_segments_give_the_last_one_too(spark):
    s = 1_000_000
    rows = [(k, n, 10**9 + (n * 9 + n // 5 * 4 * k + n // 13 * 11) * s) for k in (1, 2) for n in range(40)] + [(3, 5, 10**9 + 50 * s)]
    schema = "session_id bigint, pos bigint, t_us bigint"
    batch = segment_table(
        activity_segments(spark.createDataFrame(rows, schema), "session_id", "pos", "t_us", 15 * s, cap=50 * s), "session_id", "t_us"
    ).collect()
    # a later event of another session moves the watermark on
    stream = replay(spark, [*rows, (9, 40, 10**9 + 9000 * s)], schema, "pos", 3).withColumn("ts", F.timestamp_micros("t_us"))
    out = jobs.run_to_table(jobs.capped_segment_stream(stream, 15 * s, 50 * s, "1 second"))
    assert sorted(tuple(r) for r in out.collect()) == sorted((r.session_id, r.start, r.end, r.blocks) for r in batch)


def test_state_ends_once_the_watermark_has_passed(spark):
    s = 1_000_000
    beat = 10**9 + 9000 * s
    revisions = [(1, 1, 1, 0, False, 10**9), (1, 2, 1, 1, True, 10**9 + s), (2, 3, 1, 0, False, 10**9 + 2 * s), (9, 4, 1, 0, True, beat), (9, 5, 1, 1, True, beat + 9000 * s)]
    schema = "session_id bigint, arrival bigint, utterance_id int, revision int, is_final boolean, t_us bigint"
    timed = lambda rows, schema, order: replay(spark, rows, schema, order, 3).withColumn("ts", F.timestamp_micros("t_us"))
    kept, left = left_states(spark, jobs.revision_stream(timed(revisions, schema, "arrival"), idle=60 * s, delay="1 second"), ["best"])
    # the last event's own key is the only one left
    assert kept.count() == 5 and left == [1]
    utterances = [(1, 1, "start", 0, 10**9, ""), (1, 2, "start", 0, 10**9 + s, ""), (1, 2, "final", 1, 10**9 + 2 * s, "a"), (9, 1, "start", 0, beat, "")]
    schema = "session_id bigint, utterance_id bigint, kind string, kind_order int, t_us bigint, text string"
    _, left = left_states(spark, jobs.commit_stream(timed(utterances, schema, "t_us"), 60 * s, "1 second"), ["texts", "open", "generation"])
    assert left == [0, 1, 1]
    answers = [(1, 1, 1, 10**9, "response.text.delta", "a"), (1, 1, 2, 10**9 + s, "turn.completed", ""), (1, 2, 3, 10**9 + s, "response.text.delta", "b"), (9, 1, 4, beat, "turn.failed", "")]
    schema = "session_id bigint, turn_no bigint, pos bigint, t_us bigint, type string, delta string"
    out, left = left_states(spark, jobs.answers_stream(timed(answers, schema, "pos"), 60 * s, "1 second"), ["deltas", "done"])
    assert sorted((r.session_id, r.turn_no, r.answer) for r in out.collect()) == [(1, 1, "a"), (9, 1, "")] and left == [0, 1]
    sessions = [(1, 1, 10**9, "turn.started", 1), (1, 2, 10**9 + s, "turn.completed", 1), (2, 3, 10**9 + 2 * s, "turn.started", 1), (9, 4, beat, "turn.failed", 1)]
    schema = "session_id bigint, pos bigint, t_us bigint, type string, turn_no bigint"
    for idle, held in ((10**12, 2), (600 * s, 1)):
        _, left = left_states(spark, jobs.session_stream(timed(sessions, schema, "pos"), 60 * s, "1 second", idle), ["session", "turns"])
        # a session with an active turn is kept, but not for ever
        assert left == [held, 0]
    segments = [(1, 1, 10**9), (1, 2, 10**9 + s), (9, 3, beat)]
    out, left = left_states(spark, jobs.capped_segment_stream(timed(segments, "session_id bigint, pos bigint, t_us bigint", "pos"), 15 * s, 50 * s, "1 second"), ["segment"])
    assert [tuple(r) for r in out.collect()] == [(1, 10**9, 10**9 + s, 2)] and left == [1]


def test_transcripts_end(spark):
    s = 1_000_000
    rows = [(1, 1, 1, "a", "en", "apd", None, None, 10**9), (1, 2, 2, "b", "en", "rpl", 1, 1, 10**9 + s), (9, 3, 1, "z", "", "apd", None, None, 10**9 + 9000 * s)]
    schema = "stream bigint, arrival bigint, sn int, word string, lg string, pgs string, rg_start int, rg_end int, t_us bigint"
    stream = replay(spark, rows, schema, "t_us", 2).withColumn("ts", F.timestamp_micros("t_us"))
    out = jobs.run_to_table(jobs.transcript_stream(stream, 60 * s, "1 second"), "update")
    last = {r.stream: r.text for r in out.groupBy("stream").agg(F.max_by("text", "arrival").alias("text")).collect()}
    assert last == {1: "b", 9: "z"}


def test_attempts_are_settled_like_the_batch(spark):
    s = 1_000_000
    rng = random.Random(8)
    rows, starts, deltas = [], [], []
    for k in range(40):
        at = 10**9 + rng.randrange(100) * s
        for attempt in (1, 2)[: rng.randrange(1, 3)]:
            first, ends = rng.choice([None, 2 * s, 8 * s, 9 * s, 30 * s]), rng.choice([None, 3 * s, 8 * s, 20 * s, 40 * s])
            if first is not None and ends is not None and ends < first:
                ends = first + s
            rows.append((k, attempt, "start", 0, at, ""))
            rows.append((k, attempt, "delta", 1, at + s, ""))
            rows += [(k, attempt, "delta", 1, at + first, "x"), (k, attempt, "delta", 1, at + first + s, "y")] if first is not None else []
            rows += [(k, attempt, "end", 2, at + ends, "")] if ends is not None else []
            starts.append((k, attempt, at, None if ends is None else at + ends))
            deltas += [(k, attempt, at + first, "x")] if first is not None else []
            at += 60 * s
    schema = "k bigint, attempt int, kind string, kind_order int, t_us bigint, text string"
    batch = attempt_outcomes(
        spark.createDataFrame(starts, "k bigint, attempt int, start_us bigint, end_us bigint"),
        spark.createDataFrame(deltas, "k bigint, attempt int, t_us bigint, text string"), ["k"],
    ).collect()
    want = sorted((r.k, r.attempt, r.start_us, r.outcome, r.retried) for r in batch)
    assert {w[3] for w in want} == {"completed", "first_token_timeout", "empty_stream"}
    for slices in (1, 4):
        stream = replay(spark, [*rows, (-1, 1, "beat", 0, 10**9 + 9000 * s, "")], schema, "t_us", slices).withColumn("ts", F.timestamp_micros("t_us"))
        out, left = left_states(spark, jobs.attempt_stream(stream, ["k"], 8 * s, "1 second"), ["attempt"])
        assert sorted(map(tuple, out.collect())) == want and left == [0]


def test_slices_of_a_log_have_equally_many_files(spark):
    log = spark.range(1000).selectExpr("id % 7 AS k", "id AS pos")
    path, files = jobs.stage_log(log, "pos", 3, file_rows=100)
    assert files == 3
    names = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), "pos").groupBy("f").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    assert len(names) == 9 and sorted(sum(r.a <= x <= r.b for r in names) for x in (100, 500, 900)) == [3, 3, 3]


class _Handle:
    """State of one key, kept in memory."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.timers[0]

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_many_requests_share_a_call(spark):
    held = _Handle()
    attempts = Attempts(["a", "b"], 8000, 2)
    attempts.init(held)
    big = str(2**53 + 1)
    rows = [("1", big, 1, "start", 0, 10_000, ""), (None, "7", 1, "start", 0, 11_000, ""), ("1", big, 1, "delta", 1, 12_000, "x"), ("2", None, 2, "start", 0, 15_000, "")]
    frame = pd.DataFrame(rows, columns=["a", "b", "attempt", "kind", "kind_order", "t_us", "text"])
    (out,) = attempts.handleInputRows((0,), iter([frame]), held)
    assert out.to_numpy().tolist() == [["1", big, 1, 10_000, "completed", False]]
    # the timer is that of the one that waits longest; the other goes on waiting
    assert held.timers == [20] and held.rows == [(None, "7", 1, 11_000), ("2", None, 2, 15_000)]
    (out,) = attempts.handleExpiredTimer((0,), held, held)
    assert out.to_numpy().tolist() == [[None, "7", 1, 11_000, "first_token_timeout", True]]
    assert held.rows == [("2", None, 2, 15_000)] and held.timers[-1] == 24


class _Handles(_Handle):
    """Several states of one key, kept in memory."""

    def __init__(self):
        super().__init__()
        self.lists = {}

    def getListState(self, name, schema):
        return self.lists.setdefault(name, _Handle())


def _called(processor, columns, rows):
    """The processor's states after a call with these rows, and what it put out."""
    held = _Handles()
    processor.init(held)
    out = [list(r) for f in processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), held) for r in f.to_numpy().tolist()]
    return held, {name: state.rows for name, state in held.lists.items()}, out


def _fired(processor, held):
    out = [list(r) for f in processor.handleExpiredTimer((0,), held, held) for r in f.to_numpy().tolist()]
    return {name: state.rows for name, state in held.lists.items()}, held.timers[-1], out


def test_many_sessions_of_commits_share_a_call():
    rows = [("1", 1, "start", 0, 10_000, ""), ("2", 1, "start", 0, 11_000, ""), (None, 1, "start", 0, 12_000, ""), ("1", 1, "final", 1, 13_000, " a "), ("2", 2, "start", 0, 14_000, ""), ("2", 1, "final", 1, 15_000, "b")]
    commit = BatchCommit(["session_id"], 8000)
    held, left, out = _called(commit, ["session_id", "utterance_id", "kind", "kind_order", "t_us", "text"], rows)
    assert out == [["1", 0, 1, 1, "a", False]] and held.timers == [20]
    assert left == {"texts": [("2", 1, "b")], "open": [("2", 2, 0), (None, 1, 0)], "generation": [("1", 0, 13_000), ("2", 0, 15_000), (None, 0, 12_000)]}
    left, timer, _ = _fired(commit, held)
    assert [r[0] for r in left["generation"]] == ["1", "2"] and left["open"] == [("2", 2, 0)] and timer == 21


def test_many_capped_segments_share_a_call():
    rows = [("1", 1, 10_000), ("2", 2, 11_000), ("1", 3, 12_000), (None, 4, 13_000), ("1", 5, 30_000)]
    segments = CappedSegments(["session_id"], 5000, 50_000, timed=True)
    held, left, out = _called(segments, ["session_id", "pos", "t_us"], rows)
    assert out == [["1", 10_000, 12_000, 2]] and held.timers == [17]
    left, timer, out = _fired(segments, held)
    assert out == [["2", 11_000, 11_000, 1]] and timer == 19
    assert left == {"segment": [("1", 30_000, 30_000, 1), (None, 13_000, 13_000, 1)]}


def test_many_turns_share_a_call():
    rows = [("1", "1", 1, 10_000, "response.text.delta", "a"), ("1", "2", 2, 11_000, "response.text.delta", "b"), ("1", "1", 3, 12_000, "turn.completed", ""), ("1", "1", 4, 13_000, "turn.failed", ""), (None, "1", 5, 14_000, "turn.failed", "")]
    answers = AnswerAssembly(["session_id", "turn_no"], 8000)
    held, left, out = _called(answers, ["session_id", "turn_no", "pos", "t_us", "type", "delta"], rows)
    assert out == [["1", "1", "turn.completed", "a"], [None, "1", "turn.failed", ""]] and held.timers == [19]
    assert left == {"deltas": [("1", "2", "b", 11_000)], "done": [("1", "1", 13_000), (None, "1", 14_000)]}
    left, timer, _ = _fired(answers, held)
    assert left == {"deltas": [], "done": [("1", "1", 13_000), (None, "1", 14_000)]} and timer == 21


def test_many_sessions_of_the_store_share_a_call():
    rows = [("1", 1, 10_000, "turn.started", 1), ("2", 2, 11_000, "turn.started", 1), ("1", 3, 12_000, "turn.completed", 1), (None, 4, 13_000, "turn.failed", 1), ("2", 5, 14_000, "turn.started", 2), ("1", 6, 21_000, "turn.failed", 2)]
    store = SessionStore(["session_id"], 8000, idle=20_000)
    held, left, out = _called(store, ["session_id", "pos", "t_us", "type", "turn_no"], rows)
    assert out == [["1", 1, 1, 0, -1], ["2", 2, 2, 0, -1], ["1", 3, 1, 1, -1], [None, 4, 4, 0, -1], ["2", 5, 2, 0, 1], ["1", 6, 6, 0, -1]]
    # the silent one goes, the one with an active turn is kept for longer
    assert held.timers == [21] and left["turns"] == []
    left, timer, _ = _fired(store, held)
    assert left["session"] == [("1", 6, 21_000, -1), ("2", 2, 14_000, 2)] and timer == 29


def test_rows_reach_a_slot_in_packs(spark):
    import pyarrow as pa

    rng = random.Random(5)
    rows = [(rng.randrange(4), None if i % 7 == 0 else f"s{i % 5}", i, None if i % 11 == 0 else i * 10) for i in range(200)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[3] for r in rows], pa.timestamp("us", "UTC")), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])],
        names=["n_slot", "ts", "session_id", "pos"],
    )
    (packs,) = jobs._pack(iter([batch.slice(0, 120), batch.slice(120)]))
    assert packs["n_slot"].to_pylist() == [0, 1, 2, 3]
    for i, slot in enumerate(packs["n_slot"].to_pylist()):
        mine = [r for r in rows if r[0] == slot]
        assert packs["n_rows"][i].as_py() == len(mine)
        assert packs["ts"].cast(pa.int64())[i].as_py() == max(r[3] or 0 for r in mine)
        frame = unpacked(packs.slice(i, 1).to_pandas())
        assert list(frame.columns) == ["session_id", "pos"]
        assert [(s if isinstance(s, str) else None, int(n)) for s, n in zip(frame["session_id"], frame["pos"], strict=True)] == [(r[1], r[2]) for r in mine]
