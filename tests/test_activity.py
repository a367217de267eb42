from pyspark.sql import functions as F

from caselens.operators import activity as op
from caselens.operators import recognition as rec
from caselens.operators.turns import assemble_text


def test_onset_gate(spark):
    us = 128 / 48000 * 1000
    rows = [("a", i, True, us) for i in range(23)] + [("b", 0, True, 85.0), ("b", 1, False, 2.0), ("b", 2, True, 2.0)]
    rows += [("c", i, True, 10.0) for i in range(16)]
    blocks = spark.createDataFrame(rows, "k string, pos bigint, above boolean, dur_ms double")
    got = op.sustained_onsets(blocks, "k", "pos", required=60).orderBy("k", "pos").collect()
    assert [r.pos for r in got if r.k == "a" and r.onset] == [22]
    assert [r.above_ms for r in got if r.k == "b"][1] == 0.0 and abs([r.above_ms for r in got if r.k == "b"][2] - 2.0) < 1e-9
    strict = op.sustained_onsets(blocks.where("k = 'c'"), "k", "pos", required=op.ONSET_POLICY["playback"][1])
    assert [r.pos for r in strict.where("onset").collect()] == [15]


def test_supersede_and_cancel(spark):
    turns = spark.createDataFrame(
        [("s", 1, 0, 50, False), ("s", 2, 20, 30, True), ("s", 3, 40, None, False), ("s", 4, 60, None, False)],
        "session_id string, turn_no bigint, start_us bigint, end_us bigint, cancelled boolean",
    )
    got = {r.turn_no: r.reason for r in op.supersede(turns).collect()}
    assert got == {1: "superseded", 2: "client_cancelled", 3: "superseded", 4: ""}


def test_capacity_keeps_active_sessions(spark):
    rows = [("old-active", 1, True), ("a", 2, False), ("b", 3, False), ("c", 4, False)]
    sessions = spark.createDataFrame(rows, "session_id string, last_seen int, active boolean")
    got = {r.session_id for r in op.lru(sessions, "session_id", "last_seen", "active", cap=2).where("evicted").collect()}
    assert got == {"a", "b"}
    alive = spark.createDataFrame([("x", 1, True), ("y", 2, True), ("z", 3, False)], "session_id string, last_seen int, active boolean")
    got = {r.session_id for r in op.lru(alive, "session_id", "last_seen", "active", cap=1).where("evicted").collect()}
    assert got == {"z"}


def test_expiry_waits_for_active_turns(spark):
    events = spark.createDataFrame(
        [("s", 1, 0, False), ("s", 2, 10, True), ("s", 3, 100, False), ("s", 4, 130, False)], "k string, pos bigint, t bigint, on boolean"
    )
    rows = op.expire_sessions(events, "k", "pos", "t", 30, active=F.col("on")).orderBy("pos").collect()
    assert [r.session_no for r in rows] == [1, 1, 1, 2]


def test_overlapping_utterances_commit_together(spark):
    rows = [("s", 1, 0, 10, " 旧句 "), ("s", 2, 5, 8, "新句"), ("s", 3, 20, 25, "  "), ("s", 4, 30, 31, "x"), ("s", 5, 31, 40, "")]
    got = op.commit_batches(spark.createDataFrame(rows, "session_id string, utterance_id bigint, start_us bigint, end_us bigint, text string"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [
        (1, 2, 2, "旧句 新句", False), (2, 3, 1, "", True), (3, 5, 2, "x", False),
    ]


def test_generations(spark):
    rows = [("s", 1, "start"), ("s", 2, "result"), ("s", 3, "start"), ("s", 4, "reset"), ("s", 5, "result"), ("s", 6, "start"), ("s", 7, "result")]
    events = spark.createDataFrame(rows, "k string, pos bigint, type string")
    got = op.apply_generation(events, "k", "pos", ["reset"], ["start"], ["result"])
    assert {r.pos for r in got.where("kept").collect()} == {2, 7}


def test_partial_revisions(spark):
    rows = [(1, 4, 2, False), (2, 4, 1, False), (3, 4, 3, False), (4, 3, 99, False), (5, 4, 4, True), (6, 4, 9, False), (7, 5, 0, False), (8, 0, 5, False)]
    partials = spark.createDataFrame(rows, "arrival bigint, utterance_id int, revision int, is_final boolean").withColumn("session_id", F.lit(1))
    got = {r.arrival for r in op.latest_revisions(partials).where("accepted").collect()}
    assert got == {1, 3, 5, 7}


def test_stable_prefix(spark):
    rows = [(1, "你好"), (2, "你好呀"), (3, "你好啊"), (4, ""), (5, "abc"), (6, "abd")]
    df = spark.createDataFrame(rows, "arrival bigint, text string").withColumn("session_id", F.lit(1))
    got = [r.stable for r in op.partial_stability(df).orderBy("arrival").collect()]
    assert got == [0, 2, 2, 0, 0, 2]


def test_pre_roll_is_clipped(spark):
    blocks = spark.createDataFrame([("s", 50 * i, 50) for i in range(1, 9)], "k string, t_us bigint, len_us bigint")
    onsets = spark.createDataFrame([("s", 390)], "k string, t_us bigint")
    rows = op.lookback_before(onsets, blocks, "k", 300).orderBy("start_us").collect()
    assert [(r.start_us, r.end_us) for r in rows] == [(90, 100), (100, 150), (150, 200), (200, 250), (250, 300), (300, 350)]


def resampled(samples, step):
    out, at = [], 0.0
    while at + 1 < len(samples):
        low = int(at)
        out.append(samples[low] * (1 - (at - low)) + samples[low + 1] * (at - low))
        at += step
    if at < len(samples):
        low = int(at)
        out.append(samples[low] * (1 - (at - low)) + samples[min(low + 1, len(samples) - 1)] * (at - low))
    return out


def test_resampling_keeps_phase(spark):
    import math

    # positions in units of 1/160 of a 44.1 kHz sample, so both rates land on integers
    for rate, unit, step in ((48000, 1, 3), (44100, 160, 441)):
        samples = [math.sin(i / 13) for i in range(300)]
        series = spark.createDataFrame([("s", i, i * unit, v) for i, v in enumerate(samples)], "k string, pos bigint, t bigint, v double")
        for rows in (37, 1 << 20):
            got = op.resample_linear(series, "k", "pos", "t", "v", step, tail=unit, rows=rows).orderBy("grid").collect()
            want = resampled(samples, step / unit)
            assert len(got) == len(want) and all(abs(a.value - b) < 1e-9 for a, b in zip(got, want))


def test_barge_in_needs_speech(spark):
    onsets = spark.createDataFrame([("s", 1, 100), ("s", 2, 200), ("s", 3, 300)], "k string, u int, t_us bigint")
    said = spark.createDataFrame([("s", 1, 90, "早"), ("s", 1, 120, "。！"), ("s", 1, 130, "停"), ("s", 2, 210, "  ")], "k string, u int, t_us bigint, text string")
    got = {r.u: (r.confirmed, r.confirmed_us) for r in op.confirm_barge_in(onsets, said, ["k", "u"]).collect()}
    assert got == {1: (True, 130), 2: (False, None), 3: (False, None)}


def test_attempts(spark):
    s = 1_000_000
    starts = spark.createDataFrame([("t", 1, 0, 20 * s), ("t", 2, 0, s), ("u", 1, 0, s), ("v", 1, 0, 20 * s)], "k string, attempt int, start_us bigint, end_us bigint")
    deltas = spark.createDataFrame([("t", 1, 9 * s, "late"), ("t", 2, s, "x"), ("u", 1, s, "")], "k string, attempt int, t_us bigint, text string")
    got = {(r.k, r.attempt): (r.outcome, r.retried) for r in op.attempt_outcomes(starts, deltas, ["k"]).collect()}
    assert got == {
        ("t", 1): ("first_token_timeout", True), ("t", 2): ("completed", False),
        ("u", 1): ("empty_stream", True), ("v", 1): ("first_token_timeout", True),
    }


def lattice(spark, results):
    import base64
    import json

    rows = [(1, n, base64.b64encode(json.dumps(r, ensure_ascii=False).encode()).decode()) for n, r in enumerate(results)]
    parsed = rec.parse_recognition_log(spark.createDataFrame(rows, "stream int, arrival int, payload string"))
    candidates = rec.piece_candidates(F.col("result"))
    return parsed.select(
        "stream", "arrival", "result.sn", "result.pgs", F.get("result.rg", F.lit(0)).alias("rg_start"),
        F.get("result.rg", F.lit(1)).alias("rg_end"), candidates.alias("candidates"),
        F.coalesce(F.get(candidates, F.lit(0)), F.lit("")).alias("word"), rec.piece_language(F.col("result")).alias("lg"),
    )


def words(*segments, lg=""):
    return [{"cw": [{"w": w, "lg": lg} for w in s]} for s in segments]


def test_nbest_words(spark):
    row = lattice(spark, [{"sn": 0, "ws": words(["朱仙镇", "朱仙阵"], ["木版年画", "木板年画", "木版年华"])}]).first()
    assert row.candidates == ["朱仙镇木版年画", "朱仙阵木板年画", "朱仙镇木版年华"]


def test_range_replacement(spark):
    log = lattice(spark, [
        {"sn": 0, "ws": words(["前文"], lg="en")}, {"sn": 1, "ws": words(["书秀", "旧候选"], lg="zh")},
        {"sn": 2, "pgs": "rpl", "rg": [1, 1], "ws": words(["刷单返利", "新候选"], lg="zh")},
        {"sn": 3, "ws": words(["吧"], lg="zh")},
    ])
    left = rec.surviving_pieces(log)
    assert assemble_text(left, ["stream"], "sn", "word").first().text == "前文刷单返利吧"
    texts = [r.text for r in rec.nbest(left, ["stream"]).orderBy("rank").collect()]
    assert texts == ["前文刷单返利吧", "前文新候选吧"]
    tagged = rec.surviving_pieces(log, filled="lg <> ''")
    assert rec.dominant_language(tagged, order="placed").first().language == "zh"


def test_language_tie_goes_to_the_first(spark):
    row = lattice(spark, [{"sn": 0, "ws": words(["a"], lg="EN ") + words(["b"], lg="zh") + words(["c"], lg="")}]).first()
    assert row.lg == "en"


def test_chunk_log(spark):
    lines = [
        "", ": ping", 'data: {"choices":[{"delta":{"content":"你"}}]}', "data: {broken", 'data:{"choices":[{"message":{"content":"好"}}]}',
        'data: {"choices":[]}', 'data: {"choices":[{"delta":{"content":""}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"晚"}}]}',
    ]
    log = spark.createDataFrame([(1, i, l) for i, l in enumerate(lines)], "stream int, line_no int, line string")
    deltas = rec.chunk_log_to_deltas(log)
    assert assemble_text(deltas, ["stream"], "line_no", "delta").first().text == "你好"
