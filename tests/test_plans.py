"""The shared plan shapes against plain windows and brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caselens.operators.activity import (
    activity_segments, commit_batches, expire_sessions, latest_revisions, resample_linear, sustained_onsets,
)
from caselens.plans import match
from caselens.plans.match import find_terms
from caselens.plans.scan import Last, Max, Next, Sum, ordered_scan, ranked, top_rows


def skewed(spark, n=600):
    rng = random.Random(5)
    rows = []
    for pos in range(n):
        key = 1 if rng.random() < 0.5 else rng.randint(2, 20)
        rows.append((key, pos, rng.choice([None, rng.randint(-50, 50)]), pos * 10 + rng.randint(0, 9)))
    return spark.createDataFrame(rows, "k int, pos bigint, v int, t bigint")


def test_ordered_scan_matches_plain_windows_across_chunks(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("pos")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    plain = df.select(
        "k", "pos",
        F.sum("v").over(upto).alias("s"), F.sum("v").over(before).alias("sx"),
        F.max("v").over(before).alias("m"), F.last("v", True).over(before).alias("l"),
        F.last("v", True).over(upto).alias("li"), F.first("v", True).over(after).alias("n"),
    )
    v = F.col("v")
    outputs = {
        "s": Sum(v), "sx": Sum(v, inclusive=False), "m": Max(v), "l": Last(v),
        "li": Last(v, inclusive=True), "n": Next(v),
    }
    for rows in (7, 64, 1 << 20):
        got = ordered_scan(df, ["k"], "pos", outputs, rows=rows).select(*plain.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_ordered_scan_without_keys(spark):
    df = skewed(spark).select("pos", "v")
    got = ordered_scan(df, [], "pos", {"n": Sum(F.lit(1).cast("bigint"))}, rows=50)
    assert [r.n for r in got.orderBy("pos").collect()] == list(range(1, 601))


def test_ranked_is_a_total_order_per_key(spark):
    df = skewed(spark).withColumn("v", F.coalesce("v", F.lit(0)))
    got = ranked(df, ["k"], [F.desc("v"), F.asc("pos")], "r")
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "pos")))
    key = lambda rows: sorted((r.k, r.pos, r.r) for r in rows)
    assert key(got.collect()) == key(plain.collect())


def test_top_rows_prunes_before_the_shuffle(spark):
    plan = top_rows(skewed(spark), ["k"], [F.desc("v"), F.asc("pos")], 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_find_terms_both_ways_match_brute_force(spark):
    rng = random.Random(11)
    alphabet = "ab中文c "
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(40)]
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(60)}
    expected = sorted(
        (i, p + 1, w) for i, t in texts for w in words for p in range(len(t)) if t.startswith(w, p)
    )
    t = spark.createDataFrame(texts, "id int, text string")
    d = spark.createDataFrame([(w,) for w in words], "term string")
    for shard in (1 << 20, 40, 1):
        got = find_terms(t, ["id"], "text", d, shard_chars=shard)
        assert got.columns == ["id", "pos", "term"]
        assert sorted(map(tuple, got.collect())) == expected
        once = find_terms(t, ["id"], "text", d, first_only=True, shard_chars=shard)
        firsts = {(i, w) for i, _, w in expected}
        assert {(r.id, r.term) for r in once.collect()} == firsts


def test_find_terms_without_terms(spark):
    t = spark.createDataFrame([(1, "abc")], "id int, text string")
    d = spark.createDataFrame([("",)], "term string")
    for shard in (1 << 20, -1):
        assert find_terms(t, ["id"], "text", d, shard_chars=shard).count() == 0


def test_long_terms_widen_the_pieces_of_their_own_shard_alone(spark, monkeypatch):
    rng = random.Random(12)
    long_text = "".join(rng.choice("abcdefgh ") for _ in range(30000))
    texts = [(0, long_text), (1, long_text[:9000] * 2), (2, None), (3, ""), (4, "a" * 20000)]
    words = {long_text[i : i + 7] for i in range(0, 30000, 37)} | {long_text[3000:7000], long_text[8190:12400], "a" * 4000, "x" * 50}
    routed = []

    def salted(held, asked, *args):
        routed.append(asked.selectExpr("sum(length(body))", "count(*)").first())
        return own(held, asked, *args)

    own = match.salted
    monkeypatch.setattr(match, "salted", salted)
    t, d = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words], "term string")
    got = find_terms(t, ["id"], "text", d, shard_chars=2500)
    where = sorted((i, p + 1, w) for i, x in texts if x for w in words for p in range(len(x)) if x.startswith(w, p))
    assert sorted(map(tuple, got.collect())) == where
    # nine shards: rows are pieces, not characters
    assert routed[0][1] < 200 and routed[0][0] < 20 * sum(len(x or "") for _, x in texts)


def test_terms_of_one_gram_are_split_over_shards(spark):
    words = [f"qqq{i:05d}" for i in range(300)]
    texts = [(i, " ".join(words[i::7])) for i in range(7)]
    t, d = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words] + [("qq",)], "term string")
    got = find_terms(t, ["id"], "text", d, shard_chars=100)
    assert sorted(map(tuple, got.collect())) == sorted((i, p + 1, w) for i, x in texts for w in [*words, "qq"] for p in range(len(x)) if x.startswith(w, p))


def test_small_chunks_do_not_change_the_event_jobs(spark):
    df = skewed(spark).withColumn("above", F.coalesce(F.col("v") > 0, F.lit(False))).withColumn("dur_ms", F.lit(20))
    utter = df.select(
        F.col("k").alias("session_id"), F.col("pos").alias("utterance_id"), F.col("t").alias("start_us"),
        (F.col("t") + F.abs(F.coalesce("v", F.lit(0)))).alias("end_us"),
        F.when(F.col("v") > 0, "x").otherwise("").alias("text"),
    )
    part = df.select(
        F.col("k").alias("session_id"), F.col("pos").alias("arrival"),
        (F.abs(F.coalesce("v", F.lit(0))) % 5).alias("utterance_id"), (F.col("pos") % 4).cast("int").alias("revision"),
        (F.col("v") == 3).alias("is_final"),
    ).fillna({"is_final": False})
    jobs = [
        lambda rows: sustained_onsets(df, "k", "pos", rows=rows).select("k", "pos", "above_ms", "onset"),
        lambda rows: expire_sessions(df, "k", "pos", "t", 40, rows=rows).select("k", "pos", "session_no"),
        lambda rows: commit_batches(utter, rows=rows),
        lambda rows: latest_revisions(part, rows=rows),
        lambda rows: resample_linear(df.withColumn("x", F.coalesce("v", F.lit(0)).cast("double")), "k", "pos", "t", "x", 7, rows=rows),
    ]
    for job in jobs:
        key = lambda frame: sorted(map(str, map(tuple, frame.collect())))
        assert key(job(9)) == key(job(1 << 20))


def test_capped_segments_match_a_sequential_walk(spark):
    df = skewed(spark)
    got = activity_segments(df, "k", "pos", "t", gap=60, cap=150, rows=25)
    seen = {}
    expected = []
    for k, pos, _v, t in sorted(map(tuple, df.collect()), key=lambda r: r[1]):
        start, last, number = seen.get(k, (None, None, 0))
        if last is None or t - last > 60 or t - start >= 150:
            start, number = t, number + 1
        seen[k] = (start, t, number)
        expected.append((k, pos, number))
    assert sorted((r.k, r.pos, r.segment) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("passes", [1, 3])
def test_long_terms_are_not_sent_to_shards(spark, monkeypatch, passes):
    rng = random.Random(13)
    lines = ["".join(rng.choice("abcdefgh 中") for _ in range(rng.choice([16, 40, 90]))) for _ in range(120)]
    # lines that begin alike, overlap, hold each other or repeat
    lines += [lines[0] + lines[1], lines[2] * 2, "shared beginning " + lines[3], "shared beginning " + lines[4], "a" * 16, "a" * 20]
    texts = [(i, "\n".join([lines[i], *rng.choices(lines, k=20)])) for i in range(len(lines))] + [(900, None), (901, ""), (902, "a" * 50)]
    written, pin = [], match.pinned

    def counting(df):
        rows = pin(df)
        columns = [f.name for f in rows.schema if f.dataType.typeName() == "string"]
        written.append(sum(rows.selectExpr(f"coalesce(sum(length({c})), 0)").first()[0] for c in columns))
        return rows

    monkeypatch.setattr(match, "pinned", counting)
    monkeypatch.setattr(match, "PLAN_TERMS", -(-len(set(lines)) // passes))
    monkeypatch.setattr(match, "PLACES", 50)
    t = spark.createDataFrame(texts, "id int, text string")
    d = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(set(lines) | {"cab", "ab"}))], "line string, no int")
    got = sorted(map(tuple, find_terms(t, ["id"], "text", d, "line", shard_chars=400).collect()))
    words = set(lines) | {"cab", "ab"}
    want = sorted((i, p + 1, w) for i, x in texts if x for w in words for p in range(len(x)) if x.startswith(w, p))
    assert got == want
    # the texts were written once for nearly each of 16 shards
    assert sum(written) < sum(len(x or "") for _, x in texts)
    numbers = {w: i for i, w in enumerate(sorted(words))}
    told = find_terms(t, ["id"], "text", d, "line", shard_chars=400, number="no")
    assert sorted(map(tuple, told.collect())) == sorted((i, p, numbers[w]) for i, p, w in want)
