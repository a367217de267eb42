"""Event-log jobs: sessions, turns, utterances, onsets, segments, resampling.

Every running value goes through ``ordered_scan``, so one busy session is spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_speech
from ..plans.scan import CHUNK_ROWS, Last, Max, Next, Sum, ordered_scan, ranked
from ..session import pinned
from .turns import joined_text, order_run

# Time limits and thresholds.
SESSION_TTL_US = 1800 * 1_000_000
MAX_SESSIONS = 1000
SILENCE_MS, MAX_UTTERANCE_MS, PRE_ROLL_MS = 680, 20000, 300
ONSET_POLICY = {"normal": (0.018, 60), "playback": (0.022, 160)}
FIRST_OUTPUT_US, MAX_ATTEMPTS = 8 * 1_000_000, 2


# --- sessions and turns ----------------------------------------------------------------


def supersede(turns: DataFrame, key: str = "session_id", order: str = "turn_no") -> DataFrame:
    """``reason`` for turns (key, order, start_us, end_us, cancelled): a next turn that
    starts before this one ends supersedes it; otherwise an explicit cancel counts."""
    nexts = ordered_scan(turns, [key], order, {"_next_start": Next(F.col("start_us"))})
    replaced = F.coalesce(F.col("_next_start") < F.coalesce("end_us", F.col("_next_start") + 1), F.lit(False))
    return nexts.withColumn(
        "reason",
        F.when(replaced, "superseded").when(F.col("cancelled"), "client_cancelled").otherwise(""),
    ).drop("_next_start")


def expire_sessions(
    events: DataFrame, key: str, order: str, time: str, ttl: int = SESSION_TTL_US,
    active: Column | None = None, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``session_no`` per key: a pause of at least ``ttl`` starts a new session unless a
    turn is still active during it. ``active``: true in a row that begins a turn, false in
    one that ends it, null in others, which leave things as they are."""
    held = F.lit(None).cast("boolean") if active is None else active
    seen = ordered_scan(events, [key], order, {"_prev": Last(F.col(time)), "_held": Last(held)}, rows)
    expired = (F.col(time) - F.col("_prev") >= ttl) & ~F.coalesce("_held", F.lit(False))
    starts = F.when(F.col("_prev").isNull() | expired, 1).otherwise(0).cast("bigint")
    # a scan reads its input twice, so a scan over a scan starts from written rows
    flagged = pinned(seen.withColumn("_new", starts).drop("_prev", "_held"))
    return ordered_scan(flagged, [key], order, {"session_no": Sum(F.col("_new"))}, rows).drop("_new")


def lru(sessions: DataFrame, key: str, last_seen: str, active: str, cap: int = MAX_SESSIONS) -> DataFrame:
    """``evicted``: idle sessions beyond the newest ones that fit beside the active ones."""
    placed = ranked(sessions, [], [F.desc(active), F.desc(last_seen), F.asc(key)], "_place")
    return placed.withColumn("evicted", (F.col("_place") > cap) & ~F.col(active)).drop("_place")


def apply_generation(events: DataFrame, key: str, order: str, resets: list[str], starts: list[str], results: list[str]) -> DataFrame:
    """``generation`` per event and ``kept`` per result: a result counts only if nothing
    reset the batch since the latest start before it."""
    reset = F.when(F.col("type").isin(resets), 1).otherwise(0).cast("bigint")
    numbered_rows = pinned(ordered_scan(events, [key], order, {"generation": Sum(reset)}))
    begun = ordered_scan(
        numbered_rows, [key], order,
        {"_begun": Last(F.when(F.col("type").isin(starts), F.col("generation")))},
    )
    return begun.withColumn(
        "kept",
        F.when(
            F.col("type").isin(results),
            F.coalesce(F.col("_begun") == F.col("generation"), F.lit(False)),
        ).otherwise(False),
    ).drop("_begun")


# --- utterances ------------------------------------------------------------------------


def close_implicitly(utterances: DataFrame, key: str = "session_id", order: str = "utterance_id") -> DataFrame:
    """``closed_us``: its own end, or the start of the next utterance if that is earlier."""
    return ordered_scan(utterances, [key], order, {"_next": Next(F.col("start_us"))}).withColumn(
        "closed_us", F.least("end_us", "_next")
    ).drop("_next")


def commit_batches(utterances: DataFrame, key: str = "session_id", order: str = "utterance_id", rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per batch of overlapping utterances: (key, batch, committed_id, utterances,
    text, rejected). ``utterances`` are in start order; a batch ends when nothing is open.
    """
    open_until = ordered_scan(utterances, [key], order, {"_open": Max(F.col("end_us"))}, rows)
    starts = F.when(F.col("_open").isNull() | (F.col("start_us") > F.col("_open")), 1).otherwise(0)
    flagged = pinned(open_until.withColumn("_new", starts.cast("bigint")).drop("_open"))
    placed = ordered_scan(flagged, [key], order, {"batch": Sum(F.col("_new"))}, rows)
    spoken = placed.withColumn("_spoken", F.when(F.trim("text") != "", F.trim("text")))
    runs = spoken.groupBy(key, "batch", order_run(order, rows).alias("_run")).agg(
        F.max(order).alias("committed_id"), F.count(F.lit(1)).alias("utterances"),
        joined_text(order, "_spoken", " ").alias("_part"),
    )
    text = joined_text("_run", "_part", " ")
    return runs.groupBy(key, "batch").agg(
        F.max("committed_id").alias("committed_id"), F.sum("utterances").alias("utterances"),
        F.coalesce(text, F.lit("")).alias("text"), text.isNull().alias("rejected"),
    )


def latest_revisions(partials: DataFrame, key: str = "session_id", order: str = "arrival", rows: int = CHUNK_ROWS) -> DataFrame:
    """``accepted``: (utterance_id, revision) beats every earlier one of the session, the
    id is positive, and no final of the same or a later utterance came before."""
    pair = F.when(F.col("utterance_id") > 0, F.struct("utterance_id", "revision"))
    closed = F.when(F.col("is_final") & (F.col("utterance_id") > 0), F.col("utterance_id"))
    seen = ordered_scan(partials, [key], order, {"_best": Max(pair), "_closed": Max(closed)}, rows)
    newer = F.coalesce(F.struct("utterance_id", "revision") > F.col("_best"), F.lit(True))
    first_zero = F.col("_best").isNull() & (F.col("utterance_id") <= 0)
    refused = F.coalesce(F.col("utterance_id") <= F.col("_closed"), F.lit(False))
    return seen.withColumn(
        "accepted", newer & ~first_zero & ~refused & (F.col("utterance_id") > 0)
    ).drop("_best", "_closed")


def common_prefix(left: Column, right: Column) -> Column:
    """Length of the longest common prefix of two texts."""
    size = F.least(F.length(left), F.length(right))
    pairs = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: F.when(a != b, 1).otherwise(0))
    first = F.array_position(F.slice(pairs, F.lit(1), size), 1)
    return F.when((size == 0), 0).when(first > 0, first - 1).otherwise(size).cast("int")


def partial_stability(partials: DataFrame, key: str = "session_id", order: str = "arrival") -> DataFrame:
    """``stable``: how many characters of the hypothesis before stay visible."""
    seen = ordered_scan(partials, [key], order, {"_before": Last(F.col("text"))})
    before = F.coalesce("_before", F.lit(""))
    return seen.withColumn("stable", common_prefix(before, F.col("text"))).drop("_before")


# --- sampled activity ------------------------------------------------------------------


def sustained_onsets(
    blocks: DataFrame, key: str, order: str, *, above: str = "above", duration: str = "dur_ms",
    required: float = ONSET_POLICY["normal"][1], rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``above_ms`` since the last quiet block and ``onset`` where it crosses ``required``."""
    loud = F.col(above) & (F.col(duration) > 0)
    spent = F.when(loud, F.col(duration)).otherwise(0)
    summed = pinned(ordered_scan(blocks, [key], order, {"_sum": Sum(spent)}, rows))
    # the running sum only grows, so its value at the last quiet block is a running maximum
    based = ordered_scan(
        summed, [key], order, {"_base": Max(F.when(~loud, F.col("_sum")), inclusive=True)}, rows
    )
    held = F.col("_sum") - F.coalesce("_base", F.lit(0))
    before = held - spent
    return based.withColumn("above_ms", held).withColumn(
        "onset", loud & (before < required) & (held >= required)
    ).drop("_sum", "_base")


def activity_segments(
    events: DataFrame, key: str, order: str, time: str, gap: int, cap: int | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``segment`` per key: a silence longer than ``gap`` ends a segment; with ``cap`` the
    first event at or after ``cap`` past the segment start opens the next one.

    The cap is a chain of jumps through the events. Each event knows where a segment that
    starts there would end; starting from the first events of the gap segments, reached
    events are found by doubling the jump length, a join per round.
    """
    seen = ordered_scan(events, [key], order, {"_prev": Last(F.col(time))}, rows)
    quiet = F.coalesce(F.col(time) - F.col("_prev") > gap, F.lit(True))
    flagged = pinned(seen.withColumn("_head", quiet.cast("bigint")).drop("_prev"))
    if cap is not None:
        flagged = _capped_heads(flagged, key, order, time, cap, rows)
    return ordered_scan(flagged, [key], order, {"segment": Sum(F.col("_head"))}, rows).drop("_head")


def _capped_heads(flagged: DataFrame, key: str, order: str, time: str, cap: int, rows: int) -> DataFrame:
    placed = pinned(
        ordered_scan(flagged, [key], order, {"_run": Sum(F.col("_head"))}, rows)
    )
    # where a segment starting at each event ends: merge the events with their end times
    # and look up the next event of the same run
    marks = placed.select(
        key, "_run",
        F.inline(F.array(
            F.struct(F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.col(order).alias("_from")),
            F.struct((F.col(time) + cap).alias("_t"), F.lit(0).alias("_kind"), F.col(order).alias("_from")),
        )),
    )
    lined = ranked(marks, [key, "_run"], [F.asc("_t"), F.asc("_kind"), F.asc("_from")], "_line")
    jumps = ordered_scan(
        lined, [key, "_run"], "_line",
        {"_to": Next(F.when(F.col("_kind") == 1, F.col("_from")))}, rows,
    ).where("_kind = 0 AND _to IS NOT NULL").select(key, "_from", "_to")
    jumps = pinned(jumps)
    reached = pinned(placed.where("_head = 1").select(key, F.col(order).alias("_from")))
    while not jumps.isEmpty():
        ahead = reached.join(jumps, [key, "_from"]).select(key, F.col("_to").alias("_from"))
        grown = pinned(reached.unionByName(ahead).distinct())
        # jumps of twice the length
        onward = jumps.select(key, F.col("_from").alias("_to"), F.col("_to").alias("_end"))
        jumps = pinned(
            jumps.join(onward, [key, "_to"]).select(key, "_from", F.col("_end").alias("_to"))
        )
        reached = grown
    heads = reached.select(key, F.col("_from").alias(order), F.lit(1).cast("bigint").alias("_mark"))
    return pinned(
        placed.join(heads, [key, order], "left")
        .withColumn("_head", F.coalesce("_mark", F.lit(0).cast("bigint")))
        .drop("_mark", "_run")
    )


def segment_table(segmented: DataFrame, key: str, time: str) -> DataFrame:
    return segmented.groupBy(key, "segment").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("blocks")
    )


def lookback_before(onsets: DataFrame, blocks: DataFrame, key: str, window: int, *, time: str = "t_us", length: str = "len_us") -> DataFrame:
    """Blocks that reach into the ``window`` before an onset, the oldest clipped.

    ``blocks`` end at ``time`` and last ``length``; pairs meet in time buckets of one
    window, so an onset sees only the two buckets its window touches.
    """
    bucket = F.floor(F.col(time) / window)
    left = onsets.select(key, F.col(time).alias("onset_us"), F.explode(F.array(bucket - 1, bucket)).alias("_b"))
    right = blocks.where(F.col(length) > 0).select(
        key, (F.col(time) - F.col(length)).alias("_start"), F.col(time).alias("end_us"), bucket.alias("_b")
    )
    low = F.col("onset_us") - window
    return left.join(right, [key, "_b"]).where(
        (F.col("end_us") <= F.col("onset_us")) & (F.col("end_us") > low)
    ).select(key, "onset_us", F.greatest("_start", low).alias("start_us"), "end_us")


def resample_linear(series: DataFrame, key: str, order: str, time: str, value: str, step: int, tail: int = 1, rows: int = CHUNK_ROWS) -> DataFrame:
    """Series on the grid ``first + n * step``: linear between neighbours; the last sample
    holds for ``tail``. Each segment between two samples makes its own grid points, so
    block borders leave no trace."""
    nexts = ordered_scan(
        series, [key], order,
        {
            "_n": Next(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))),
            "_back": Max(-F.col(time), inclusive=True),
        },
        rows,
    ).withColumn("_t0", -F.col("_back"))
    t0, t1 = F.col(time), F.coalesce(F.col("_n.t"), F.col(time) + tail)
    low = F.ceil((t0 - F.col("_t0")) / step)
    high = F.ceil((t1 - F.col("_t0")) / step) - 1
    points = nexts.where(high >= low).select(
        "*", F.explode(F.sequence(low, high)).alias("n")
    ).withColumn("grid", F.col("_t0") + F.col("n") * step)
    share = (F.col("grid") - t0) / (t1 - t0)
    shown = F.when(F.col("_n").isNull(), F.col(value)).otherwise(
        F.col(value) * (1 - share) + F.col("_n.v") * share
    )
    return points.select(key, "grid", shown.alias("value"))


# --- confirmations ---------------------------------------------------------------------


def confirm_barge_in(onsets: DataFrame, partials: DataFrame, keys: list[str]) -> DataFrame:
    """Tentative onsets and the first spoken partial of the same utterance after them."""
    spoken = partials.where(has_speech("text")).select(*keys, F.col("t_us").alias("_spoken"))
    pairs = onsets.join(spoken, keys, "left").withColumn(
        "_ok", F.when(F.col("_spoken") >= F.col("t_us"), F.col("_spoken"))
    )
    return pairs.groupBy(*keys, "t_us").agg(F.min("_ok").alias("confirmed_us")).withColumn(
        "confirmed", F.col("confirmed_us").isNotNull()
    )


def attempt_outcomes(
    starts: DataFrame, deltas: DataFrame, keys: list[str], timeout: int = FIRST_OUTPUT_US,
    attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Outcome per attempt: completed, first_token_timeout or empty_stream; ``retried`` when
    another attempt is allowed. ``starts``: keys, attempt, start_us, end_us; ``deltas``:
    keys, attempt, t_us, text."""
    full = [*keys, "attempt"]
    first = deltas.where("text <> ''").groupBy(*full).agg(F.min("t_us").alias("_first"))
    joined = starts.join(first, full, "left")
    answered = F.coalesce(F.col("_first") - F.col("start_us") <= timeout, F.lit(False))
    ended = F.coalesce(F.col("end_us") - F.col("start_us") <= timeout, F.lit(False))
    outcome = F.when(answered, "completed").when(F.col("_first").isNull() & ended, "empty_stream").otherwise(
        "first_token_timeout"
    )
    return joined.withColumn("outcome", outcome).withColumn(
        "retried", (F.col("outcome") != "completed") & (F.col("attempt") < min(max(attempts, 1), 2))
    ).drop("_first")
