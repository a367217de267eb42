"""Streaming jobs over event logs and the helpers that run them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import has_speech
from ..session import ensure_checkpoint_dir, pinned
from . import processors as p

#: Rows of a replayed file, and how long a silent key's state is kept, in micros.
FILE_ROWS = 1 << 17
IDLE_US = 60 * 24 * 3600 * 1_000_000
#: Sessions, turns and requests are dealt by hash to so many keys of state, as each key that a trigger touches costs calls of its own.
SLOTS = 1 << 10
#: Rows that are packed at a time on their way to the slots.
PACK_ROWS = 1 << 17
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state outside the heap; the stateful processors need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stage_log(log: DataFrame, order: str, slices: int = 3, file_rows: int = FILE_ROWS) -> tuple[str, int]:
    """Write a log in arrival order for replay: (folder, files of a slice).

    Slices hold about equally many rows, in files of about ``file_rows`` that many tasks write.
    Every slice has the same number of files, so a trigger of so many takes one slice.
    """
    path = f"{ensure_checkpoint_dir(log.sparkSession)}/log-{uuid.uuid4().hex}"
    log = pinned(log)
    cuts = log.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts)) if slices > 1 else []
    bounds = [None, *cuts, None]
    place = sum(((F.col(order) > c).cast("int") for c in cuts), F.lit(0))
    sizes = [r["count"] for r in log.groupBy(place.alias("slice")).count().collect()]
    files = max(1, min(sizes, default=0) // file_rows)
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = log
        if low is not None:
            part = part.where(F.col(order) > low)
        if high is not None:
            part = part.where(F.col(order) <= high)
        # dealt in turn, so no file stays empty
        part.repartition(files).write.mode("append").parquet(path)
    return path, files


def open_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", "*.parquet").parquet(path)
    )


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there now into a parquet table and read it back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = start(stream, f"{base}/table", f"{base}/state")
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/table/b={number}")

        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def start(stream: DataFrame, table: str, state: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", table)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def _stateful(events: DataFrame, keys: list[str], processor, out: str, time_mode: str = "None", mode: str = "Append") -> DataFrame:
    use_rocksdb(events.sparkSession)
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode=mode, timeMode=time_mode
    )


def _ending(events: DataFrame, keys: list[str], make, out: str, idle: int | None, delay: str, mode: str = "Append") -> DataFrame:
    """With ``idle`` events carry ts and t_us, and a key's state ends so long after its last one."""
    if idle is None:
        return _stateful(events, keys, make(None), out, mode=mode)
    return _stateful(events.withWatermark("ts", delay), keys, make(idle), out, "EventTime", mode)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slot that holds its rows' columns as lists, in their order, their number and the latest ``ts``."""
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        slots = rows["n_slot"].to_numpy()
        order = np.argsort(slots, kind="stable")
        rows, slots = rows.take(pa.array(order)).combine_chunks(), slots[order]
        first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        ends = np.r_[first, len(slots)]
        columns = {"n_slot": pa.array(slots[first]), "n_rows": pa.array(np.diff(ends).astype(np.int64))}
        for name in rows.column_names:
            column = pa.concat_arrays(rows[name].chunks)
            if name == "ts":
                # a null counts as the earliest time
                latest = np.maximum.reduceat(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), first)
                columns[name] = pa.array(latest).cast(column.type)
            elif name != "n_slot":
                columns[name] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), column)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield packed(held)
            held = []
    if held:
        yield packed(held)


def _sharing(events: DataFrame, keys: list[str], make, out: str, delay: str | None) -> DataFrame:
    """Columns of ``keys`` and ``out`` from a processor that holds many keys in a slot. ``make`` takes
    the names of the keys, which it sees as texts. Without ``delay`` nothing is timed.

    Rows reach a slot in packs, as each row that is handed over costs more than what is done with it.
    Of rows that come later than ``delay`` those are dropped whose whole pack does."""
    kinds = {f.name: f.dataType for f in events.schema}
    rest = [c for c in events.columns if c not in keys and c != "ts"]
    texts = [F.col(k).cast("string").alias(k) for k in keys]
    timed = [] if delay is None else ["ts"]
    dealt = events.select(F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).alias("n_slot"), *timed, *texts, *rest)
    lists = [f"{f.name} {'timestamp' if f.name == 'ts' else f'array<{f.dataType.simpleString()}>'}" for f in dealt.schema if f.name != "n_slot"]
    packs = dealt.mapInArrow(_pack, ", ".join(["n_slot bigint, n_rows bigint", *lists]))
    if delay is not None:
        packs = packs.withWatermark("ts", delay)
    schema = ", ".join(f"{k} string" for k in keys) + f", {out}"
    found = _stateful(packs, ["n_slot"], make(keys), schema, "None" if delay is None else "EventTime")
    return found.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], *[c for c in found.columns if c not in keys])


def session_stream(events: DataFrame, ttl: int, delay: str = "1 hour", idle: int | None = IDLE_US) -> DataFrame:
    """``events``: session_id, pos, t_us, ts, type, turn_no. A session is known by ``opened``, the event it began with."""
    return _sharing(events, ["session_id"], lambda names: p.SessionStore(names, ttl, idle=idle), p.SESSION_OUT, delay)


def revision_stream(partials: DataFrame, idle: int | None = None, delay: str = "1 hour") -> DataFrame:
    return _ending(partials, ["session_id"], p.RevisionFilter, p.REVISION_OUT, idle, delay)


def commit_stream(events: DataFrame, idle: int | None = None, delay: str = "1 hour") -> DataFrame:
    """``events``: session_id, utterance_id, kind, kind_order, t_us, text."""
    return _sharing(events, ["session_id"], lambda names: p.BatchCommit(names, idle), p.COMMIT_OUT, None if idle is None else delay)


def transcript_stream(pieces: DataFrame, idle: int | None = None, delay: str = "1 hour") -> DataFrame:
    return _ending(pieces, ["stream"], p.Transcript, p.TRANSCRIPT_OUT, idle, delay, "Update")


def answers_stream(events: DataFrame, idle: int | None = None, delay: str = "1 hour") -> DataFrame:
    """``events``: session_id, turn_no, pos, type, delta."""
    return _sharing(events, ["session_id", "turn_no"], lambda names: p.AnswerAssembly(names, idle), p.ANSWER_OUT, None if idle is None else delay)


def capped_segment_stream(events: DataFrame, gap: int, cap: int, delay: str | None = None) -> DataFrame:
    """``events``: session_id, pos, t_us, and with ``delay`` ts. Without it the last segment of
    a session stays open; with it every segment comes out once the watermark has passed it."""
    return _sharing(events, ["session_id"], lambda names: p.CappedSegments(names, gap, cap, timed=delay is not None), p.SEGMENT_OUT, delay)


def segment_stream(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Session windows: (session_id, start, end, blocks), emitted once the watermark has
    passed the window. ``end`` is the last event."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("session_id", F.session_window("ts", gap))
        .agg(F.min("t_us").alias("start"), F.max("t_us").alias("end"), F.count(F.lit(1)).alias("blocks"))
        .select("session_id", "start", "end", "blocks")
    )


def dedup_stream(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def barge_in_stream(onsets: DataFrame, partials: DataFrame, keys: list[str], within: str, delay: str) -> DataFrame:
    """Onsets joined with spoken partials of the same utterance that follow in time.
    ``onsets``: keys, onset_ts; ``partials``: keys, partial_ts, text."""
    left = onsets.withWatermark("onset_ts", delay).alias("o")
    right = partials.where(has_speech("text")).withWatermark("partial_ts", delay).alias("p")
    same = F.expr(
        " AND ".join([
            *[f"o.{k} = p.{k}" for k in keys],
            "p.partial_ts >= o.onset_ts", f"p.partial_ts <= o.onset_ts + INTERVAL {within}",
        ])
    )
    return left.join(right, same).select(*[F.col(f"o.{k}") for k in keys], "onset_ts", "partial_ts")


def attempt_stream(events: DataFrame, keys: list[str], timeout: int, delay: str, attempts: int = 2) -> DataFrame:
    """(keys, attempt, start_us, outcome, retried) of every attempt, once it is settled.
    ``events``: keys, attempt, kind (start, delta, end), kind_order, t_us, ts, text."""
    out = "attempt int, start_us bigint, outcome string, retried boolean"
    return _sharing(events, keys, lambda names: p.Attempts(names, timeout, attempts), out, delay)
