"""Substring duplicates by content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import BYTE_VALUES, blocks
from .spans import Report, identified, place, position
from .store import Scratch

#: A chunk ends where the upper bits of the rolling hash are zero, but isn't shorter or longer than this unless the text ends.
SHORTEST, LONGEST = 32, 1024
CUT_BITS = 6
_GEAR = (BYTE_VALUES >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes up to it: the sum of the gears of byte i back, shifted left by i."""
    h = _GEAR[data]
    for n in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h = longer
    return h


def chunk_ends(candidates: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of a text from start to end, given all places where the hash allows one."""
    out, last = [], start
    for c in candidates:
        while c - last > LONGEST:
            last += LONGEST
            out.append(last)
        if c - last >= SHORTEST:
            last = c
            out.append(c)
    while end - last > LONGEST:
        last += LONGEST
        out.append(last)
    if end > last:
        out.append(end)
    return out


def chunked(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, ends of its chunks) for every row."""
    for lo, _, data, offsets in blocks(column):
        cuts = np.flatnonzero(gear_hash(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
        bounds = np.searchsorted(cuts, offsets, "right")
        for i in range(len(offsets) - 1):
            start, end = int(offsets[i]), int(offsets[i + 1])
            # the first SHORTEST bytes hold no end, so a hash that reaches into the text before is never used
            ends = chunk_ends(cuts[bounds[i] : bounds[i + 1]].tolist(), start, end)
            yield lo + i, data[start:end], np.array(ends, np.int64) - start


def chunk_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Drop every chunk whose digest an earlier chunk has: smaller id, or same document and earlier place.

    Columns: the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of what
    is left, and with ``with_kept`` those bytes. A null or empty text has no chunks. Rows with
    one id and one text are one document and are reported alike; different texts of one id are
    ordered by a hash. Rows with a null id are reported whole and remove nothing elsewhere. An
    empty table gives an empty one; other columns are left out.

    Spark groups the digests, with partial sums before the shuffle, and sends each first
    place back to its document: chunks that aren't named there are repeats, so no group of
    equal chunks is ever gathered.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = identified(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            version = batch.column(1).to_numpy()
            digests, rows, at = [], [], []

            def out() -> pa.RecordBatch:
                index = np.array(rows, np.int64)
                found = place(version[index], np.array(at, np.int64))
                return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(pa.array(index)), pa.array(found)], names=["digest", "id", "at"])

            for row, data, ends in chunked(batch.column(2)):
                raw, last = data.tobytes(), 0
                for end in ends.tolist():
                    digests.append(hashlib.blake2b(raw[last:end], digest_size=16).digest())
                    rows.append(row)
                    at.append(last)
                    last = end
                if len(digests) > 50_000:
                    yield out()
                    digests, rows, at = [], [], []
            yield out()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, found = batch.slice(lo, 200), Report(with_kept)
                ids, first = part.column(0), part.column(2)
                for row, data, ends in chunked(part.column(1)):
                    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
                    named = first[row].values.to_numpy() if first[row].is_valid else np.zeros(0, np.int64)
                    again = ~np.isin(starts, position(named)) & ids[row].is_valid
                    found.add(data, np.repeat(again, ends - starts) if len(ends) else np.zeros(0, bool))
                yield found.batch(ids)

    chunks = read.where("id IS NOT NULL").mapInArrow(emit, f"digest binary, id {kind}, at long")
    first = chunks.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("first")).select("first.*")
    named = first.groupBy("id", F.shiftright("at", 32).alias("version")).agg(F.collect_list("at").alias("named"))
    named = scratch.write(named)
    joined = read.join(named, ["id", "version"], "left").select("id", "text", "named")
    return joined.mapInArrow(report, f"id {kind}, {Report.SCHEMA}" + ", kept binary" * with_kept).withColumnRenamed("id", id_col)
