"""Exact repeated substrings: suffix arrays of the places where a repeat can be, and their longest previous factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import BYTE_VALUES, blocks, mixed, prefix_hash, row_of, run_starts, span_hash
from .spans import identified, place, position, without_spans
from .store import Scratch

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: A string's anchor is the least of its hashed grams; equal strings have equal anchors at equal places.
GRAM = 28
GRAMS = LENGTH - GRAM + 1
#: More contexts of one anchor than this are compared string by string in a grouping instead of in one suffix array.
BUCKET = 4096
#: Contexts that are sorted at a time.
SORTED_AT_ONCE = 40_000
_PLACE_BITS = np.uint64(26)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first string, last string, gram hash, context hash) of all anchors.

    A string is named by its first byte. The strings whose anchor is one place follow one
    another; the bytes from the first of them to the end of the last are the anchor's context.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(BYTE_VALUES[data])
    at = np.arange(len(data) - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    # of equal grams the leftmost is least, in every text alike
    least = (gram >> _PLACE_BITS << _PLACE_BITS) | (at.astype(np.uint64) & np.uint64((1 << 26) - 1))
    width = 1
    while width * 2 <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < GRAMS:
        rest = GRAMS - width
        least = np.minimum(least[:-rest], least[rest:])
    inside = np.zeros(len(data) + 1, np.int64)
    length = np.diff(offsets)
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, offsets[:-1] + np.maximum(0, length - LENGTH + 1), -1)
    string = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    low = (least[string] & np.uint64((1 << 26) - 1)).astype(np.int64)
    # a place is known up to 2**26, and is less than LENGTH after its string
    anchor = string + ((low - string) & ((1 << 26) - 1))
    change = np.ones(len(string), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1] + 1)
    begin = np.flatnonzero(change)
    first, last = string[begin], string[np.append(begin[1:], len(string)) - 1] if len(begin) else none
    spot = anchor[begin]
    context = mixed(span_hash(prefix, first, last + LENGTH) ^ mixed((spot - first).astype(np.uint64)))
    return spot, first, last, gram[spot], context


def longest_previous_factor(when: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """For suffixes in suffix order the longest prefix that an earlier suffix shares, 0 if it is under ``least``.

    ``when`` says which suffix is earlier (smaller; equal ones are none), ``lcp[i]`` how long a prefix suffix i
    shares with suffix i - 1. The longest is shared with the nearest earlier suffix before or
    the nearest earlier one after in suffix order; both are found for all suffixes at once by
    following the answers of the suffixes passed over.
    """

    def nearest(when: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        to, shared = np.arange(len(when)) - 1, np.where(lcp >= least, lcp, 0)
        shared[:1] = 0
        while True:
            open_ = np.flatnonzero(shared > 0)
            open_ = open_[when[to[open_]] >= when[open_]]
            if not len(open_):
                return shared
            over = to[open_]
            new_shared, new_to = np.minimum(shared[open_], shared[over]), to[over]
            shared[open_], to[open_] = new_shared, new_to

    before = nearest(when, lcp)
    after = nearest(when[::-1], np.concatenate(([0], lcp[:0:-1])))[::-1]
    return np.maximum(before, after)


def repeated_strings(bucket: np.ndarray, when: np.ndarray, offset: np.ndarray, count: np.ndarray, context: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, string in it) of all strings that an earlier context of the bucket has too.

    ``offset`` is the anchor's place in the context and ``count`` the number of strings in
    it; ``when`` orders contexts of different places. Strings can only be equal at equal
    distance before their anchors. The suffix order at distance d follows from that at d - 1
    by a stable sort on the one byte in front.
    """
    reach = GRAMS - 1
    table = np.zeros((len(context), reach + LENGTH), np.uint8)
    for i, (raw, o) in enumerate(zip(context, offset.tolist(), strict=True)):
        table[i, reach - o : reach - o + len(raw)] = np.frombuffer(raw, np.uint8)
    tail = np.ascontiguousarray(table[:, reach:]).view(f"S{LENGTH}").reshape(-1)
    order = np.lexsort((tail, bucket))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(reach + 1):
        if d:
            order = order[offset[order] >= d]
            order = order[np.argsort(bucket[order] * 256 + table[order, reach - d], kind="stable")]
        string = offset[order] - d
        here = order[string < count[order]]
        if len(here) < 2:
            continue
        window = table[here, reach - d : reach - d + LENGTH]
        same = window[1:] == window[:-1]
        lcp = np.zeros(len(here), np.int64)
        lcp[1:] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1)) * (bucket[here[1:]] == bucket[here[:-1]])
        again = here[longest_previous_factor(when[here], lcp, LENGTH) >= LENGTH]
        found.append((again, offset[again] - d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, string = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((string, which))
    return which[order], string[order]


def _span_batch(ids: pa.Array, start: np.ndarray, end: np.ndarray, version: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(version, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["id", "version", "start", "end"])


def _anchor_rows(kind: str, docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            version = batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                spot, first, _, gram, context = anchors(data, offsets)
                row = row_of(offsets, spot)
                at = place(version[lo + row], first - offsets[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(pa.array(lo + row)), pa.array(at)],
                    names=["gram", "context", "id", "at"],
                )

    return docs.mapInArrow(run, f"gram long, context long, id {kind}, at long")


def _open_contexts(kind: str, docs: DataFrame) -> DataFrame:
    """Documents with their marks (2 * place + whether other contexts share the anchor) to spans and contexts.

    An anchor without a mark isn't the first with its context, so all its strings are repeats:
    a span (context null, offset its end). A marked one whose anchor occurs in other contexts
    may hold repeats: its context is sent on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            version = batch.column(1).to_numpy()
            marks = batch.column(3)
            for lo, hi, data, offsets in blocks(batch.column(2)):
                spot, first, last, gram, _ = anchors(data, offsets)
                row = row_of(offsets, spot)
                own = [marks[i].values.to_numpy() if marks[i].is_valid else np.zeros(0, np.int64) for i in range(lo, hi)]
                # places in the block, so that one search serves all rows
                place_in = np.concatenate([position(m >> 1) + o for m, o in zip(own, offsets, strict=False)]).astype(np.int64)
                shared = np.concatenate([m & 1 for m in own]).astype(bool)
                order = np.argsort(place_in)
                place_in, shared = place_in[order], shared[order]
                index = np.minimum(np.searchsorted(place_in, first), max(0, len(place_in) - 1))
                marked = place_in[index] == first if len(place_in) else np.zeros(len(first), bool)
                again, open_ = np.flatnonzero(~marked), np.flatnonzero(marked & (shared[index] if len(place_in) else False))
                # spans of neighbouring repeats are one
                if len(again):
                    fresh = np.ones(len(again), bool)
                    fresh[1:] = (row[again[1:]] != row[again[:-1]]) | (first[again[1:]] > last[again[:-1]] + LENGTH)
                    begin = np.flatnonzero(fresh)
                    start, end = first[again[begin]], last[again[np.append(begin[1:], len(again)) - 1]] + LENGTH
                    span_row = row[again[begin]]
                else:
                    start = end = span_row = np.zeros(0, np.int64)
                rows = np.concatenate((span_row, row[open_]))
                begins = np.concatenate((start, first[open_]))
                context = [None] * len(start) + [data[f : t + LENGTH].tobytes() for f, t in zip(first[open_], last[open_], strict=True)]
                offset = np.concatenate((end - offsets[span_row], (spot - first)[open_]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(lo + rows)), pa.array(place(version[lo + rows], begins - offsets[rows])),
                    pa.array(np.concatenate((np.zeros(len(start), np.int64), gram[open_].view(np.int64)))), pa.array(offset, pa.int64()), pa.array(context, pa.binary()),
                ], names=["id", "at", "gram", "offset", "context"])

    return docs.mapInArrow(run, f"id {kind}, at long, gram long, offset long, context binary")


def _sorted_spans(kind: str, contexts: DataFrame) -> DataFrame:
    """Contexts in order of their anchors to spans, by suffix arrays of so many whole buckets at a time."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        gram, at, offset = (table[c].to_numpy() for c in ("gram", "at", "offset"))
        context = table["context"].to_pylist()
        count = np.array([len(c) for c in context], np.int64) - LENGTH + 1
        bucket = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1]))) if len(gram) else gram
        # the anchor's place orders what lies at equal distance before it
        keys = pa.table({"id": table["id"].combine_chunks(), "spot": pa.array(at + offset)})
        order = pc.sort_indices(keys, [("id", "ascending"), ("spot", "ascending")]).to_numpy()
        # rows that repeat a document give the same place, and neither is earlier
        id_, spot = keys["id"].take(pa.array(order)).combine_chunks(), (at + offset)[order]
        moved = np.ones(len(order), np.int64)
        moved[1:] = (spot[1:] != spot[:-1]) | pc.not_equal(id_.slice(1), id_.slice(0, len(id_) - 1)).to_numpy(zero_copy_only=False)
        when = np.empty(len(order), np.int64)
        when[order] = np.cumsum(moved)
        which, string = repeated_strings(bucket, when, offset, count, context)
        begin = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (string[1:] != string[:-1] + 1)))) if len(which) else np.zeros(0, np.int64)
        end = string[np.append(begin[1:], len(which)) - 1] + LENGTH if len(which) else begin
        which, string = which[begin], string[begin]
        return _span_batch(table["id"].combine_chunks().take(pa.array(which)), position(at[which]) + string, position(at[which]) + end, at[which] >> 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= SORTED_AT_ONCE:
                gram = held["gram"].to_numpy()
                cut = int(run_starts(gram)[-1])
                if cut:
                    yield solve(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return contexts.mapInArrow(run, f"id {kind}, version long, start long, end long")


def _window_rows(kind: str, contexts: DataFrame) -> DataFrame:
    """Every string of the contexts with 128 bits of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in blocks(batch.column(2), 1 << 18):
                count = np.diff(offsets) - LENGTH + 1
                row = np.repeat(np.arange(len(count)), count)
                string = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = offsets[row] + string
                hashes = [span_hash(prefix_hash(values[data]), start, start + LENGTH) for values in (BYTE_VALUES, mixed(BYTE_VALUES))]
                at = batch.column(1).to_numpy()[lo + row] + string
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), pa.array(at), *(pa.array(h.view(np.int64)) for h in hashes)], names=["id", "at", "h1", "h2"])

    return contexts.select("id", "at", "context").mapInArrow(run, f"id {kind}, at long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, version, text) to the spans (id, version, start, end) covered by strings that also start earlier."""
    kind = docs.schema["id"].dataType.simpleString()
    found = _anchor_rows(kind, docs.where("id IS NOT NULL"))
    first = scratch.write(found.groupBy("gram", "context").agg(F.min(F.struct("id", "at")).alias("first")).select("gram", "first.*"))
    several = first.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1")
    marked = scratch.write(
        first.join(several, "gram", "left").select("id", (F.col("at") * 2 + F.when(F.col("contexts").isNotNull(), 1).otherwise(0)).alias("mark"))
    )
    scratch.drop(first)
    marks = marked.groupBy("id", F.shiftright("mark", 33).alias("version")).agg(F.collect_list("mark").alias("marks"))
    joined = docs.where("id IS NOT NULL").join(marks, ["id", "version"], "left").select("id", "version", "text", "marks")
    opened = scratch.write(_open_contexts(kind, joined))
    scratch.drop(marked)
    contexts = opened.where("context IS NOT NULL")
    crowded = contexts.groupBy("gram").agg(F.count("*").alias("n")).where(f"n > {BUCKET}").select("gram")
    crowded = scratch.write(crowded)
    few = contexts.join(crowded, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    by_order = _sorted_spans(kind, few)
    # an anchor with very many contexts: its strings are grouped, with partial minima before the shuffle
    windows = scratch.write(_window_rows(kind, contexts.join(crowded, "gram", "left_semi")))
    earliest = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(earliest, ["h1", "h2"]).where(F.struct("id", "at") != F.col("first"))
    version, start = F.shiftright("at", 32).alias("version"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    by_group = again.select("id", version, start.alias("start"), (start + LENGTH).alias("end"))
    whole = opened.where("context IS NULL").select("id", version, start.alias("start"), F.col("offset").alias("end"))
    return scratch.write(whole.union(by_order).union(by_group))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Remove every byte covered by a LENGTH-byte string that also starts earlier: in a smaller id, or before in its document.

    Strings lie within one document, may overlap, and are judged on the input. Columns: the
    id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of what is left, and
    with ``with_kept`` those bytes. A null text is empty. Rows with one id and one text are one
    document and are reported alike; different texts of one id are ordered by a hash. Rows
    with a null id are reported whole and remove nothing elsewhere. An empty table gives an
    empty one; other columns are left out.

    Two equal strings have equal anchors, so contexts are first grouped by (anchor, context):
    all strings of a context that isn't the first of its kind are repeats. What is left to
    decide are first contexts whose anchor occurs in other contexts too. Their strings are
    put in suffix order by anchor, and longest previous factors of LENGTH or more are repeats.
    """
    read = identified(docs, id_col, text_col)
    spans = repeated_spans(read, Scratch(docs.sparkSession))
    return without_spans(read, spans, with_kept).withColumnRenamed("id", id_col)
