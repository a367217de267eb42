"""Near duplicates: MinHash bands find candidates, full shingle sets confirm them, alternating stars connect them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import binary_rows, blocks, mixed, run_starts
from .store import Scratch
from .words import windows, words_of

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Minima of a band. A pair at the threshold shares no band with a probability of at most UNMET: 20 bands at 0.85, 28 at 0.80.
ROWS, UNMET = 4, 5e-7
#: Minima of a signature, of each of which 4 bits are kept, in 16 64-bit integers.
MINIMA, SIGNS = 256, 16
#: A pair at the threshold agrees in fewer minima than a candidate needs with a probability of at most this: 192 of 256 at 0.85, 177 at 0.80.
DISAGREEING = 1.2e-6
#: Up to so many members all pairs of a bucket are candidates, which is a bounded number for each row.
SMALL_BUCKET = 8

#: Bits, and bits of a page, of the bitmap that tells which texts are not wanted again.
MARKS, MARK_PAGE = 1 << 24, 1 << 15

_SIGN_COLUMNS = tuple(f"s{i}" for i in range(SIGNS))

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def bands_needed(percent: int) -> int:
    """Bands of ROWS minima that a pair at the threshold needs to meet."""
    if not 0 < percent <= 100:
        raise ValueError(f"a threshold of {percent} %")
    unmet = 1 - (percent / 100) ** ROWS
    bands = math.ceil(math.log(UNMET) / math.log(unmet)) if unmet else 1
    if bands * ROWS > MINIMA:
        raise ValueError(f"{MINIMA} minima are too few for a threshold of {percent} %")
    return bands


def least_agreeing(percent: int) -> int:
    """Agreeing minima, in their 4 bits, that a candidate needs; one in 16 agrees by chance."""
    agree = percent / 100 + (1 - percent / 100) / 16
    fewer = 0.0
    for k in range(MINIMA):
        fewer += math.comb(MINIMA, k) * agree**k * (1 - agree) ** (MINIMA - k)
        if fewer > DISAGREEING:
            return k
    return MINIMA


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of all rows, sorted within each row, and the number of each row."""
    words = words_of(data, offsets, lower=True)
    at, value = windows(words, SHINGLE_WORDS)
    row = words.row[at]
    short = (words.count > 0) & (words.count < SHINGLE_WORDS)
    for n in range(1, SHINGLE_WORDS):
        own = short & (words.count == n)
        if own.any():
            begin, whole = windows(words, n)
            mine = own[words.row[begin]]
            row, value = np.concatenate((row, words.row[begin][mine])), np.concatenate((value, whole[mine]))
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    if len(value):
        keep = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))
        row, value = row[keep], value[keep]
    return value, np.bincount(row, minlength=len(offsets) - 1)


def signatures(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Minima of multiply-shift hashes, a row of MINIMA for every set that isn't empty."""
    first = (np.cumsum(count) - count)[count > 0]
    out = np.zeros((len(first), MINIMA), np.uint32)
    if len(first):
        for k in range(MINIMA):
            out[:, k] = np.minimum.reduceat((value * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32), first)
    return out


def fingerprints(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """128 bits of every set, from sums of two mixes of its members."""
    first = (np.cumsum(count) - count)[count > 0]
    out = np.zeros((len(count), 2), np.uint64)
    if len(first):
        for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0xF7C2EBC08F67F2B5)):
            out[count > 0, k] = mixed(np.add.reduceat(mixed(value ^ np.uint64(salt)), first) + count[count > 0].astype(np.uint64))
    return out


def sign_texts(docs: DataFrame, n_bands: int) -> DataFrame:
    """(id, text) to (id, fp binary of 16, n long, bands binary, s0 to s15 long); bands is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                value, count = shingle_sets(data, offsets)
                minima = signatures(value, count)
                signs = np.zeros((hi - lo, SIGNS), np.uint64)
                nibble = (minima & np.uint32(15)).astype(np.uint64).reshape(-1, SIGNS, MINIMA // SIGNS)
                signs[count > 0] = np.bitwise_or.reduce(nibble << (4 * np.arange(MINIMA // SIGNS)).astype(np.uint64), axis=2)
                bands = iter(minima[:, : n_bands * ROWS])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    binary_rows(fingerprints(value, count).reshape(-1), np.full(hi - lo, 2)),
                    pa.array(count, pa.int64()),
                    pa.array([next(bands).tobytes() if n else None for n in count], pa.binary()),
                    *(pa.array(signs[:, i].view(np.int64)) for i in range(SIGNS)),
                ], names=["id", "fp", "n", "bands", *_SIGN_COLUMNS])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, fp binary, n long, bands binary, " + ", ".join(f"{c} long" for c in _SIGN_COLUMNS))


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, text) to (fp, shingles: the sorted set as 64-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(1)):
                value, count = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [binary_rows(fingerprints(value, count).reshape(-1), np.full(len(count), 2)), binary_rows(value, count)],
                    names=["fp", "shingles"],
                )

    return docs.mapInArrow(run, "fp binary, shingles binary")


def _agreeing() -> F.Column:
    """How many minima of two signatures s0_1, ... and s0_2, ... agree: 4-bit groups without a differing bit."""
    differing = F.lit(0)
    for c in _SIGN_COLUMNS:
        x = F.col(f"{c}_1").bitwiseXOR(F.col(f"{c}_2"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(MINIMA) - differing


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, xa, xb) whose full sets are similar enough, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, "a binary, b binary")


def _links(scratch: Scratch, candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that pass on the full sets."""
    whole = candidates.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    return scratch.write(_confirmed(whole, percent))


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Components of an edge list (a, b): (node, label), the label being the least node that can be reached.

    Large-star and small-star alternate until every edge leads to a node that leads nowhere,
    so that each component is a star around its least node. Each is a grouping
    for the least neighbour and a join back, so no task holds all neighbours of a node. An
    edge list without rows gives no nodes; loops and repeated edges are harmless.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        roots = now.select(F.col("v").alias("u")).distinct()
        if now.join(roots, "u", "left_semi").isEmpty():
            # a node of two edges would still be between two roots
            if now.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
                break
        # large star: every larger neighbour of a node is linked to the least node around
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(large, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


def _merged(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between labelled or other nodes: the components of the labels alone are made anew."""
    links = scratch.write(links)
    if links.isEmpty():
        return labels
    known = labels.toDF("node", "label")
    ends = links.join(known.toDF("a", "la"), "a", "left").join(known.toDF("b", "lb"), "b", "left")
    contracted = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = connected(scratch, contracted).toDF("label", "top")
    # a node without a label is its own, and may be a label of the contracted graph
    moved = known.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = over.join(known.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return moved.union(new)


def _marked(ids: DataFrame) -> DataFrame:
    """(page, marks): a bitmap of MARKS bits, at most MARKS / 32768 rows of 4 kB, with a bit for the hash of every id."""
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    return ids.select((place / MARK_PAGE).cast("int").alias("page"), (place % MARK_PAGE).alias("bit")).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("marks"))


def _perhaps(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose id has its bit in the bitmap: all that are wanted, and few others while the wanted ids are fewer than the bits."""
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    met = rows.withColumn("page", (place / MARK_PAGE).cast("int")).join(F.broadcast(marks), "page")
    byte = F.conv(F.hex(F.substring(F.col("marks"), (F.floor(place % MARK_PAGE / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.lit(1).bitwiseAND(F.call_function("shiftright", byte, (place % 8).cast("int"))) == 1).select(*rows.columns)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach), kept.

    Texts with equal shingle sets are one class, so a group of exact copies is one row from
    the first aggregation on. Classes that share a band meet in a bucket. A small bucket
    gives its pairs. In a larger one the member that shares most of its shingles with others
    is compared with the rest; what that leaves in different components is compared too,
    unless counts of shingles that occur once prove that the pair can't be linked.

    A text without words, or null, has an empty set and is linked with nothing. Rows with a
    null id are linked by their text but never name a component; a component of such rows
    alone has a null component_id. Rows that repeat an id each keep their own row. An empty
    table gives an empty one; other columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_bands = bands_needed(percent)
    signed = scratch.write(sign_texts(read, n_bands))
    nodes = scratch.write(
        signed.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in _SIGN_COLUMNS))
    )
    # the rows that find who meets whom carry nothing else
    width = 4 * ROWS
    keys = f"transform(sequence(0, {n_bands - 1}), i -> xxhash64(i, substring(bands, i * {width} + 1, {width})))"
    cut = f"posexplode({keys}) AS (band, bucket)"
    shared = nodes.selectExpr(cut).groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.write(nodes.selectExpr("fp", cut).join(shared, "bucket"))

    # what belongs to the classes that meet any other; their full sets are read from one document of each
    wanted = members.select("fp").distinct()
    signs = scratch.write(nodes.join(wanted, "fp", "left_semi").selectExpr("fp", "id", "n", *_SIGN_COLUMNS, f"{keys} AS keys"))
    named = signs.select("id").distinct()
    nameless = read.where("id IS NULL")
    # most texts are left where they are before the ids are compared; a semi join would be moved before the bitmap
    texts = _perhaps(read, scratch.write(_marked(named))).join(named, "id")
    sets = full_sets(texts.union(nameless)).join(signs.select("fp"), "fp", "left_semi")
    sets = scratch.write(sets.dropDuplicates(["fp"]))

    labels = _all_labels(scratch, members, signs, sets, percent)
    classes = nodes.select("fp", "id").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    classes = scratch.write(classes)
    least = classes.groupBy("label").agg(F.min("id").alias("component"))
    named = scratch.write(classes.join(least, "label").select("fp", "component"))
    scratch.drop(members, signs, sets, classes)
    own = signed.select("id", "fp", "n").join(named, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return own.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _all_labels(scratch: Scratch, members: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the classes that are linked with any other, after links enough to connect every class with all that it can reach."""

    def fits(a: str, b: str) -> F.Column:
        return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)

    alike = fits("n_1", "n_2") & (_agreeing() >= least_agreeing(percent))

    def sided(rows: DataFrame, side: int, *but: str) -> DataFrame:
        return rows.select(*but, *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in but))

    def pairs(left: DataFrame, right: DataFrame, *more: F.Column, last: F.Column | None = None) -> DataFrame:
        x, y = sided(left, 1, "bucket"), sided(right, 2, "bucket")
        condition = (x["bucket"] == y["bucket"]) & fits("n_1", "n_2")
        for c in more:
            condition &= c
        # the signatures are compared in the join, so its result has the pairs that pass alone
        condition &= _agreeing() >= least_agreeing(percent)
        if last is not None:
            condition &= last
        return x.join(y, condition).select(F.least("fp_1", "fp_2").alias("a"), F.greatest("fp_1", "fp_2").alias("b")).distinct()

    compared = signs.select("fp", "n", *_SIGN_COLUMNS)
    # pairs of a small bucket are few; each is made once before its signatures are fetched
    few = members.where(f"size <= {SMALL_BUCKET}").select("bucket", "fp")
    met = sided(few, 1, "bucket").join(sided(few, 2, "bucket"), "bucket").where("fp_1 < fp_2").select("fp_1", "fp_2").distinct()
    small = met.join(sided(compared, 1), "fp_1").join(sided(compared, 2), "fp_2").where(alike).select(F.col("fp_1").alias("a"), F.col("fp_2").alias("b"))
    many = scratch.write(members.where(f"size > {SMALL_BUCKET}").select("bucket", "band", "fp"))
    if many.isEmpty():
        return connected(scratch, _links(scratch, scratch.write(small), sets, percent))
    large = many.join(signs.select("fp", "n", "keys", *_SIGN_COLUMNS), "fp")

    # how many shingles of a class no other class of the large buckets has
    crowded = sets.join(large.select("fp").distinct(), "fp", "left_semi")
    tokens = crowded.select(F.xxhash64("fp").alias("node"), "shingles").mapInArrow(_shingle_rows, "node long, shingle long")
    lonely = tokens.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    # two classes may share the 64 bits; their counts are then no bound, so none is used
    sole = crowded.select("fp", F.xxhash64("fp").alias("node"))
    twice = sole.groupBy("node").agg(F.count("*").alias("times"))
    own = sole.join(twice, "node").join(lonely, "node", "left").select(
        "fp", F.when(F.col("times") == 1, F.coalesce("own", F.lit(0))).otherwise(0).alias("own")
    )
    # at most n - own shingles are in any other class: below the threshold nothing can link it
    large = scratch.write(large.join(own, "fp").withColumn("common", F.col("n") - F.col("own")).where(F.col("common") * 100 >= F.col("n") * percent).drop("own"))

    centre = large.groupBy("bucket").agg(F.min_by("fp", F.struct(-F.col("common") / F.col("n"), "fp")).alias("fp"))
    centre = large.join(centre, ["bucket", "fp"], "left_semi").drop("common", "band", "keys")
    stars = pairs(centre, large.drop("common", "band", "keys"), F.col("fp_1") != F.col("fp_2"))
    tried = scratch.write(small.union(stars).distinct())
    first = _links(scratch, tried, sets, percent)

    labels = scratch.write(connected(scratch, first))
    grouped = large.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    grouped = scratch.write(grouped)
    open_buckets = grouped.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    rest = scratch.write(grouped.join(open_buckets, "bucket", "left_semi"))
    if rest.isEmpty():
        return labels
    most = F.least("common_1", "common_2")
    # a pair that meets in several buckets is made in the first of them
    again = F.exists(F.slice(F.zip_with("keys_1", "keys_2", lambda x, y: x == y), 1, F.col("band_1")), lambda x: x)
    possible = most * 100 >= (F.col("n_1") + F.col("n_2") - most) * percent
    rest = pairs(rest, rest, F.col("fp_1") < F.col("fp_2"), F.col("label_1") != F.col("label_2"), possible, last=~again)
    second = _links(scratch, rest.join(tried, ["a", "b"], "left_anti"), sets, percent)
    return _merged(scratch, labels, second)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            members = [np.frombuffer(v.as_py(), np.int64) for v in part.column(1)]
            node = np.repeat(part.column(0).to_numpy(), [len(m) for m in members])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate(members), pa.int64())], names=["node", "shingle"])
