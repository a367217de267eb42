"""Spelling variants: words that one edit apart, found by k-d trees over letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import ragged, run_starts
from .store import Scratch

LEAST_POINTS, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
FACTOR = 10
#: Words of one length beyond this are dealt to the boxes of a shared tree, each searched by itself.
BOX_WORDS = 1 << 14
#: The shared tree of a length is fitted to about so many of its words, and has at most so many levels.
SAMPLE_WORDS, LEVELS = 1 << 13, 12
#: Different vectors in a leaf of a box's own tree.
LEAF = 32
#: Words a counting task holds before it hands them on, and cells of the largest array made at once.
HELD_WORDS, ARRAY_CELLS = 1 << 18, 1 << 22

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_counts(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, shorten: int | None = None) -> DataFrame:
    """(id, text) to (word, n): runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of enough code points and occurrences.

    With ``shorten``, a run whose crc32 of `id:run` it divides loses a code point first, as the
    query's contract has it.
    """
    # a greedy match never begins inside a run that is long enough
    long_runs = re.compile(f"{_RUN.pattern[:-1]}{{{least_points},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def held() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = [w.lower() if w.isascii() else w.translate(_LOWER) for w in long_runs.findall(text.as_py() or "")]
                if shorten:
                    prefix = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                    for i, w in enumerate(words):
                        h = zlib.crc32(w.encode(), prefix)
                        if not h % shorten:
                            k = h % len(w)
                            words[i] = w[:k] + w[k + 1 :]
                    words = [w for w in words if len(w) >= least_points]
                counts.update(words)
                if len(counts) > HELD_WORDS:
                    yield held()
        yield held()

    found = docs.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Counts of each of 256 letters in every row of a matrix of bytes."""
    rows, width = letters.shape
    out = np.empty((rows, 256), np.int32)
    step = max(1, ARRAY_CELLS // 256)
    for lo in range(0, rows, step):
        part = letters[lo : lo + step]
        key = np.repeat(np.arange(len(part)), width) * 256 + part.reshape(-1)
        out[lo : lo + step] = np.bincount(key, minlength=len(part) * 256).reshape(-1, 256)
    return out


def _split(vectors: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part vectors most evenly into at most so many and more; None if all are equal."""
    best, most = None, 0
    for t in range(int(vectors.min()), int(vectors.max())):
        below = (vectors <= t).sum(axis=0)
        even = np.minimum(below, len(vectors) - below)
        k = int(even.argmax())
        if even[k] > most:
            best, most = (k, t), int(even[k])
    return best


class KdTree:
    """A k-d tree over letter counts. Nodes are (letter, count, left, right), leaves numbers."""

    def __init__(self, vectors: np.ndarray, leaf: int, levels: int = 64):
        self.leaves: list[np.ndarray] = []
        self._vectors, self._leaf = vectors, leaf
        self.root = self._grown(np.arange(len(vectors)), levels)
        del self._vectors

    def _grown(self, rows: np.ndarray, levels: int) -> tuple | int:
        at = _split(self._vectors[rows]) if len(rows) > self._leaf and levels else None
        if at is None:
            self.leaves.append(rows)
            return len(self.leaves) - 1
        left = self._vectors[rows, at[0]] <= at[1]
        return (*at, self._grown(rows[left], levels - 1), self._grown(rows[~left], levels - 1))

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            k, t, low, high = node
            left = vectors[rows, k] <= t
            todo += [(low, rows[left]), (high, rows[~left])]
        return out

    def near(self, vectors: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) such that each row's distance to the leaf's box is at most ``more`` letters to be added and ``fewer`` to be taken away."""
        start = np.zeros(len(vectors), np.int32)
        todo: list[tuple] = [(self.root, np.arange(len(vectors)), start, start, {})]
        while todo:
            node, rows, added, taken, box = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            k, t, low, high = node
            x = vectors[rows, k]
            least, most = box.get(k, (0, 1 << 30))
            less = taken + np.maximum(x - t, 0) - np.maximum(x - most, 0)
            many = added + np.maximum(t + 1 - x, 0) - np.maximum(least - x, 0)
            left, right = less <= fewer, many <= more
            todo.append((low, rows[left], added[left], less[left], {**box, k: (least, t)}))
            todo.append((high, rows[right], many[right], taken[right], {**box, k: (t + 1, most)}))


def _unary(vectors: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as bits, so many ones for each letter, in 64-bit integers: the distance of two vectors is that of their bits."""
    bits = np.concatenate([np.arange(m)[None, :] < vectors[:, [k]] for k, m in enumerate(most) if m] or [np.zeros((len(vectors), 1), bool)], axis=1)
    room = np.zeros((len(vectors), -(-bits.shape[1] // 64) * 64), bool)
    room[:, : bits.shape[1]] = bits
    return np.packbits(room, axis=1).view(np.uint64)


def _replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words of one length differ in exactly one place."""
    return (x != y).sum(axis=1) == 1


def _inserted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether y is x with one letter more: up to their first difference they agree, from there on when y is moved by one."""
    width = x.shape[1]
    first = np.where(unequal := x != y[:, :-1], np.arange(width), width).min(axis=1, initial=width)
    last = np.where(x != y[:, 1:], np.arange(1, width + 1), 0).max(axis=1, initial=0)
    del unequal
    return last <= first


def _grouped(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different vectors of words, and the words of each: (vectors, words in their order, where each begins, how many)."""
    vectors = letter_counts(letters)
    used = np.flatnonzero(vectors.any(axis=0))
    order = np.lexsort(vectors[:, used].T) if len(used) else np.arange(len(vectors))
    kept = vectors[order]
    changes = np.concatenate(([True], (kept[1:] != kept[:-1]).any(axis=1))) if len(kept) else np.zeros(0, bool)
    begin = np.flatnonzero(changes)
    return kept[begin], order, begin, np.diff(np.concatenate((begin, [len(order)])))


def edit_pairs(points: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of asked, rows of points) of pairs that one edit apart.

    Both are matrices of letters; ``points`` have one letter more than ``asked`` or as many.
    A range search in a k-d tree of the points' vectors leaves vectors at a distance of at
    most two; of the words that have them the order of letters is compared.
    """
    longer = points.shape[1] > asked.shape[1]
    if not len(points) or not len(asked):
        return
    pv, p_words, p_begin, p_count = _grouped(points)
    qv, q_words, q_begin, q_count = _grouped(asked)
    most = np.maximum(pv.max(axis=0), qv.max(axis=0))
    p_bits, q_bits = _unary(pv, most), _unary(qv, most)
    tree = KdTree(pv, LEAF)
    fits = _inserted if longer else _replaced
    wait: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def compared(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        q, p = (np.concatenate(c) for c in zip(*pairs, strict=True))
        each = q_count[q] * p_count[p]
        ends = np.cumsum(each)
        lo = 0
        while lo < len(q):
            # so many vector pairs that their words fill an array; the words of one pair may fill several
            base = ends[lo] - each[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + ARRAY_CELLS // max(1, points.shape[1]), "right")))
            total = int(ends[hi - 1] - base)
            step = max(1, ARRAY_CELLS // max(1, points.shape[1]))
            for at in range(0, total, step):
                k = np.arange(at, min(total, at + step)) + base
                pair = np.searchsorted(ends, k, "right")
                inside = k - (ends[pair] - each[pair])
                a = q_words[q_begin[q[pair]] + inside // p_count[p[pair]]]
                b = p_words[p_begin[p[pair]] + inside % p_count[p[pair]]]
                good = fits(asked[a], points[b])
                yield a[good], b[good]
            lo = hi

    for leaf, rows in tree.near(qv, 1, 0 if longer else 1):
        own = tree.leaves[leaf]
        step = max(1, ARRAY_CELLS // (len(own) * p_bits.shape[1]))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            apart = np.zeros((len(part), len(own)), np.int32)
            for w in range(p_bits.shape[1]):
                apart += np.bitwise_count(q_bits[part, w][:, None] ^ p_bits[own, w][None, :])
            q, p = np.nonzero(apart == (1 if longer else 2))
            wait.append((part[q], own[p]))
            waiting += len(q)
            if waiting > ARRAY_CELLS // 16:
                yield from compared(wait)
                wait, waiting = [], 0
    if waiting:
        yield from compared(wait)


def _letters(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of words of one length, a row for each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


_ROUTED = "size int, box int, role int, word binary, n long"


def _routes(trees: dict[int, KdTree], words: DataFrame) -> DataFrame:
    """Every word in its box (role 0), and in the boxes where words of its length (1) or one letter more (2) may be near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # all letters are of the first 256 characters
            coded = np.array([w.encode("latin-1") for w in batch.column(0).to_pylist()], object)
            n, size = batch.column(1).to_numpy(), np.array([len(w) for w in coded], np.int64)
            order = np.argsort(size, kind="stable")
            begin = run_starts(size[order])
            for lo, hi in zip(begin, [*begin[1:], len(order)], strict=True):
                own = order[lo:hi]
                width = int(size[own[0]])
                here, above = trees.get(width), trees.get(width + 1)
                vectors = letter_counts(np.frombuffer(b"".join(coded[own]), np.uint8).reshape(len(own), width)) if here or above else None
                home = here.home(vectors) if here else np.zeros(len(own), np.int64)
                sent = [(width, home, np.arange(len(own)), 0)]
                if here:
                    for box, rows in here.near(vectors, 1, 1):
                        rows = rows[home[rows] != box]
                        sent.append((width, np.full(len(rows), box), rows, 1))
                if above:
                    sent += [(width + 1, np.full(len(rows), box), rows, 2) for box, rows in above.near(vectors, 1, 0)]
                else:
                    sent.append((width + 1, np.zeros(len(own), np.int64), np.arange(len(own)), 2))
                for target, box, rows, role in sent:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), target, np.int32)), pa.array(box.astype(np.int32)), pa.array(np.full(len(rows), role, np.int32)),
                        pa.array(list(coded[own[rows]]), pa.binary()), pa.array(n[own[rows]]),
                    ], names=["size", "box", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _ROUTED)


def _searched(table: pa.Table) -> pa.Table:
    """The words of a box to what each of them is near to there: word, n_near, best_n, best."""
    role = table["role"].to_numpy()
    width = table["size"][0].as_py()
    point, same, shorter = (np.flatnonzero(role == r) for r in range(3))
    words = table["word"].combine_chunks()
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks)
    n = table["n"].to_numpy()
    owner, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    letters = _letters(words.take(pa.array(point)), width)
    equal = np.concatenate((point, same))
    for a, b in edit_pairs(letters, _letters(words.take(pa.array(equal)), width)):
        owner.append(equal[a])
        other.append(point[b])
    for a, b in edit_pairs(letters, _letters(words.take(pa.array(shorter)), width - 1)):
        owner += [shorter[a], point[b]]
        other += [point[b], shorter[a]]
    mine, near = np.concatenate(owner), np.concatenate(other)
    if not len(mine):
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    # the most frequent near word, the smallest by code points among equals
    listed = words.to_pylist()
    place = np.empty(len(listed), np.int64)
    place[sorted(range(len(listed)), key=listed.__getitem__)] = np.arange(len(listed))
    order = np.lexsort((place[near], -n[near], mine))
    mine, near = mine[order], near[order]
    first = run_starts(mine)
    return pa.table({
        "word": pa.array([listed[i].decode("latin-1") for i in mine[first]], pa.string()), "n_near": pa.array(np.diff(np.concatenate((first, [len(mine)])))),
        "best_n": pa.array(n[near[first]]), "best": pa.array([listed[i].decode("latin-1") for i in near[first]], pa.string()),
    })


def shared_trees(words: DataFrame) -> dict[int, KdTree]:
    """A tree for every length of more than BOX_WORDS words, fitted to a sample by hash of about SAMPLE_WORDS of them.

    The sample shapes the boxes alone. There are fewer such lengths than words / BOX_WORDS, and a tree has at most
    2 ** LEVELS boxes.
    """
    size = F.length("word")
    large = {r["size"]: r["count"] for r in words.groupBy(size.alias("size")).count().where(F.col("count") > BOX_WORDS).collect()}
    if not large:
        return {}
    rate = F.element_at(F.create_map(*(F.lit(x) for size, count in large.items() for x in (size, max(1, count // SAMPLE_WORDS)))), size)
    sample: dict[int, list[bytes]] = {}
    for r in words.where(size.isin(list(large)) & (F.pmod(F.xxhash64("word"), rate) == 0)).select("word").collect():
        sample.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    out = {}
    for width, rows in sample.items():
        vectors = letter_counts(np.frombuffer(b"".join(sorted(rows)), np.uint8).reshape(len(rows), width))
        out[width] = KdTree(vectors, max(1, BOX_WORDS * len(rows) // large[width]), LEVELS)
        del out[width].leaves
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) to (word, n_near, best_n, best): how many words one edit away, and the most frequent of them (ties: the smallest by code points).

    Words are distinct, of the letters of word_counts(). Those of one length are dealt to the boxes
    of a shared k-d tree and sent as queries to every box that one edit may reach, and a box is
    searched by a tree of its own. A word without near words has no row.
    """
    found = _routes(shared_trees(words), words).groupBy("size", "box").applyInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("fewer"), F.col("best"))).alias("least")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("least.fewer")).alias("best_n"), F.col("least.best").alias("best"))


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT,
    factor: int = FACTOR, shorten: int | None = None,
) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent word one edit away (an inserted, deleted or replaced code point;
    ties: the smallest by code points) if it is at least ``factor`` times as frequent, else null.
    ``root`` is the last word that forms lead to, the word itself without one. A form is more
    frequent than its word, so forms never go round.

    Words are as word_counts() makes them. Null and empty texts have none, a null id is written as
    nothing before the colon, repeated rows count each time, texts without words or an empty table
    give an empty result, other columns are left out.
    """
    if factor < 2:
        raise ValueError("a form has to be more frequent than its variants")
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = scratch.write(word_counts(read, least_points, least_count, shorten))
    near = words.join(near_words(words), "word", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    told = scratch.write(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"),
    ))
    # pointer jumping: each round doubles the forms that a root has followed
    rooted = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = rooted.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rooted = scratch.write(rooted.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not rooted.where("moved").limit(1).count():
            break
        rooted = rooted.select("word", "root")
    return told.join(rooted.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
