"""Periodic runs of words: suffix trees of a text and its reversal, and Lyndon roots extended both ways."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least so many times its period.
LEAST_LENGTH, LEAST_POWER = 6, 4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class SuffixTree:
    """Ukkonen's suffix tree of numbers from 1 on, closed by a 0; longest common extensions by an Euler tour.

    A node's edge holds symbols[start:end]. Children are found by (node, first symbol).
    """

    def __init__(self, symbols: list[int]):
        self.symbols = [*symbols, 0]
        self.width = max(symbols, default=0) + 1
        self.start, self.end, self.child = self._grown()
        self._toured = False

    def _grown(self) -> tuple[list[int], list[int], dict[int, int]]:
        s, width, n = self.symbols, self.width, len(self.symbols)
        start, end, link, child = [-1], [-1], [0], {}
        # the active point: a node, and so many symbols down the edge that begins like s[edge]
        node = edge = down = 0
        pending = 0
        for i, symbol in enumerate(s):
            pending += 1
            unlinked = 0
            while pending:
                if not down:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key, 0)
                if not below:
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    child[key] = len(start) - 1
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    length = min(end[below], i + 1) - start[below]
                    if down >= length:
                        edge += length
                        down -= length
                        node = below
                        continue
                    if s[start[below] + down] == symbol:
                        if unlinked and node:
                            link[unlinked] = node
                        down += 1
                        break
                    # split the edge, and hang a leaf on the new node
                    split, leaf = len(start), len(start) + 1
                    start += [start[below], i]
                    end += [start[below] + down, n]
                    link += [0, 0]
                    start[below] += down
                    child[key] = split
                    child[split * width + symbol] = leaf
                    child[split * width + s[start[below]]] = below
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                pending -= 1
                if not node and down:
                    down -= 1
                    edge = i - pending + 1
                elif node:
                    node = link[node]
        return start, end, child

    def _families(self) -> list[list[int]]:
        """Every node's children in the order of their first symbols."""
        out: list[list[int]] = [[] for _ in self.start]
        for key in sorted(self.child):
            out[key // self.width].append(self.child[key])
        return out

    def suffix_orders(self) -> tuple[list[int], list[int]]:
        """Ranks of the suffixes by the symbols' order and by its reverse; the end is least in both."""
        families, n = self._families(), len(self.symbols)
        orders = []
        for turned in (False, True):
            rank, place = [0] * n, 0
            todo = [(0, 0)]
            while todo:
                node, depth = todo.pop()
                below = families[node]
                if node:
                    depth += self.end[node] - self.start[node]
                if not below and node:
                    rank[n - depth] = place
                    place += 1
                    continue
                if turned:
                    # the end symbol's leaf stays the first
                    first = [c for c in below if not self.symbols[self.start[c]]]
                    below = first + [c for c in reversed(below) if self.symbols[self.start[c]]]
                todo += [(c, depth) for c in reversed(below)]
            orders.append(rank)
        return orders[0], orders[1]

    def _tour(self) -> None:
        families, n = self._families(), len(self.symbols)
        depths: list[int] = []
        first = [0] * n
        todo: list[tuple[int, int, int]] = [(0, 0, 0)]
        while todo:
            node, depth, k = todo.pop()
            below = families[node]
            if not below:
                first[n - depth] = len(depths)
            depths.append(depth)
            if k < len(below):
                todo.append((node, depth, k + 1))
                c = below[k]
                todo.append((c, depth + self.end[c] - self.start[c], 0))
        self._first = np.array(first, np.int64)
        table = [np.array(depths, np.int32)]
        while 2 << (len(table) - 1) <= len(depths):
            last, step = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(last[:-step], last[step:]))
        self._table = table
        self._toured = True

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common extensions to the right from different places a and b: the depth of their leaves' lowest common ancestor."""
        if not self._toured:
            self._tour()
        x, y = self._first[a], self._first[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self._table[k][lo[own]], self._table[k][hi[own] - (1 << k) + 1])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For every suffix the next one to the right that is smaller; what lies between is the longest Lyndon word here."""
    out = [0] * len(rank)
    for i in range(len(rank) - 1, -1, -1):
        j = i + 1
        while j < len(rank) and rank[j] > rank[i]:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(symbols: list[int], least: int = LEAST_LENGTH, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` symbols and ``power`` (2 or more) periods.

    Each run holds its Lyndon root, by one of the two orders, as the longest Lyndon word at
    some place. Every such word is a candidate; it is extended by common extensions to the
    right in the tree of the text and to the left in that of the reversal. A Lyndon word has
    no shorter period, so the period of what it extends to is its length.
    """
    n = len(symbols)
    if n < max(least, power):
        return []
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    at = np.arange(n, dtype=np.int64)
    roots = []
    for rank in ahead.suffix_orders():
        after = _next_smaller(rank)[:n]
        roots.append(np.stack((at, after), axis=1)[power * (after - at) <= n])
    i, j = np.unique(np.concatenate(roots), axis=0).T
    if not len(i):
        return []
    begin = i - back.common(n - i, n - j)
    end = j + ahead.common(i, j)
    period = j - i
    good = (end - begin >= np.maximum(least, power * period))
    found = np.unique(np.stack((begin, period, end - begin), axis=1)[good], axis=0)
    return [(int(s), int(length), int(p)) for s, p, length in found]


def repetitive_stretches(ids: np.ndarray, least: int = LEAST_LENGTH, power: int = LEAST_POWER) -> list[tuple[int, int]]:
    """(begin, end) of stretches of consecutive words outside which no run can lie.

    In a run of ``power`` periods each word comes at least ``power`` times, and each two
    neighbours at least ``power`` - 1 times. Places between neighbours that are rarer in their
    stretch part it, until nothing changes; a stretch of fewer than ``least`` words is left out.
    """
    n = len(ids)
    if n < least:
        return []
    width = int(ids.max()) + 1
    pair = ids[:-1].astype(np.int64) * width + ids[1:]
    at = np.arange(n - 1)
    stretch = np.zeros(n - 1, np.int64)
    while len(at):
        # the second sort is stable, so equal pairs of one stretch lie together
        order = np.argsort(pair[at], kind="stable")
        order = order[np.argsort(stretch[order], kind="stable")]
        there, here = pair[at][order], stretch[order]
        changes = np.concatenate(([True], (there[1:] != there[:-1]) | (here[1:] != here[:-1])))
        group = np.cumsum(changes) - 1
        often = np.empty(len(at), bool)
        often[order] = np.bincount(group)[group] >= power - 1
        kept = at[often]
        parted = np.concatenate(([True], kept[1:] != kept[:-1] + 1)) if len(kept) else np.zeros(0, bool)
        number = np.cumsum(parted) - 1
        size = np.bincount(number, minlength=1)
        wide = size[number] >= least - 1 if len(kept) else np.zeros(0, bool)
        kept, number = kept[wide], number[wide]
        if len(kept) == len(at):
            break
        at, stretch = kept, number
    if not len(at):
        return []
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
    end = np.concatenate((begin[1:], [len(at)])) - 1
    return [(int(at[b]), int(at[e]) + 2) for b, e in zip(begin, end, strict=True)]


def periodic_runs(words: list, least: int = LEAST_LENGTH, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = []
    for begin, end in repetitive_stretches(ids, least, power):
        own: dict[int, int] = {}
        part = [own.setdefault(i, len(own) + 1) for i in ids[begin:end].tolist()]
        found += [(begin + s, length, p) for s, length, p in runs_of(part, least, power)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def repeat_tail(words: list, doc_id: object) -> list:
    """The words of a chosen tenth of the ids with their end made periodic, as the query's contract has it; others as they are."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def run_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", periodic_tails: bool = False, with_runs: bool = False) -> DataFrame:
    """One row per document: its periodic runs of words, and what is left when each keeps its first period.

    Columns: the id, n_runs; start, length, period and exponent_milli of the longest run (ties:
    the smallest start, then period; null without a run); runs_sha256 of the lines
    `start,length,period` of all runs; collapsed_sha256 of the words left, joined by a space;
    and with ``with_runs`` also runs (array of structs) and collapsed (text). With
    ``periodic_tails`` the words of a tenth of the ids are changed first by repeat_tail().

    Words are split at white space, whole texts are read. A null or empty text has no words and
    no run. Rows with a null id are left unchanged by ``periodic_tails``. Rows with a null or repeated id
    stay rows of their own, an empty table gives an empty one, other columns are left out. A
    task holds the trees of one stretch of one text at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests, texts = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                # bytes are split at the same white space as the words' pattern
                words = (text.as_py() or "").encode().split()
                if periodic_tails:
                    words = repeat_tail(words, doc_id.as_py())
                runs = periodic_runs(words)
                left = b" ".join(collapsed(words, runs) if runs else words)
                lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
                found.append([{"start": s, "length": length, "period": p} for s, length, p in runs])
                digests.append((hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
                texts.append(left.decode() if with_runs else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(_RUN)), *(pa.array([d[i] for d in digests], pa.string()) for i in (0, 1)), pa.array(texts, pa.string())],
                names=["id", "runs", "runs_sha256", "collapsed_sha256", "collapsed"],
            )

    schema = f"id {kind}, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string, collapsed string"
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

    def best(name: str) -> Column:
        return F.col(f"best.{name}")

    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS before, -r.period AS smaller, r.start AS start, r.period AS period)))")
    return made.withColumn("best", longest).select(
        F.col("id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), best("start").alias("start"), best("length").alias("length"), best("period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if with_runs else []),
    )


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
