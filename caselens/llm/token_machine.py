"""Token counts by a deterministic transducer that is compiled from a byte-level BPE vocabulary.

The transducer reads characters. Its states hold what of the text read so far can still
matter: the kind of the open pre-token, and every piece of a token that a further byte could
complete, with the token before that piece. Its transitions are annotated with the tokens
that they emit, as the change of the count of all that has been read, so the annotations of a
path add up to the count of its text. States and transitions are made when they are first met
and remembered in a worker up to a bound.
"""

from __future__ import annotations

import ast
import functools
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .bpe import byte_alphabet
from .store import Scratch

#: Texts of more characters are counted in chunks of so many.
CHUNK_CHARS = 1 << 14
#: Characters before a chunk that are read to foresee the states it may be entered in,
#: starting afresh at each of the first STARTS of them.
LOOK_BACK, STARTS = 512, 32
#: Neighbouring chunks whose maps are composed in one step of the scan.
FAN_IN = 64
#: Transitions that a worker remembers before it starts afresh.
TRANSITIONS = 3 << 18
#: A text of more tokens is over the limit.
TOKEN_LIMIT = 512

_LETTER, _NUMBER, _OTHER, _SPACE = "L", "N", "O", "S"
#: The state before a pre-token: nothing is open.
START = ("0",)
#: Fixed values of the public pre-token pattern: what may follow an apostrophe to be one pre-token with it.
_SHORT_ENDINGS = "stmd"
_LONG_ENDINGS = {"r": "e", "v": "e", "l": "l"}


def character_kinds() -> bytes:
    """The kind of every code point, as the library's own pre-tokenizer tells them apart, compressed.

    The characters that the local edition of Unicode holds to be of one kind are given to it
    in one string; of each piece that comes back one character is asked about by itself.
    """
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kinds = bytearray(_OTHER.encode() * 0x110000)

    def kind(c: str) -> str:
        if c == " " or len(split(f"\n{c}\n")) == 1:
            return _SPACE
        return next((k for k, friend in ((_LETTER, "a"), (_NUMBER, "1")) if len(split(friend + c)) == 1), _OTHER)

    for pattern in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s"):
        same = "".join(regex.findall(pattern, everything))
        for _, (lo, hi) in split(same):
            told = [kind(c) for c in same[lo:hi]] if pattern == r"\s" else [kind(same[lo])] * (hi - lo)
            for c, k in zip(same[lo:hi], told, strict=True):
                kinds[ord(c)] = ord(k)
    return zlib.compress(bytes(kinds), 9)


class _Merges:
    """The vocabulary's tokens as bytes, and what byte-pair merging makes of two of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte_level = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and byte_level["type"] == "ByteLevel"
        if not plain or byte_level["add_prefix_space"] or not byte_level.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE is compiled")
        added = spec["added_tokens"]
        if len(added) > 1 or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("at most one added token without options is compiled")
        self.special = added[0]["content"] if added else None
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ids = {token: i for token, i in model["vocab"].items() if not added or token != self.special}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.single = {ord(b): i for i, b in self.bytes.items() if len(b) == 1}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self._meets: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        parts = [self.single[b] for b in data]
        while len(parts) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.merge[parts[i], parts[i + 1]][1]]
        return parts

    def meets(self, a: int, b: int) -> bool:
        """Whether b can follow a: merging the bytes of both gives them back. Tokens whose neighbours all can are the merged text."""
        found = self._meets.get((a, b))
        if found is None:
            if len(self._meets) > TRANSITIONS:
                self._meets.clear()
            found = self._meets[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return found


class _State(dict):
    """A state's transitions, from a character to the next state and the tokens emitted; made when first followed."""

    __slots__ = ("machine", "key")

    def __init__(self, machine: TokenMachine, key: tuple):
        super().__init__()
        self.machine, self.key = machine, key

    def __missing__(self, c: str) -> tuple[_State, int]:
        key, n = self.machine.step(self.key, c)
        made = self[c] = self.machine.state(key), n
        self.machine.size += 1
        return made

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other: object) -> bool:
        return self is other


class TokenMachine:
    """The compiled transducer of one vocabulary file."""

    def __init__(self, path: str, kinds: bytes):
        self.merges = _Merges(path)
        self.special = self.merges.special
        self.kinds = zlib.decompress(kinds).decode("ascii")
        # the tokens that merging makes of their own bytes, in a trie whose nodes are numbered by the vocabulary's order
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = {0}
        for i, data in sorted(self.merges.bytes.items()):
            if self.merges.merged(data) != [i]:
                continue
            node = 0
            for b in data:
                self.inner.add(node)
                after = self.child.get(node << 8 | b)
                if after is None:
                    after = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = after
            self.token[node] = i
        self._forget()

    def _forget(self) -> None:
        self.size = 0
        self.states: dict[tuple, _State] = {}

    def state(self, key: tuple) -> _State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State(self, key)
        return found

    # merging inside a pre-token

    def _byte(self, open_pieces: tuple, b: int) -> tuple[tuple, int]:
        """Read a byte: the open pieces afterwards, and by how much the count of tokens changes.

        An open piece is (trie node, token before the piece or -1, count up to there less the
        count now). Exactly one of the tokens that end here can follow the one before it.
        """
        grown = [(self.child[node << 8 | b], last, count) for node, last, count in open_pieces if node << 8 | b in self.child]
        for node, last, count in grown:
            token = self.token[node]
            if token >= 0 and (last < 0 or self.merges.meets(last, token)):
                change = count + 1
                return (*((n, t, c - change) for n, t, c in grown if n in self.inner), (0, token, 0)), change
        raise AssertionError("every byte is a token")

    def _fed(self, pieces: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for b in text.encode("utf-8", "surrogatepass"):
            pieces, change = self._byte(pieces, b)
            total += change
        return pieces, total

    @functools.lru_cache(4096)  # noqa: B019 - a worker has one machine
    def _alone(self, text: str) -> tuple[tuple, int]:
        return self._fed(((0, -1, 0),), text)

    # pre-tokens

    def _opened(self, c: str) -> tuple[tuple, int]:
        """The state after a character that begins a pre-token."""
        pieces, n = self._alone(c)
        kind = self.kinds[ord(c)]
        if kind == _SPACE:
            return (_SPACE, c, pieces, n), n
        return ("A" if c == "'" else kind, pieces), n

    def step(self, key: tuple, c: str) -> tuple[tuple, int]:
        """The transition of a state for one character."""
        state, kind = key[0], self.kinds[ord(c)]
        if state == _SPACE:
            # white space is one pre-token up to the end of the text; before anything else its last character is not part of it
            _, last, pieces, without = key
            if kind == _SPACE:
                pieces, n = self._fed(pieces, c)
                return (_SPACE, c, pieces, n), n
            if last == " ":
                opened, n = self._alone(" " + c)
                return (kind, opened), n - without
            after, n = self._opened(c)
            return after, n + self._alone(last)[1] - without
        if state == "A":  # an apostrophe that begins a pre-token
            if c in _SHORT_ENDINGS:
                return START, self._alone("'" + c)[1] - self._alone("'")[1]
            if c in _LONG_ENDINGS:
                pieces, n = self._alone(c)
                return ("R", c, pieces), n
            state = _OTHER
        elif state == "R":  # and the first of two letters after it
            if c == _LONG_ENDINGS[key[1]]:
                return START, self._alone("'" + key[1] + c)[1] - self._alone("'")[1] - self._alone(key[1])[1]
            state = _LETTER
        if state == kind:
            pieces, n = self._fed(key[-1], c)
            return (kind, pieces), n
        return self._opened(c)

    def run(self, entry: tuple, text: str) -> tuple[tuple, int]:
        """The state after a text entered in state ``entry``, and the tokens emitted on the way."""
        if self.size > TRANSITIONS:
            self._forget()
        state, total = self.state(entry), 0
        for i, part in enumerate(text.split(self.special) if self.special else [text]):
            if i:  # the special token ends what is open and is a token itself
                state, total = self.state(START), total + 1
            for c in part:
                state, n = state[c]
                total += n
        return state.key, total

    def count(self, text: str) -> int:
        return self.run(START, text)[1]

    def foreseen(self, before: str) -> list[tuple]:
        """States that a chunk may be entered in after the text ``before``."""
        known = before.rfind(self.special) if self.special else -1
        if known >= 0:
            return [self.run(START, before[known + len(self.special) :])[0]]
        keys = {self.run(START, before[i:STARTS])[0] for i in range(min(STARTS, len(before)))}
        states = {self.state(k) for k in keys}
        for c in before[STARTS:]:
            states = {s[c][0] for s in states}
        return sorted((s.key for s in states), key=repr)

    def chunks(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(number, text before it, chunk) of a long text; no cut falls into the special token."""
        at = number = 0
        while at < len(text):
            end = min(at + CHUNK_CHARS, len(text))
            if self.special:
                inside = text.find(self.special, max(at, end - len(self.special) + 1), end + len(self.special) - 1)
                end = inside + len(self.special) if 0 <= inside < end else end
            yield number, text[max(0, at - LOOK_BACK) : at], text[at:end]
            at, number = end, number + 1


@functools.lru_cache(1)
def machine(path: str, kinds: bytes) -> TokenMachine:
    return TokenMachine(path, kinds)


_MAPS = "digest binary, number long, entry array<binary>, exit array<binary>, tokens array<long>"


def _written(keys: list[tuple]) -> list[bytes]:
    return [repr(k).encode() for k in keys]


def _composed(maps: list[dict]) -> dict[bytes, tuple[bytes, int]]:
    """One map for consecutive ones: entries for which every state on the way was foreseen."""
    out = {}
    for entry in maps[0]:
        state, total = entry, 0
        for each in maps:
            if state not in each:
                break
            state, n = each[state]
            total += n
        else:
            out[entry] = state, total
    return out


def _children(cell: list[dict]) -> list[dict]:
    return [dict(zip(c["entry"], zip(c["exit"], c["tokens"], strict=True), strict=True)) for c in cell]


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, number, children) to a map for each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            digest, number, children = (c[i] for c in batch.columns)
            made = _composed(_children(children.as_py()))
            yield pa.RecordBatch.from_arrays([
                pa.array([digest.as_py()], pa.binary()), pa.array([number.as_py()], pa.int64()), pa.array([list(made)], pa.list_(pa.binary())),
                pa.array([[v[0] for v in made.values()]], pa.list_(pa.binary())), pa.array([[v[1] for v in made.values()]], pa.list_(pa.int64())),
            ], names=["digest", "number", "entry", "exit", "tokens"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, children, state, before) to (digest, number, state, before, after) of every child."""
    for batch in batches:
        for i in range(batch.num_rows):
            digest, children, state, before = (c[i].as_py() for c in batch.columns)
            rows = []
            for child, own in zip(children, _children(children), strict=True):
                after, n = own.get(state, (None, None)) if state is not None else (None, None)
                total = None if n is None else before + n
                rows.append((digest, child["number"], state, before, total))
                state, before = after, total
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                names=["digest", "number", "state", "before", "after"],
            )


def scan_maps(scratch: Scratch, maps: DataFrame) -> DataFrame:
    """Parallel prefix scan of chunk maps: (digest, number, state, before, after) of every chunk.

    ``before`` and ``after`` count the tokens up to the chunk's begin and end. Maps of FAN_IN
    neighbours are composed, then maps of those, until a text has one; the states then come
    down the same levels. All are null behind a chunk entered in a state it did not foresee.
    """
    levels = []
    while True:
        child = F.struct("number", "entry", "exit", "tokens")
        parent = F.expr(f"number div {FAN_IN}").alias("number")
        grouped = scratch.write(maps.groupBy("digest", parent).agg(F.sort_array(F.collect_list(child)).alias("children")))
        levels.append(grouped)
        if grouped.agg(F.max("number")).first()[0] in (None, 0):
            break
        maps = grouped.mapInArrow(_up, _MAPS)
    start = F.lit(repr(START).encode())
    known = levels[-1].select("digest", "number", start.alias("state"), F.lit(0).cast("long").alias("before"))
    for grouped in reversed(levels):
        entered = grouped.join(known.select("digest", "number", "state", "before"), ["digest", "number"])
        known = entered.select("digest", "children", "state", "before").mapInArrow(_down, "digest binary, number long, state binary, before long, after long")
    return known


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """One row per document: id, n_bytes (of UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a tokenizer file that every executor has at the same place. Texts are whole: one
    of more than CHUNK_CHARS characters is cut into chunks, which become maps from the states
    they may be entered in to the state and the count they end with; a prefix scan composes
    the maps. Copies of a long text are counted once. A text with a chunk entered in a state
    that wasn't foreseen is run through whole.

    A null text is an empty one, of no bytes and no tokens. Rows with a null or repeated id
    stay rows of their own, an empty table gives an empty one, other columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    kinds = character_kinds()
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    short, long = (read.where(c) for c in (F.length("text") <= CHUNK_CHARS, F.length("text") > CHUNK_CHARS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = machine(path, kinds)
        for batch in batches:
            n = [tool.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = machine(path, kinds)
        for batch in batches:
            for i in range(batch.num_rows):
                digest = batch.column(0)[i].as_py()
                for number, before, body in tool.chunks(batch.column(1)[i].as_py()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest], pa.binary()), pa.array([number], pa.int64()), pa.array([before]), pa.array([body])], names=["digest", "number", "look", "body"]
                    )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = machine(path, kinds)
        for batch in batches:
            entry, leave, tokens = [], [], []
            for number, before, body in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                entered = tool.foreseen(before) if number else [START]
                ended = [tool.run(key, body) for key in entered]
                entry.append(_written(entered))
                leave.append(_written([key for key, _ in ended]))
                tokens.append([n for _, n in ended])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(entry, pa.list_(pa.binary())), pa.array(leave, pa.list_(pa.binary())), pa.array(tokens, pa.list_(pa.int64()))],
                names=["digest", "number", "entry", "exit", "tokens"],
            )

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    counted = short.select("id", n_bytes, "text").mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long")
    marked = scratch.write(long.select("id", n_bytes, digest, "text"))
    distinct = marked.select("digest", "text").dropDuplicates(["digest"])
    pieces = distinct.mapInArrow(cut, "digest binary, number long, look string, body string").repartition("digest", "number")
    ends = scratch.write(scan_maps(scratch, scratch.write(pieces.mapInArrow(mapped, _MAPS))).groupBy("digest").agg(F.max("after").alias("n_tokens"), F.max(F.col("after").isNull()).alias("lost")))
    missed = distinct.join(ends.where("lost").select("digest"), "digest", "left_semi").select("digest", F.lit(0).cast("long").alias("n_bytes"), "text")
    rerun = missed.mapInArrow(whole, "id binary, n_bytes long, n_tokens long").select(F.col("id").alias("digest"), "n_tokens")
    totals = ends.where("NOT lost").select("digest", "n_tokens").union(rerun)
    counted = counted.union(marked.select("id", "n_bytes", "digest").join(totals, "digest").select("id", "n_bytes", "n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def state_of(written: bytes) -> tuple:
    """A state as scan_maps() gives it, for TokenMachine.run()."""
    return ast.literal_eval(written.decode())
