"""Byte-level BPE through a sentencepiece model that is written from the ranks alone."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import binary_rows, ragged

#: Characters of a text that are split into pre-tokens at a time.
SLICE_CHARS = 1 << 20
#: Distinct pre-tokens a worker remembers before it starts afresh.
CACHE_TOKENS = 400_000
#: A single space between a word character and a letter always begins a pre-token.
_SAFE_CUT = regex.compile(r"(?<=[\p{L}\p{N}]) (?=\p{L})")

#: All characters below are old ones.
_BEYOND_GREEK = re.compile("[\u0400-\U0010ffff]")


def byte_alphabet() -> list[str]:
    """A printable character for each byte, as the vocabularies of byte-level BPE write them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message: varint, float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The model file: piece r is the byte-mapped token of rank r with score -r, then the unknown piece.

    Field numbers are those of the public sentencepiece_model.proto. Nothing is normalised:
    no dummy prefix, no removed or escaped white space, the identity rule.
    """
    letters = byte_alphabet()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return ranks


def _newer_characters() -> str:
    """A class of the characters that the splitting library here counts as letters or numbers and tiktoken's doesn't.

    The two follow different editions of Unicode. Both are asked about every character.
    """
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    differing: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(everything)).decode())
        differing |= set(regex.findall(kind, everything)) - theirs
    points, parts = sorted(map(ord, differing)), []
    for p in points:
        if parts and parts[-1][1] == p - 1:
            parts[-1][1] = p
        else:
            parts.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts)


class Codec:
    """Encodes and decodes with one vocabulary; made once in each worker."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.split = regex.compile(pattern)
        self.newer = regex.compile(f"[{_newer_characters() or chr(0xE000)}]")
        self.whole = ranks
        back = {ord(c): b for b, c in enumerate(byte_alphabet())}
        tokens = [bytes(back[ord(c)] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _mapped(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.letters[32])
        return "".join(map(self.letters.__getitem__, word.encode()))

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words not seen so far."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        # a pre-token that is itself in the vocabulary is that token, whatever its merges say
        whole = [self.whole.get(w.encode()) for w in new]
        merged = iter(self.model.encode([self._mapped(w) for w, rank in zip(new, whole, strict=True) if rank is None], num_threads=1))
        found = [next(merged) if rank is None else (rank,) for rank in whole]
        length = np.fromiter(map(len, found), np.int64, len(found))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(length.sum()))))

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def _pre_tokens(self, part: str) -> list[str]:
        if part.isascii() or not _BEYOND_GREEK.search(part) or not self.newer.search(part):
            return self.split.findall(part)
        # such characters are symbols to tiktoken, as one for private use is to both
        return [part[slice(*m.span())] for m in self.split.finditer(self.newer.sub("\ue000", part))]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of consecutive pre-tokens, and how many each has."""
        if len(self.place) > CACHE_TOKENS:
            self._forget()
        places = list(map(self.place.get, words))
        if None in places:
            self._learn(words)
            places = list(map(self.place.__getitem__, words))
        at = np.array(places, np.int64)
        return self.ids[ragged(self.start[at], self.length[at])], self.length[at]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self._ids(self._pre_tokens(part))[0] for part in self._slices(text))])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """encode() of each text; short texts are looked up together."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_CHARS):
                size += len(texts[hi])
                hi += 1
            if hi == lo + 1:
                out.append(self.encode(texts[lo]))
            else:
                words = [self._pre_tokens(t) for t in texts[lo:hi]]
                ids, length = self._ids(list(itertools.chain.from_iterable(words)))
                ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum([len(w) for w in words])]
                out += np.split(ids, ends[:-1])
            lo = hi
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        length = self.token_length[ids]
        return self.token_bytes[ragged(self.token_start[ids], length)].tobytes()


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token counts and digests of every whole text, and with ``with_ids`` the token ids.

    ``path`` is a rank file that every executor has at the same place. Columns: the id,
    n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256
    (of the decoded bytes), and ids (array of int) if asked for. A null text is an empty
    one: no tokens, digests of nothing. Rows with a null or repeated id stay rows of their
    own, an empty table gives an empty one, other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                counts, hashes, decoded, ids = [], [], [], []
                for got in tool.encode_batch([v or "" for v in rows.column(1).to_pylist()]):
                    counts.append(len(got))
                    hashes.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(tool.decode(got)).hexdigest())
                    if with_ids:
                        ids.append(got.astype(np.int32))
                columns = [rows.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of every row's token ids: columns id and decoded (binary). Null ids are none."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            parts = [np.frombuffer(tool.decode(np.array(v.as_py() or [], np.int64)), np.uint8) for v in batch.column(1)]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_rows(flat, np.array([len(p) for p in parts], np.int64))], names=["id", "decoded"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
