"""Language of whole texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import blocks, mixed
from .store import Scratch

#: Lengths of the n-grams, and buckets they are hashed to.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Texts are read in pieces of about so many bytes.
PIECE_BYTES = 1 << 19
#: More labels than this are not languages; the fit stops instead of filling the driver.
MAX_LABELS = 1000
#: The label of a text without a letter.
UNDETERMINED = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the row of each, in order of the rows, and which rows have a letter.

    Characters are lower-cased; whatever isn't a letter is a space, several of which count as one.
    """
    # one text after the other, each between two zeros, which no n-gram may hold
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts).lower() + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    zero = code == 0
    code = np.where(letter | zero, code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code, zero, letter = code[keep], zero[keep], letter[keep]
    row = np.cumsum(zero) - 1
    has_letter = np.zeros(len(texts) + 1, bool)
    has_letter[row[letter]] = True
    buckets, rows = [], []
    value = code.astype(np.uint64)
    running, whole = np.zeros(len(code), np.uint64), np.ones(len(code), bool)
    for n in range(1, max(ORDERS) + 1):
        # n-grams that begin at each place, longer by one each time
        m = len(code) - n + 1
        if m <= 0:
            break
        running = running[:m] * np.uint64(0x100000001B3) + value[n - 1 :]
        whole = whole[:m] & ~zero[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(whole if n > 1 else whole & letter[:m])
            buckets.append((mixed(running[at] + np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int64))
            rows.append(row[at])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has_letter[: len(texts)]
    return np.concatenate(buckets), np.concatenate(rows), has_letter[: len(texts)]


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    log_prior: np.ndarray
    #: Buckets by labels.
    log_probability: np.ndarray


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_language_model(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Count n-grams by label over all rows and smooth them.

    Rows with a null label or text teach nothing. Each task adds up counts of fixed length by
    label and hands on those that aren't zero; the driver gets BUCKETS counts a label at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for lo, hi, _, _ in blocks(batch.column(0), PIECE_BYTES):
                own = sorted(set(labels[lo:hi]))
                number = {x: i for i, x in enumerate(own)}
                label = np.array([number[x] for x in labels[lo:hi]])
                bucket, row, _ = _grams(batch.column(0).slice(lo, hi - lo).to_pylist())
                got = np.bincount(label[row] * BUCKETS + bucket, minlength=len(own) * BUCKETS).reshape(-1, BUCKETS)
                for x, i in number.items():
                    counts[x] = counts.get(x, 0) + got[i]
                    texts_of[x] = texts_of.get(x, 0) + int((label == i).sum())
        for x, total in counts.items():
            at = np.flatnonzero(total)
            # bucket -1 has the number of texts
            columns = [pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], texts_of[x]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "bucket", "n"])

    read = labelled.select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counted = read.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counted = Scratch(labelled.sparkSession).write(counted)
    if counted.select("label").distinct().count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    table = counted.toArrow()
    labels = sorted(pc.unique(table["label"]).to_pylist())
    where = np.searchsorted(np.array(labels, object), np.array(table["label"].to_pylist(), object)) if labels else np.zeros(0, np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    seen = np.full((BUCKETS, max(1, len(labels))), smoothing)
    texts = np.ones(max(1, len(labels)))
    grams = bucket >= 0
    seen[bucket[grams], where[grams]] += n[grams]
    texts[where[~grams]] += n[~grams]
    return LanguageModel(tuple(labels), np.log(texts / texts.sum()), np.log(seen / seen.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns: the id, those named in ``carry``, lang_pred and score (the posterior of the prediction, 0 to 1).

    A null text and one without a letter are ``und`` with score 0, and so is every text if
    nothing was learned. Ties go to the label that sorts first. Repeated rows and null ids
    stay rows of their own; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.labels, model.log_prior, model.log_probability))
    names = [id_col, *carry]
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, prior, matrix = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi, _, _ in blocks(texts, PIECE_BYTES):
                values = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                found, score = [UNDETERMINED] * len(values), np.zeros(len(values))
                if labels:
                    bucket, row, has_letter = _grams(values)
                    total = np.stack([np.bincount(row, matrix[bucket, k], minlength=len(values)) for k in range(len(labels))], axis=1) + prior
                    best = total.argmax(axis=1)
                    top = total.max(axis=1)
                    score = np.where(has_letter, 1 / np.exp(total - top[:, None]).sum(axis=1), 0.0)
                    found = [labels[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)]
                part = batch.slice(lo, hi - lo)
                columns = [*part.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in range(len(names))), "lang_pred", "score"])

    read = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(text_col).alias("t"))
    return read.mapInArrow(run, f"{kinds}, lang_pred string, score double").withColumnsRenamed({f"c{i}": c for i, c in enumerate(names)})
