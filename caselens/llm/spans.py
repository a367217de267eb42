"""Removing byte spans from texts, and what the substring operators return for it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places in texts are one 64-bit number: 30 bits that tell apart texts which share an id, then 32 bits of position.
_POSITION = (1 << 32) - 1


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text): rows with one id and one text are one document, and version tells the texts of an id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    version: Column = F.xxhash64(text).bitwiseAND(F.lit(0x3FFFFFFF))
    return docs.select(F.col(id_col).alias("id"), version.alias("version"), text.alias("text"))


def place(version: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (version << 32) | position


def position(places: np.ndarray) -> np.ndarray:
    return places & _POSITION


def union_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge)[:-1] > 0


class Report:
    """Collects the rows (n_bytes, n_removed, n_spans, kept_sha256) of a batch, and the kept texts if asked for."""

    SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def __init__(self, with_kept: bool):
        self.rows: list[tuple[int, int, int, str]] = []
        self.kept: list[bytes] | None = [] if with_kept else None

    def add(self, data: np.ndarray, removed: np.ndarray) -> None:
        kept = data[~removed].tobytes()
        begins = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
        self.rows.append((len(data), int(removed.sum()), begins, hashlib.sha256(kept).hexdigest()))
        if self.kept is not None:
            self.kept.append(kept)

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        columns = [ids, *(pa.array([r[i] for r in self.rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in self.rows], pa.string())]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if self.kept is not None:
            columns.append(pa.array(self.kept, pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names=names)


def without_spans(docs: DataFrame, spans: DataFrame, with_kept: bool = False) -> DataFrame:
    """(id, version, text) and spans (id, version, start, end) to the id, Report's columns, and kept (binary) if asked for."""
    kind = docs.schema["id"].dataType.simpleString()
    grouped = spans.groupBy("id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, report = batch.slice(lo, 200), Report(with_kept)
                for text, cell in zip(part.column(1), part.column(2), strict=True):
                    data = np.frombuffer(text.as_py().encode(), np.uint8)
                    removed = np.zeros(len(data), bool)
                    if cell.is_valid:
                        removed = union_mask(len(data), cell.values.field(0).to_numpy(), cell.values.field(1).to_numpy())
                    report.add(data, removed)
                yield report.batch(part.column(0))

    joined = docs.join(grouped, ["id", "version"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, {Report.SCHEMA}" + ", kept binary" * with_kept)
