"""Held rows meet asking rows of the same key in one pass, with one key's held rows in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pinned

#: Given the held rows of a key, answers batches of its asking rows.
Prepare = Callable[[pa.Table], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]

SALTS = 1 << 20


def salted(held: DataFrame, asked: DataFrame, key: str, weight: str, share: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_key``, the key cut so that about ``share`` of the asking rows' ``weight`` meet one copy of its held rows.

    A key that a large part of the asking rows has is spread over many tasks; its held rows are
    copied once for each ``share``, so the copies stay in proportion to the asking side. The
    asking table is read twice; keys without asking rows are dropped.
    """
    # written, so that Spark knows how few they are before it deals out the asking rows to join them
    parts = pinned(asked.groupBy(key).agg(F.least(F.ceil(F.sum(weight) / share).cast("int"), F.lit(SALTS)).alias("_parts")))
    spread = held.join(parts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    names = asked.columns
    dealt = asked.join(parts, key).withColumn("_salt", F.pmod(F.xxhash64(*names), F.col("_parts")))
    whole = (F.col(key).cast("bigint") * SALTS + F.col("_salt")).alias("_key")
    return spread.select(whole, *[c for c in held.columns if c != key]), dealt.select(whole, *[c for c in names if c != key])


def meet(held: DataFrame, asked: DataFrame, prepare: Prepare, schema: T.StructType) -> DataFrame:
    """``prepare(held rows of a key)(batch of asking rows)`` for every ``_key``, an integer both sides have.

    A key's held rows have to fit in a task; its asking rows stream past them and are never
    gathered. Rows are dealt by key and sorted inside a partition, the held ones first.
    """
    left = [c for c in held.columns if c != "_key"]
    right = [c for c in asked.columns if c != "_key"]
    empty_right = [F.lit(None).cast(asked.schema[c].dataType).alias(f"r_{c}") for c in right]
    empty_left = [F.lit(None).cast(held.schema[c].dataType).alias(f"l_{c}") for c in left]
    both = held.select("_key", F.lit(False).alias("_asks"), *[F.col(c).alias(f"l_{c}") for c in left], *empty_right).union(
        asked.select("_key", F.lit(True).alias("_asks"), *empty_left, *[F.col(c).alias(f"r_{c}") for c in right])
    )
    n = len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, answer = None, [], None
        for batch in batches:
            keys, asks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = 0
            while begin < batch.num_rows:
                end = begin + 1
                while end < batch.num_rows and keys[end] == keys[begin] and asks[end] == asks[begin]:
                    end += 1
                if keys[begin] != key:
                    key, kept, answer = keys[begin], [], None
                part = batch.slice(begin, end - begin)
                if not asks[begin]:
                    kept.append(pa.RecordBatch.from_arrays(part.columns[2 : 2 + n], names=left))
                elif kept:
                    if answer is None:
                        answer = prepare(pa.Table.from_batches(kept))
                    yield from answer(pa.RecordBatch.from_arrays(part.columns[2 + n :], names=right))
                begin = end

    return both.repartition("_key").sortWithinPartitions("_key", "_asks").mapInArrow(run, schema)
