"""Run registered queries beside their SQL twins and compare the row sets."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from ..session import build_session
from .registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _cell(value: object) -> object:
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return ("f", repr(value + 0.0))
    return value


def _bag(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    begin = time.time()
    frame = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in frame.collect()]
    spent = time.time() - begin
    if name not in ORACLES:
        return len(rows) > 0, f"rows-only {len(rows)} rows {spent:.1f}s"
    begin = time.time()
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    left, right = _bag(frame.columns, rows), _bag(columns, expected)
    note = f"{len(rows)} rows {spent:.1f}s, sql {time.time() - begin:.1f}s"
    if left == right:
        return True, note if rows else f"{note} (empty)"
    only_left, only_right = list((left - right).items()), list((right - left).items())
    return False, (
        f"{note} vs {len(expected)}; extra {len(only_left)} {only_left[:2]} "
        f"missing {len(only_right)} {only_right[:2]} cols {sorted(columns)}"
    )


def main() -> None:
    from . import load_all

    load_all()
    sf = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark, con = build_session(), connect(sf)
    bad = 0
    for name in names:
        try:
            good, note = compare(spark, con, name, sf)
        except Exception as error:  # a failing query must not hide the others
            good, note = False, f"{type(error).__name__}: {str(error)[:400]}"
        bad += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} good", flush=True)


if __name__ == "__main__":
    main()
