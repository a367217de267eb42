"""Case catalogue files: JSON envelopes in, three tables out."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scan import Last, Sum, ordered_scan
from ..schema import CATEGORY_SCHEMA, CORE_FIELDS, MULTI_VALUE_FIELDS
from ..session import pinned

TEXTS = T.ArrayType(T.StringType())
#: A file of more bytes is read in pieces by many tasks.
WHOLE_BYTES = 32 << 20
#: Where an envelope holds its records, in the order of preference.
BUILDER_KEYS = ("items", "records", "list")
LOADER_KEYS = ("items", "case_items")

_GAP = re.compile(r"[\s,]*")
_RECORD = [T.StructField(n, TEXTS if n in MULTI_VALUE_FIELDS else T.StringType()) for n in CORE_FIELDS] + [T.StructField("_id", T.StringType())]
_FIELDS = frozenset(CORE_FIELDS)
_ARROW_TYPES = {f.name: pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in _RECORD}


def _text_value(value: object, mode: str) -> str | None:
    """A scalar as the builder or the loader writes it: the loader takes what is false for nothing."""
    if value is None or (mode == "loader" and not value):
        return None
    return str(value)


def _list_value(value: object, mode: str) -> list[str] | None:
    if value is None:
        return None
    if isinstance(value, list):
        # an entry that is null is no value to the builder and the word None to the loader
        return [str(v) for v in value if v is not None or mode == "loader"]
    text = str(value)
    if mode == "builder":
        return text.replace("；", ";").split(";")
    return [text] if text.strip() else []


def typed_record(record: dict, mode: str) -> dict:
    """The 31 fields of a parsed record as texts and lists of texts, and its ``id`` as ``_id``."""
    row = {
        n: _list_value(record.get(n), mode) if n in MULTI_VALUE_FIELDS else _text_value(record.get(n), mode)
        for n in CORE_FIELDS
    }
    # a case_id that is there, even empty, hides the id
    row["_id"] = None if "case_id" in record else _text_value(record.get("id"), mode)
    return row


def _at(text: str, i: int) -> int:
    return _GAP.match(text, i).end()


def json_events(text: str, depth: int, listed: bool, last: bool) -> Iterator[tuple[str, str | None, object]]:
    """(kind, key, value) of what stands outside records in a stretch of an envelope.

    ``depth`` containers are open before it; ``listed`` tells that the outermost is an array.
    Kinds: ``open`` an array under a key, ``value`` anything else under a key, ``element`` an
    entry of the array last opened, ``scalar`` a document without containers.
    """
    decode = json.JSONDecoder().raw_decode
    try:
        i = _at(text, 0)
        while i < len(text):
            c = text[i]
            if depth == 0 and c in "[{":
                depth, listed = 1, c == "["
                if listed:
                    yield "open", None, None
                i += 1
            elif depth == 0:
                value, i = decode(text, i)
                yield "scalar", None, value
            elif c == ("]" if listed or depth == 2 else "}"):
                depth -= 1
                i += 1
                if not depth and text[i:].strip():
                    raise ValueError("text behind the document")
            elif listed or depth == 2:
                value, i = decode(text, i)
                yield "element", None, value
            else:
                key, i = decode(text, i)
                i = _at(text, i)
                if text[i : i + 1] != ":" or not isinstance(key, str):
                    raise ValueError("a key without a value")
                i = _at(text, i + 1)
                if text[i : i + 1] == "[":
                    depth, i = 2, i + 1
                    yield "open", key, None
                else:
                    value, i = decode(text, i)
                    yield "value", key, value
            i = _at(text, i)
        if last and depth:
            raise ValueError("the document is not closed")
    except ValueError as problem:
        raise ValueError(f"source is not valid JSON: {problem}") from problem


_EVENT = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("unit", T.LongType()), T.StructField("ord", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("truthy", T.BooleanType()),
    T.StructField("type", T.StringType()), T.StructField("raw", T.StringType()), *_RECORD,
])


def _events(units: DataFrame, mode: str) -> DataFrame:
    """(file, unit, depth, listed, last, text) to a row for each event, records typed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, unit, depth, listed, last, text = (c[i].as_py() for c in batch.columns)
                told: list[dict] = []
                for n, (kind, key, value) in enumerate(json_events(text.removeprefix("\ufeff"), depth, listed, last)):
                    record = typed_record(value, mode) if kind == "element" and isinstance(value, dict) else {}
                    # what is no record is kept as it stands: header fields, categories
                    if kind == "value" or (record and not _FIELDS & value.keys()):
                        record["raw"] = json.dumps(value, ensure_ascii=False)
                    told.append({"file": file, "unit": unit, "ord": n, "kind": kind, "key": key, "truthy": bool(value), "type": type(value).__name__, **record})
                    if len(told) == 1024:
                        yield _event_batch(told)
                        told = []
                if told:
                    yield _event_batch(told)

    return units.select("file", "unit", "depth", "listed", "last", "text").mapInArrow(run, _EVENT)


def _event_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "unit": pa.int64(), "ord": pa.int64(), "kind": pa.string(), "key": pa.string(), "truthy": pa.bool_(), "type": pa.string(), "raw": pa.string()} | _ARROW_TYPES
    return _batch(rows, kinds)


def _batch(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()], names=list(kinds))


def placed_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, file_size, pos, value): the lines of text files, numbered from 1 in their file.

    A task numbers the lines of its blocks; counts per block, added up along the file, make
    the numbers of the whole. Nothing is sorted but one row for each block.
    """
    source = spark.read.text(path) if separator is None else spark.read.option("lineSep", separator).text(path)
    rows = pinned(source.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value",
    ))
    blocks = rows.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("file", "_block", (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(begins, ["file", "_block"]).select("file", "file_size", (F.col("_row") + F.col("_shift")).alias("pos"), "value")


def _bare(text: Column, inside: Column) -> Column:
    """The brackets of a piece outside its strings; ``inside``: it begins within one."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    plain = F.when(inside, F.regexp_replace(plain, r'(?s)^[^"]*"?', "")).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(plain, r'(?s)"[^"]*("|$)', ""), r"[^\[\]{}]", "")


def _units(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes cut behind records: (file, unit, depth, listed, last, text), each unit with one record or a few.

    A file is read by many tasks in pieces that end with a closing brace. Running sums over
    them tell which braces stand in strings and how deep the others are, and a unit ends
    with a brace that closes an entry of a top-level array.
    """
    pieces = placed_lines(spark, path, "}")
    # the separator is not part of a piece, and the last one may not have had it
    ends = pieces.groupBy("file", "file_size").agg(F.max("pos").alias("_last"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    missing = F.col("_bytes") - F.col("file_size")
    ends = ends.select("file", "_last", (missing.isin(1, -2)).alias("_open"))
    whole = F.when((F.col("pos") == F.col("_last")) & F.col("_open"), F.col("value")).otherwise(F.concat("value", F.lit("}")))
    pieces = pieces.join(ends, "file").select("file", "pos", (F.col("pos") == F.col("_last")).alias("last"), whole.alias("text"))
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    quoted = ordered_scan(pieces, ["file"], "pos", {"_quotes": Sum(quotes.cast("bigint"), inclusive=False)}).withColumn(
        "_inside", F.coalesce(F.col("_quotes"), F.lit(0)) % 2 == 1
    )
    bare = pinned(quoted.withColumn("_bare", _bare(F.col("text"), F.col("_inside"))))
    change = F.length(F.regexp_replace("_bare", r"[\]}]", "")) - F.length(F.regexp_replace("_bare", r"[\[{]", ""))
    top = F.when(F.col("pos") == 1, F.substring("_bare", 1, 1))
    deep = ordered_scan(bare, ["file"], "pos", {"_before": Sum(change.cast("bigint"), inclusive=False), "_top": Last(top, inclusive=True)})
    deep = deep.withColumn("_before", F.coalesce("_before", F.lit(0))).withColumn("_after", F.col("_before") + change)
    # of an object's values, an array may be parted and an object not: what opened the second level last
    second = F.expr("""aggregate(split(_bare, ''), struct(_before AS d, CAST(NULL AS STRING) AS c), (a, x) -> CASE
        WHEN x IN ('[', '{') THEN struct(a.d + 1 AS d, CASE WHEN a.d = 1 THEN x ELSE a.c END AS c)
        WHEN x IN (']', '}') THEN struct(a.d - 1 AS d, a.c AS c) ELSE a END).c""")
    held = ordered_scan(pinned(deep), ["file"], "pos", {"_second": Last(second, inclusive=True)})
    after_quotes = (F.coalesce(F.col("_quotes"), F.lit(0)) + quotes) % 2 == 0
    parted = after_quotes & F.when(F.col("_top") == "[", F.col("_after") <= 1).otherwise(
        (F.col("_after") <= 1) | ((F.col("_after") == 2) & (F.col("_second") == "["))
    )
    ended = ordered_scan(held, ["file"], "pos", {"unit": Sum(parted.cast("bigint"), inclusive=False)}).withColumn("unit", F.coalesce("unit", F.lit(0)))
    first = F.min_by(F.struct("_before", "_top"), "pos").alias("_f")
    units = ended.groupBy("file", "unit").agg(
        first, F.max("last").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "").alias("text")
    )
    return units.select("file", "unit", F.col("_f._before").cast("int").alias("depth"), F.coalesce(F.col("_f._top") == "[", F.lit(False)).alias("listed"), "last", "text")


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("unit"), F.lit(0).alias("depth"), F.lit(False).alias("listed"), F.lit(True).alias("last"), F.col("value").alias("text"),
    )


def read_cases(spark: SparkSession, path: str, mode: str = "builder", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Records of one or more envelope files with ``file`` and ``input_pos`` (1-based in its file).

    The builder takes the first of items/records/list that holds something; the loader takes
    ``items`` if the key is there, otherwise ``case_items``, and accepts ``id`` for ``case_id``.
    To the builder a document that is neither object nor array, records that are no array and
    an entry that is no object are errors; the loader passes over entries that are no objects
    and takes an object or a text in the records' place as holding none. A text that is no
    JSON is an error to both. Numbers and truth values become text as each mode writes them.

    A file of up to ``whole_bytes`` is parsed at once. A larger one is cut behind its records,
    so that one large array is read by many tasks.
    """
    return _chosen(_file_events(spark, path, mode, whole_bytes), mode)


def _file_events(spark: SparkSession, path: str, mode: str, whole_bytes: int) -> DataFrame:
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    some = sizes.agg(F.max("length").alias("most"), F.collect_list(F.when(F.col("length") <= whole_bytes, F.col("path"))).alias("small"), F.collect_list(F.when(F.col("length") > whole_bytes, F.col("path"))).alias("large")).first()
    units = None
    for paths, reader in ((some["small"], _whole_files), (some["large"], _units)):
        for one in ([paths] if paths else []):
            part = reader(spark, one)
            units = part if units is None else units.unionByName(part)
    return spark.createDataFrame([], _EVENT) if units is None else pinned(_events(units, mode))


def _refuse(rows: DataFrame, complaint: Column) -> None:
    kept = ["file", "input_pos"] if "input_pos" in rows.columns else ["file"]
    found = rows.select(*kept, complaint.alias("complaint")).where("complaint IS NOT NULL").orderBy(*kept).first()
    if found:
        raise ValueError(f"{found['file']}: {found['complaint']}")


def parse_envelopes(rows: DataFrame, key: str, text: str, mode: str = "builder") -> DataFrame:
    """The records of envelopes that are texts of a column, as read_cases() gives those of files, with ``key`` in place of the file.

    A text that is null holds no records. Keys are unique.
    """
    schema = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("input_pos", T.LongType()), T.StructField("complaint", T.StringType()), *_RECORD
    ])
    kinds = {"file": pa.string(), "input_pos": pa.int64(), "complaint": pa.string()} | _ARROW_TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: list[dict] = []
            for i in range(batch.num_rows):
                for record in _told_records(batch.column(1)[i].as_py(), mode):
                    told.append({"file": batch.column(0)[i].as_py(), **record})
                    if len(told) == 1024:
                        yield _batch(told, kinds)
                        told = []
            if told:
                yield _batch(told, kinds)

    # an envelope stands in one row, so its records are chosen where it is parsed
    units = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("file"), F.col(text).alias("text"))
    told = pinned(units.mapInArrow(run, schema)).where("file IS NOT NULL")
    _refuse(told.where("input_pos IS NULL").drop("input_pos"), F.col("complaint"))
    _refuse(told, F.col("complaint"))
    if mode == "loader":
        told = told.withColumn("case_id", F.coalesce("case_id", "_id"))
    return told.select(F.col("file").cast(rows.schema[key].dataType).alias(key), "input_pos", *CORE_FIELDS)


def _told_records(text: str, mode: str) -> Iterator[dict]:
    """The records of a whole envelope that the mode takes, typed and numbered, or what is wrong with it."""
    names = BUILDER_KEYS if mode == "builder" else LOADER_KEYS
    best, taken, entries = None, None, []
    found = []
    for kind, key, value in json_events(text.removeprefix("\ufeff"), 0, False, True):
        if kind == "element":
            entries.append(value)
            continue
        # a document that is an array has no key
        order = 1 if key is None else names.index(key) + 1 if key in names else 0
        entries = []
        if order:
            found.append((order, kind, key, "list" if kind == "open" else type(value).__name__, bool(value), entries))
    for order, kind, key, type_, truthy, held in found:
        full = truthy or bool(held)
        if (mode == "loader" or full or key is None) and (best is None or order <= best[0]):
            best, taken = (order, kind, type_), held
    if best is None:
        return
    _, kind, type_ = best
    complaint = None
    if mode == "builder":
        complaint = "source must be a JSON object or array" if kind == "scalar" else "items/records/list must be an array" if type_ != "list" else None
    elif kind == "scalar" or type_ not in ("list", "dict", "str"):
        complaint = "items must be an array"
    if complaint:
        yield {"complaint": complaint}
        return
    for place, value in enumerate(taken, 1):
        if isinstance(value, dict):
            yield {"input_pos": place, **typed_record(value, mode)}
        elif mode == "builder":
            yield {"input_pos": place, "complaint": f"record {place} is no JSON object"}


def _placed(events: DataFrame) -> DataFrame:
    """Events with ``_array``, the array opened last before them, in their unit or in an earlier one."""
    per_unit = events.groupBy("file", "unit").agg(
        F.count(F.when(F.col("kind") == "element", 1)).alias("_n"), F.max_by(F.struct("ord", "key"), F.when(F.col("kind") == "open", F.col("ord"))).alias("_opened")
    )
    opened = F.when(F.col("_opened").isNotNull(), F.struct(F.col("unit").alias("u"), F.col("_opened.ord").alias("o"), F.col("_opened.key").alias("key")))
    placed = ordered_scan(per_unit, ["file"], "unit", {"_array": Last(opened)}).select("file", "unit", "_array")
    inside = Window.partitionBy("file", "unit").orderBy("ord")
    here = F.last(F.when(F.col("kind") == "open", F.struct(F.col("unit").alias("u"), F.col("ord").alias("o"), "key")), ignorenulls=True).over(inside)
    return events.join(placed, ["file", "unit"]).withColumn("_array", F.coalesce(here, "_array"))


def _chosen(events: DataFrame, mode: str) -> DataFrame:
    """The typed records of the array that the mode takes, numbered."""
    told = _placed(events)
    arrays = told.where("kind = 'element'").groupBy("file", "_array").agg(F.count(F.lit(1)).alias("n"))
    listed = told.where("kind = 'open'").select("file", "_array").join(arrays, ["file", "_array"], "left").select(
        "file", F.col("_array.key").alias("key"), "_array", (F.col("n") > 0).alias("full"), F.lit("list").alias("type"), F.lit("open").alias("kind")
    )
    others = told.where("kind IN ('value', 'scalar')").select("file", "key", F.lit(None).cast(told.schema["_array"].dataType).alias("_array"), F.col("truthy").alias("full"), "type", "kind")
    names = BUILDER_KEYS if mode == "builder" else LOADER_KEYS
    order = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.coalesce("key", F.lit(""))), F.lit(0))
    known = listed.unionByName(others).withColumn("full", F.coalesce("full", F.lit(False)))
    # a document that is an array has no key
    known = known.withColumn("_order", F.when(F.col("key").isNull(), F.lit(1)).otherwise(order)).where("_order > 0")
    if mode == "builder":
        known = known.where(F.col("full") | F.col("key").isNull())
    best = known.groupBy("file").agg(F.min_by(F.struct("_array", "type", "kind"), "_order").alias("b"))
    wrong = F.col("b.kind") == "scalar"
    if mode == "builder":
        complaint = F.when(wrong, "source must be a JSON object or array").when(F.col("b.type") != "list", "items/records/list must be an array")
    else:
        complaint = F.when(wrong | ~F.col("b.type").isin("list", "dict", "str"), "items must be an array")
    _refuse(best, complaint)
    best = best.select("file", F.col("b._array").alias("_taken"))
    rows = told.where("kind = 'element'").drop("key").join(best, "file")
    rows = rows.where(F.col("_array") == F.col("_taken"))
    counts = rows.groupBy("file", "unit").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_least"))
    before = ordered_scan(counts, ["file"], "unit", {"_before": Sum(F.col("_n"), inclusive=False)}).select("file", "unit", "_least", F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered_rows = rows.join(before, ["file", "unit"]).withColumn("input_pos", F.col("_before") + F.col("ord") - F.col("_least") + 1)
    if mode == "builder":
        _refuse(numbered_rows, F.when(F.col("type") != "dict", F.concat(F.lit("record "), F.col("input_pos").cast("string"), F.lit(" is no JSON object"))))
    else:
        numbered_rows = numbered_rows.where("type = 'dict'").withColumn("case_id", F.coalesce("case_id", "_id"))
    return numbered_rows.select("file", "input_pos", *CORE_FIELDS)


def read_case_lines(spark: SparkSession, path: str, mode: str = "builder") -> DataFrame:
    """One record per line with ``file`` and ``input_pos``, counted over the lines that aren't blank; a line that is no JSON object lands in ``_corrupt_record``.

    Positions equal those of an envelope with the same records.
    """
    lines = placed_lines(spark, path)
    filled = F.trim("value") != ""
    lines = ordered_scan(lines, ["file"], "pos", {"input_pos": Sum(filled.cast("bigint"))}).where(filled)
    schema = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("input_pos", T.LongType()), T.StructField("_corrupt_record", T.StringType()), *_RECORD
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(2):
                line = line.as_py()
                try:
                    value = json.loads(line.removeprefix("\ufeff"))
                except ValueError:
                    value = None
                rows.append(typed_record(value, mode) if isinstance(value, dict) else {"_corrupt_record": line})
            kinds = {"_corrupt_record": pa.string()} | _ARROW_TYPES
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()]], names=["file", "input_pos", *kinds]
            )

    cases = lines.select("file", "input_pos", "value").mapInArrow(run, schema)
    if mode == "loader":
        cases = cases.withColumn("case_id", F.coalesce("case_id", "_id"))
    return cases.drop("_id")


def read_envelopes(spark: SparkSession, path: str, mode: str = "loader", whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, categories, meta) of envelope files, one row of meta for each.

    Categories that an envelope lists are taken as they stand: file, pos, id (the position if it
    has none), name, item_count. Meta: file, schema_version, generated_at, source. The builder
    writes version 4 and no time whatever the file says and names the file as the source if it
    names none; the loader takes what is there, and version 1 where there is none.
    """
    events = _file_events(spark, path, mode, whole_bytes)
    told = _placed(events)
    listed = told.where("kind = 'element' AND raw IS NOT NULL AND _array.key = 'categories'")
    row = F.from_json("raw", "id string, name string, item_count string")
    order = Window.partitionBy("file").orderBy("unit", "ord")
    categories = listed.withColumn("c", row).withColumn("pos", F.row_number().over(order)).select(
        "file", "pos", F.coalesce(F.col("c.id").cast("int"), F.col("pos")).alias("id"), F.coalesce("c.name", F.lit("")).alias("name"),
        F.coalesce(F.col("c.item_count").cast("bigint"), F.lit(0)).alias("item_count"),
    )
    plain = F.regexp_replace("raw", '^"|"$', "")
    given = {k: F.max(F.when((F.col("kind") == "value") & (F.col("key") == k) & F.col("truthy"), v)) for k, v in
             {"schema_version": plain, "generated_at": plain, "source": F.col("raw")}.items()}
    meta = events.groupBy("file").agg(*[v.alias(k) for k, v in given.items()])
    if mode == "builder":
        named = F.to_json(F.struct(F.element_at(F.split("file", "/"), -1).alias("name")))
        meta = meta.select("file", F.lit(4).alias("schema_version"), F.lit("").alias("generated_at"), F.coalesce("source", named).alias("source"))
    else:
        meta = meta.select(
            "file", F.coalesce(F.col("schema_version").cast("int"), F.lit(1)).alias("schema_version"),
            F.coalesce("generated_at", F.lit("")).alias("generated_at"), F.coalesce("source", F.lit("{}")).alias("source"),
        )
    return _chosen(events, mode), categories, meta


def write_catalogue(cases: DataFrame, categories: DataFrame, meta: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").parquet(f"{path}/cases")
    categories.write.mode("overwrite").parquet(f"{path}/categories")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.read.parquet(f"{path}/cases"),
        spark.read.schema(CATEGORY_SCHEMA).parquet(f"{path}/categories"),
        spark.read.parquet(f"{path}/meta"),
    )


def dataset_meta(spark: SparkSession, source: str, generated_at: str = "", version: int = 4) -> DataFrame:
    return spark.range(1).select(
        F.lit(version).alias("schema_version"),
        F.lit(generated_at).alias("generated_at"),
        F.create_map(F.lit("name"), F.lit(source)).alias("source"),
    )
