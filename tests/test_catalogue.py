import json
import random

import pytest
from pyspark.sql import functions as F

from caselens.functions.text import line_text, multi_values, norm, shorten
from caselens.operators import catalogue as op
from caselens.operators.build import build_catalogue, refresh_index
from caselens.schema import CORE_FIELDS, REQUIRED_FIELDS
from caselens.sources.cases import dataset_meta, read_case_lines, read_cases, read_catalogue, read_envelopes, write_catalogue
from caselens.sources.index import read_index

RECORD = {
    "case_id": "FZ-001", "title": "冒充客服退款", "summary": "摘要\r\n第二行", "judgment_reason": "原因",
    "risk_signals": "信号", "risk_level": "高", "prevention_advice": "建议", "source_name": "来源",
    "entry_channels": ["电话", " 电话 ", "微信"], "ccl2023_category": "冒充电商物流客服类", "unknown": 1,
}


def write(path, payload, bom=False):
    path.write_text(("\ufeff" if bom else "") + json.dumps(payload, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_builder_reads_every_envelope(spark, tmp_path):
    second = {**RECORD, "case_id": "FZ-002"}
    cases = {
        "array": [RECORD, second],
        "items": {"items": [RECORD, second]},
        "records": {"items": [], "records": [RECORD, second]},
        "list": {"list": [RECORD, second], "schema_version": 4},
    }
    for name, payload in cases.items():
        rows = read_cases(spark, write(tmp_path / f"{name}.json", payload, bom=name == "items"))
        clean = op.normalize_cases(rows, order="input_pos")
        assert [r.case_id for r in clean.orderBy("input_pos").collect()] == ["FZ-001", "FZ-002"], name


def test_loader_prefers_items_and_skips_foreign_entries(spark, tmp_path):
    path = write(tmp_path / "a.json", {"case_items": [RECORD, "text", None]})
    assert read_cases(spark, path, mode="loader").count() == 1
    path = write(tmp_path / "b.json", {"items": [], "case_items": [RECORD]})
    assert read_cases(spark, path, mode="loader").count() == 0


def test_a_scalar_document_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="JSON object or array"):
        read_cases(spark, write(tmp_path / "x.json", 5)).collect()


@pytest.mark.parametrize("mode", ["builder", "loader"])
def test_a_broken_document_is_an_error(spark, tmp_path, mode):
    path = tmp_path / "x.json"
    path.write_text('{"items": [{"case_id": "FZ-001"}', encoding="utf-8")
    with pytest.raises(Exception, match="not valid JSON"):
        read_cases(spark, str(path), mode=mode).collect()


def test_record_keeps_31_fields_in_order(spark, tmp_path):
    rows = op.normalize_cases(read_cases(spark, write(tmp_path / "a.json", [RECORD])))
    row = rows.first()
    assert tuple(rows.columns) == CORE_FIELDS and len(CORE_FIELDS) == 31
    assert row.summary == "摘要\n第二行"
    assert row.entry_channels == ["电话", "微信"]
    assert row.remark == "" and row.tags == []
    summary = op.category_summary(rows).collect()
    assert [tuple(r) for r in summary] == [(1, "冒充电商物流客服类", 1)]


def test_loader_list_rule(spark):
    raw = spark.createDataFrame([(" a;b ", [" x ", "", "x"])], "tags string, key_methods array<string>")
    row = op.normalize_cases(raw, mode="loader").first()
    assert row.tags == [" a;b "] and row.key_methods == ["x", "x"]
    row = op.normalize_cases(raw).first()
    assert row.tags == ["a", "b"] and row.key_methods == ["x"]


def test_surrogate_ids_rejects_and_duplicates(spark):
    raw = spark.createDataFrame(
        [(5, "", "t"), (9, "A", "t"), (12, "", ""), (13, "A", "t")], "pos bigint, case_id string, title string"
    )
    rows = op.normalize_cases(raw, order="pos")
    assert [r.case_id for r in rows.orderBy("pos").collect()] == ["FZ-001", "A", "FZ-003", "A"]
    assert [tuple(r) for r in op.duplicate_ids(rows).collect()] == [("A", 2)]
    good, bad = op.split_rejects(rows)
    assert good.count() == 0
    assert set(bad.where("pos = 12").first().missing) == set(REQUIRED_FIELDS) - {"case_id"}


def test_catalogue_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("FZ-1", "t", ["a"])], "case_id string, title string, tags array<string>")
    cases = op.normalize_cases(raw)
    categories = op.category_summary(cases).withColumn("id", F.col("id").cast("int"))
    write_catalogue(cases, categories, dataset_meta(spark, "unit"), str(tmp_path / "out"))
    back, names, meta = read_catalogue(spark, str(tmp_path / "out"))
    assert back.first() == cases.first()
    assert names.first().name == "未分类"
    assert meta.first().source == {"name": "unit"}


def test_case_lines_keep_bad_lines_apart(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text(json.dumps(RECORD, ensure_ascii=False) + "\n{broken\n", encoding="utf-8")
    rows = read_case_lines(spark, str(path)).cache()
    assert [r.input_pos for r in rows.where("_corrupt_record IS NOT NULL").collect()] == [2]


def test_records_that_are_no_array_and_entries_that_are_no_objects_are_errors_to_the_builder(spark, tmp_path):
    for payload in ({"items": {"a": 1}}, {"items": "text"}, {"items": [], "records": 5}):
        with pytest.raises(ValueError, match="must be an array"):
            read_cases(spark, write(tmp_path / "x.json", payload)).collect()
    for entry in ("text", None, 5, ["x"]):
        with pytest.raises(ValueError, match="record 2 is no JSON object"):
            read_cases(spark, write(tmp_path / "x.json", {"list": [RECORD, entry]})).collect()
    assert read_cases(spark, write(tmp_path / "x.json", {"items": {}, "list": [RECORD]})).count() == 1
    for payload in ({"items": {"a": 1}, "case_items": [RECORD]}, {"items": "text"}, {"records": [RECORD]}):
        assert read_cases(spark, write(tmp_path / "x.json", payload), mode="loader").count() == 0
    with pytest.raises(ValueError, match="must be an array"):
        read_cases(spark, write(tmp_path / "x.json", {"items": None}), mode="loader").collect()


def test_truth_values_and_numbers_are_written_as_each_mode_writes_them(spark, tmp_path):
    record = {"case_id": 0, "id": "L", "title": True, "summary": False, "loss_occurred": 0, "remark": 1.50, "publish_date": 1e22, "victim_group": 0.0001,
              "tags": [True, None, 0, 1.0], "loss_type": False, "law_basis_ids": 12}
    path = write(tmp_path / "t.json", [record])
    row = op.normalize_cases(read_cases(spark, path)).first()
    assert (row.case_id, row.title, row.summary, row.loss_occurred, row.remark, row.publish_date, row.victim_group) == ("0", "True", "False", "0", "1.5", "1e+22", "0.0001")
    assert (row.tags, row.loss_type, row.law_basis_ids) == (["True", "0", "1.0"], ["False"], ["12"])
    row = op.normalize_cases(read_cases(spark, path, mode="loader"), mode="loader").first()
    assert (row.case_id, row.title, row.summary, row.loss_occurred) == ("", "True", "", "")
    assert (row.tags, row.loss_type, row.law_basis_ids) == (["True", "None", "0", "1.0"], ["False"], ["12"])


def hard_records(n):
    rng = random.Random(n)
    texts = ['a "quoted" }', "{[", "]}}", "\\", 'x\\"}', "line\n}", "中文}", "}" * 30, ""]
    return [{**RECORD, "case_id": f"R{i}", "title": rng.choice(texts), "remark": "".join(rng.choice(texts) for _ in range(5)), "nested": {"a": [{"b": rng.choice(texts)}, {}]}} for i in range(n)]


@pytest.mark.parametrize("bom", [False, True])
def test_a_large_array_is_cut_behind_its_records(spark, tmp_path, bom):
    records = hard_records(300)
    want = [(r["case_id"], r["title"], r["remark"]) for r in records]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "24k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        envelopes = {
            "a": records, "b": {"source": {"name": "}", "x": {"y": [{}]}}, "records": [], "items": records, "list": [{}], "end": 1},
            "c": {"case_items": [{"case_id": "no"}], "items": records, "categories": [{"id": 1}, {"id": 2}]},
        }
        for name, modes in {"b": ("builder",)}.items() if bom else {"a": ("loader",), "b": ("builder", "loader"), "c": ("builder",)}.items():
            path = write(tmp_path / f"{name}.json", envelopes[name], bom)
            for mode in modes:
                rows = read_cases(spark, path, mode, whole_bytes=0)
                got = rows.orderBy("input_pos").select("input_pos", "case_id", "title", "remark").collect()
                assert [tuple(r)[1:] for r in got] == [(a, b or None if mode == "loader" else b, c or None if mode == "loader" else c) for a, b, c in want], (name, mode)
                assert [r.input_pos for r in got] == list(range(1, 301))
        tasks = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        assert tasks > 5
        mixed = write(tmp_path / "m.json", [1, *records[:3], "}", None, [{}], *records[3:6], {}, 7], bom)
        got = read_cases(spark, mixed, "loader", whole_bytes=0).orderBy("input_pos").collect()
        assert [(r.input_pos, r.case_id) for r in got] == [*((i, r["case_id"]) for i, r in zip((2, 3, 4, 8, 9, 10), records, strict=False)), (11, None)]
        with pytest.raises(ValueError, match="record 1 is no JSON object"):
            read_cases(spark, mixed, whole_bytes=0)
        for text in ('[{"a":1},', '[{"a":1}}', '{"items":[{"a":"}]}', '[{"a":1}] x', '[{"a":}]'):
            (tmp_path / "bad.json").write_text(text, encoding="utf-8")
            with pytest.raises(Exception, match="not valid JSON"):
                read_cases(spark, str(tmp_path / "bad.json"), whole_bytes=0).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_like_the_envelope_over_many_blocks(spark, tmp_path):
    records = hard_records(400)
    lines = "".join(json.dumps(r, ensure_ascii=False) + ("\n \n" if i % 7 == 0 else "\n") for i, r in enumerate(records))
    (tmp_path / "l.jsonl").write_text(lines, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "24k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_case_lines(spark, str(tmp_path / "l.jsonl")).orderBy("input_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = read_cases(spark, write(tmp_path / "l.json", records)).orderBy("input_pos").collect()
    assert [(r.input_pos, r.case_id, r.title, r.tags) for r in got] == [(r.input_pos, r.case_id, r.title, r.tags) for r in whole]


def test_facets_order(spark):
    raw = spark.createDataFrame(
        [("a", "中", ["微信", "电话"]), ("b", "极高", ["电话"]), ("c", "特别", []), ("d", "高", [])],
        "case_id string, risk_level string, entry_channels array<string>",
    )
    rows = op.facet_metadata(op.normalize_cases(raw)).orderBy("kind", "pos").collect()
    pick = lambda kind: [r.value for r in rows if r.kind == kind]
    assert pick("risk_level") == ["极高", "高", "中", "特别"]
    assert pick("entry_channel") == ["微信", "电话"]
    assert pick("item_count") == ["4"] and pick("category_count") == ["0"]


def test_text_rules(spark):
    import textwrap

    samples = [
        "a  b　c\t\n d ", "20 Han 字" * 3, "字" * 40, "alpha beta-gamma delta", "well-known half-baked re-use",
        "x " * 30, "short", "semi-automatic", "",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    for width in (10, 14, 22):
        rows = df.select("i", shorten(norm("s"), width).alias("cut")).orderBy("i").collect()
        for row, sample in zip(rows, samples):
            clean = " ".join(sample.replace(" ", " ").split())
            assert row.cut == textwrap.shorten(clean, width=width, placeholder="..."), (sample, width)
    row = spark.sql("SELECT '\\r\\n a \\r b ' AS s, ' x ; y；x;;' AS v").select(
        line_text("s").alias("s"), multi_values("v").alias("v")
    ).first()
    assert row.s == "a \n b" and row.v == ["x", "y"]


def test_multi_value_fields_may_be_text_or_list(spark, tmp_path):
    payload = [{"id": "L1", "tags": "a；b;a", "key_methods": ["x", 5]}]
    path = write(tmp_path / "t.json", payload)
    row = op.normalize_cases(read_cases(spark, path)).first()
    assert row.tags == ["a", "b"] and row.key_methods == ["x", "5"] and row.case_id == ""
    row = op.normalize_cases(read_cases(spark, path, mode="loader"), mode="loader").first()
    assert row.tags == ["a；b;a"] and row.case_id == "L1"


def full_record(i, **more):
    return {**RECORD, "case_id": f"FZ-{i:03d}", **more}


def test_the_catalogue_is_built_only_from_sound_records(spark, tmp_path):
    target = str(tmp_path / "out")
    path = write(tmp_path / "a.json", {"source": {"name": "unit"}, "items": [full_record(1), full_record(2, ccl2023_category="", official_category=["甲", "乙"])], "categories": [{"name": "x"}]})
    assert build_catalogue(spark, path, target).count() == 2
    cases, categories, meta = read_catalogue(spark, target)
    assert [(r.id, r.name, r.item_count) for r in categories.orderBy("id").collect()] == [(1, "冒充电商物流客服类", 1), (2, "甲", 1)]
    assert tuple(cases.columns) == CORE_FIELDS and tuple(meta.first()) == (4, "", '{"name": "unit"}')
    for records, message in (([full_record(1), full_record(2, title="")], "FZ-002 missing required fields: title"), ([full_record(1), full_record(1)], "duplicate case_id values: FZ-001")):
        with pytest.raises(ValueError, match=message):
            build_catalogue(spark, write(tmp_path / "b.json", records), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_stored_categories_and_header_win_in_the_loader(spark, tmp_path):
    path = write(tmp_path / "a.json", {
        "schema_version": 3, "generated_at": "2026-01-02", "source": {"name": "n"}, "items": [full_record(1)],
        "categories": [{"id": 7, "name": "甲", "item_count": 5}, {"name": "乙"}],
    })
    cases, categories, meta = read_envelopes(spark, path)
    assert cases.count() == 1 and [tuple(r)[1:] for r in categories.orderBy("pos").collect()] == [(1, 7, "甲", 5), (2, 2, "乙", 0)]
    assert tuple(meta.first())[1:] == (3, "2026-01-02", '{"name": "n"}')
    _, none, meta = read_envelopes(spark, write(tmp_path / "b.json", [full_record(1)]))
    assert none.count() == 0 and tuple(meta.first())[1:] == (1, "", "{}")
    _, _, meta = read_envelopes(spark, write(tmp_path / "c.json", [full_record(1)]), "builder")
    assert tuple(meta.first())[1:] == (4, "", '{"name":"c.json"}')


def test_an_index_of_another_model_or_data_set_is_not_gone_on_with(spark, tmp_path):
    path = str(tmp_path / "index")
    items = spark.createDataFrame([(f"i{n}", f"text {n}") for n in range(5)], "item_id string, text string")
    now = spark.createDataFrame([(4, "", 5)], "schema_version int, generated_at string, item_count bigint")
    assert refresh_index(items.limit(3), now, path, "item_id", "text", model="m").count() == 0
    assert refresh_index(items, now, path, "item_id", "text", model="m").count() == 0
    vectors, meta = read_index(spark, path)
    assert vectors.count() == 5 and meta.first().dimensions == 64
    for model, data, message in (("n", now, "other model"), ("m", now.withColumn("generated_at", F.lit("later")), "other dataset")):
        with pytest.raises(ValueError, match=message):
            refresh_index(items, data, path, "item_id", "text", model=model)
    assert refresh_index(items, now, path, "item_id", "text", model="n", resume=False).count() == 0


@pytest.mark.parametrize("mode", ["builder", "loader"])
def test_envelopes_of_a_column_are_read_as_files_are_without_a_shuffle(spark, tmp_path, mode):
    from caselens.sources.cases import parse_envelopes, read_cases

    texts = [
        '{"items":[],"records":[{"case_id":"a"},{"id":"b"}],"list":[{"case_id":"c"}]}', '[{"case_id":"d","tags":["x",null]},{"id":"e"}]',
        '﻿{"schema_version":4,"items":[{"case_id":"f"}],"case_items":[{"case_id":"g"}]}', '{"case_items":[{"id":"h"}]}', "{}", "[]",
    ]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
    shown = lambda rows: sorted((int(r.at), r.input_pos, r.case_id, r.tags) for r in rows.collect())
    want = shown(read_cases(spark, str(tmp_path), mode).withColumn("at", F.regexp_extract("file", r"(\d+)\.json", 1)))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])] + [(None, "[]")], "k long, envelope string")
    got = parse_envelopes(rows, "k", "envelope", mode)
    assert want and shown(got.withColumn("at", F.col("k"))) == want
    assert "Exchange" not in got._jdf.queryExecution().toString()
    bad = {"builder": ('{"items":{"x":1}}', "must be an array"), "loader": ("3", "must be an array")}[mode]
    with pytest.raises(ValueError, match=bad[1]):
        parse_envelopes(spark.createDataFrame([(7, bad[0])], "k long, envelope string"), "k", "envelope", mode)
    if mode == "builder":
        with pytest.raises(ValueError, match="7: record 2 is no JSON object"):
            parse_envelopes(spark.createDataFrame([(7, "[{},5]")], "k long, envelope string"), "k", "envelope", mode)
