"""The pipeline against its stages done by hand, and the queries' twins."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from caselens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, sf, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    rows = QUERIES[name](spark, sf)
    want = connection.execute(ORACLES[name]).to_arrow_table().select(rows.columns).to_pylist()
    key = lambda r: tuple(str(v) for v in r.values())
    assert sorted((r.asDict() for r in rows.collect()), key=key) == sorted(want, key=key)


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "and", "ha"], "fr": ["eau", "ou", "é", "tion"]}

    def prose(lang, n):
        return " ".join("".join(rng.choices(parts[lang], k=4)) + str(rng.randrange(10**6)) for _ in range(n))

    clean = [(i, prose(["en", "fr"][i % 2], 80), ["en", "fr"][i % 2]) for i in range(40)]
    passage = prose("en", 30)
    near = clean[4][1].split(" ")
    near[10] = "other"
    planted = [(100, "1234 5678", "en"), (101, None, "en"), (102, " ".join(near), "en"), (103, clean[6][1], "en"), (104, prose("en", 50) + " " + passage + " " + prose("en", 9), "en")]
    planted += [(105, clean[8][1] + "\n" + prose("en", 70), "en")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in clean + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in clean} | {105}
    # the repeated line of the last document is gone
    assert got[105] < len(re.findall(r"\S+", rows[-1][1])) * 8
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_near_stage_drops_a_copy_at_081(spark):
    def shingles(text):
        words = text.split(" ")
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rows = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(104)]
        # 81 of 100 shingles are in both: the first 85 words are the same
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:85]))]
        # under the threshold: 79 of 100
        rows += [(10 * k + 2, " ".join(f"u{w}" for w in words)), (10 * k + 3, " ".join(f"u{w}" for w in words[:83]))]
    sets = {i: shingles(t) for i, t in rows}
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) == 0.81 and len(sets[2] & sets[3]) / len(sets[2] | sets[3]) == 0.79
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, _ in rows if i % 10 != 1)
