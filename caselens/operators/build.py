"""Jobs that make the written tables: the catalogue from its source, the embedding index from the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pinned
from ..sources.cases import read_envelopes, write_catalogue
from ..sources.index import index_meta, read_index, write_index
from .catalogue import category_summary, duplicate_ids, normalize_cases, with_missing_fields
from .vectors import Embedder, build_index, hashed_embedder, index_staleness

#: Ids that an error names; it counts them all.
NAMED = 20


def build_catalogue(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Check the records of an envelope file and write cases, categories and meta; gives the cases back.

    A record without a required field, or two with one id, is an error, and nothing is
    written then. Categories are counted anew from the records.
    """
    raw, _, meta = read_envelopes(spark, source, "builder")
    cases = pinned(normalize_cases(raw, order="input_pos").withColumnRenamed("input_pos", "_pos"))
    wrong = with_missing_fields(cases).where(F.size("missing") > 0)
    first = wrong.orderBy("_pos").select("case_id", F.array_join("missing", ", ").alias("missing")).first()
    if first:
        raise ValueError(f"{first['case_id']} missing required fields: {first['missing']} ({wrong.count()} records)")
    twice = duplicate_ids(cases)
    ids = [r["case_id"] for r in twice.orderBy("case_id").limit(NAMED).collect()]
    if ids:
        raise ValueError(f"duplicate case_id values: {', '.join(ids)} ({twice.count()} ids)")
    cases = cases.drop("_pos")
    write_catalogue(cases, category_summary(cases).withColumn("id", F.col("id").cast("int")), meta.drop("file"), target)
    return cases


def refresh_index(
    items: DataFrame, dataset: DataFrame, path: str, key: str, text: str, *, model: str, embedder: Embedder = hashed_embedder,
    resume: bool = True, generated_at: str = "", base_url: str = "",
) -> DataFrame:
    """Embed what the index at ``path`` lacks and write it to ``path`` with its header; gives items still missing.

    An index of another model or another data set (``dataset``: schema_version, generated_at,
    item_count) is not gone on with: that is an error unless ``resume`` is off, which makes all
    vectors anew. Without an index there all are made.
    """
    spark = items.sparkSession
    existing, size = None, 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")  # noqa: SLF001
    if resume and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # noqa: SLF001
        vectors, meta = read_index(spark, path)
        status = index_staleness(meta, dataset, model).first()["status"]
        if status != "fresh":
            raise ValueError(f"the index at {path} is of {status.replace('_', ' ')}; build it anew with resume=False")
        existing, size = pinned(vectors), meta.first()["dimensions"]
    index, missing = build_index(items, key, text, embedder, existing=existing)
    missing = pinned(missing)
    header = pinned(index_meta(index, dataset, model=model, base_url=base_url, generated_at=generated_at, key=key, dimensions=size))
    write_index(index, header, path)
    return missing
