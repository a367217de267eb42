"""Embedding index files: one vector table and a one-row header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize

INDEX_SCHEMA_VERSION = 2


def valid_vectors(rows: DataFrame, key: str = "item_id", vector: str = "embedding") -> DataFrame:
    """Rows with an id and a non-zero vector, normalised."""
    unit = rows.withColumn(vector, l2_normalize(vector))
    return unit.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (F.size(vector) > 0))


def dataset_lineage() -> Column:
    return F.struct(
        "schema_version", "generated_at", F.col("item_count").cast("bigint").alias("item_count")
    )


def index_meta(
    vectors: DataFrame, dataset: DataFrame, *, model: str, base_url: str = "", generated_at: str = "",
    vector: str = "embedding", key: str = "item_id", dimensions: int = 0,
) -> DataFrame:
    """One row: header fields plus the lineage of the data set it was built from. The
    dimensions are those given, or those of the first valid vector by its id."""
    named = key if key in vectors.columns else vectors.columns[0]
    first = F.min_by(F.size(vector), F.when(F.size(vector) > 0, F.col(named)))
    size = vectors.agg((F.lit(dimensions) if dimensions else first).cast("int").alias("dimensions"))
    lineage = dataset.select(dataset_lineage().alias("dataset"))
    one = size.unionByName(lineage, allowMissingColumns=True).agg(
        F.coalesce(F.max("dimensions"), F.lit(0)).alias("dimensions"), F.max("dataset").alias("dataset")
    )
    return one.select(
        F.lit(INDEX_SCHEMA_VERSION).alias("schema_version"), F.lit(generated_at).alias("generated_at"),
        F.lit(model).alias("model"), F.lit(base_url).alias("base_url"), "dimensions", "dataset",
    )


def write_index(vectors: DataFrame, meta: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid vectors and the header; a header without dimensions takes those of the first vector."""
    vectors, meta = valid_vectors(spark.read.parquet(f"{path}/vectors")), spark.read.parquet(f"{path}/meta")
    if meta.where("coalesce(dimensions, 0) = 0").isEmpty():
        return vectors, meta
    first = vectors.agg(F.min_by(F.size("embedding"), vectors.columns[0])).first()[0] or 0
    return vectors, meta.withColumn("dimensions", F.when(F.coalesce("dimensions", F.lit(0)) == 0, first).otherwise(F.col("dimensions")))
