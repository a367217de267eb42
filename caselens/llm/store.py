"""Written intermediates in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, shuffles_freed


class Scratch:
    """Tables of one job in the shared folder; those the result doesn't read are dropped on the way.

    A written table cuts the lineage: an executor that is lost costs a read of files, and
    the shuffle files of the finished step are removed instead of lying there to the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self._paths)}"
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self._paths[len(self._paths)] = path
        read._scratch_path = path  # noqa: SLF001
        return read

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)  # noqa: SLF001
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
