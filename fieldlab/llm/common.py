"""What several operators of this subpackage share: tables, folders, text rules."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.operators.ranks import shared_folder

#: Fixed values of the text rules: ASCII white space separates words; only A-Z has a lower case.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a generated key, and its column's name, which no other column has. The key holds only once the rows are kept."""
    name = "row_key"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return df.withColumn(name, F.monotonically_increasing_id()), name


def by_value(module: str) -> None:
    """Task functions of the module travel inside the job, so executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, in local mode a temporary one."""
    return shared_folder(spark)


class Scratch:
    """Tables one query writes to the shared folder: they cut the lineage, so a lost executor costs only its running tasks."""

    def __init__(self, spark: SparkSession, query: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{query}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows as Parquet and returns the table read from there."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no result reads any more."""
        remove(self.spark, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
