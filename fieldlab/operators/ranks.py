"""Positions in an order that is total, exact at any size and never taken in one task.

Rows are range-partitioned by their sort key and written once, with their
partition and their place in it, to the folder that all executors share. What
is counted per partition and what is numbered by it are then the same rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places within a partition are the lower bits of Spark's increasing ids.
_PLACE_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fieldlab-"))
    return spark.conf.get("spark.checkpoint.dir")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: Sequence[Column | str], out: str = "position", *, by: str | Sequence[str] = ()) -> DataFrame:
    """Adds `out`: the position from 0 in the given order, within the groups of `by` if there are any.

    order: columns or expressions that together tell all rows apart. Groups of
    any size spread over the tasks that their rows fall to. Nulls come first;
    a null in `by` is a group.
    """
    groups = [by] if isinstance(by, str) else list(by)
    keys = {f"_k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.withColumns(keys).repartitionByRange(parts, *groups, *keys).sortWithinPartitions(*groups, *keys)
    placed = kept(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop(*keys), "numbered")
    # of each group its first place and its rows in each partition: a row per group and partition
    sizes = placed.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_n") - F.col("_first")
    names = {f"_g{i}": g for i, g in enumerate(groups)}
    offsets = sizes.select(F.col("_part").alias("_p"), *[F.col(g).alias(n) for n, g in names.items()], before.alias("_before"))
    on = F.col("_part") == F.col("_p")
    for n, g in names.items():
        on = on & F.col(g).eqNullSafe(F.col(n))
    return placed.join(offsets, on).select(*rows.columns, (F.col("_at") + F.col("_before")).alias(out))
