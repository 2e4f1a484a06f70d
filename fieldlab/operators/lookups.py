"""Joins with a sample index or another catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S


def lookup_samples(rows: DataFrame, samples: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """Adds path, class_name and class_id of each row's sample; rows of unknown samples keep nulls."""
    return rows.join(samples.select(sample_id, "path", "class_name", "class_id"), sample_id, "left")


def requested_samples(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """The samples of an explicit list of (class_name, file_name)."""
    named = samples.withColumn("file_name", S.base_name("path"))
    return named.join(pairs, ["class_name", "file_name"], "left_semi").drop("file_name")


def reconcile(catalog: DataFrame, files: DataFrame, catalog_name: str, file_name: str) -> DataFrame:
    """(name, in_catalog, in_files) of all names after cleaning: what is missing on either side."""
    left = catalog.select(S.clean_filename(catalog_name).alias("name")).distinct().withColumn("in_catalog", F.lit(True))
    right = files.select(S.clean_filename(file_name).alias("name")).distinct().withColumn("in_files", F.lit(True))
    both = left.join(right, "name", "full_outer")
    return both.select("name", F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"), F.coalesce("in_files", F.lit(False)).alias("in_files"))


def ensemble_prediction(scores: Sequence[DataFrame], mapping: DataFrame, sample_id: str = "sample_id", column: str = "scores") -> DataFrame:
    """(sample_id, pred): the models' score vectors joined end to end, the best position mapped through (position, class_id)."""
    joined = scores[0].select(sample_id, F.col(column).alias("_s0"))
    for i, s in enumerate(scores[1:], 1):
        joined = joined.join(s.select(sample_id, F.col(column).alias(f"_s{i}")), sample_id)
    every = joined.select(sample_id, S.argmax(F.concat(*[f"_s{i}" for i in range(len(scores))])).alias("position"))
    return every.join(mapping, "position", "left").select(sample_id, F.col("class_id").alias("pred"))


def skip_existing(inputs: DataFrame, existing: DataFrame, overwrite: bool = False, on: Sequence[str] = ("class_name", "stem")) -> DataFrame:
    """Inputs without an output of their class and stem; all of them to overwrite."""
    return inputs if overwrite else inputs.join(existing.select(*on), list(on), "left_anti")


def retain_latest(artefacts: DataFrame, n: int, *, run: str | Sequence[str], order: Sequence[Column], salts: int = 16) -> DataFrame:
    """Adds `retained`: whether a row is among the newest n of its run by the given descending order.

    A run is first cut into `salts` parts: only the newest n of each part can
    be the run's, so no task sees more of a large run than a part of it.
    """
    from pyspark.sql import Window

    by = [run] if isinstance(run, str) else list(run)
    salted = artefacts.withColumn("_salt", F.pmod(F.xxhash64(*artefacts.columns), F.lit(salts)))
    first = salted.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)))
    near = first.where(F.col("_nth") <= n).withColumn("retained", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= n)
    return near.unionByName(first.where(F.col("_nth") > n).withColumn("retained", F.lit(False))).drop("_salt", "_nth")


def distinct_union(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """The distinct values of a column over several tables: all species, all roots."""
    out = tables[0].select(column)
    for t in tables[1:]:
        out = out.unionByName(t.select(column))
    return out.distinct()


def equal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): rows, with their multiplicity, that the other side lacks."""
    left = a.exceptAll(b.select(*a.columns)).agg(F.count(F.lit(1)).alias("only_a"))
    right = b.select(*a.columns).exceptAll(a).agg(F.count(F.lit(1)).alias("only_b"))
    return left.crossJoin(right)  # one row each


def cell_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Cells of two long-form matrices that differ: keys, left, right."""
    both = a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), list(keys), "full_outer")
    return both.where(F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > tolerance))
