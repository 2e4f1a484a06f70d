"""Listings of files and class trees, and tables of what is already done."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S


def expand_path(path: str) -> str:
    """~ and variables filled in; wildcards are left to Spark's readers."""
    return os.path.expandvars(os.path.expanduser(path))


def list_files(spark: SparkSession, root: str | Sequence[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of files whose name matches the glob; contents are not read. Spark leaves out files of zero bytes."""
    roots = [root] if isinstance(root, str) else list(root)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load([expand_path(r) for r in roots]).select("path", "length", F.col("modificationTime").alias("modified"))


def list_children(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return list_files(spark, f"{folder.rstrip('/')}/*", pattern, recursive=False)


def class_samples(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds class_name, the last directory, for image files outside dot-directories."""
    visible = ~F.rlike(F.regexp_replace(F.col(path), r"^[a-z]+:", ""), F.lit(r"/\.[^/]+/"))
    images = files.where(S.is_image_file(path) & visible)
    return images.withColumn("class_name", F.regexp_extract(S.directory(path), r"([^/]*)$", 1))


def class_directories(samples: DataFrame, path: str = "path") -> DataFrame:
    """(class_name, directories): a class may have several."""
    return samples.groupBy("class_name").agg(F.array_sort(F.collect_set(S.directory(path))).alias("directories"))


def class_names(samples: DataFrame, cls: str = "class_name") -> DataFrame:
    return samples.select(cls).distinct().orderBy(S.natural_key(cls))


def labelled_split(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds class_name and split, the directory above it: <root>/<split>/<class>/<file>."""
    return class_samples(files, path).withColumn("split", F.regexp_extract(F.col(path), r"([^/]+)/[^/]+/[^/]+$", 1))


def with_output_stem(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds class_name and stem: what an output of the file is called."""
    return files.withColumn("class_name", F.regexp_extract(S.directory(path), r"([^/]*)$", 1)).withColumn("stem", S.stem(path))
