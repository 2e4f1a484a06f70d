"""Annotation tables: tab-separated selections with a species and a mix of others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S

#: Columns of a selection table, in file order. Fixed values.
COLUMNS = (
    "Selection", "View", "Channel", "Begin Time (s)", "End Time (s)", "Low Freq (Hz)", "High Freq (Hz)",
    "species", "type", "number", "mix",
)
NUMBERS = ("Begin Time (s)", "End Time (s)", "Low Freq (Hz)", "High Freq (Hz)")


def read_selection_tables(spark: SparkSession, path: str | Sequence[str], ordered: bool = False) -> DataFrame:
    """One row per selection, if asked for sorted by file and begin time: numbers as doubles, mix as an array, intervals, path and recording_id."""
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, sep="\t", header=True, schema=schema)
    numbers = {c: F.col(f"`{c}`").try_cast("double") for c in NUMBERS}
    mix = F.filter(F.transform(F.split(F.coalesce("mix", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    typed = raw.withColumn("path", F.col("_metadata.file_path")).withColumns({**numbers, "mix": mix})
    interval = lambda a, b: F.struct(F.col(f"`{a}`").alias("low_val"), F.col(f"`{b}`").alias("high_val"))
    out = typed.withColumn("time_interval", interval("Begin Time (s)", "End Time (s)")).withColumn("freq_interval", interval("Low Freq (Hz)", "High Freq (Hz)"))
    out = out.withColumn("recording_id", S.recording_id("path"))
    return out.orderBy("path", "`Begin Time (s)`") if ordered else out
