"""Filters that report what they leave out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S

#: Serial numbers that are kept by default: [50000, 70001) and [170000, 180001). Fixed values.
SERIAL_RANGES = ((50_000, 70_001), (170_000, 180_001))


def in_serial_ranges(path: Column | str, ranges: Sequence[tuple[int, int]] = SERIAL_RANGES) -> Column:
    """Whether the last '_' token of the file's stem is a number in one of the half-open ranges."""
    n = S.serial_number(path)
    out = F.lit(False)
    for low, high in ranges:
        out = out | ((n >= low) & (n < high))
    return F.coalesce(out, F.lit(False))


def cull_by_serial_range(files: DataFrame, path: str = "path", ranges: Sequence[tuple[int, int]] = SERIAL_RANGES) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected); rejected rows keep their columns, so byte sizes can be summed."""
    marked = files.withColumn("_kept", in_serial_ranges(path, ranges))
    return marked.where("_kept").drop("_kept"), marked.where("NOT _kept").drop("_kept")


def filter_recordings(recordings: DataFrame, *, length: str = "length", rating: str = "rating", seconds: tuple[float, float] = (5, 60), ratings: Sequence[str] = ("A", "B")) -> DataFrame:
    return recordings.where(S.minutes_seconds(length).between(*seconds) & F.col(rating).isin(*ratings))


def filter_tallies(predictions: DataFrame, step: int | None = None, phase: str | None = None, newest_first: bool = False) -> DataFrame:
    out = predictions
    if step is not None:
        out = out.where(F.col("step") == step)
    if phase is not None:
        out = out.where(F.col("phase") == phase)
    return out.orderBy(F.col("step").desc() if newest_first else F.col("step"))


def misclassified(predictions: DataFrame, samples: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(label, pred, name): the distinct file names of the samples taken for another class, a row each."""
    return predictions.where("pred <> label").join(samples.select(sample_id, S.base_name("path").alias("name")), sample_id).select("label", "pred", "name").distinct()


def select_by_species(recordings: DataFrame, requested: DataFrame, species: str = "phylo_name") -> tuple[DataFrame, DataFrame]:
    """(recordings of the requested species, requested species without any)."""
    return recordings.join(requested, species, "left_semi"), requested.join(recordings, species, "left_anti")


def well_defined(curves: DataFrame) -> DataFrame:
    """Classes whose precision, recall and F1 were defined at every threshold."""
    return curves.where(~(F.col("undef_prec") | F.col("undef_rec") | F.col("undef_f1")))
