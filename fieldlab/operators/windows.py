"""Overlapping windows over spectrograms and audio, as rows first: pixels and samples are cut afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """a // b for positive doubles as Python has it, also near multiples."""
    return F.bround((a - a % b) / b, 0).cast("int")


def spectrogram_windows(spectrograms: DataFrame, *, width: str = "width", duration: str = "duration", window_len: float = 5.0, skip: float = 2.0, least_columns: int = 256) -> DataFrame:
    """One row per snippet: index, start_column, columns, start_time, end_time.

    A column lasts duration / width seconds. Snippets start every skip seconds
    and have window_len seconds but at least least_columns columns; a tail
    that is too short is dropped, and so are recordings shorter than a window.
    """
    per = F.col(duration).cast("double") / F.col(width)
    rows = spectrograms.where(F.col(duration) >= window_len).withColumn("_per", per)
    rows = rows.withColumn("columns", F.greatest(F.lit(least_columns), floor_div(F.lit(float(window_len)), F.col("_per")))).withColumn("_hop", F.greatest(F.lit(1), floor_div(F.lit(float(skip)), F.col("_per"))))
    bound = F.least(floor_div(F.lit(1.0) + F.ceil(F.col(duration)) - float(skip), F.col("_per")), F.col(width).cast("int"))
    rows = rows.withColumn("_bound", bound).where("_bound > 0")
    each = rows.select(*spectrograms.columns, "columns", "_per", F.posexplode(F.sequence(F.lit(0), F.col("_bound") - 1, F.col("_hop"))).alias("index", "start_column"))
    inside = each.where(F.col("start_column") + F.col("columns") <= F.col(width))
    start = F.col("start_column") * F.col("_per")
    return inside.withColumn("start_time", start).withColumn("end_time", F.col("start_time") + F.col("columns") * F.col("_per")).drop("_per")


def audio_windows(audio: DataFrame, *, samples: str = "samples", sr: str = "sr", window_len: int = 5, hop: int = 1) -> DataFrame:
    """One row per window of whole seconds 0 .. floor(length) - window_len - 1: start_time and its samples."""
    seconds = F.floor(F.size(samples) / F.col(sr)).cast("int")
    last = seconds - window_len - 1
    rows = audio.where(last >= 0).withColumn("start_time", F.explode(F.sequence(F.lit(0), last, F.lit(hop))))
    return rows.withColumn(samples, F.slice(samples, (F.col("start_time") * F.col(sr) + 1).cast("int"), (F.lit(window_len) * F.col(sr)).cast("int")))


# ---- arrays as signals ------------------------------------------------------
def gain(samples: Column | str, db: Column | float) -> Column:
    factor = F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)
    return F.transform(F.col(samples) if isinstance(samples, str) else samples, lambda x: x.cast("double") * factor)


def time_shift(samples: Column | str, seconds: float | Column, sr: Column | int) -> Column:
    """The signal from `seconds` on, then its head; the length stays."""
    s = F.col(samples) if isinstance(samples, str) else samples
    rate = sr if isinstance(sr, Column) else F.lit(sr)
    n = F.pmod(F.floor((seconds if isinstance(seconds, Column) else F.lit(float(seconds))) * rate).cast("int"), F.greatest(F.size(s), F.lit(1)))
    return F.concat(F.slice(s, n + 1, F.size(s) - n), F.slice(s, 1, n))


def mask_stripe(samples: Column | str, start: int | Column, size: int | Column, fill: Column | None = None) -> Column:
    """Positions start .. start + size - 1 (from 0) filled, by default with the array's mean."""
    s = F.col(samples) if isinstance(samples, str) else samples
    mean = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(s)
    value = mean if fill is None else fill
    return F.transform(s, lambda x, i: F.when((i >= start) & (i < start + size), value).otherwise(x.cast("double")))
