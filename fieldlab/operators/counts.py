"""Class counts, weights and the sample index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S
from fieldlab.operators.ranks import numbered

KINDS = ("add_bg", "time_shift", "volume", "noise", "mask", "original")


def samples_per_class(samples: DataFrame, cls: str = "class_name") -> DataFrame:
    return samples.groupBy(cls).agg(F.count(F.lit(1)).alias("num_samples"))


def samples_per_class_and_kind(samples: DataFrame, cls: str = "class_name", name: str = "path") -> DataFrame:
    """One column per kind of augmentation and their total."""
    kind = S.augmentation_kind(name, otherwise="original")
    counts = samples.select(cls, kind.alias("_kind")).groupBy(cls)
    out = counts.agg(*[F.count_if(F.col("_kind") == k).alias(k) for k in KINDS], F.count(F.lit(1)).alias("total"))
    return out


def recording_length_per_class(recordings: DataFrame, cls: str = "class_name", seconds: str = "duration") -> DataFrame:
    return recordings.groupBy(cls).agg(F.sum(seconds).alias("total_seconds"))


def class_weights(samples: DataFrame, cls: str = "class_name") -> DataFrame:
    """count / largest count: the majority class has 1. Only class counts go through the window. Without samples there are no classes, which is an error."""
    if samples.isEmpty():
        raise ValueError("there are no classes to weigh")
    return samples_per_class(samples, cls).withColumn("weight", F.col("num_samples") / F.max("num_samples").over(Window.partitionBy())).orderBy(S.natural_key(cls))


def totals(recordings: DataFrame, species: str = "phylo_name") -> DataFrame:
    return recordings.agg(F.countDistinct(species).alias("num_species"), F.count(F.lit(1)).alias("num_recordings"))


def count_nonzero(distribution: DataFrame, column: str) -> DataFrame:
    return distribution.agg(F.count_if(F.col(column) != 0).alias("nonzero"))


def assign_class_ids(samples: DataFrame, cls: str = "class_name") -> DataFrame:
    """(class, class_id): ids from 0 in natural order of the distinct classes."""
    return samples.select(cls).distinct().withColumn("class_id", F.row_number().over(Window.orderBy(S.natural_key(cls), cls)) - 1)


def assign_sample_ids(samples: DataFrame, *, cls: str = "class_name", order: Sequence[str] = ("path",), first: int = 0) -> DataFrame:
    """Adds class_id and sample_id: consecutive by class, then natural order of the given columns, which tell the samples of a class apart."""
    named = samples.join(assign_class_ids(samples, cls), cls)
    out = numbered(named, ["class_id", *[S.natural_key(c) for c in order], *order], "sample_id")
    return out.withColumn("sample_id", F.col("sample_id") + first)


def union_roots(roots: Sequence[DataFrame], *, cls: str = "class_name", order: Sequence[str] = ("root", "path")) -> DataFrame:
    """Several indexes as one: a class has one id in all roots, samples are numbered anew."""
    joined = roots[0].withColumn("root", F.lit(0))
    for i, r in enumerate(roots[1:], 1):
        joined = joined.unionByName(r.withColumn("root", F.lit(i)))
    return assign_sample_ids(joined, cls=cls, order=order)


def first_per_group(rows: DataFrame, group: str | Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group, found by a running minimum rather than by sorting the group."""
    names = [group] if isinstance(group, str) else list(group)
    key = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(*names).agg(F.min(key).alias("_first")).select("_first.*").select(*rows.columns)
