"""Orders, and the long tables that tallies and collections are kept in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.scalars import natural_key


def natural_sort(rows: DataFrame, *columns: str) -> DataFrame:
    """Digit runs compare as numbers: Foo3 before Foo30."""
    return rows.orderBy(*[natural_key(c) for c in columns], *columns)


def sort_by_start_time(snippets: DataFrame, start: str = "start_time(secs)") -> DataFrame:
    """Times in metadata are text; they are compared as numbers, so 2 comes before 10."""
    return snippets.orderBy(F.col(f"`{start}`").try_cast("double"))


def append_tallies(*tallies: DataFrame) -> DataFrame:
    """Predictions of several batches as one table; a tally is its (run, step, phase), so those of the same key are merged by it. Columns that some lack are null."""
    out = tallies[0]
    for t in tallies[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def steps(predictions: DataFrame, step: str = "step") -> DataFrame:
    return predictions.select(step).distinct().orderBy(step)


def slice_by_position(ordered: DataFrame, start: int, stop: int, order: Sequence[str]) -> DataFrame:
    """Rows start .. stop - 1 (from 0) in the given order: a top-k and an offset, without numbering the table."""
    return ordered.orderBy(*order).limit(stop).offset(start)
