"""Interval joins: labelling snippets by overlapping annotations, points in intervals, as-of values."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldlab.functions.shipping import by_value
from fieldlab.operators.ranks import kept, numbered

NOISE = "noise"
#: Labels that mean nothing was heard. Fixed values.
NOISE_LABELS = ("noise", "no_bird", "no bird")


def associate(snippets: DataFrame, annotations: DataFrame, key: str = "recording_id") -> DataFrame:
    """Every snippet with every annotation of its recording; Spark broadcasts annotations if they are small."""
    return snippets.join(annotations, key)


def _binned(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long")))


def label_by_overlap(
    snippets: DataFrame, annotations: DataFrame, *, keys: Sequence[str] = ("recording_id",), snippet_id: str = "snippet_id",
    start: str = "start", end: str = "end", begin: str = "begin", finish: str = "finish", label: str = "species",
    mix: str | None = "mix", extra: Sequence[str] = (), part_rows: int | None = None,
) -> DataFrame:
    """Labels each snippet by the annotations of its recording that overlap it.

    An annotation overlaps if begin <= end of the snippet and its own end >
    start of the snippet. The first to begin gives the label and the extra
    columns; labels and mixes of the others make the mix. Without overlap the
    label is noise. Each entry of the mix gives a further row with that label;
    a row of noise with a mix is left out.

    The join is an equi-join on the keys with a range condition. With
    part_rows, recordings with more snippets than that are cut into parts of so
    many, so one very long recording spreads over many tasks (`_in_parts`).
    Null times overlap nothing, and null keys match nothing.

    Returns keys, snippet_id, start, end, extra, label, mix, is_primary.
    """
    keys = list(keys)
    base = snippets.select(*keys, snippet_id, start, end)
    own_mix = F.coalesce(F.col(mix), F.expr("cast(array() as array<string>)")) if mix else F.expr("cast(array() as array<string>)")
    notes = annotations.select(
        *keys, F.col(begin).alias("_begin"), F.col(finish).alias("_finish"),
        F.struct(F.col(begin).alias("b"), F.col(finish).alias("f"), F.col(label).alias("label"), own_mix.alias("mix"), *[F.col(c).alias(c) for c in extra]).alias("_a"),
    )
    overlap = (F.col("_begin") <= F.col(end)) & (F.col("_finish") > F.col(start))
    longer = None
    if part_rows is not None:
        many = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows).select(*keys)
        longer = None if many.isEmpty() else kept(many, "longer")
    if longer is None:
        joined = base.join(notes, keys).where(overlap)
    else:
        short = base.join(longer, keys, "left_anti").join(notes, keys).where(overlap)
        joined = short.unionByName(_in_parts(base.join(longer, keys, "left_semi"), notes.join(longer, keys, "left_semi"), keys, start, end, part_rows))
    ids = [*keys, snippet_id, start, end]
    heard = F.array_union(F.array("_a.label"), "_a.mix")
    found = joined.groupBy(*ids).agg(F.min("_a").alias("_first"), F.count(F.lit(1)).alias("_times"), F.collect_set(heard).alias("_heard"))
    nothing = F.array(*[F.lit(x) for x in NOISE_LABELS])
    others = F.array_except(F.flatten("_heard"), F.concat(F.array("_first.label"), nothing))
    found = found.withColumn("_mix", F.when(F.col("_times") > 1, others).otherwise(F.array_except("_first.mix", nothing)))
    rows = base.join(found.select(*keys, snippet_id, start, end, "_first", "_mix"), ids, "left")
    primary = F.when(F.col("_first").isNull() | F.col("_first.label").isin(*NOISE_LABELS), NOISE).otherwise(F.translate(F.col("_first.label"), " ", "_"))
    clean = F.transform(F.coalesce("_mix", F.expr("cast(array() as array<string>)")), lambda x: F.translate(x, " ", "_"))
    rows = rows.withColumn("_label", primary).withColumn("_mix", F.array_sort(F.array_remove(F.array_distinct(clean), F.lit(NOISE))))
    copies = F.transform(F.filter("_mix", lambda x: x != F.col("_label")), lambda x: F.struct(x.alias("label"), F.lit(False).alias("is_primary")))
    own = F.when((F.col("_label") == NOISE) & (F.size("_mix") > 0), F.array().cast("array<struct<label:string,is_primary:boolean>>")).otherwise(F.array(F.struct(F.col("_label").alias("label"), F.lit(True).alias("is_primary"))))
    out = rows.withColumn("_row", F.explode(F.concat(own, copies)))
    return out.select(*ids, *[F.col(f"_first.{c}").alias(c) for c in extra], F.col("_row.label").alias("label"), F.col("_mix").alias("mix"), F.col("_row.is_primary").alias("is_primary"))


#: Time bins over which lookups of times among parts are spread.
BINS = 1000


def _in_parts(base: DataFrame, notes: DataFrame, keys: list[str], start: str, end: str, rows: int) -> DataFrame:
    """The overlapping pairs of snippets and annotations of long recordings.

    Snippets are cut by their exact order into parts of so many, wherever those
    lie in time. An annotation goes to the parts whose extent it overlaps: the
    first and last come from two as-of lookups, so a long one among short ones
    costs a row per part, not one per unit of time. Annotations of a part are
    dealt to slices of bounded size, and each slice is searched as a nested
    interval list.
    """
    base = base.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    notes = notes.where(F.col("_begin").isNotNull() & F.col("_finish").isNotNull())
    placed = numbered(base, [start, end], "_at", by=keys).withColumn("_part", F.floor(F.col("_at") / rows)).drop("_at")
    extent = kept(placed.groupBy(*keys, "_part").agg(F.min(start).alias("_lo"), F.max(end).alias("_hi")), "extents")
    reach = extent.withColumn("_top", F.max("_hi").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    low, high = extent.agg(F.min(F.col("_lo").cast("double")), F.max(F.col("_hi").cast("double"))).first()
    width = max((high - low) / BINS, 1e-9)
    bins = lambda c: F.greatest(F.lit(-1), F.least(F.lit(BINS), F.floor((F.col(c).cast("double") - low) / width)))
    # parts before `_first` end too early, those after `_last` start too late
    firsts = reach.groupBy(*keys, F.col("_top").alias("_begin")).agg(F.min("_part").alias("_p"))
    lasts = extent.groupBy(*keys, F.col("_lo").alias("_finish")).agg(F.max("_part").alias("_p"))
    near = asof_le(notes, firsts, on="_begin", keys=keys, value="_p", out="_first", bins=bins("_begin"))
    near = asof_le(near, lasts, on="_finish", keys=keys, value="_p", out="_last", bins=bins("_finish"))
    first = F.coalesce("_first", F.lit(0).cast("long"))
    dealt = near.where(first <= F.col("_last")).withColumn("_part", F.explode(F.sequence(first, "_last"))).drop("_first", "_last")
    dealt = kept(dealt.join(extent, [*keys, "_part"]).where((F.col("_begin") <= F.col("_hi")) & (F.col("_finish") > F.col("_lo"))).drop("_lo", "_hi"), "dealt")
    slices = dealt.groupBy(*keys, "_part").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_slices"))
    on = [*keys, "_part", "_slice"]
    left = placed.join(slices, [*keys, "_part"]).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    right = dealt.join(slices, [*keys, "_part"]).withColumn("_slice", F.pmod(F.xxhash64("_begin", "_finish", F.to_json("_a")), F.col("_slices"))).drop("_slices")
    timed = lambda df, a, b: df.withColumn("_s", F.col(a).cast("double")).withColumn("_e", F.col(b).cast("double"))
    # types as they are once written, when any entry may be null
    schema = StructType([*(placed.schema[c] for c in base.columns), *(dealt.schema[c] for c in ("_begin", "_finish", "_a"))])
    return timed(left, start, end).groupBy(*on).cogroup(timed(right, "_begin", "_finish").groupBy(*on)).applyInArrow(_pairs(base.columns), schema)


def nested_lists(begin: np.ndarray, finish: np.ndarray) -> list[np.ndarray]:
    """The intervals as lists in which none lies inside another, so that begins and ends both rise."""
    order = np.lexsort((-finish, begin))
    lists: list[list[int]] = []
    ends: list[float] = []  # minus the last end of each list, rising
    for i in order.tolist():
        # the first list that ends no later than this interval
        at = bisect.bisect_left(ends, -finish[i])
        if at == len(lists):
            lists.append([])
            ends.append(0.0)
        lists[at].append(i)
        ends[at] = -finish[i]
    return [np.array(own) for own in lists]


def overlapping(start: np.ndarray, end: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the snippets and annotations with begin <= end and finish > start: a run of each nested list by snippet."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for own in nested_lists(begin, finish):
        first, last = np.searchsorted(finish[own], start, side="right"), np.searchsorted(begin[own], end, side="right")
        n = np.maximum(0, last - first)
        of = np.repeat(np.arange(len(start)), n)
        left.append(of)
        right.append(own[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]])
    return np.concatenate(left), np.concatenate(right)


def _pairs(columns: list[str]):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        times = [c.to_numpy() for c in (left["_s"], left["_e"], right["_s"], right["_e"])]
        at, to = overlapping(*times) if len(left) and len(right) else (np.empty(0, np.int64),) * 2
        found, notes = left.select(columns).take(pa.array(at)), right.select(["_begin", "_finish", "_a"]).take(pa.array(to))
        return pa.Table.from_arrays([*found.columns, *notes.columns], names=[*columns, "_begin", "_finish", "_a"])

    return work


def point_in_interval(points: DataFrame, intervals: DataFrame, *, x: str, low: str = "low", high: str = "high", index: str = "index", keys: Sequence[str] = (), bin_width: float | None = None) -> DataFrame:
    """Adds `interval`: the index of the half-open interval that holds x, else -1.

    Without keys give bin_width: points and intervals meet by time bin, so
    that no plan compares every point with every interval.
    """
    keys = list(keys)
    if not keys and bin_width is None:
        raise ValueError("give keys or a bin_width")
    right = intervals.select(*keys, F.col(low).alias("_low"), F.col(high).alias("_high"), F.col(index).alias("_index"))
    left, on = points, keys
    if bin_width is not None:
        left = points.withColumn("_bin", F.floor(F.col(x) / bin_width).cast("long"))
        right = right.where(F.col("_low") < F.col("_high")).withColumn("_bin", _binned(F.col("_low"), F.col("_high"), bin_width))
        on = [*keys, "_bin"]
    condition = (left[x] >= right["_low"]) & (left[x] < right["_high"])
    for k in on:
        condition = condition & (left[k] == right[k])
    joined = left.join(right, condition, "left")
    return joined.select(*[left[c] for c in points.columns], F.coalesce(right["_index"], F.lit(-1)).alias("interval"))


def _asof(left: DataFrame, right: DataFrame, on: str, keys: list[str], value: str, forward: bool, out: str, bins: Column | None) -> DataFrame:
    """Both sides in one window per key, sorted towards the value that is asked for, so that a running `last` finds it.

    A null time has no value, nor is it one's time. Null keys are a key like
    others. With bins the window is one per key and bin; what earlier bins end with is
    worked out from one row per bin and fills in where a bin holds nothing yet.
    """
    right = right.where(F.col(on).isNotNull())
    timed = lambda found: F.when(F.col(on).isNotNull(), found)
    l = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).withColumn("_row", F.struct(*left.columns))
    r = right.select(*keys, F.col(on), F.col(value).alias("_v")).withColumn("_side", F.lit(0)).withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType))
    both = l.select(*keys, on, "_v", "_side", "_row").unionByName(r.select(*keys, on, "_v", "_side", "_row"))
    # a value at the same time counts for what is at or before it, and isn't greater
    order = [F.col(on).desc(), F.col("_side").desc()] if forward else [F.col(on), F.col("_side")]
    if bins is None:
        running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return both.withColumn("_found", timed(F.last("_v", ignorenulls=True).over(running))).where("_side = 1").select("_row.*", F.col("_found").alias(out))
    both = both.withColumn("_bin", bins)
    nearest = F.min_by if forward else F.max_by
    per_bin = both.groupBy(*keys, "_bin").agg(nearest("_v", F.when(F.col("_v").isNotNull(), F.col(on))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(F.col("_bin").desc() if forward else F.col("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bin.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    running = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(running)).where("_side = 1")
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    return found.join(carried, same).select("_row.*", timed(F.coalesce("_found", "_carried")).alias(out))


def asof_le(left: DataFrame, right: DataFrame, *, on: str, keys: Sequence[str], value: str, out: str = "le", bins: Column | None = None) -> DataFrame:
    """Adds the right value at the greatest `on` that is at most the left one.

    bins: a function of `on` that never falls, such as its day; keys with very
    many rows then spread over tasks by it.
    """
    return _asof(left, right, on, list(keys), value, False, out, bins)


def asof_gt(left: DataFrame, right: DataFrame, *, on: str, keys: Sequence[str], value: str, out: str = "gt", bins: Column | None = None) -> DataFrame:
    """Adds the right value at the smallest `on` that is greater than the left one. bins: as for asof_le."""
    return _asof(left, right, on, list(keys), value, True, out, bins)


by_value(__name__)
