"""Plans that balance classes: quotas, their allocation to files, methods for each new sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.operators.counts import samples_per_class
from fieldlab.operators.ranks import numbered
from fieldlab.operators.sampling import order_key, ranked

GOALS = ("tenth", "median", "max", "number")


def _goal(kind: str, column: str, number: int | None) -> Column:
    """Goal per class as an aggregate over the class counts."""
    if kind == "tenth":
        return 1 + F.floor(F.max(column) / 10)
    if kind == "median":
        return F.floor(F.median(column))
    if kind == "max":
        return F.max(column)
    if kind == "number" and number is not None:
        return F.lit(number)
    raise ValueError(f"a goal is one of {GOALS}; 'number' needs a number")


def quota(counts: DataFrame, goal: str = "median", *, cls: str = "class_name", n: str = "num_samples", number: int | None = None, goals: DataFrame | None = None) -> DataFrame:
    """(class, n, goal, need): how many samples each class lacks. goals: (class, goal kind) for a goal of its own per class."""
    figures = counts.agg(*[_goal(g, n, number if g != "number" else number or 0).cast("long").alias(g) for g in GOALS])  # one row
    with_figures = counts.crossJoin(figures)
    if goals is None:
        kind = F.lit(goal)
    else:
        with_figures = with_figures.join(goals.select(cls, F.col("goal").alias("_kind")), cls, "left")
        kind = F.coalesce("_kind", F.lit(goal))
    if goal not in GOALS or (goal == "number" and number is None):
        raise ValueError(f"a goal is one of {GOALS}; 'number' needs a number")
    target = F.when(kind == "tenth", F.col("tenth")).when(kind == "median", F.col("median")).when(kind == "max", F.col("max")).otherwise(F.col("number"))
    return with_figures.select(cls, n, target.alias("goal"), F.greatest(F.lit(0), target - F.col(n)).cast("long").alias("need"))


def class_target(counts: DataFrame, goal: str = "median", **options) -> DataFrame:
    return quota(counts, goal, **options).drop("need")


def allocate_round_robin(files: DataFrame, quotas: DataFrame, *, cls: str = "class_name", order: str = "path") -> DataFrame:
    """Adds `augmentations`: the class's need spread over its files, the first ones one more."""
    counted = numbered(files, [order], "_rn", by=cls).withColumn("_rn", F.col("_rn") + 1)
    sized = counted.join(samples_per_class(files, cls).select(cls, F.col("num_samples").alias("_files")), cls).join(quotas.select(cls, "need"), cls)
    share = F.floor(F.col("need") / F.col("_files")) + (F.col("_rn") <= F.col("need") % F.col("_files")).cast("long")
    return sized.withColumn("augmentations", share.cast("long")).select(*files.columns, "augmentations")


def assign_methods(allocated: DataFrame, methods: Sequence[str], *, ident: str = "path", seed: int = 42, distinct: int = 3) -> DataFrame:
    """One row per new sample: slot 1.. and its method. Each file cycles through up to `distinct` methods in an order of chance."""
    options = F.array(*[F.struct(F.md5(F.concat(F.lit(f"{seed}:{m}:"), F.col(ident).cast("string"))).alias("k"), F.lit(m).alias("m")) for m in methods])
    chosen = F.transform(F.slice(F.array_sort(options), 1, min(distinct, len(methods))), lambda x: x["m"])
    slots = allocated.where("augmentations > 0").withColumn("_methods", chosen).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("augmentations"))))
    return slots.withColumn("method", F.element_at("_methods", (F.pmod(F.col("slot") - 1, F.size("_methods")) + 1).cast("int"))).drop("_methods")


def balance_to_target(files: DataFrame, targets: DataFrame, weights: dict[str, float], *, cls: str = "class_name", ident: str = "path", seed: int = 42) -> DataFrame:
    """(class, id, copy, method): larger classes are cut to the goal, smaller ones get goal - n further samples from their files in turn.

    Copy 0 is the file itself. The method of a further sample is drawn by
    weight: the smallest -ln(u) / w, with u from the hash.
    """
    r = ranked(files, order_key(seed, ident), ident, cls).join(targets.select(cls, "goal"), cls)
    kept = r.where(F.col("_rank") <= F.col("goal"))
    short = F.greatest(F.col("goal") - F.col("_n"), F.lit(0))
    more = F.floor(short / F.col("_n")) + (F.col("_rank") <= short % F.col("_n")).cast("long")
    rows = kept.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), more.cast("long"))))

    def draw(method: str, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{method}:"), F.col(ident).cast("string"), F.lit(":"), F.col("copy").cast("string"))), 1, 12)
        u = (F.conv(digits, 16, 10).cast("double") + 1) / float(16**12 + 1)
        return F.struct((-F.ln(u) / weight).alias("k"), F.lit(method).alias("m"))

    best = F.array_min(F.array(*[draw(m, w) for m, w in weights.items() if w > 0]))["m"]
    return rows.select(cls, ident, "copy", F.when(F.col("copy") > 0, best).alias("method"))


def parameter_grid(values: dict[str, Sequence], spark) -> DataFrame:
    """One row per combination of the value lists, as text, with a map `settings`."""
    out = None
    for name, of in values.items():
        column = spark.createDataFrame([(str(v),) for v in of], f"`{name}` string")
        out = column if out is None else out.crossJoin(column)  # the product is what is asked for
    return with_settings(out, list(values))


def with_settings(grid: DataFrame, names: Sequence[str], base: Column | None = None) -> DataFrame:
    """Adds `settings`: the base map with each row's values over it."""
    from fieldlab.functions.scalars import map_update

    own = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
    return grid.withColumn("settings", own if base is None else map_update(base, own))
