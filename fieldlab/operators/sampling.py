"""Folds, shards, batches and hold-outs that repeat exactly for a seed.

The order of chance is md5(seed:id), ties by id. Ranks within a class are
taken in two levels, by the first digits of the digest and then within them,
so a large class spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S
from fieldlab.functions.permute import permuted
from fieldlab.operators.ranks import numbered


def order_key(seed: str | int, ident: str, epoch: int | None = None) -> Column:
    lead = f"{seed}:" if epoch is None else f"{seed}:{epoch}:"
    return F.md5(F.concat(F.lit(lead), F.col(ident).cast("string")))


def ranked(rows: DataFrame, key: Column, ident: str, cls: str | None = None, digits: int = 2) -> DataFrame:
    """Adds _rank (from 1, by key within the class, or over all rows) and _n (rows of the class)."""
    by = [cls] if cls else []
    keyed = rows.withColumn("_key", key).withColumn("_pre", F.substring("_key", 1, digits))
    sizes = keyed.groupBy(*by, "_pre").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*by).orderBy("_pre")
    offsets = sizes.select(*by, "_pre", (F.sum("_m").over(before) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy(*by)).alias("_n"))
    if cls:
        named = offsets.toDF("_cls", "_pre2", "_before", "_n")
        joined = keyed.join(named, F.col(cls).eqNullSafe(F.col("_cls")) & (F.col("_pre") == F.col("_pre2"))).drop("_cls", "_pre2")
    else:
        joined = keyed.join(offsets, "_pre")
    within = Window.partitionBy(*by, "_pre").orderBy("_key", ident)
    return joined.withColumn("_rank", F.row_number().over(within) + F.col("_before")).drop("_before", "_pre")


def stratified_kfold(rows: DataFrame, k: int, *, cls: str, ident: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds `fold` 0..k-1: each class is dealt round, starting where the classes before it ended, so folds differ by one row at most."""
    r = ranked(rows, order_key(seed, ident, epoch), ident, cls)
    sizes = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select(cls, (F.sum("_c").over(Window.orderBy(cls)) - F.col("_c")).alias("_start"))
    out = r.join(starts.toDF("_cls", "_start"), F.col(cls).eqNullSafe(F.col("_cls"))).drop("_cls")
    return out.withColumn("fold", F.pmod(F.col("_rank") - 1 + F.col("_start"), F.lit(k)).cast("int")).select(*rows.columns, "fold")


def fold_splits(folds: DataFrame, k: int) -> DataFrame:
    """Every row in each of the k splits, as `validate` in its own and `train` in the others."""
    splits = folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return splits.withColumn("role", F.when(F.col("split") == F.col("fold"), "validate").otherwise("train"))


def class_coverage(splits: DataFrame, cls: str) -> DataFrame:
    """(split, class, train, validate): rows seen per class."""
    return splits.groupBy("split", cls).agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "validate").alias("validate"))


def leaks_per_split(splits: DataFrame, ident: str) -> DataFrame:
    """(split, n_train, n_leaking): rows trained on, and ids of them that the split is validated with too."""
    trained = splits.where("role = 'train'").groupBy("split").agg(F.count(F.lit(1)).alias("n_train"))
    return trained.join(leaking_ids(splits, ident).groupBy("split").agg(F.count(F.lit(1)).alias("n_leaking")), "split", "left").withColumn("n_leaking", F.coalesce("n_leaking", F.lit(0)))


def leaking_ids(splits: DataFrame, ident: str) -> DataFrame:
    """(split, id) both trained on and validated with: none, if folds are right."""
    pick = lambda role: splits.where(F.col("role") == role).select("split", ident)
    return pick("train").intersect(pick("validate"))


def shard(positions: DataFrame, replicas: int, *, position: str = "position", drop_last: bool = False) -> DataFrame:
    """Deals rows at positions 0.. to replicas in turn, all of the same length: the tail is dropped, or the first rows are dealt again.

    Adds `replica` and `place`, the position dealt.
    """
    total = positions.agg(F.count(F.lit(1)).alias("_n"))
    rows = positions.crossJoin(total)  # total is one row
    if drop_last:
        even = rows.where(F.col(position) < F.col("_n") - F.col("_n") % replicas).withColumn("place", F.col(position))
    else:
        size = F.ceil(F.col("_n") / replicas) * replicas
        # row p is dealt at p, p + n, ... below the padded size
        even = rows.withColumn("place", F.explode(F.sequence(F.col(position), size - 1, F.col("_n")))).where(F.col("place") < size)
    return even.withColumn("replica", F.pmod(F.col("place"), F.lit(replicas)).cast("int")).drop("_n")


def positions(rows: DataFrame, ident: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds `position` 0.. in the order of chance."""
    return ranked(rows, order_key(seed, ident, epoch), ident).withColumn("position", F.col("_rank") - 1).select(*rows.columns, "position")


def fold_batches(splits: DataFrame, batch: int, *, ident: str, seed: int = 42, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Training rows of each split in batches: adds `batch`, the position in the split's order of chance divided by the size."""
    train = splits.where("role = 'train'")
    r = ranked(train, order_key(seed, ident, epoch), ident, "split").withColumn("batch", F.floor((F.col("_rank") - 1) / batch))
    if drop_last:
        r = r.where((F.col("batch") + 1) * batch <= F.col("_n"))
    return r.select(*splits.columns, "batch")


def keep_percent_per_class(rows: DataFrame, percent: float, *, cls: str, ident: str, seed: int = 42) -> DataFrame:
    """round-half-even(percent of the class) rows of each class."""
    r = ranked(rows, order_key(seed, ident), ident, cls)
    return r.where(F.col("_rank") <= F.bround(F.col("_n") * percent / 100)).select(*rows.columns)


def holdout_percent(rows: DataFrame, percent: float, *, ident: str, seed: int = 42) -> DataFrame:
    """Adds `held_out`: exactly round-half-even(percent) of all rows."""
    r = ranked(rows, order_key(seed, ident), ident)
    return r.withColumn("held_out", F.col("_rank") <= F.bround(F.col("_n") * percent / 100)).select(*rows.columns, "held_out")


def holdout_percent_per_class(rows: DataFrame, percent: float, *, cls: str, ident: str, seed: int = 42) -> DataFrame:
    """Adds `split`: floor(percent of the class) rows of each class are 'validation', the others 'train'."""
    r = ranked(rows, order_key(seed, ident), ident, cls)
    return r.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_n") * percent / 100), "validation").otherwise("train")).select(*rows.columns, "split")


def sample_across_classes(rows: DataFrame, total: int, *, cls: str, ident: str, seed: int = 42) -> DataFrame:
    """round-half-even(total / classes) rows of each class, all of smaller ones."""
    classes = rows.agg(F.countDistinct(cls).alias("_k"))
    r = ranked(rows, order_key(seed, ident), ident, cls).crossJoin(classes)  # one row
    return r.where(F.col("_rank") <= F.bround(F.lit(total) / F.col("_k"))).select(*rows.columns)


def shuffle(rows: DataFrame, ident: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    return rows.orderBy(order_key(seed, ident, epoch), ident)


def epoch_order(rows: DataFrame, n: int, *, position: str = "position", replicas: int = 1, batch: int = 1, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds `place`, `replica`, `turn` and `batch` of an epoch's order of chance to rows at positions 0 .. n - 1.

    The order is a keyed permutation of positions that are numbered once, so
    an epoch neither sorts nor shuffles: every row computes its place, the
    replica it is dealt to, its turn there and that turn's batch.
    """
    placed = rows.withColumn("place", permuted(F.col(position), n, seed, epoch))
    turn = F.floor(F.col("place") / replicas)
    return placed.withColumns({"replica": F.pmod("place", F.lit(replicas)).cast("int"), "turn": turn, "batch": F.floor(turn / batch)})


def unique_names(files: DataFrame, *, folder: str, name: str, order: str) -> DataFrame:
    """Adds `unique_name`: names repeated in a folder get _r<n> before the suffix from the second on."""
    again = numbered(files, [order], "_n", by=[folder, name])
    return again.withColumn("unique_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(S.stem(name), F.lit("_r"), F.col("_n").cast("string"), S.suffix(name)))).drop("_n")
