"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are ordered by label and, within it, along a Hilbert curve over
their widest dimensions, and written as blocks of that order. A zone map holds
each block's least and largest coordinate per dimension and its labels.
Anchors form groups in the same order. By interval arithmetic on the boxes of
a group and a block (first of chunks of blocks) no member's score can lie
outside a range; only blocks whose range meets the group's windows are joined
with it, and in the task each anchor's own bounds are tested again before it
is compared. Positives are sought first, each anchor knowing from the rows next
to it in the order what its fifth best score is at least; their scores are the
windows in which negatives are sought.

Rows with a null label, a null vector, or a null or non-finite component (or
one of 2**53 and more in size) take no part. Shorter vectors count as filled
up with zeros. A null id is a row like others, never an anchor, and comes last
among ties. An anchor's own id is never its positive, so repeated rows of an
anchor are not its positives; repeated candidates count each. Each row of a
repeated anchor gives its results. Scores beyond a long count as its ends. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.llm.common import Scratch, by_value, table
from fieldlab.llm.vectors import CHUNK, block_size, boxes, chunk_boxes, fold, packed, product_bound, unpacked, width_of
from fieldlab.operators.ranks import numbered

#: A component becomes a whole number of this many parts.
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Percent of the positive's score that a negative's must reach.
LOW = 80
#: Dimensions of the curve and bits of each; blocks of a small table, rows of a block, and blocks whose anchors are a group.
CURVE, BITS, BLOCKS, LEAST_ROWS, MOST_ROWS, GROUP = 8, 7, 24, 256, 32_768, 8
NO_ID, MOST = (1 << 63) - 1, (1 << 63) - 1
RAW = "<i8"


def whole_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fits = (np.abs(x) < 2.0**53).all(axis=1)
    return np.floor(np.where(fits[:, None], x, 0) * SCALE).astype(np.int64), fits


def curve_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of rows of cell numbers (below 2**bits) on a Hilbert curve (Skilling's transform)."""
    x = cells.T.astype(np.int64).copy()
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for axis in range(len(x)):
            turned = (x[axis] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[axis] ^= swap
        bit >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flips = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = key << 1 | (x[axis] >> b) & 1
    return key


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by floating point where no sum can leave its whole numbers."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -MOST - 1, MOST).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of each row with any member of a box, with slack for rounding."""
    p, q = a.astype(np.float64) * lo, a.astype(np.float64) * hi
    least, most = np.minimum(p, q).sum(axis=1), np.maximum(p, q).sum(axis=1)
    slack = 1 + 1e-9 * np.maximum(np.abs(p), np.abs(q)).sum(axis=1)
    return least - slack, most + slack


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


# ---- blocks and groups ---------------------------------------------------------
def _zones(rows: DataFrame, by: str, width: int) -> DataFrame:
    """(by, lo, hi, first, last): boxes with the range of labels."""
    label = rows.groupBy(by).agg(F.min("label").alias("first"), F.max("label").alias("last"))
    return boxes(rows, by, lambda raw: unpacked(raw, width, RAW).astype(np.float64)).join(label, by)


def must_read(groups: DataFrame, zones: DataFrame, n_blocks: int, test: Callable[[str, str], Column], labels: Column | None = None) -> DataFrame:
    """(grp, block) whose boxes pass the test, chunks of blocks first. test is given prefixes of the two sides' columns."""
    chunk = chunk_boxes(zones.select("block", "lo", "hi"))
    each = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_blocks - 1) // CHUNK).cast("long"))))
    chunks = each.alias("g").join(chunk.alias("z"), "chunk").where(test("g", "z")).select("chunk", *[F.col(f"g.{c}").alias(c) for c in groups.columns])
    of = zones.withColumn("chunk", (F.col("block") / CHUNK).cast("long"))
    found = chunks.alias("g").join(of.alias("z"), "chunk").where(test("g", "z"))
    return (found if labels is None else found.where(labels)).select("g.grp", "z.block")


def may_reach(g: str, z: str, at_least: str) -> Column:
    """The bound of scores reaches the group's column at_least; null is no limit."""
    top = product_bound(F.col(f"{g}.lo"), F.col(f"{g}.hi"), F.col(f"{z}.lo"), F.col(f"{z}.hi"), F.greatest)
    return F.col(f"{g}.{at_least}").isNull() | (top + 1 + F.abs(top) * 1e-6 >= F.col(f"{g}.{at_least}"))


def may_stay_below(g: str, z: str, at_most: str) -> Column:
    low = product_bound(F.col(f"{g}.lo"), F.col(f"{g}.hi"), F.col(f"{z}.lo"), F.col(f"{z}.hi"), F.least)
    return low - 1 - F.abs(low) * 1e-6 <= F.col(f"{g}.{at_most}")


def nearby(placed: DataFrame, width: int, k: int) -> DataFrame:
    """(position, least) of the anchors: the k-th best score among same-label rows of the same batch, which are near in the order; null if there are fewer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096).to_pandas()
                anchor = np.flatnonzero(part["anchor"].to_numpy(dtype=bool))
                x, label, ids = unpacked(part["raw"].to_list(), width, RAW), part["label"].to_numpy(), part["id"].to_numpy()
                s = scores(x[anchor], x)
                least: list[int | None] = []
                for row, a in enumerate(anchor):
                    own = s[row][(label == label[a]) & (ids != ids[a])]
                    least.append(int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else None)
                yield pa.RecordBatch.from_pydict({"position": pa.array(part["position"].to_numpy()[anchor], pa.int64()), "least": pa.array(least, pa.int64())})

    return placed.select("position", "id", "label", "raw", "anchor").mapInArrow(work, "position bigint, least bigint")


def in_units(anchors: DataFrame, placed: DataFrame, pairs: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f(anchors, rows) of each pair of a group and a block. Both have at most a few blocks' rows."""
    left = anchors.join(pairs, "grp")
    left = left.select("grp", "block", F.lit(True).alias("is_anchor"), "position", "id", "label", "raw", "limits")
    right = placed.join(pairs, "block").select("grp", "block", F.lit(False).alias("is_anchor"), "position", "id", "label", "raw", F.lit(None).cast("array<bigint>").alias("limits"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["is_anchor"].to_numpy(dtype=bool)
        return f(pdf[side], pdf[~side])

    return left.unionByName(right).groupBy("grp", "block").applyInPandas(work, schema)


def best(rows: DataFrame, by: list[str], k: int, out: str) -> DataFrame:
    """The k best of each `by`, numbered from 1."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col(out) <= k)


# ---- what a task does ------------------------------------------------------------
def find_positives(width: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        x, y = unpacked(a["raw"].to_list(), width, RAW), unpacked(b["raw"].to_list(), width, RAW)
        if len(a) and len(b):
            label, ids = b["label"].to_numpy(), b["id"].to_numpy()
            most = bounds(x, y.min(axis=0), y.max(axis=0))[1]
            least = np.array([t[0] for t in a["limits"]], dtype=np.int64)
            go = np.flatnonzero(most >= least)
            s = scores(x[go], y)
            for row, i in enumerate(go):
                fits = (label == a["label"].iloc[i]) & (ids != a["id"].iloc[i])
                at = np.flatnonzero(fits & (s[row] >= least[i]))
                at = at[first_of(s[row][at], ids[at], k)]
                out.append(pd.DataFrame({"position": a["position"].iloc[i], "score": s[row][at], "id": ids[at]}))
        return pd.concat(out) if out else pd.DataFrame({"position": [], "score": [], "id": []}, dtype=np.int64)

    return work


def find_negatives(width: int, k: int, low: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        x, y = unpacked(a["raw"].to_list(), width, RAW), unpacked(b["raw"].to_list(), width, RAW)
        if len(a) and len(b):
            label, ids = b["label"].to_numpy(), b["id"].to_numpy()
            most, least = np.array([max(w) for w in a["limits"]]), np.array([-(-low * int(min(w)) // 100) for w in a["limits"]])
            under, over = bounds(x, y.min(axis=0), y.max(axis=0))
            go = np.flatnonzero((over >= least) & (under <= most))
            s = scores(x[go], y)
            for row, i in enumerate(go):
                at = np.flatnonzero((label != a["label"].iloc[i]) & (s[row] >= least[i]) & (s[row] <= most[i]))
                at = at[first_of(s[row][at], ids[at], len(at))]
                falling = -s[row][at]
                for rank, p in enumerate(map(int, a["limits"].iloc[i]), 1):
                    first = np.searchsorted(falling, -p)
                    own = at[first : min(first + k, np.searchsorted(falling, -(-(-low * p // 100)), side="right"))]
                    if len(own):
                        out.append(pd.DataFrame({"position": a["position"].iloc[i], "place": rank, "score": s[row][own], "id": ids[own]}))
        return pd.concat(out) if out else pd.DataFrame({"position": [], "place": [], "score": [], "id": []}, dtype=np.int64)

    return work


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, n_blocks: int = BLOCKS, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `anchors` holds."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    width = width_of(vectors, vec_col)
    rows = vectors.where(F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchors & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), F.col(vec_col).alias("v")
    )
    rows = scratch.keep(packed(rows, ["id", "label", "anchor"], "v", width, whole_numbers).where("raw IS NOT NULL"), "vectors")
    ends = fold(rows.select("raw"), lambda batch: _ends(batch, width), np.maximum) if width else None
    if ends is None:
        empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return vectors.sparkSession.createDataFrame([], empty)
    lo, hi = -ends[:width], ends[width:]
    n = rows.count()
    size = block_size(n, n_blocks, least_rows, MOST_ROWS)
    last = math.ceil(n / size)
    placed = numbered(with_curve(rows, width, lo, hi), ["label", "curve", "id", "raw"])
    placed = placed.select((F.col("position") / size).cast("long").alias("block"), "position", "id", "label", "anchor", "raw")
    zones = scratch.keep(_zones(placed, "block", width), "zones")

    anchor = placed.where("anchor").join(nearby(placed, width, positives), "position").select((F.col("block") / GROUP).cast("long").alias("grp"), "position", "id", "label", "raw", "least")
    anchor = scratch.keep(anchor, "anchors")
    limit = anchor.groupBy("grp").agg(F.when(F.count("least") == F.count(F.lit(1)), F.min("least")).alias("least"))
    groups = scratch.keep(_zones(anchor, "grp", width).join(limit, "grp"), "groups")
    same = (F.col("g.first") <= F.col("z.last")) & (F.col("z.first") <= F.col("g.last"))
    pairs = scratch.keep(must_read(groups, zones, last, lambda g, z: may_reach(g, z, "least"), same), "pairs")
    found = in_units(anchor.withColumn("limits", F.array(F.coalesce("least", F.lit(-MOST - 1)))), placed, pairs, find_positives(width, positives), "position bigint, score bigint, id bigint")
    positive = scratch.keep(best(found, ["position"], positives, "place"), "positives")

    # a negative score has no window: four fifths of it lie above it
    windows = positive.where("score >= 0").groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("limits"))  # `positives` of them
    anchor = scratch.keep(anchor.join(windows, "position").drop("least"), "windows")
    limit = anchor.groupBy("grp").agg(F.max(F.array_max("limits")).alias("most"), F.min(F.ceil(F.array_min("limits") * (low / 100) - 1)).alias("least"))
    groups = scratch.keep(_zones(anchor, "grp", width).join(limit, "grp"), "groups")
    other = (F.col("g.first") < F.col("g.last")) | (F.col("z.first") < F.col("z.last")) | (F.col("g.first") != F.col("z.first"))
    pairs = scratch.keep(must_read(groups, zones, last, lambda g, z: may_reach(g, z, "least") & may_stay_below(g, z, "most"), other), "pairs")
    found = in_units(anchor, placed, pairs, find_negatives(width, negatives, low), "position bigint, place int, score bigint, id bigint")
    negative = best(found, ["position", "place"], negatives, "rank").select("position", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    of = positive.select("position", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negative.join(of, ["position", "place"]).join(anchor.select("position", F.col("id").alias("anchor_id")), "position")
    return out.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")


def _ends(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = unpacked(batch.column(0).to_pylist(), width, RAW).astype(np.float64)
    return np.concatenate([-x.min(axis=0), x.max(axis=0)])


def with_curve(rows: DataFrame, width: int, lo: np.ndarray, hi: np.ndarray) -> DataFrame:
    """Adds `curve`: the place on a Hilbert curve over the dimensions with the widest range."""
    dims = np.argsort(lo - hi, kind="stable")[:CURVE]
    span = np.maximum(hi[dims] - lo[dims], 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("raw").to_pylist(), width, RAW)[:, dims]
            cells = np.minimum(((x - lo[dims]) / span * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield batch.append_column("curve", pa.array(curve_key(cells, BITS)))

    return rows.mapInArrow(work, rows.withColumn("curve", F.lit(0).cast("long")).schema)


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 256)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

by_value(__name__)
