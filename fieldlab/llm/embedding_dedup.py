"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are turned to their principal axes and sorted by the grid cells,
as wide as the largest distance of a link, of the leading ones. The sequence
is cut into intervals; two intervals are joined only if their boxes are not
provably farther apart than a link is long, first chunks of blocks, then
blocks, then halves of halves within a task, down to leaves that are compared
by a matrix product. Intervals that are provably linked throughout are
counted, not compared. Links are never listed: a task gives each vector its
number of links and a root in its own union-find, so a group of m near copies
costs rows in proportion to m.

Equal vectors are one class with a weight before anything is compared.
Vectors that are null, zero, or hold null or non-finite entries link with
nothing and are kept. Shorter vectors count as filled up with zeros. Rows are
what is linked and counted; ids only name them, so repeated rows are copies
that link with each other, and a component's id is the smallest non-null id of
its rows. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import Scratch, by_value, table
from fieldlab.llm.components import components
from fieldlab.llm.vectors import CHUNK, block_size, boxes, chunk_boxes, fold, gap, packed, unpacked, width_of
from fieldlab.operators.ranks import numbered

#: Vectors of a leaf; blocks of a small table; rows of a block at most; leading dimensions of the grid.
LEAF, BLOCKS, MOST_ROWS, GRID = 512, 12, 65_536, 8
#: Slack of bounds that are computed with rounding.
SLACK = 1e-9
RAW = "<f8"


def units(raw, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, their lengths, unit vectors); scaled by a power of two first, which changes no cosine, so that no square overflows or vanishes."""
    x = unpacked(raw, width, RAW)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    length = np.sqrt((x * x).sum(axis=1))
    return x, length, x / length[:, None]


# ---- union-find in a task -------------------------------------------------------
def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while ((up := parent[x]) != x).any():
        x = up
    return x


def merge(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins u[i] with v[i]; roots are the smallest members."""
    while len(u):
        u, v = roots(parent, u), roots(parent, v)
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links, the smallest row each can reach; every row and column has a link."""
    n = len(linked)
    row = np.arange(n)
    while True:
        col = np.where(linked, row[:, None], n).min(axis=0)
        new = np.minimum(row, np.where(linked, col[None, :], n).min(axis=1))
        if (new == row).all():
            return row, col
        row = new


# ---- one pair of intervals ------------------------------------------------------
class Interval:
    """A sequence of vectors with the boxes of its leaves, of pairs of leaves, and so on up to the whole."""

    def __init__(self, raw, weight: np.ndarray, width: int, axes: np.ndarray, leaf: int):
        self.x, self.length, unit = units(raw, width)
        self.unit, self.weight, self.leaf = unit.astype(np.float32), weight, leaf
        y = unit @ axes
        at = np.arange(0, len(y), leaf)
        self.levels = [(np.minimum.reduceat(y, at), np.maximum.reduceat(y, at))]
        while len(self.levels[-1][0]) > 1:
            lo, hi = self.levels[-1]
            at = np.arange(0, len(lo), 2)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def __len__(self) -> int:
        return len(self.x)

    def box(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.levels[min(level, len(self.levels) - 1)]
        return lo[i], hi[i]

    def children(self, level: int, i: np.ndarray) -> np.ndarray:
        """(len(i), 2) numbers one level down; a missing second child is -1."""
        if level >= len(self.levels):
            return np.stack([i, np.full_like(i, -1)], axis=1)
        two = np.stack([2 * i, 2 * i + 1], axis=1)
        two[two >= len(self.levels[level - 1][0])] = -1
        return two

    def part(self, level: int, i: int) -> slice:
        size = self.leaf << min(level, len(self.levels) - 1)
        return slice(i * size, min(len(self), (i + 1) * size))


def join_intervals(a: Interval, b: Interval, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's vectors, links of b's, union-find parents of both, a's first). Links are weights; b may be a itself, and then links with itself count."""
    same = a is b
    long2 = 2 - 2 * least  # squared length of the longest link
    close = least - (a.x.shape[1] + 8) * 2.0**-22  # by float32
    of_a, of_b, parent = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    i = j = np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels)) - 1, -1, -1):
        (alo, ahi), (blo, bhi) = a.box(level, i), b.box(level, j)
        near = (np.maximum(0, np.maximum(alo - bhi, blo - ahi)) ** 2).sum(axis=1) <= long2 + SLACK
        whole = near & ((np.maximum(ahi - blo, bhi - alo) ** 2).sum(axis=1) <= long2 - SLACK)
        for p, q in zip(i[whole].tolist(), j[whole].tolist()):  # linked throughout
            at, to = a.part(level, p), b.part(level, q)
            of_a[at] += b.weight[to].sum()
            if not (same and p == q):
                of_b[to] += a.weight[at].sum()
            both = np.r_[np.arange(at.start, at.stop), np.arange(to.start, to.stop) + shift]
            merge(parent, both[1:], np.full(len(both) - 1, both[0]))
        i, j = i[near & ~whole], j[near & ~whole]
        if level:
            p, q = a.children(level, i), b.children(level, j)
            i, j = np.repeat(p, 2, axis=1).ravel(), np.tile(q, (1, 2)).ravel()
            there = (i >= 0) & (j >= 0) & ((i <= j) | (not same))
            i, j = i[there], j[there]
    for p, q in zip(i.tolist(), j.tolist()):
        at, to = a.part(0, p), b.part(0, q)
        maybe = a.unit[at] @ b.unit[to].T >= close
        if not maybe.any():
            continue
        r, c = np.flatnonzero(maybe.any(axis=1)) + at.start, np.flatnonzero(maybe.any(axis=0)) + to.start
        linked = (a.x[r] @ b.x[c].T) / (a.length[r][:, None] * b.length[c]) >= least
        if same and p == q:
            np.fill_diagonal(linked, True)  # r and c are equal
        if not linked.any():
            continue
        r, c, linked = r[linked.any(axis=1)], c[linked.any(axis=0)], linked[linked.any(axis=1)][:, linked.any(axis=0)]
        of_a[r] += linked @ b.weight[c]
        if not (same and p == q):
            of_b[c] += linked.T @ a.weight[r]
        row, col = stars(linked)
        merge(parent, np.r_[r, c + shift], np.r_[r[row], r[col]])
    return of_a, of_b, parent


# ---- the join -------------------------------------------------------------------
def near_blocks(blocks: DataFrame, n_blocks: int, long2: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks that are not provably farther apart than a link is long."""
    last = (n_blocks - 1) // CHUNK
    col = lambda x, side: F.col(f"{side}.{x}")
    near = gap(col("lo", "x"), col("hi", "x"), col("lo", "y"), col("hi", "y")) <= F.lit(long2 + SLACK)
    chunk = chunk_boxes(blocks)
    ahead = chunk.withColumn("other", F.explode(F.sequence("chunk", F.lit(last).cast("long"))))
    chunks = ahead.alias("x").join(chunk.alias("y"), F.col("x.other") == F.col("y.chunk")).where(near).select(F.col("x.chunk").alias("ca"), F.col("x.other").alias("cb"))
    of = blocks.withColumn("chunk", (F.col("block") / CHUNK).cast("long"))
    first = chunks.join(of, F.col("ca") == F.col("chunk")).select("cb", "block", "lo", "hi").alias("x")
    both = first.join(of.alias("y"), F.col("x.cb") == F.col("y.chunk")).where((F.col("x.block") <= F.col("y.block")) & near)
    return both.select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, grid: int = GRID, leaf: int = LEAF, n_blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    width = width_of(vectors, vec_col)
    rows = scratch.keep(packed(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), ["id"], "v", width, lambda x: (x, (x != 0).any(axis=1))), "vectors")
    distinct = rows.where("raw IS NOT NULL").groupBy("raw").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"))
    classes = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = class_links(classes, scratch, width, least, grid, leaf, n_blocks)
    linked = classes.join(found, "node", "left")
    name = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = linked.join(name, "component", "left").select("raw", F.col("n_links").alias("links"), "component_id")
    out = rows.join(result, "raw", "left")
    alone = F.col("raw").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.when(alone, F.lit(0)).otherwise(F.col("links") - 1).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def class_links(classes: DataFrame, scratch: Scratch, width: int, least: float, grid: int, leaf: int, n_blocks: int) -> DataFrame:
    """(node, n_links, component) of every class: n_links is the weight of all it links with, itself included."""
    packed_size = width * width + width + 1

    def moments(batch) -> np.ndarray:
        unit = units(batch.column(0).to_pylist(), width)[2]
        return np.concatenate([[len(unit)], unit.sum(axis=0), (unit.T @ unit).ravel()])

    found = fold(classes.select("raw"), moments)
    if found is None:
        return classes.select("node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component"))
    assert len(found) == packed_size
    n, mean = int(found[0]), found[1 : width + 1] / found[0]
    spread = found[width + 1 :].reshape(width, width) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(spread)[1][:, ::-1]
    longest = math.sqrt(max(2 - 2 * least, 1e-12))

    placed = numbered(with_cells(classes, width, axes[:, :grid], longest), ["cells", "node"])
    size = block_size(n, n_blocks, leaf, MOST_ROWS)
    placed = placed.select((F.col("position") / size).cast("long").alias("block"), "position", "node", "weight", "raw")
    box = scratch.keep(boxes(placed, "block", lambda raw: units(raw, width)[2] @ axes), "boxes")
    pairs = scratch.keep(near_blocks(box, math.ceil(n / size), 2 - 2 * least), "pairs")
    sides = pairs.select(F.col("a").alias("block"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.where("a < b").select(F.col("b").alias("block"), "a", "b", F.lit(1).alias("side")))
    joined = placed.join(sides, "block").groupBy("a", "b").applyInPandas(pair_join(width, axes, least, leaf), "node bigint, links bigint, root bigint")
    part = scratch.keep(joined, "links")
    total = part.groupBy("node").agg(F.sum("links").alias("n_links"))
    component = components(part.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    return total.join(component, "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("component"))


def with_cells(classes: DataFrame, width: int, axes: np.ndarray, longest: float) -> DataFrame:
    """Adds `cells`: the grid cell of each vector on the leading principal axes."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            cell = np.floor(units(batch.column("raw").to_pylist(), width)[2] @ axes / longest).astype(np.int32)
            yield batch.append_column("cells", pa.array(cell.tolist(), pa.list_(pa.int32())))

    rows = classes.select("node", "weight", "raw")
    return rows.mapInArrow(work, "node bigint, weight bigint, raw binary, cells array<int>")


def pair_join(width: int, axes: np.ndarray, least: float, leaf: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "position"])
        sides = [own for _, own in pdf.groupby("side")]
        made = [Interval(own["raw"].to_list(), own["weight"].to_numpy(), width, axes, leaf) for own in sides]
        of_a, of_b, parent = join_intervals(made[0], made[-1], least)
        node = pdf["node"].to_numpy()
        links = of_a + of_b if len(made) == 1 else np.r_[of_a, of_b]
        root = node[roots(parent, np.arange(len(parent)))]
        return pd.DataFrame({"node": node, "links": links, "root": root})[links > 0]

    return work


def op11_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS length FROM v),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.length * b.length) >= 0.9),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
links AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a),
least AS (SELECT a AS vec_id, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN links USING (vec_id) LEFT JOIN least USING (vec_id)
"""

by_value(__name__)
