"""What the operators on embeddings share: packed vectors, folds over all rows, blocks of an order and their boxes.

A vector travels as the bytes of its numbers. Vectors shorter than the longest
of their table count as filled up with zeros; those that are null or hold null
or non-finite entries are packed as null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import by_value

#: Blocks of one chunk: boxes are compared chunk by chunk before block by block.
CHUNK = 64
#: Tasks that add up what all others found before the driver gets it.
LAST_TASKS = 8


def width_of(vectors: DataFrame, vec_col: str) -> int:
    """Entries of the longest vector."""
    return max(0, vectors.agg(F.max(F.size(vec_col))).first()[0] or 0)


def dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows as float64 of `width` entries, which are whole and finite)."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = np.asarray(pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat  # nulls have become NaN
    return out + 0.0, np.isfinite(out).all(axis=1) & column.is_valid().to_numpy(zero_copy_only=False)


def binary(values: np.ndarray, good: np.ndarray) -> pa.Array:
    """A row's numbers as bytes; null where a row isn't good."""
    size = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int64) * size
    whole = pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return pc.if_else(pa.array(good), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def unpacked(raw, width: int, kind: str) -> np.ndarray:
    """(rows, width) of the bytes of many rows, none of them null."""
    return np.frombuffer(b"".join(raw if isinstance(raw, list) else list(raw)), dtype=kind).reshape(len(raw), width)


def packed(vectors: DataFrame, keep: list[str], vec_col: str, width: int, f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The columns `keep` and `raw`: what f makes of rows of finite float64 vectors, as bytes. f gives (rows of numbers, which of them count)."""
    rows = vectors.select(*keep, F.col(vec_col).alias("raw"))
    schema = rows.drop("raw").schema.add("raw", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = dense(batch.column(len(keep)), width)
            x[~good] = 0
            made, counts = f(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], binary(made, good & counts)], names=[*keep, "raw"])

    return rows.mapInArrow(work, schema)


def fold(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, kind: str = "<f8") -> np.ndarray | None:
    """f of every batch, added up within tasks, then in a few tasks, then here: what reaches the driver doesn't grow with the rows. None without rows."""

    def total(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = None
        for part in parts:
            out = part if out is None else add(out, part)
        if out is not None:
            yield pa.RecordBatch.from_pydict({"part": [np.ascontiguousarray(out, dtype=kind).tobytes()]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (np.frombuffer(b, dtype=kind) for batch in batches for b in batch.column(0).to_pylist())

    first = rows.mapInArrow(lambda batches: total(f(b).ravel() for b in batches if b.num_rows), "part binary")
    last = first.repartition(LAST_TASKS).mapInArrow(lambda batches: total(read(batches)), "part binary")
    out = None
    for r in last.collect():  # LAST_TASKS rows
        part = np.frombuffer(r["part"], dtype=kind)
        out = part if out is None else add(out, part)
    return out


# ---- boxes --------------------------------------------------------------------
def _boxes(parts: DataFrame, by: str) -> DataFrame:
    def work(pdf):
        import pandas as pd

        lo, hi = np.stack(pdf["lo"].to_list()).min(axis=0), np.stack(pdf["hi"].to_list()).max(axis=0)
        return pd.DataFrame({by: [int(pdf[by].iloc[0])], "lo": [lo], "hi": [hi]})

    return parts.groupBy(by).applyInPandas(work, f"{by} bigint, lo array<double>, hi array<double>")


def boxes(rows: DataFrame, by: str, f: Callable[[list], np.ndarray]) -> DataFrame:
    """(by, lo, hi): per dimension the least and largest coordinate of the rows of each value of `by`, a long. f: bytes of rows to their coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x = batch.column(0).to_numpy(zero_copy_only=False), f(batch.column(1).to_pylist())
            order = np.argsort(key, kind="stable")
            key, x = key[order], x[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lo, hi = np.minimum.reduceat(x, at, axis=0), np.maximum.reduceat(x, at, axis=0)
            yield pa.RecordBatch.from_pydict({by: pa.array(key[at], pa.int64()), "lo": pa.array(lo.tolist(), pa.list_(pa.float64())), "hi": pa.array(hi.tolist(), pa.list_(pa.float64()))})

    parts = rows.select(by, "raw").mapInArrow(work, f"{by} bigint, lo array<double>, hi array<double>")
    return _boxes(parts, by)


def chunk_boxes(blocks: DataFrame, by: str = "block") -> DataFrame:
    """(chunk, lo, hi) of consecutive blocks."""
    return _boxes(blocks.select((F.col(by) / CHUNK).cast("long").alias("chunk"), "lo", "hi"), "chunk")


def gap(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Squared distance of two boxes, 0 where they meet."""
    apart = F.zip_with(F.zip_with(alo, bhi, lambda x, y: x - y), F.zip_with(blo, ahi, lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def product_bound(alo: Column, ahi: Column, blo: Column, bhi: Column, of: Callable[..., Column]) -> Column:
    """Bound of the inner product of any two members of two boxes by interval arithmetic: of is F.greatest or F.least."""
    left, right = F.arrays_zip(alo.alias("l"), ahi.alias("h")), F.arrays_zip(blo.alias("l"), bhi.alias("h"))
    each = F.zip_with(left, right, lambda a, b: of(a["l"] * b["l"], a["l"] * b["h"], a["h"] * b["l"], a["h"] * b["h"]))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def block_size(n: int, blocks: int, least: int, most: int) -> int:
    """Rows of a block: so many blocks of a small table, and no block larger than `most`."""
    return min(most, max(least, math.ceil(n / blocks)))


by_value(__name__)
