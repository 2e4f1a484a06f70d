"""Orders by chance that are computed, not sorted: a keyed permutation of the positions 0 .. n - 1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of mixing, and how many divisions of the positions into rows and columns are tried.
ROUNDS, TRIED = 6, 100_000


def grid(n: int) -> tuple[int, int]:
    """Rows and columns, both near the square root, that hold n positions with as few to spare as can be."""
    root = max(1, math.isqrt(n))
    rows = min(range(root, max(0, root - max(root // 2, 1), root - TRIED), -1), key=lambda a: -n % a)
    return rows, -(-n // rows)


def permuted(position: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """The place of a position (0 .. n - 1) in a random order of all, another for each seed and epoch.

    Positions are cells of a grid; each round moves a cell along its row or
    column by a hash of the other coordinate, which is a bijection (a Feistel
    network). Of the few cells beyond the last position a walk goes on until
    it meets a position; it takes at most as many steps as there are such
    cells.
    """
    rows, columns = grid(max(1, n))

    def step(v: Column) -> Column:
        row, column = (v / columns).cast("long"), v % columns
        for r in range(ROUNDS):
            key = [F.lit(seed), F.lit(epoch), F.lit(r)]
            if r % 2:
                row = (row + F.pmod(F.xxhash64(*key, column), F.lit(rows))) % rows
            else:
                column = (column + F.pmod(F.xxhash64(*key, row), F.lit(columns))) % columns
        return row * columns + column

    whole = lambda v: F.floor(v).cast("long")
    spare = rows * columns - n
    first = whole(step(position.cast("long")))
    if not spare:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(spare)), first, lambda v, _: F.when(v < n, v).otherwise(whole(step(v))))
