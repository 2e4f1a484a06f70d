"""Operators on embeddings against brute force over all pairs of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.llm import embedding_dedup as ed
from fieldlab.llm import hard_negatives as hn
from fieldlab.llm import whitening as wh

VEC = "vec_id long, embedding array<float>, label int, kept string, node string"  # extra columns with names that results and steps use


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label, "x", "y") for i, v, label in rows], VEC)


def awkward(rng, dims):
    """Rows with nulls, zeros, non-finite entries, short vectors, repeats and chains of near copies."""
    rows = [(i, rng.normal(size=dims), int(rng.integers(0, 4))) for i in range(400)]
    base = rng.normal(size=dims)
    rows += [(1000 + i, base + rng.normal(size=dims) * 0.02, 1) for i in range(120)]  # linked throughout
    rows += [(2000 + i, base * 3, 2) for i in range(30)]  # equal
    at = rng.normal(size=dims)
    for i in range(60):  # a chain whose ends aren't linked
        at = at + rng.normal(size=dims) * 0.25 * np.linalg.norm(at) / math.sqrt(dims)
        rows.append((3000 + i, at, 3))
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (6, rows[7][1], 2), (None, rows[8][1], 0), (None, rng.normal(size=dims), None)]
    rows += [(4000, None, 1), (4001, [0.0] * dims, 1), (4002, [math.nan] + [1.0] * (dims - 1), 1), (4003, [None] + [1.0] * (dims - 1), 1), (4004, [], 1), (4005, [math.inf] * dims, 1)]
    rows += [(4006, [1.0, 2.0], 1), (4007, [1.0, 2.0] + [0.0] * (dims - 2), 1), (4008, [-0.0, 1.0], 1), (None, None, None)]
    return rows


def whole(v, dims):
    """The row as float64 filled up with zeros; None where it doesn't count."""
    if v is None or any(c is None or not math.isfinite(np.float32(c)) for c in v):
        return None
    return np.array([float(np.float32(c)) for c in v] + [0.0] * (dims - len(v)))


def brute_links(rows, dims, least=0.9):
    xs = [whole(v, dims) for _, v, _ in rows]
    good = [k for k, x in enumerate(xs) if x is not None and x.any()]
    x = np.array([xs[k] for k in good]).reshape(-1, dims)
    n = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / (n[:, None] * n) >= least
    np.fill_diagonal(linked, False)
    root = list(range(len(good)))
    for _ in good:
        new = [min([root[a], *(root[b] for b in np.flatnonzero(linked[a]))]) for a in range(len(good))]
        if new == root:
            break
        root = new
    out = [(i, 0, i, True) for i, *_ in rows]
    for a, k in enumerate(good):
        ids = [rows[good[b]][0] for b in range(len(good)) if root[b] == root[a] and rows[good[b]][0] is not None]
        least_id = min(ids) if ids else None
        out[k] = (rows[k][0], int(linked[a].sum()), least_id, rows[k][0] == least_id)
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaf", "blocks"), [(512, 12), (16, 5), (8, 90)])
def test_near_duplicates(spark, leaf, blocks):
    rows = awkward(np.random.default_rng(3), 12)
    got = ed.near_duplicates(frame(spark, rows), leaf=leaf, n_blocks=blocks)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows, 12)


def test_near_duplicates_edges(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(2, [1.0], 1)], [(2, [1e30], 1), (1, [1e-30], None)]):
        assert sorted((tuple(r) for r in ed.near_duplicates(frame(spark, rows)).collect()), key=str) == brute_links(rows, 1)


def test_whole_intervals_are_counted_not_compared():
    rng = np.random.default_rng(1)
    x = rng.normal(size=8) + rng.normal(size=(300, 8)) * 1e-3
    made = ed.Interval([r.tobytes() for r in x], np.ones(300, np.int64), 8, np.eye(8), 16)
    made.unit = None  # a comparison would fail
    links, none, parent = ed.join_intervals(made, made, 0.9)
    assert (links == 300).all() and (none == 0).all() and (ed.roots(parent, np.arange(300)) == 0).all()


# ---- whitening ---------------------------------------------------------------------
def brute_whitened(rows, dims, most=32):
    """id to (n, deviation, whitened of components) by plain numpy and whole numbers of any size."""
    good = [(i, whole(v, dims)) for i, v, _ in rows if whole(v, dims) is not None]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    z = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    v = z.T @ z / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    return [i for i, _ in good], n, deviation, z @ axes / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    rows = [r for r in awkward(rng, 40) if r[1] is None or len(r[1]) != 40 or r[0] is None or not 2000 <= r[0] < 4000]
    got = wh.whiten(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    ids, n, deviation, whitened, explained = brute_whitened(rows, 40)
    assert len(got) == 32 * len(ids) and {r.n for r in got} == {n} and all(r.identity_error <= 1e-9 for r in got)
    of = {}
    for r in got:
        of.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert sorted(map(str, of)) == sorted(map(str, set(zip(ids, deviation))))
    signs = np.ones(32)
    for k in range(32):
        first = next(j for j in range(len(ids)) if abs(whitened[j, k]) > 0.1)
        signs[k] = np.sign(of[ids[first], deviation[first]][k + 1][0] * whitened[first, k])
    for j, key in enumerate(zip(ids, deviation)):
        for k in range(32):
            assert any(abs(v - signs[k] * whitened[j, k]) < 1e-8 for v in of[key][k + 1])


def test_whitening_edges(spark):
    run = lambda rows, **kw: [tuple(r) for r in wh.whiten(frame(spark, rows), **kw).orderBy("vec_id", "component").collect()]
    assert run([]) == run([(1, None, 1)]) == run([(1, [], 1)]) == run([(1, [math.nan], 1), (2, [1e30], 1)]) == []
    assert run([(3, [0.5, 1.0], 1)]) == [(3, c, 1, 0, None, None, None) for c in (1, 2)]
    two = run([(3, [0.5, 1.0], 1), (None, [1.5, 1.0], 1), (None, [1.5, 1.0], 1)])
    assert [r[:4] for r in two] == [(i, c, 3, d) for i, d in ((None, 64**2), (None, 64**2), (3, 128**2)) for c in (1, 2)] or [r[3] for r in two] == [64**2] * 4 + [128**2] * 2
    assert all((r[4] is None) == (r[1] == 2) and abs(r[5] - (r[1] == 1)) < 1e-12 and r[6] < 1e-12 for r in two)
    assert abs(abs(two[-2][4]) - math.sqrt(2)) < 1e-12
    wide = run([(1, [2.0**50], 1), (2, [-(2.0**50)], 1)])
    assert [r[3] for r in wide] == [None, None] and all(abs(abs(r[4]) - 1) < 1e-12 for r in wide)


def test_eigenvectors_of_clusters():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(50, 50)))[0]
    for values in (np.linspace(1, 2, 50), [5, 5 + 1e-9, 5 + 2e-9, *np.linspace(1, 2, 47)], [1.0] * 10 + [1 + 1e-12] * 10 + list(np.linspace(2, 3, 30)), [0.0] * 30 + list(np.linspace(1, 2, 20)), 10.0 ** np.linspace(-12, 3, 50)):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        e, x = wh.eigenvectors(a)
        high = np.longdouble
        assert np.abs(a.astype(high) @ x.astype(high) - x.astype(high) * e.astype(high)).max() < 2e-16 * max(values)
        assert np.abs(x.T @ x - np.eye(50)).max() < 4e-15 and (np.diff(e) <= 0).all()
    assert [tuple(map(np.shape, wh.eigenvectors(m))) for m in (np.zeros((3, 3)), np.eye(2))] == [((3,), (3, 3)), ((2,), (2, 2))]


# ---- hard negatives --------------------------------------------------------------------
def brute_negatives(rows, dims, anchor):
    good = [(math.inf if i is None else i, [math.floor(256 * c) for c in whole(v, dims)], label) for i, v, label in rows if label is not None and whole(v, dims) is not None]
    out = []
    for i, x, label in good:
        if i == math.inf or not anchor(i):
            continue
        s = [(-sum(p * q for p, q in zip(x, y)), j, other) for j, y, other in good if j != i]
        s = sorted(t for t in s)
        positives = [t for t in s if t[2] == label][:5]
        for p, j, _ in positives:
            found = [t for t in s if t[2] != label and 80 * -p <= 100 * -t[0] <= 100 * -p][:5]
            named = lambda v: None if v == math.inf else v
            out += [(i, named(j), rank, named(k), -p, -q) for rank, (q, k, _) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("dims", "blocks", "least"), [(6, 24, 256), (24, 150, 1)])
def test_hard_negatives(spark, dims, blocks, least):
    rows = awkward(np.random.default_rng(8), dims)
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, n_blocks=blocks, least_rows=least)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, dims, lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_hard_negatives_edges(spark):
    for rows in ([], [(1, None, 1)], [(0, [], 1)], [(0, [1.0], 1)], [(0, [1.0], None), (1, [1.0], 1)], [(0, [1.0], 1), (2, [1.0], 1), (1, [0.9], 2), (3, [1.1], 2), (5, [0.85], 3)]):
        got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows, 1, lambda i: i % 10 == 0)


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(np.ndindex(*[1 << bits] * dims)))
        key = hn.curve_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_scores_are_exact():
    for top in (2**20, 2**27, 2**40, 2**60):
        a = np.array([[top - 1, -top, 3]], dtype=np.int64)
        want = (top - 1) ** 2 + top**2 + 9
        assert hn.scores(a, a)[0, 0] == min(want, 2**63 - 1)
