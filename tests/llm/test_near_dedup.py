import random

import numpy as np
import pytest

from fieldlab.llm import near_dedup as nd


def brute(rows, k, threshold=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 4)
    bases = [[word() for _ in range(rng.randint(20, 60))] for _ in range(4)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.6:
            w = list(bases[0] if kind < 0.4 else rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        elif kind < 0.8:
            w = passage + [f"y{rng.randrange(10)}" for _ in range(rng.randint(1, 7))]
        else:
            w = [word() for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 % 161, " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w)))
    return rows


@pytest.mark.parametrize("seed,k,small,hubs", [(1, 4, 64, 16), (2, 5, 2, 2)])
def test_components_equal_brute_force(spark, seed, k, small, hubs):
    rows = corpus(seed) + [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "One"), (3, rows_text(seed))]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = nd.near_duplicates(df, k=k, small_bucket=small, hubs=hubs).collect()
    want = brute(rows, k)
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got), [(r.doc_id, r.component_id, want[r.doc_id]) for r in got if r.component_id != want[r.doc_id]][:5]


@pytest.mark.parametrize("options", [{"threshold": 60}, {"bands": 16, "slots": 4}, {"threshold": 30}])
def test_cuts_follow_threshold_and_slots(spark, options):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(df, k=4, **options).collect()}
    assert got == brute(rows, 4, options.get("threshold", 80))


def test_defaults_of_the_queries():
    assert nd.layout(80) == (32, 4) and nd.sketch_cut(80, 128) == 85


def rows_text(seed):
    return corpus(seed)[1][1]


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a b c d e f"), (1, None), (1, None), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in nd.near_duplicates(nulls).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert nd.near_dedup(nulls).count() == 4


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    b = np.concatenate([a[:180], rng.integers(0, 2**63, 20, dtype=np.uint64)])
    flat, owner = np.concatenate([a, b]), np.repeat([0, 1], 200)
    sig = nd.superminhash(flat, owner, 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 180 / 220) < 0.06
    # each element's values lie on distinct slots: one element fills all of them
    one = nd.superminhash(a[:1], np.zeros(1, dtype=np.int64), 1, 64)
    assert sorted(one[0] >> np.uint64(32)) == list(range(64))
