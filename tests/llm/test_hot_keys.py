"""Many rows of one id, without an id, or of one text; texts with very many runs."""

import hashlib
import random
import time

import pytest

from fieldlab.llm import common, line_dedup, mixing, near_dedup, secrets, substring_dedup
from tests.llm.test_near_dedup import brute

DOC = "doc_id long, text string, source string"


@pytest.fixture
def tables(monkeypatch):
    """The tables a query keeps, by name."""
    kept = {}
    keep = common.Scratch.keep

    def remember(self, df, name):
        kept.setdefault(name, []).append(out := keep(self, df, name))
        return out

    monkeypatch.setattr(common.Scratch, "keep", remember)
    return kept


def test_near_copies_in_repeated_rows(spark, tables):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    near = words[:100] + ["other"] + words[101:]
    docs = spark.createDataFrame([(1, " ".join(words), "s")] * 2000 + [(2, " ".join(near), "s")] * 2000 + [(3, "alone in this", "s")] * 2 + [(None, " ".join(words), "s")], DOC)
    got = near_dedup.near_duplicates(docs, k=4).collect()
    assert len(got) == 4003
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)}
    assert tables["sets"][0].count() == 2 and all(t.count() <= 2 for t in tables["verified"])


def test_repeated_ids_of_different_texts(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 50)}" for _ in range(40)]
    rows = [(i, " ".join(base[a : a + 30])) for i, a in ((1, 0), (1, 0), (2, 1), (2, 1), (3, 10), (4, 9), (5, 1))]
    got = near_dedup.near_duplicates(spark.createDataFrame([(*r, "s") for r in rows], DOC), k=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(brute(rows, 4).items()) and len(got) == len(rows)


def test_mixing_spreads_null_and_repeated_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))
    rows = [(None, text(), "a") for _ in range(2000)] + [(7, text(), "a") for _ in range(2000)] + [(100 + i, text(), "b") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(len(t.split()) for _, t, _ in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(spark.createDataFrame(rows[::-1], DOC)).collect()))  # another order of the rows


def test_mixing_buckets(spark, tables):
    rows = [(None, f"text {i}", "a") for i in range(2000)] + [(7, f"text {i}", "a") for i in range(2000)]
    plan = mixing.mix(spark.createDataFrame(rows, DOC))
    assert plan.count() == 4000 and tables["again"][0].count() == 1
    ids = tables["sizes"][0].selectExpr("doc_id", "concat(key, substring(content, 1, 3)) AS bucket").distinct().groupBy("doc_id").count().collect()
    assert all(r["count"] > 100 for r in ids)


def test_substrings_of_repeated_rows(spark, tables):
    rng = random.Random(4)
    shared = " ".join(f"s{rng.randint(0, 999)}" for _ in range(60))
    one, two = (" ".join(f"{c}{rng.randint(0, 999)}" for _ in range(40)) + " " + shared for c in "ab")
    docs = spark.createDataFrame([(1, one, "s")] * 500 + [(2, two, "s")] * 500 + [(3, "x y", "s"), (4, two.replace(" ", "  "), "s")], DOC)
    got = substring_dedup.repeated_spans(docs).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(1, 100), (2, 100), (3, 0), (4, 100)} and len(got) == 1002
    assert tables["candidates"][0].count() <= 3


def test_secrets_among_very_many_runs(spark):
    def took(n):
        text = " ".join(f"{i:016x}x" for i in range(n))
        start = time.perf_counter()
        base = secrets.base_spans(text)
        assert len(base) == n and secrets.inefficient_spans(text, list, base) == []
        return time.perf_counter() - start

    took(1000)
    assert took(80_000) < 40 * max(took(8000), 0.02)  # 10 times as many; by the square it was 100


def test_taken_spans_are_joined():
    rng = random.Random(5)
    for _ in range(200):
        spans = sorted((("hex", a := rng.randint(0, 50), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 12))), key=lambda s: s[1])
        joined = secrets.joined_spans(spans)
        assert sorted({i for _, a, b in spans for i in range(a, b)}) == [i for a, b in joined for i in range(a, b)]


@pytest.mark.parametrize("crowd", [256, 16])
def test_lines_that_differ_in_digits(spark, tables, crowd):
    """Pairs grow with the lines and not with their square; links among such lines are found."""
    rng = random.Random(6)
    line = lambda a, b: f"request {a:08d} finished after {b:08d} steps on host alpha beta gamma"
    tested = []
    for n in (500, 2000):
        tables.clear()
        lines = [line(rng.randint(0, 10**8 - 1), rng.randint(0, 10**8 - 1)) for _ in range(n)]
        copies = [s.replace("finished", "finishd").replace("alpha", "alphaa") if i % 2 else s[:10] + "x" + s[11:] for i, s in enumerate(lines[:20])]
        docs = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
        got = line_dedup.line_dedup(docs, crowd=crowd).where("n_removed > 0").collect()
        close = {n + i for i in range(20)}
        assert {r.doc_id for r in got} == close
        tested.append(sum(t.count() for t in tables["pairs"]))
    assert tested[0] < 20 * 500 and tested[1] < 20 * 2000


def test_runs_outside_the_hub_keep_linked_lines_together(spark):
    rng = random.Random(7)
    letters = "abc 12"
    base = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(12)]

    def edited(s):
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :]])
        return s

    pairs = [(s, edited(s)) for s in base for _ in range(10)]
    lines = sorted({s for p in pairs for s in p})
    node = {s: i for i, s in enumerate(lines)}
    near = spark.createDataFrame([(i, s) for s, i in node.items()], "node long, line string")
    crowded = near.selectExpr("1L AS band", "node", "named_struct('own', true) AS fact")
    for level in (1, 2, 3):
        buckets = {}
        for r in line_dedup.by_grams(crowded, level, near, 2).collect():
            buckets.setdefault(r.node, set()).add(r.band)
        assert all(buckets[node[x]] & buckets[node[y]] for x, y in pairs)


def test_runs_are_worked_out_for_crowded_lines_only(spark, tables):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é€") for _ in range(n))
    crowded = [f"request {rng.randint(0, 10**8 - 1):08d} finished on host alpha beta gamma" for _ in range(40)]
    others = [text(60) for _ in range(100)]
    lines = crowded + others + [s + "x" for s in others]
    got = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), crowd=16).where("n_removed > 0").collect()
    assert {r.doc_id for r in got} == set(range(140, 240))
    assert tables["near"][0].count() == len(lines)
    line = {r.node: r.line for r in tables["near"][0].select("node", "line").collect()}
    runs = [[line[r.node] for r in t.select("node").collect()] for t in tables["runs"]]
    assert sorted(runs[0]) == sorted(crowded) and all(len(x) == len(set(x)) and set(x) <= set(crowded) for x in runs)
    for r in tables["near"][0].select("line", "counts").collect():
        assert list(r.counts) == [r.line.count(c) for c in line_dedup.COUNTED]


@pytest.mark.parametrize("keyed", [True, False])
def test_mixing_takes_rows_of_one_id_in_the_order_of_sizes(spark, keyed):
    """Also beside other ids with the same first digits, and where the mix ends within the rows of that id."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 7, i]), " ".join(["w"] * rng.randint(0, 9) + [f"x{rng.randint(0, 99)}"]), i) for i in range(400)]
    docs = [(d, t, "a", n) for d, t, n in rows] + [(1000, "v " * 100, "b", 400)]
    df = spark.createDataFrame(docs, DOC + ", n long")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for digits in (0, 1, 3):
        got = mixing.mix(df, bucket_digits=digits, row_col="n" if keyed else None).collect()
        left = sum(r.taken for r in got if r.source_size != 100)
        assert 0 < left < sum(len(t.split()) for _, t, _ in rows)
        want = []
        for _, _, size, _, d, n in sorted((md5(f"{mixing.SEED}:{'' if d is None else d}"), d or 0, len(t.split()), n if keyed else md5(t), d, n) for d, t, n in rows):
            want.append((d, size, min(size, left), n if keyed else None))
            left -= want[-1][2]
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.taken, r.n if keyed else None)) for r in got if r.source_size != 100)
