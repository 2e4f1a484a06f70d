import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import augment, counts, evaluate, filters, intervals, lookups, sampling, windows


# ---- labelling by overlap: six fixed cases and brute force -------------------
SELECTIONS = [(10, 20, "dog", None), (25, 30, "dog", ["species1"]), (30, 40, "cat", ["species1"]), (50, 60, "dog", ["species1", "species2"])]


def label(spark, snippets, selections=SELECTIONS, **options):
    s = spark.createDataFrame([("r", i, float(a), float(b)) for i, (a, b) in enumerate(snippets)], "recording_id string, snippet_id int, start double, end double")
    n = spark.createDataFrame([("r", float(a), float(b), sp, m) for a, b, sp, m in selections], "recording_id string, begin double, finish double, species string, mix array<string>")
    return intervals.label_by_overlap(s, n, **options)


def test_fixed_cases(spark):
    cases = [(5, 6), (6, 12), (12, 16), (14, 22), (28, 35), (65, 70)]
    rows = {r.snippet_id: r for r in label(spark, cases).where("is_primary").collect()}
    assert [rows[i].label for i in range(6)] == ["noise", "dog", "dog", "dog", "dog", "noise"]
    assert rows[4].mix == ["cat", "species1"] and rows[1].mix == []
    copies = label(spark, cases).where("NOT is_primary").collect()
    assert sorted((r.snippet_id, r.label) for r in copies) == [(4, "cat"), (4, "species1")]


def test_noise_rows(spark):
    only_mix = label(spark, [(0, 5)], [(1, 2, "no bird", ["a b"])])
    assert [(r.label, r.is_primary) for r in only_mix.collect()] == [("a_b", False)]
    assert [r.label for r in label(spark, [(0, 5)], [(1, 2, "no bird", None)]).collect()] == ["noise"]


@pytest.mark.parametrize("width", [None, 7, 1, 30])
def test_overlap_equals_brute_force(spark, width):
    rng = random.Random(4)
    sel = [(a := rng.randint(0, 100), a + rng.randint(1, 30), rng.choice("abcd"), None) for _ in range(40)]
    snip = [(a := rng.randint(-5, 120), a + rng.randint(1, 10)) for _ in range(40)]
    got = {r.snippet_id: (r.label, r.mix) for r in label(spark, snip, sel, part_rows=width).where("is_primary").collect()}
    for i, (lo, hi) in enumerate(snip):
        over = sorted(s[:3] for s in sel if s[0] <= hi and s[1] > lo)
        want = (over[0][2], sorted({s[2] for s in over} - {over[0][2]})) if over else ("noise", [])
        assert got[i] == want


def test_overlap_in_parts(spark, monkeypatch):
    """One annotation over all of a long recording costs a row per part; keys, ties, repeats and nulls."""
    rng = random.Random(9)
    notes = [("r", 0, 10_000, "week", None)] + [("r", a := rng.randint(0, 10_000), a + rng.randint(0, 20), rng.choice("abcd"), ["m"]) for _ in range(300)]
    notes += [("q", 5, 9, "q", None), (None, 0, 99, "none", None), ("r", None, 50, "x", None), ("r", 4, None, "x", None), ("s", 1, 2, "s", None)]
    snips = [("r", i, t := rng.choice([50, 51, rng.randint(-100, 10_100)]), t + rng.randint(0, 15)) for i in range(400)]
    snips += [("q", 1, 0, 5), ("q", 2, 9, 12), (None, 3, 0, 5), ("r", 9000, None, 7), ("r", 9001, 3, None), ("r", 5, snips[5][2], snips[5][3])]
    s = spark.createDataFrame(snips, "recording_id string, snippet_id int, start int, end int")
    n = spark.createDataFrame(notes, "recording_id string, begin int, finish int, species string, mix array<string>")
    want = sorted(map(str, intervals.label_by_overlap(s, n).collect()))
    written = []
    keep = intervals.kept
    monkeypatch.setattr(intervals, "kept", lambda df, name: written.append((name, out := keep(df, name))) or out)
    assert sorted(map(str, intervals.label_by_overlap(s, n, part_rows=16).collect())) == want
    dealt = dict(written)["dealt"]
    assert dealt.where("_a.label = 'week'").count() <= 26 and dealt.count() < 1500  # 401 snippets are 26 parts
    assert sorted(map(str, intervals.label_by_overlap(s, n, part_rows=1000).collect())) == want
    assert intervals.label_by_overlap(s, n.limit(0), part_rows=16).where("label <> 'noise'").count() == 0
    assert intervals.label_by_overlap(s.limit(0), n, part_rows=16).count() == 0


def test_nested_lists():
    rng = np.random.default_rng(0)
    for size, spread in ((0, 5), (1, 5), (200, 10), (200, 1000)):
        begin = rng.integers(0, 100, size).astype(float)
        finish = begin + rng.integers(0, spread, size)
        lists = intervals.nested_lists(begin, finish)
        assert sorted(i for own in lists for i in own) == list(range(size))
        assert all((np.diff(begin[own]) >= 0).all() and (np.diff(finish[own]) >= 0).all() for own in lists)
        start = rng.integers(-5, 110, 50).astype(float)
        end = start + rng.integers(0, 20, 50)
        at, to = intervals.overlapping(start, end, begin, finish)
        assert sorted(zip(at, to)) == [(i, j) for i in range(50) for j in range(size) if begin[j] <= end[i] and finish[j] > start[i]]


@pytest.mark.parametrize("x,want", [(0, -1), (1, 0), (2, 0), (3, -1), (4, 1), (5, -1), (6, 2), (8, -1)])
def test_point_in_interval(spark, x, want):
    iv = spark.createDataFrame([(1.0, 3.0, 0), (4.0, 5.0, 1), (6.0, 7.0, 2)], "low double, high double, index int")
    got = intervals.point_in_interval(spark.createDataFrame([(float(x),)], "x double"), iv, x="x", bin_width=2.0).first()
    assert got.interval == want
    with pytest.raises(ValueError):
        intervals.point_in_interval(iv, iv, x="low")


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 9, "c")], "k int, t int, v string")
    le = {(r.k, r.t): r.le for r in intervals.asof_le(left, right, on="t", keys=["k"], value="v").collect()}
    gt = {(r.k, r.t): r.gt for r in intervals.asof_gt(left, right, on="t", keys=["k"], value="v").collect()}
    assert le == {(1, 5): "a", (1, 7): "b", (2, 1): None} and gt == {(1, 5): "b", (1, 7): "c", (2, 1): None}


def test_asof_nulls_and_bins(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, *range(40)])
    left = [(i, rng.choice([None, 1, 2]), some()) for i in range(200)]
    right = [(rng.choice([None, 1, 2, 3]), some(), rng.choice([None, "v"])) for _ in range(60)]
    right = list({(k, t): (k, t, v and f"{k}:{t}") for k, t, v in right}.values())
    l, r = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, t int, v string")
    for f, after in ((intervals.asof_le, False), (intervals.asof_gt, True)):
        want = {}
        for i, k, t in left:
            fit = [(u, v) for q, u, v in right if q == k and u is not None and v is not None and t is not None and (u > t if after else u <= t)]
            want[i] = (min(fit) if after else max(fit))[1] if fit else None
        for bins in (None, F.floor(F.col("t") / 7), F.lit(1)):
            assert {x.i: x.out for x in f(l, r, on="t", keys=["k"], value="v", out="out", bins=bins).collect()} == want


# ---- evaluation --------------------------------------------------------------
LABELS = [1, 0, 0, 1, 1, 1, 0, 1, 0, 1, 1, 1, 1, 0, 0, 0]
SCORES = [0.7, 0.3, 0.5, 0.6, 0.55, 0.9, 0.4, 0.2, 0.4, 0.3, 0.7, 0.5, 0.8, 0.2, 0.3, 0.35]
STEPS = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65]


def test_pr_curve_golden(spark):
    curve = evaluate.pr_curve(spark.createDataFrame(list(zip(LABELS, SCORES)), "label int, score double"), STEPS)
    rows = curve.orderBy("i").collect()
    assert [round(r.precision, 4) for r in rows] == [0.5625, 0.5714, 0.5714, 0.6364, 0.7, 0.875, 0.875, 1, 1, 1]
    assert [round(r.recall, 4) for r in rows] == [1, 0.8889, 0.8889, 0.7778, 0.7778, 0.7778, 0.7778, 0.6667, 0.5556, 0.4444]
    best = evaluate.best_operating_point(curve).first()
    assert (best.threshold, round(best.f1, 3), round(best.precision, 3), round(best.recall, 3)) == (0.45, 0.824, 0.875, 0.778)
    assert round(evaluate.average_precision(curve).first().average_precision, 5) == 0.88988


def test_matrix_and_scores(spark):
    truth = [0, 0, 0, 1, 1, 2, 2, 2, 2, 3]
    pred = [0, 0, 1, 1, 2, 2, 2, 2, 0, 4]
    p = spark.createDataFrame(list(zip(truth, pred)), "label int, pred int")
    classes = spark.createDataFrame([(i,) for i in range(6)], "class_id int")
    m = evaluate.confusion_matrix(p, classes)
    assert m.count() == 36 and m.agg(F.sum("n")).first()[0] == 10
    norm = {(r.truth, r.pred): r.share for r in evaluate.normalize_rows(m).collect()}
    assert norm[2, 2] == 0.75 and norm[5, 0] is None
    assert {(r.truth, r.pred): r.percent for r in evaluate.confusion_percent(m).collect()}[0, 0] == 66
    s = {r.cls: r for r in evaluate.class_scores(m, zero_division=1.0).collect()}
    assert set(s) == {0, 1, 2, 3, 4} and s[4].recall == 1.0 and s[4].precision == 0.0 and s[3].precision == 1.0
    total = evaluate.summary_scores(m).first()
    assert total.accuracy == 0.6 and abs(total.balanced_accuracy - (2 / 3 + 0.5 + 0.75 + 0) / 4) < 1e-12
    assert abs(total.adjusted_balanced_accuracy - (total.balanced_accuracy - 0.25) / 0.75) < 1e-12
    placed = {r.cls: r.recall for r in evaluate.place_on_all_classes(evaluate.class_scores(m), classes).collect()}
    assert placed[4] is None and placed[5] is None and placed[2] == 0.75


def test_curves_of_classes(spark):
    rows = [(i % 3, [float(i % 5), float(i % 7), float(i % 3)]) for i in range(60)]
    p = spark.createDataFrame(rows, "label int, logits array<double>")
    curves = evaluate.pr_curves_multiclass(p)
    assert curves.count() == 12
    summaries = evaluate.curve_summary(curves)
    assert summaries.count() == 3 and evaluate.best_and_worst_curve(summaries).first().best is not None
    assert 0 <= evaluate.mean_average_precision(curves).first()[0] <= 1
    q = p.withColumn("pred", F.lit(1))
    got = evaluate.testing_result_summary(q, classes=3)
    assert got.count() == 3
    report = evaluate.score_report(q, spark.createDataFrame([(i,) for i in range(3)], "class_id int"))
    assert set(report) == {"matrix", "percent", "class_scores", "summary", "curves", "curve_summaries", "map"}
    assert filters.well_defined(summaries).count() <= 3


def test_epochs_and_runs(spark):
    p = spark.createDataFrame([("r", e, ph, 1, int(e > 0)) for e in range(3) for ph in ("training", "validating")], "run_id string, step int, phase string, label int, pred int")
    loss = spark.createDataFrame([("r", 0, "training", 4.0, 2), ("r", 0, "training", 2.0, 2)], "run_id string, step int, phase string, loss double, batch_size int")
    epochs = evaluate.epoch_summary(p, loss)
    first = epochs.where("step = 0 AND phase = 'training'").first()
    assert first.mean_loss == 1.5 and first.accuracy == 0.0
    board = evaluate.run_leaderboard(epochs).first()
    assert board.last_step == 2 and board.accuracy_training == 1.0 and board.accuracy_testing is None
    flat = spark.createDataFrame([("r", i, 0.5 + 0.001 * i) for i in range(20)], "run_id string, step int, accuracy double")
    assert [r.step for r in evaluate.plateau(flat).where("stop").collect()] == [15, 16, 17, 18, 19]
    mean = evaluate.aggregate_matrices(spark.createDataFrame([(0, 0, 0, 4), (1, 0, 0, 2)], "step int, truth int, pred int, n int")).first()
    assert mean.mean_n == 3.0
    table = evaluate.per_class_train_val(spark.createDataFrame([(0, "training", 0.26), (0, "validating", 0.74)], "cls int, phase string, f1 double")).first()
    assert (table.training, table.validating) == (0.3, 0.7)


# ---- sampling ----------------------------------------------------------------
def ids(spark, n, classes=2):
    return spark.createDataFrame([(i, i % classes) for i in range(n)], "id int, cls int")


def test_folds_partition_rows(spark):
    rows = ids(spark, 34)
    f = sampling.stratified_kfold(rows, 3, cls="cls", ident="id")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sum(sizes) == 34 and max(sizes) - min(sizes) <= 1
    splits = sampling.fold_splits(f, 3)
    assert sampling.leaking_ids(splits, "id").count() == 0
    assert splits.where("role = 'validate'").select("id").distinct().count() == 34
    again = sampling.stratified_kfold(rows.repartition(3), 3, cls="cls", ident="id")
    assert sorted(f.collect()) == sorted(again.collect())
    assert sorted(f.collect()) != sorted(sampling.stratified_kfold(rows, 3, cls="cls", ident="id", epoch=1).collect())
    b = sampling.fold_batches(splits, 5, ident="id", drop_last=True)
    assert {r["count"] for r in b.groupBy("split", "batch").count().collect()} == {5}


def test_shards(spark):
    at = sampling.positions(ids(spark, 10), "id")
    pad = sampling.shard(at, 4)
    assert sorted(r["count"] for r in pad.groupBy("replica").count().collect()) == [3, 3, 3, 3] and pad.select("id").distinct().count() == 10
    drop = sampling.shard(at, 4, drop_last=True)
    assert sorted(r["count"] for r in drop.groupBy("replica").count().collect()) == [2, 2, 2, 2]
    few = sampling.shard(at.where("position < 2"), 5)
    assert few.count() == 5


def test_cuts(spark):
    r = sampling.keep_percent_per_class(ids(spark, 12), 20, cls="cls", ident="id")
    assert [x["count"] for x in r.groupBy("cls").count().collect()] == [1, 1]
    assert sampling.holdout_percent(ids(spark, 10), 20, ident="id").where("held_out").count() == 2
    assert sampling.holdout_percent(ids(spark, 10), 0, ident="id").where("held_out").count() == 0
    assert sampling.holdout_percent_per_class(ids(spark, 18), 20, cls="cls", ident="id").where("split = 'validation'").count() == 2
    assert sampling.sample_across_classes(ids(spark, 20, 4), 10, cls="cls", ident="id").count() == 8
    assert sampling.shuffle(ids(spark, 10), "id").collect() == sampling.shuffle(ids(spark, 10).repartition(3), "id").collect()


# ---- plans, windows, catalogs --------------------------------------------------
def test_quotas(spark):
    c = spark.createDataFrame([("foo", 10), ("bar", 25), ("fum", 50)], "class_name string, num_samples int")
    need = lambda g, **o: {r.class_name: r.need for r in augment.quota(c, g, **o).collect()}
    assert need("median") == {"foo": 15, "bar": 0, "fum": 0}
    assert need("max") == {"foo": 40, "bar": 25, "fum": 0}
    assert need("tenth") == {"foo": 0, "bar": 0, "fum": 0}
    assert need("number", number=30) == {"foo": 20, "bar": 5, "fum": 0}
    own = spark.createDataFrame([("foo", "max")], "class_name string, goal string")
    assert need("median", goals=own) == {"foo": 40, "bar": 0, "fum": 0}
    with pytest.raises(ValueError):
        augment.quota(c, "most")
    files = spark.createDataFrame([("foo", f"f{i}") for i in range(4)], "class_name string, path string")
    given = augment.allocate_round_robin(files, augment.quota(c, "median"))
    assert [r.augmentations for r in given.orderBy("path").collect()] == [4, 4, 4, 3]
    slots = augment.assign_methods(given, ["a", "b", "c", "d"])
    assert slots.count() == 15
    per = slots.where("path = 'f0'").orderBy("slot").collect()
    assert len({r.method for r in per[:3]}) == 3 and per[3].method == per[0].method
    many = spark.createDataFrame([("foo", f"f{i}") for i in range(4)] + [("fum", f"g{i}") for i in range(50)], "class_name string, path string")
    done = augment.balance_to_target(many, augment.class_target(c, "median"), {"a": 1.0, "b": 3.0})
    assert {r.class_name: r["count"] for r in done.groupBy("class_name").count().collect()} == {"foo": 25, "fum": 25}
    assert done.where("copy > 0 AND method IS NULL").count() == 0


def test_grid(spark):
    g = augment.parameter_grid({"lr": [0.1, 0.2], "bs": [32, 64, 128]}, spark)
    assert g.count() == 6 and g.where("lr = '0.1' AND bs = '64'").first().settings == {"lr": "0.1", "bs": "64"}


def test_windows(spark):
    s = spark.createDataFrame([("a", 1000, 20.0), ("b", 100, 3.0)], "path string, width int, duration double")
    w = windows.spectrogram_windows(s, least_columns=1).orderBy("start_column").collect()
    assert {r.path for r in w} == {"a"} and w[0].columns == int(5 // 0.02) and w[1].start_column == int(2 // 0.02) and all(r.start_column + r.columns <= 1000 for r in w)
    a = spark.createDataFrame([("a", 2, [float(i) for i in range(20)])], "path string, sr int, samples array<double>")
    got = windows.audio_windows(a).orderBy("start_time").collect()
    assert [r.start_time for r in got] == [0, 1, 2, 3, 4] and got[1].samples == [float(i) for i in range(2, 12)]
    row = a.select(windows.gain("samples", 20).alias("g"), windows.time_shift("samples", 1.5, 2).alias("t"), windows.mask_stripe("samples", 1, 2, F.lit(0.0)).alias("m")).first()
    assert abs(row.g[3] - 30) < 1e-9 and row.t[:2] == [3.0, 4.0] and len(row.t) == 20 and row.m[:4] == [0.0, 0.0, 0.0, 3.0]


def test_index(spark):
    s = spark.createDataFrame([("Foo30", "x/b10.png"), ("Foo3", "x/b2.png"), ("Foo3", "x/b10.png")], "class_name string, path string")
    got = [(r.class_name, r.path, r.class_id, r.sample_id) for r in counts.assign_sample_ids(s).orderBy("sample_id").collect()]
    assert got == [("Foo3", "x/b2.png", 0, 0), ("Foo3", "x/b10.png", 0, 1), ("Foo30", "x/b10.png", 1, 2)]
    u = counts.union_roots([s, s])
    assert sorted(r.sample_id for r in u.collect()) == list(range(6)) and u.select("class_name", "class_id").distinct().count() == 2
    weights = spark.createDataFrame([(f"c{i}",) for i, n in enumerate([6, 6, 6, 6, 5, 5]) for _ in range(n)], "class_name string")
    assert [r.weight for r in counts.class_weights(weights).collect()] == [1, 1, 1, 1, 5 / 6, 5 / 6]
    found = lookups.lookup_samples(spark.createDataFrame([(2,), (9,)], "sample_id bigint"), counts.assign_sample_ids(s)).orderBy("sample_id").collect()
    assert found[0].class_name == "Foo30" and found[1].path is None
    assert lookups.requested_samples(s, spark.createDataFrame([("Foo3", "b2.png")], "class_name string, file_name string")).count() == 1
    assert counts.count_nonzero(spark.createDataFrame([(0,), (3,), (-1,)], "n int"), "n").first()[0] == 2
    assert tuple(counts.totals(s.withColumnRenamed("class_name", "phylo_name")).first()) == (2, 3)


def test_catalog_filters(spark):
    r = spark.createDataFrame([("0:30", "A"), ("2:00", "A"), ("0:10", "C"), ("0:04", "B")], "length string, rating string")
    assert [x.length for x in filters.filter_recordings(r).collect()] == ["0:30"]
    kept, gone = filters.cull_by_serial_range(spark.createDataFrame([("a_50000.wav", 1), ("a_70001.wav", 2), ("a_170001.wav", 3), ("x.wav", 4)], "path string, length int"))
    assert sorted(x.length for x in kept.collect()) == [1, 3] and sorted(x.length for x in gone.collect()) == [2, 4]
    c = spark.createDataFrame([("a",), ("b",)], "phylo_name string")
    have, missing = filters.select_by_species(c, spark.createDataFrame([("b",), ("z",)], "phylo_name string"))
    assert [x.phylo_name for x in have.collect()] == ["b"] and [x.phylo_name for x in missing.collect()] == ["z"]
    names = sampling.unique_names(spark.createDataFrame([("d", "a.png", 1), ("d", "a.png", 2), ("e", "a.png", 3)], "folder string, name string, i int"), folder="folder", name="name", order="i")
    assert [x.unique_name for x in names.orderBy("i").collect()] == ["a.png", "a_r1.png", "a.png"]
    diff = lookups.cell_differences(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "r int, c int, v double"), spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "r int, c int, v double"), ["r", "c"], "v")
    assert [(x.left, x.right) for x in diff.collect()] == [(2.0, 3.0)]
    t = spark.createDataFrame([(1, "a"), (3, "a"), (2, "b")], "step int, phase string")
    assert [x.step for x in filters.filter_tallies(t, phase="a", newest_first=True).collect()] == [3, 1]


def test_orders(spark):
    from fieldlab.operators import ordering

    s = spark.createDataFrame([("10.0",), ("2.5",)], "`start_time(secs)` string")
    assert [r[0] for r in ordering.sort_by_start_time(s).collect()] == ["2.5", "10.0"]
    n = spark.createDataFrame([("a10",), ("a2",), ("b1",)], "s string")
    assert [r.s for r in ordering.natural_sort(n, "s").collect()] == ["a2", "a10", "b1"]
    assert [r.s for r in ordering.slice_by_position(n, 1, 3, ["s"]).collect()] == ["a2", "b1"]
    a = spark.createDataFrame([(1, 2)], "step int, pred int")
    b = spark.createDataFrame([(1, 3, "x")], "step int, pred int, note string")
    assert ordering.append_tallies(a, b).count() == 2 and ordering.steps(ordering.append_tallies(a, b)).count() == 1


def test_ids_are_dense_at_any_partitioning(spark):
    rows = spark.range(12_000).selectExpr("concat('c', id % 3) AS class_name", "concat('f', id) AS path")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = counts.assign_sample_ids(rows).collect()
            assert sorted(r.sample_id for r in got) == list(range(12_000))
            order = sorted(got, key=lambda r: r.sample_id)
            assert [r.path for r in order] == [f"f{i}" for c in range(3) for i in range(c, 12_000, 3)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_numbered_within_groups(spark):
    from fieldlab.operators.ranks import numbered

    rows = spark.createDataFrame([(g, i) for i in range(50) for g in ("hot", None)] + [("cold", 7)], "g string, i int")
    got = {(r.g, r.i): r.position for r in numbered(rows, ["i"], by="g").collect()}
    assert got == {**{(g, i): i for i in range(50) for g in ("hot", None)}, ("cold", 7): 0}
    assert numbered(rows.limit(0), ["i"]).count() == 0


def test_asof_with_and_without_bins(spark):
    import random

    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(60)) for i in range(300)]
    right = [(k, t, f"{k}{t}") for k in "ab" for t in sorted(rng.sample(range(60), 12))]
    l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string")
    for f, best in ((intervals.asof_le, lambda t, ts: max((x for x in ts if x <= t), default=None)), (intervals.asof_gt, lambda t, ts: min((x for x in ts if x > t), default=None))):
        for bins in (None, F.floor(F.col("t") / 7)):
            got = {x.i: x.found for x in f(l, r, on="t", keys=["k"], value="v", out="found", bins=bins).collect()}
            for i, k, t in left:
                want = best(t, [x for kk, x, _ in right if kk == k])
                assert got[i] == (None if want is None else f"{k}{want}")


def test_errors_of_empty_and_uneven_input(spark):
    empty = spark.createDataFrame([], "class_name string")
    with pytest.raises(ValueError):
        counts.class_weights(empty)
    with pytest.raises(ValueError):
        evaluate.per_class_train_val(spark.createDataFrame([], "cls int, phase string, f1 double"))
    uneven = spark.createDataFrame([("r", 1, "training", 0.1), ("r", 1, "validating", 0.2), ("r", 2, "training", 0.3)], "run_id string, step int, phase string, f1 double")
    with pytest.raises(ValueError):
        evaluate.recent_history(uneven, "f1", 2, strict=True)
    assert evaluate.recent_history(uneven, "f1", 1).first().validating is None


def test_associate_and_containment(spark):
    from fieldlab.functions import scalars as S

    snippets = spark.createDataFrame([("r1", 0), ("r2", 1), ("r3", 2)], "recording_id string, s int")
    notes = spark.createDataFrame([("r1", "x"), ("r1", "y"), ("r2", "z")], "recording_id string, species string")
    assert sorted((r.s, r.species) for r in intervals.associate(snippets, notes).collect()) == [(0, "x"), (0, "y"), (1, "z")]
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (0.0, 1.0, 1.0)], "lo double, hi double, x double")
    assert [r.i for r in df.select(S.interval_contains("lo", "hi", "x").alias("i")).collect()] == [True, False]
    assert spark.range(1).select(S.step_number(F.lit(3), F.lit(2), 5).alias("s")).first().s == 17
