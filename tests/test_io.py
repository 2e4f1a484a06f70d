import json
import os
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import evaluate, signal
from fieldlab.sources import annotations, collections, file_sink, files, logs, media
from fieldlab.streaming import jobs

SR = 22_050


def tone(hz, seconds, sr=SR):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * sr)) / sr)).astype(np.float32)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for cls, name, data in (("wren", "a.wav", media.encode_wav(tone(1000, 8), SR)), ("wren", "empty.wav", media.encode_wav(tone(1, 0), SR)), ("owl", "bad.wav", b"RIFFxxxx"), ("owl", "b.wav", media.encode_wav(tone(3000, 3), SR))):
        os.makedirs(root / cls, exist_ok=True)
        (root / cls / name).write_bytes(data)
    return str(root)


def test_audio(spark, tree):
    got = {r.path.rsplit("/", 1)[1]: r for r in media.read_audio(media.load_files(spark, tree, "*.wav")).collect()}
    assert got["a.wav"].sr == SR and len(got["a.wav"].samples) == 8 * SR and abs(max(got["a.wav"].samples) - 0.5) < 0.01
    assert got["empty.wav"].error == "no samples" and got["bad.wav"].error and got["bad.wav"].error != got["empty.wav"].error
    part = media.read_audio(media.load_files(spark, tree, "a.wav"), offset=1, duration=2).first()
    assert len(part.samples) == 2 * SR
    assert {round(r.duration) for r in media.audio_durations(media.load_files(spark, tree, "[ab].wav")).collect()} == {8, 3}


def test_png_round_trip(spark, tmp_path):
    image = np.arange(256 * 40, dtype=np.uint32).astype(np.uint8).reshape(256, 40)
    rows = [("wren/x.png", 256, 40, bytearray(image.tobytes()), {"sr": "22050", "duration": "3.0"})]
    df = spark.createDataFrame(rows, "path string, height int, width int, pixels binary, meta map<string,string>")
    file_sink.write_files(media.png_files(media.update_metadata(df, F.create_map(F.lit("sr"), F.lit("8000"), F.lit("k"), F.lit("v")))), str(tmp_path))
    back = media.read_spectrograms(media.load_files(spark, str(tmp_path), "*.png")).first()
    assert bytes(back.pixels) == image.tobytes() and back.meta == {"sr": "8000", "duration": "3.0", "k": "v"} and back.error is None
    assert media.read_png_metadata(media.load_files(spark, str(tmp_path), "*.png")).first().meta["k"] == "v"
    assert media.clear_metadata(df).first().meta == {}
    assert media.update_metadata(df, F.create_map(F.lit("z"), F.lit("1")), replace=True).first().meta == {"z": "1"}
    (tmp_path / "bad.png").write_bytes(b"no")
    assert media.read_spectrograms(media.load_files(spark, str(tmp_path), "bad.png")).first().error
    media.write_spectrograms(df.withColumn("species", F.lit("wren")), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).first().species == "wren"


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    rows = []
    for y in range(5):
        line = []
        for x in range(7):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            guess = [0, a, b, (a + b) // 2, min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]][kind]
            line.append((int(image[y, x]) - guess) & 255)
        rows.append([kind, *line])
    assert (media._unfilter(np.array(rows, dtype=np.uint8)) == image).all()


def test_spectrogram_jobs(spark, tree):
    source = media.load_files(spark, tree, "*.wav")
    out = signal.create_spectrograms(source)
    rows = {r.path.rsplit("/", 1)[1]: r for r in out.collect()}
    assert rows["bad.wav"].error and rows["empty.wav"].error and rows["a.wav"].meta == {"sr": str(SR), "duration": "8.0"}
    image = np.frombuffer(rows["a.wav"].pixels, dtype=np.uint8).reshape(rows["a.wav"].height, rows["a.wav"].width)
    bank = signal.mel_bank(SR, signal.N_FFT, signal.N_MELS)
    band = int(np.argmax(bank[:, round(1000 * signal.N_FFT / SR)]))
    darkest = 255 - int(np.argmin(image[:, image.shape[1] // 2]))
    assert image.shape[0] == 256 and abs(darkest - band) <= 2 and image.min() == 0
    existing = spark.createDataFrame([("wren", "a")], "class_name string, stem string")
    assert "a.wav" not in {r.path.rsplit("/", 1)[1] for r in signal.create_spectrograms(source, existing).collect()}
    good = out.where("error IS NULL")
    snippets = signal.slice_snippets(good, window_len=4, skip=2, least_columns=16).orderBy("path", "index").collect()
    assert len({r.path for r in snippets}) == 1 and snippets[1].meta["start_time(secs)"] != "0.0"
    first = np.frombuffer(snippets[0].pixels, dtype=np.uint8).reshape(256, snippets[0].width)
    assert (first == image[:, : snippets[0].width]).all()
    masked = signal.mask_stripes(good, "freq", 20, zero=True).collect()
    assert all(r.stripe.startswith("-fmask") and r.error is None for r in masked) and masked == signal.mask_stripes(good, "freq", 20, zero=True).collect()
    noisy = signal.add_noise(good, "uniform", 5).collect()
    assert all(len(r.pixels) == r.height * r.width for r in noisy)
    small = signal.resize_normalize(good, 10, 12).first()
    assert len(small.values) == 120 and small.error is None


def test_filters_and_mixing(spark):
    audio = spark.createDataFrame([("lo", SR, tone(100, 2).tolist()), ("mid", SR, tone(2000, 2).tolist())], "path string, sr int, samples array<float>")
    b, a = signal.bandpass_coefficients(500, 8000, SR)
    energy = {n: float((signal.filtered(b, a, tone(n, 2).astype(float))[SR // 2 :] ** 2).mean() / (tone(n, 2)[SR // 2 :] ** 2).mean()) for n in (50, 2000)}
    assert energy[50] < 0.01 and 0.8 < energy[2000] < 1.1
    assert all(abs(max(r.samples) - 1) < 1e-6 for r in signal.filter_band(audio).collect())
    noises = spark.createDataFrame([(0, SR // 2, tone(300, 3, SR // 2).tolist())], "noise_id bigint, sr int, samples array<float>")
    mixed = {r.path: r for r in signal.mix_background(audio, noises).collect()}
    # both rates become their greatest common divisor, and the duration stays
    assert (mixed["lo"].sr, len(mixed["lo"].samples)) == (SR // 2, 2 * (SR // 2)) and mixed["lo"].samples != audio.first().samples and mixed["lo"].error is None
    plan = audio.withColumn("slot", F.lit(1).cast("long")).withColumn("method", F.when(F.col("path") == "lo", "volume").otherwise("nothing"))
    done = signal.augment_audio(plan).join(audio.select("path", F.lit("c").alias("class_name")), "path")
    report = signal.augmentation_report(done).first()
    assert (report.succeeded, report.failed) == (1, 1)
    planned = audio.withColumn("slot", F.lit(2).cast("long")).withColumn("method", F.lit("add_bg"))
    mixed = {r.path: r for r in signal.augment_audio(planned, noises=noises).collect()}
    assert mixed["lo"].slot == 2 and mixed["lo"].error is None and len(mixed["lo"].samples) == 2 * (SR // 2)


def test_image_augmentation_and_chopping(spark):
    pixels = bytes(range(240)) * 4
    rows = [(f"p{i}", i, m, 24, 40, pixels, {"sr": "1", "duration": "10"}) for i, m in enumerate(("freq_mask", "time_mask", "noise", "volume"))]
    planned = spark.createDataFrame(rows, "path string, slot bigint, method string, height int, width int, pixels binary, meta map<string,string>")
    got = {r.method: r for r in signal.augment_images(planned).collect()}
    assert all((got[m].error is None) == (m != "volume") for m in got) and len(got) == 4
    assert all(got[m].pixels != pixels and len(got[m].pixels) == len(pixels) for m in ("freq_mask", "time_mask", "noise"))
    colour = spark.createDataFrame([("c", 2, 2, bytes([255, 0, 0] * 4))], "path string, height int, width int, pixels binary")
    assert list(signal.resize_normalize(colour, 2, 2, mean=[0.0, 0.5, 0.5], std=[1.0, 0.5, 0.5], channels=3).first().values)[:3] == [1.0, -1.0, -1.0]
    assert abs(signal.resize_normalize(colour, 2, 2, mean=0.0, std=1.0, channels=3, gray=True).first().values[0] - 0.299) < 1e-6


def test_batch_scores(spark):
    def make_predict():
        return lambda run, x: np.stack([x.sum(axis=1) * (run + 1), x.max(axis=1)], axis=1)

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "sample_id int, values array<double>")
    from pyspark.ml.functions import predict_batch_udf  # noqa: F401

    scored = signal.batch_scores(rows.withColumn("label", F.lit(0)), make_predict, [2], size=2, label="label").first()
    assert abs(scored.loss - (np.log(np.exp(np.array(scored.logits)).sum()) - scored.logits[0])) < 1e-9
    got = signal.batch_scores(rows, make_predict, [2], models=2, size=2).collect()
    assert len(got) == 10 and {r.run_id for r in got} == {0, 1}
    assert all(abs(r.logits[0] - (r.sample_id + 1) * (r.run_id + 1)) < 1e-9 for r in got)


def test_selection_table(spark, tmp_path):
    head = "\t".join(annotations.COLUMNS)
    lines = ["19\tSpectrogram 1\t1\t5.926034705\t7.964992409\t3944.330\t9791.219\tbgta\tcall\t1\thowp", "1\tSpectrogram 1\t1\t0.0\t6.2374\t2088.175\t8538.314\tvase\tsong\t1\trbps, bgta, rcwp", "2\tSpectrogram 1\t1\tx\t3.23\t1564.1\t3519.1\trbps\tsong\t1\t"]
    (tmp_path / "AM01_20190719_063242.selections.txt").write_text("\n".join([head, *lines]) + "\n")
    rows = annotations.read_selection_tables(spark, str(tmp_path), ordered=True).collect()
    assert [r.species for r in rows] == ["rbps", "vase", "bgta"]
    assert rows[1].mix == ["rbps", "bgta", "rcwp"] and rows[0].mix == [] and rows[0].time_interval.low_val is None
    assert rows[2].freq_interval.high_val == 9791.219 and rows[2].recording_id == "AM01_20190719_063242"


def test_collections(spark, tmp_path):
    rec = lambda i, g, s, **more: {"_xeno_canto_id": str(i), "genus": g, "species": s, "phylo_name": g + s, "type": "call", **more}
    coll = {"Xa": [rec(1, "X", "a"), rec(2, "X", "a", rating="A")], "Yb": [rec(3, "Y", "b", filepath="/f")]}
    (tmp_path / "c.json").write_text(json.dumps(coll, indent=1))
    flat = collections.read_collection(spark, str(tmp_path / "c.json"))
    assert flat.count() == 3 and flat.where("rating = 'A'").first().position == 1
    collections.write_collection(flat, str(tmp_path / "out"))
    back = collections.read_collection_lines(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, flat.collect()))
    (tmp_path / "r.json").write_text(json.dumps({"numSpecies": "1", "recordings": [{"id": "9", "gen": "X", "sp": "a", "file-name": "f.mp3", "q": "B"}]}))
    one = collections.read_catalog_response(spark, str(tmp_path / "r.json")).first()
    assert one.full_name == "Xa_xc9" and one._filename == "f.mp3" and one.rating == "B"


def test_logs(spark, tmp_path):
    rows = [("r", s, p, i, (i + s) % 3, i % 3) for s in range(2) for p in ("training", "validating") for i in range(4)]
    p = spark.createDataFrame(rows, "run string, step int, phase string, position int, pred int, label int")
    path = str(tmp_path / "x_net_resnet18_bs_64.csv")
    logs.write_prediction_log(p, path)
    back = logs.read_prediction_log(spark, path)
    assert sorted((r.step, r.phase, r.position, r.pred, r.label) for r in back.collect()) == sorted(r[1:] for r in rows)
    run = spark.createDataFrame([(1, 0.5, [[1, 2], [3, 4]], 'a "q"'), (0, 0.25, [[0, 0], [0, 1]], None)], "epoch int, loss double, matrix array<array<int>>, note string")
    logs.write_run_log(run, str(tmp_path / "log"), "epoch")
    got = logs.read_run_log(spark, str(tmp_path / "log"), [("epoch", "int"), ("loss", "double"), ("matrix", "array<array<int>>"), ("note", "string")]).orderBy("epoch").collect()
    assert [(r.epoch, r.loss, r.matrix) for r in got] == [(0, 0.25, [[0, 0], [0, 1]]), (1, 0.5, [[1, 2], [3, 4]])] and got[1].note == 'a "q"'
    for i, text in enumerate(["foo,bar,fum\nfoo,1,2,3\nbar,4,5,6\nfum,7,8,9\n", ",foo,bar,fum\nfoo,1,2,3\nbar,4,5,6\nfum,7,8,9\n"]):
        (tmp_path / f"m{i}.csv").write_text(text)
        cells = {(r.truth, r.pred): r.n for r in logs.read_confusion_csv(spark, str(tmp_path / f"m{i}.csv")).collect()}
        assert len(cells) == 9 and cells["bar", "fum"] == 6
    (tmp_path / "m2.csv").write_text("x,y\nx,1,2\ny,3,4\n")
    both = logs.read_confusion_csv(spark, str(tmp_path / "m*.csv"), file_col="file")
    assert {r.file: r.n for r in both.groupBy("file").agg(F.sum("n").alias("n")).collect()} == {"m0.csv": 45, "m1.csv": 45, "m2.csv": 10}
    summary = evaluate.summary_scores(evaluate.confusion_counts(p))
    logs.write_metric_csv(summary, str(tmp_path / "metrics"), evaluate.class_scores(evaluate.confusion_counts(p)))
    assert spark.read.csv(str(tmp_path / "metrics"), header=True).where("measure = 'accuracy'").count() == 1


def test_listings(spark, tree, tmp_path):
    assert files.list_files(spark, tree, "*.wav").count() == 4
    assert files.list_children(spark, tree + "/wren", "*.wav").count() == 2
    paths = spark.createDataFrame([("/r/train/Foo30/a.png",), ("/r/train/Foo3/b.jpg",), ("/r/val/Foo3/c.png",), ("/r/.hid/Foo9/c.png",), ("/r/train/Foo3/x.txt",)], "path string")
    s = files.class_samples(paths)
    assert [r.class_name for r in files.class_names(s).collect()] == ["Foo3", "Foo30"]
    assert {r.class_name: r.directories for r in files.class_directories(s).collect()}["Foo3"] == ["/r/train/Foo3", "/r/val/Foo3"]
    assert {r.split for r in files.labelled_split(paths).collect()} == {"train", "val"}
    assert files.expand_path("~/x").startswith("/")


def _tally(spark, schema, folder, checkpoint, **options):
    """The groups' accuracies by batch of one run over what has arrived."""
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert jobs.start_tally(stream, lambda df, e: seen.append({(r.run_id, r.step): r.accuracy for r in df.collect()}), checkpoint, **options).awaitTermination(120)
    return [s for s in seen if s]


def test_streaming_tally(spark, tmp_path):
    schema = "run_id string, step int, phase string, label int, pred int"
    folder, checkpoint = str(tmp_path / "preds"), str(tmp_path / "state")
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    add([("r", 0, "training", 1, 1), ("r", 0, "training", 0, 1), ("q", 0, "training", 1, None)])
    assert _tally(spark, schema, folder, checkpoint) == [{("r", 0): 0.5}]
    add([("r", 1, "training", 1, 0)])
    assert _tally(spark, schema, folder, checkpoint) == [{("r", 1): 0.0}]  # only what has changed
    add([("r", 0, "training", 1, 1)] * 2 + [("s", 0, "training", 2, 2)])  # late rows, after a restart
    assert _tally(spark, schema, folder, checkpoint) == [{("r", 0): 0.75, ("s", 0): 1.0}]
    assert _tally(spark, schema, folder, checkpoint) == []


def test_streaming_tally_expires(spark, tmp_path):
    schema = "run_id string, step int, phase string, label int, pred int"
    folder, checkpoint = str(tmp_path / "preds"), str(tmp_path / "state")
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    add([("r", 0, "training", 0, 1)])
    assert _tally(spark, schema, folder, checkpoint, keep_seconds=1) == [{("r", 0): 0.0}]
    time.sleep(2)
    add([("s", 0, "training", 1, 1)])
    assert _tally(spark, schema, folder, checkpoint, keep_seconds=1) == [{("s", 0): 1.0}]
    add([("r", 0, "training", 1, 1)])
    assert _tally(spark, schema, folder, checkpoint, keep_seconds=1) == [{("r", 0): 1.0}]  # a new tally


def test_streaming_ingest(spark, tree, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "specs")
    shutil.copytree(tree, source)
    for _ in range(2):  # the second run finds nothing new
        jobs.start_ingest(spark, source, out, str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(f"{out}/*").count() == 2
    bad = {os.path.basename(r.path): r.error for r in jobs.quarantined(spark, out).collect()}
    assert sorted(bad) == ["bad.wav", "empty.wav"]
    with open(f"{source}/owl/bad.wav", "wb") as f:
        f.write(media.encode_wav(tone(2000, 1), SR))
    os.remove(f"{source}/wren/empty.wav")
    assert [os.path.basename(r.path) for r in jobs.retry_quarantined(spark, out).collect()] == ["empty.wav"]
    assert sorted(os.path.basename(r.path) for r in spark.read.parquet(f"{out}/*").collect()) == ["a.wav", "b.wav", "bad.wav"]
