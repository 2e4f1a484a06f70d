"""PNG files of every kind, resampling, antialiasing, rows of bad files, and orders by a keyed permutation."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.functions.permute import grid, permuted
from fieldlab.operators import sampling, signal
from fieldlab.sources import media


def encoded(image, depth, colour, interlaced, filters, palette=None, extra=b""):
    """A PNG of samples (h, w, channels), filtered byte by byte in the plain way."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w, channels = image.shape
    size, out, n = max(1, channels * depth // 8), b"", 0
    for x0, y0, dx, dy in media.PASSES if interlaced else ((0, 0, 1, 1),):
        part = image[y0::dy, x0::dx]
        if not part.size:
            continue
        before = None
        for row in part:
            bits = "".join(format(int(v), f"0{depth}b") for v in row.ravel())
            line = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
            above = before or [0] * len(line)
            kind, done = filters[n % len(filters)], []
            for i, v in enumerate(line):
                a, b, c = line[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
                guess = [0, a, b, (a + b) // 2, min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]][kind]
                done.append((v - guess) & 255)
            out, before, n = out + bytes([kind, *done]), line, n + 1
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced)))
    data = zlib.compress(out)
    return media.PNG_START + head + extra + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_kinds(colour, depth, interlaced):
    rng = np.random.default_rng(colour * 100 + depth)
    for h, w in ((9, 13), (1, 1), (3, 2)):
        image = rng.integers(0, 1 << depth, (h, w, media.CHANNELS[colour]))
        palette = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8) if colour == 3 else None
        got = media.decode_image(encoded(image, depth, colour, interlaced, (4, 3, 0, 1, 2), palette))
        want = palette[image[:, :, 0]] if colour == 3 else image * (255 // ((1 << depth) - 1)) if depth < 8 else image
        assert got[:2] == (h, w) and (got[2] == want).all() and got[2].dtype == (np.uint16 if depth == 16 else np.uint8)


def test_png_gray_and_text(spark):
    text = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    extra = text(b"tEXt", b"sr\0" + b"8000") + text(b"zTXt", b"z\0\0" + zlib.compress(b"packed")) + text(b"iTXt", b"i\0\1\0de\0\0" + zlib.compress("é".encode())) + text(b"iTXt", "j\0\0\0\0\0ü".encode())
    image = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [10, 20, 30]]])
    good = encoded(image, 8, 2, False, (0,), extra=extra)
    rows = [("rgb", bytearray(good)), ("deep", bytearray(encoded(image[:, :, :1] * 257, 16, 0, False, (0,)))), ("cut", bytearray(good[:60])), ("kind", bytearray(encoded(image, 8, 2, False, (0,)).replace(b"\x08\x02\0\0\0", b"\x07\x02\0\0\0")))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in media.read_spectrograms(files).collect()}
    assert list(got["rgb"].pixels) == [76, 150, 29, 18] and got["rgb"].meta == {"sr": "8000", "z": "packed", "i": "é", "j": "ü"}
    assert list(got["deep"].pixels) == [255, 0, 0, 10] and got["cut"].error and "colour type 2 of 7 bits" in got["kind"].error
    whole = {r.path: r for r in media.read_images(files).collect()}
    assert (whole["rgb"].channels, whole["rgb"].depth, bytes(whole["rgb"].pixels)) == (3, 8, image.astype(np.uint8).tobytes()) and (whole["deep"].depth, len(whole["deep"].pixels)) == (16, 8)


def test_resampling_keeps_what_fits_and_cuts_the_rest():
    t = lambda hz, sr, n: np.sin(2 * np.pi * hz * np.arange(n) / sr)
    for sr, new in ((44_100, 22_050), (48_000, 44_100), (22_050, 44_100), (44_100, 300), (8000, 8000)):
        low = min(sr, new)
        y = signal.resampled(t(low * 0.4, sr, sr), sr, new)
        inside = slice(len(y) // 4, 3 * len(y) // 4)
        assert len(y) == new and np.abs(y - t(low * 0.4, new, new))[inside].max() < 1e-3
        if new < sr:
            gone = signal.resampled(t(new * 0.5 * 1.03, sr, sr), sr, new)[inside]
            assert np.abs(gone).max() < 1e-3  # 60 dB
    assert len(signal.resampled(np.zeros(0), 2, 3)) == 0 and len(signal.resampled(np.ones(1), 44_100, 300)) == 1


def test_background_at_other_rates(spark):
    sr = 22_050
    tone = (0.5 * np.sin(2 * np.pi * 500 * np.arange(sr) / sr)).astype(np.float32).tolist()
    audio = spark.createDataFrame([("a", sr, tone), ("b", sr, tone[:4000])], "path string, sr int, samples array<float>")
    noises = spark.createDataFrame([(0, 44_100, np.random.default_rng(0).normal(size=88_200).tolist())], "noise_id bigint, sr int, samples array<float>")
    got = {r.path: r for r in signal.mix_background(audio, noises).collect()}
    assert (got["a"].sr, len(got["a"].samples), got["a"].error, len(got["b"].samples)) == (22_050, sr, None, 4000)
    slow = signal.mix_background(audio, noises.withColumn("sr", F.lit(14_700))).first()
    assert (slow.sr, len(slow.samples), slow.error) == (7350, 7350, None)
    for none in (noises.limit(0), noises.withColumn("samples", F.expr("cast(array() as array<float>)")), noises.withColumn("noise_id", F.lit(5).cast("long"))):
        assert [(r.path, "no noise" in r.error) for r in signal.mix_background(audio, none).orderBy("path").collect()] == [("a", True), ("b", True)]
    plan = audio.withColumn("slot", F.lit(1).cast("long")).withColumn("method", F.when(F.col("path") == "a", "volume"))
    assert sorted((r.path, r.error is None) for r in signal.augment_audio(plan, noises=noises).collect()) == [("a", True), ("b", False)]
    images = spark.createDataFrame([("p", 1, None, 1, 1, bytearray(1), {})], "path string, slot bigint, method string, height int, width int, pixels binary, meta map<string,string>")
    assert [r.error for r in signal.augment_images(images).collect()] == ["unknown method None"]


def test_shrinking_skips_no_pixel(spark):
    board = (np.indices((16, 16)).sum(axis=0) % 2 * 255).astype(np.uint8)
    images = spark.createDataFrame([("b", 16, 16, bytearray(board.tobytes())), ("d", 16, 16, bytearray(np.eye(16, dtype=np.uint8).tobytes()))], "path string, height int, width int, pixels binary")
    got = {r.path: np.array(r.values) for r in signal.resize_normalize(images, 4, 4, mean=0.0, std=1.0).collect()}
    # inside, black and white weigh the same; two pixels from an edge they are cut off unevenly
    assert np.abs(got["b"].reshape(4, 4)[1:3, 1:3] * 255 - 128).max() <= 1 and np.abs(got["b"] * 255 - 127.5).max() < 6
    w = signal.resize_weights(16, 4)
    assert (w > 0).any(axis=0).all() and np.allclose(w.sum(axis=1), 1) and np.allclose(signal.resize_weights(5, 5), np.eye(5))
    assert signal.resize_weights(2, 4).tolist() == [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]]


def test_chopping_reports_bad_files(spark):
    image = np.arange(40, dtype=np.uint8)[None, :].repeat(8, axis=0)
    png = lambda meta: bytearray(media.encode_png(image.tobytes(), 8, 40, meta))
    files = spark.createDataFrame([("good", png({"duration": "10"})), ("bad", bytearray(b"no")), ("untimed", png({})), ("odd", png({"duration": "x"}))], "path string, content binary")
    rows = signal.chop_spectrograms(files, least_columns=4).collect()
    assert {r.path for r in rows if r.error is None} == {"good"} and sum(r.error is None for r in rows) > 1
    assert sorted((r.path, "duration" in r.error) for r in rows if r.error) == [("bad", False), ("odd", True), ("untimed", True)]


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000, 1009, 4096, 9973):
        rows, columns = grid(n)
        assert rows * columns - n < rows
        df = spark.range(n)
        orders = [[r[0] for r in df.select(permuted(F.col("id"), n, seed, epoch)).collect()] for seed, epoch in ((1, 0), (1, 1), (2, 0))]
        assert all(sorted(o) == list(range(n)) for o in orders)
        if n > 90:
            assert all(abs(np.corrcoef(range(n), o)[0, 1]) < 4 / np.sqrt(n) for o in orders) and orders[0] != orders[1] != orders[2]
            assert abs(np.mean(np.abs(np.diff(orders[0]))) / n - 1 / 3) < 0.08
    assert grid(10**10)[0] * grid(10**10)[1] - 10**10 < 3


def test_epochs_neither_sort_nor_shuffle(spark):
    rows = spark.range(1000).withColumnRenamed("id", "position")
    order = sampling.epoch_order(rows, 1000, replicas=3, batch=50, epoch=2)
    plan = order._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    got = order.collect()
    assert sorted((r.replica, r.turn) for r in got) == sorted((p % 3, p // 3) for p in range(1000)) and all(r.batch == r.turn // 50 for r in got)
