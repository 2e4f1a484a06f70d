"""Recordings read, filtered and drawn in pieces, against the same work on whole recordings; files written in two phases."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import pieces, signal
from fieldlab.sources import audio_ranges, file_sink, media, stores

SR = 22_050


def wav(fmt, data, head=b"RIFF", before=b"", size=None):
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    return head + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    rng = np.random.default_rng(0)
    long = media.encode_wav(rng.uniform(-1, 1, 60 * SR), SR)
    rows = [("x/long.wav", long), ("y/empty.wav", b""), ("y/bad.wav", b"RIFFxxxx"), ("y/none.wav", media.encode_wav(np.zeros(0), SR)), ("y/s.WAV", media.encode_wav(np.linspace(-1, 1, 1000), 8000)), ("y/no.txt", b"x"), ("_hidden/h.wav", long[:100])]
    file_sink.write_files(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), str(root))
    return str(root)


def test_headers_read_nothing_else(spark, folder):
    rows = {os.path.relpath(r.path, folder): r for r in audio_ranges.audio_headers(spark, folder).collect()}
    assert sorted(rows) == ["x/long.wav", "y/bad.wav", "y/empty.wav", "y/none.wav", "y/s.WAV"]
    assert (rows["x/long.wav"].duration, rows["x/long.wav"].bits, rows["x/long.wav"].bytes_read) == (60.0, 16, 4096)
    assert (rows["y/s.WAV"].frames, rows["y/s.WAV"].duration, rows["y/none.wav"].duration) == (1000, 0.125, 0.0)
    assert "empty" in rows["y/empty.wav"].error and "not a WAV" in rows["y/bad.wav"].error and rows["y/none.wav"].error is None


@pytest.mark.parametrize("sizes", [{"piece_bytes": 100_001}, {"piece_frames": 50_000, "piece_bytes": 100_000}, {}])
def test_pieces_cover_a_recording(spark, folder, sizes):
    got = audio_ranges.read_audio_pieces(spark, folder, **sizes)
    if sizes:
        assert got.rdd.getNumPartitions() > 20  # one recording is the work of many tasks
    rows = sorted((r for r in got.collect() if r.path.endswith("long.wav")), key=lambda r: r.piece)
    with open(f"{folder}/x/long.wav", "rb") as f:
        want = media.decode_wav(f.read())[1]
    assert [r.start for r in rows] == list(np.cumsum([0] + [len(r.samples) for r in rows[:-1]])) and {r.frames for r in rows} == {60 * SR}
    assert (np.concatenate([r.samples for r in rows]).astype(np.float32) == want).all()
    errors = {os.path.basename(r.path): r.error for r in got.where("error IS NOT NULL").collect()}
    assert sorted(errors) == ["bad.wav", "empty.wav", "none.wav"] and errors["none.wav"] == "no samples"


def test_only_the_range_is_read(spark, folder):
    got = audio_ranges.read_audio_pieces(spark, f"{folder}/x/long.wav", offset=30.2, duration=0.5, piece_bytes=1 << 18).collect()
    with open(f"{folder}/x/long.wav", "rb") as f:
        want = media.decode_wav(f.read(), 30.2, 0.5)[1]
    assert (np.concatenate([r.samples for r in sorted(got, key=lambda r: r.piece)]).astype(np.float32) == want).all() and len(want) == round(0.5 * SR)
    assert sum(r.bytes_read for r in got) <= 4096 * len(got) + len(want) * 2
    beyond = audio_ranges.read_audio_pieces(spark, folder, offset=100).collect()
    assert len(beyond) == 5 and all(r.error and r.samples is None for r in beyond)
    with pytest.raises(Exception, match="no-such"):
        audio_ranges.read_audio_pieces(spark, f"{folder}/no-such").collect()


def test_formats_of_samples():
    x = np.array([-1, -0.5, 0, 0.25, 0.75])
    fmt = lambda code, channels, bits: struct.pack("<HHIIHH", code, channels, SR, 0, 0, bits)
    forms = {
        "8": wav(fmt(1, 1, 8), (x * 128 + 128).astype(np.uint8).tobytes()), "16": wav(fmt(1, 1, 16), (x * 2**15).astype("<i2").tobytes()),
        "24": wav(fmt(1, 1, 24), b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x)), "32": wav(fmt(1, 1, 32), (x * 2**31).astype("<i4").tobytes()),
        "f32": wav(fmt(3, 1, 32), x.astype("<f4").tobytes()), "f64": wav(fmt(3, 1, 64), x.astype("<f8").tobytes()),
        "stereo": wav(fmt(1, 2, 16), np.repeat(x * 2**15, 2).astype("<i2").tobytes()),
        "extended": wav(fmt(0xFFFE, 1, 16) + struct.pack("<HHI", 22, 16, 4) + struct.pack("<H", 1) + bytes(14), (x * 2**15).astype("<i2").tobytes()),
        "odd chunk": wav(fmt(1, 1, 16), (x * 2**15).astype("<i2").tobytes(), before=b"LIST" + struct.pack("<I", 5001) + bytes(5002)),
        "cut": wav(fmt(1, 1, 16), (x * 2**15).astype("<i2").tobytes(), size=1000), "stream": wav(fmt(1, 1, 16), (x * 2**15).astype("<i2").tobytes(), size=0xFFFFFFFF),
        "RF64": wav(fmt(1, 1, 16), (x * 2**15).astype("<i2").tobytes(), b"RF64", b"ds64" + struct.pack("<IQQQI", 28, 0, 10, 0, 0), 0xFFFFFFFF),
    }
    for name, data in forms.items():
        sr, got = media.decode_wav(data)
        assert sr == SR and np.abs(got - x).max() < 1e-6, name
    for bad in (wav(fmt(2, 1, 16), b"xx"), wav(fmt(1, 0, 16), b"xx"), wav(b"", b"xx"), forms["16"][:30]):
        with pytest.raises(ValueError):
            media.decode_wav(bad)


def test_scan_equals_the_recurrence():
    rng = np.random.default_rng(1)
    b, a = signal.bandpass_coefficients(500, 8000, SR)
    for n in (1, 3, 511, 512, 513, 5000):
        x, z = rng.normal(size=n), rng.normal(size=4)
        got, last = signal.scan_filter(b, a, x, z)
        for i in range(n):
            out = b[0] * x[i] + z[0]
            z = np.append(z[1:], 0) + b[1:] * x[i] - a[1:] * out
            assert abs(out - got[i]) < 1e-12
        assert np.abs(z - last).max() < 1e-12


@pytest.mark.parametrize("frames", [4096, 6000, 1 << 20])
def test_pieces_equal_whole_recordings(spark, frames):
    rng = np.random.default_rng(2)
    made = {"a": (SR, rng.normal(size=60_000) * np.linspace(0, 1, 60_000)), "b": (SR, rng.normal(size=512 * 64)), "c": (8000, rng.normal(size=700)), "d": (SR, rng.normal(size=4096 * 3 + 10)), "e": (SR, np.zeros(5000)), "f": (SR, np.array([0.5]))}
    audio = spark.createDataFrame([(p, sr, x.tolist()) for p, (sr, x) in made.items()], "path string, sr int, samples array<float>")
    cut = pieces.in_pieces(audio, frames=frames)
    whole = {r.path: np.array(r.samples) for r in signal.filter_band(audio).collect()}
    got: dict = {}
    for r in pieces.filter_pieces(cut).orderBy("path", "piece").collect():
        got.setdefault(r.path, []).append(np.array(r.samples))
    assert sorted(got) == sorted(whole) and all(np.abs(np.concatenate(got[p]) - whole[p]).max() < 1e-6 for p in whole)
    for band in (None, (500.0, 8000.0)):
        want = {r.path: r for r in signal.spectrograms_of(audio, band=band).collect()}
        drawn = {r.path: r for r in pieces.assembled(pieces.long_spectrograms(cut, band=band)).collect()}
        assert all(drawn[p].pixels == want[p].pixels and (drawn[p].height, drawn[p].width, drawn[p].meta) == (want[p].height, want[p].width, want[p].meta) for p in want)


def test_pieces_of_files_with_bad_ones(spark, folder):
    cut = audio_ranges.read_audio_pieces(spark, folder, piece_frames=SR * 4)
    drawn = pieces.long_spectrograms(cut).collect()
    assert sorted(os.path.basename(r.path) for r in drawn if r.error) == ["bad.wav", "empty.wav", "none.wav"]
    of = sorted((r for r in drawn if r.path.endswith("long.wav")), key=lambda r: r.piece)
    assert len(of) == 15 and [r.first_column for r in of] == list(np.cumsum([0] + [r.columns for r in of[:-1]])) and sum(r.columns for r in of) == 1 + 60 * SR // signal.HOP
    assert pieces.long_spectrograms(cut.where("path IS NULL")).count() == 0
    with pytest.raises(Exception, match="shorter than a window"):
        pieces.long_spectrograms(audio_ranges.read_audio_pieces(spark, f"{folder}/x", piece_frames=1000)).collect()


def test_a_failed_write_shows_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    good = spark.range(40).select(F.format_string("d%d/f%d", F.col("id") % 3, "id").alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"), F.lit(1).alias("other")).repartition(8)
    file_sink.write_files(good, "file://" + root)
    found = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)
    assert len(found) == 41 and "_SUCCESS" in found and open(f"{root}/d1/f4").read() == "4"
    other = good.withColumn("content", F.encode(F.lit("new"), "utf-8"))
    with pytest.raises(Exception, match="without a path"):
        file_sink.write_files(other.withColumn("path", F.when(F.col("path") != "d1/f4", F.concat(F.lit("z/"), "path"))), root)
    assert not os.path.exists(f"{root}/z") and open(f"{root}/d1/f4").read() == "4"
    file_sink.write_files(other.where("path = 'd1/f4'"), root)
    assert open(f"{root}/d1/f4").read() == "new" and [p for p, _ in stores.listed(root, "")] == [f"{root}/{f}" for f in found if f != "_SUCCESS"]
    file_sink.write_files(spark.createDataFrame([("/../../up", bytearray(b"x"))], "path string, content binary"), root)
    assert open(f"{root}/up").read() == "x"
    with pytest.raises(Exception, match="append"):
        good.select("path", "content").write.format("single_files").mode("overwrite").save(root)
