"""Jobs over tables of signals and images: filters, spectrograms, snippets, masks, noise, scoring.

Each job is one mapInPandas over rows that a Spark source or operator made;
a row that fails becomes a row with an error. Choices of chance come from a
hash of seed and path, so results repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.shipping import by_value
from fieldlab.operators.windows import spectrogram_windows
from fieldlab.sources.media import LUMINANCE, SPECTROGRAM, read_audio, read_spectrograms

LOW_HZ, HIGH_HZ = 500.0, 8000.0
N_FFT, HOP, N_MELS = 2048, 512, 256


def chance(seed: int, path: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{path}".encode()).digest()[:8], "big"))


def map_rows(rows: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """One result per row from f(row as dict); an exception becomes the row's `error`. User code plugs in here."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**row, **f(row), "error": None})
                except Exception as e:
                    out.append({**row, "error": f"{type(e).__name__}: {e}"})
            frame = pd.DataFrame(out)
            yield frame.reindex(columns=names) if len(frame) else pd.DataFrame(columns=names)

    names = [c.strip().split(" ")[0].strip("`") for c in _fields(schema)]
    return rows.mapInPandas(work, schema)


def _fields(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


# ---- audio ------------------------------------------------------------------
def bandpass_coefficients(low: float, high: float, sr: int) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Butterworth band-pass whose low-pass prototype has order 2, by the bilinear transform."""
    warped = 2 * sr * np.tan(np.pi * np.array([low, min(high, sr / 2 * 0.999)]) / sr)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    poles = np.exp(1j * np.pi * np.array([3, 5]) / 4) * width / 2
    root = np.sqrt(poles**2 - centre**2)
    poles = np.concatenate([poles + root, poles - root])
    z = (2 * sr + poles) / (2 * sr - poles)
    gain = width**2 * (2 * sr) ** 2 / np.prod(2 * sr - poles)
    return np.real(gain * np.poly([1, 1, -1, -1])), np.real(np.poly(z))


#: Samples of a lane at most: as many lanes as a signal has are filtered side by side.
LANE = 512


def state_matrix(a: np.ndarray) -> np.ndarray:
    """What a step without input makes of the filter's state."""
    m = np.diag(np.ones(len(a) - 2), 1)
    m[:, 0] -= a[1:]
    return m


@lru_cache(maxsize=32)
def _free_response(a: tuple[float, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, order): output over n steps without input by state; and what becomes of the state."""
    m = state_matrix(np.array(a))
    out, now = np.zeros((n, len(m))), np.eye(len(m))
    for t in range(n):
        out[t] = now[0]
        now = m @ now
    return out, now


def scan_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(output, last state) of the causal recurrence a * y = b * x from a state, at rest by default.

    The signal is cut into lanes that are filtered side by side from rest. A
    lane's last state is an affine map of its first; a parallel prefix scan
    composes the maps, and each lane's free response to its first state is
    added.
    """
    order = len(a) - 1
    lane = min(LANE, 1 << (math.isqrt(max(1, len(x))).bit_length() - 1))  # as many steps as lanes, about
    lanes = max(1, -(-len(x) // lane))
    padded = np.zeros(lanes * lane)
    padded[: len(x)] = x
    u, z = padded.reshape(lanes, lane).T.copy(), np.zeros((order, lanes))
    y = np.empty_like(u)
    for t in range(lane):
        y[t] = b[0] * u[t] + z[0]
        z[:-1] = z[1:] + b[1:-1, None] * u[t] - a[1:-1, None] * y[t]
        z[-1] = b[-1] * u[t] - a[-1] * y[t]
    free, step = _free_response(tuple(a), lane)
    first = np.zeros((order, lanes))  # the state each lane begins with
    first[:, 0] = 0 if state is None else state
    first[:, 1:] = z[:, :-1]
    ahead, shift = step, 1
    while shift < lanes:
        moved = ahead @ first[:, :-shift]
        first[:, shift:] += moved
        ahead, shift = ahead @ ahead, 2 * shift
    y += free @ first
    rest = len(x) - (lanes - 1) * lane
    if rest == lane:
        last = z[:, -1] + step @ first[:, -1]
    else:  # the last lane's state before the padding
        last = first[:, -1]
        for v in u[:rest, -1]:
            out = b[0] * v + last[0]
            last = np.append(last[1:], 0) + b[1:] * v - a[1:] * out
    return y.T.ravel()[: len(x)], last


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return scan_filter(b, a, x)[0]


def filter_band(audio: DataFrame, low: float = LOW_HZ, high: float = HIGH_HZ) -> DataFrame:
    """Band-passed samples divided by their maximum."""

    def f(row: dict) -> dict:
        x = np.asarray(row["samples"], dtype=np.float64)
        y = filtered(*bandpass_coefficients(low, high, int(row["sr"])), x)
        top = y.max()
        return {"samples": (y / top if top > 0 else y).astype(np.float32)}

    return map_rows(audio.select("path", "sr", "samples"), f, "path string, sr int, samples array<float>, error string")


@lru_cache(maxsize=32)
def mel_bank(sr: int, n_fft: int, n_mels: int) -> np.ndarray:
    """(n_mels, bins) triangles evenly spaced on the mel scale, each of unit area."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(sr / 2), n_mels + 2) / 2595) - 1)
    bins = np.linspace(0, sr / 2, n_fft // 2 + 1)[None, :]
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - lo) / (mid - lo), (hi - bins) / (hi - mid))) * 2 / (hi - lo)


def mel_power(padded: np.ndarray, sr: int, frames: int, n_mels: int, n_fft: int, hop: int) -> np.ndarray:
    """(n_mels, frames): mel power of so many windows, a hop apart, of samples that have half a window before the first centre."""
    if frames <= 0:
        return np.zeros((n_mels, 0))
    windows = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][:frames]
    power = np.abs(np.fft.rfft(windows * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    return mel_bank(sr, n_fft, n_mels) @ power.T


def scaled_image(mel: np.ndarray, loudest: float, faintest: float) -> np.ndarray:
    """8-bit columns of a recording whose mel power lies in the given range: low frequencies at the bottom, loud dark."""
    decibel = lambda v: np.maximum(10 * np.log10(np.maximum(v, 1e-10) / max(loudest, 1e-10)), -80)
    db, lo, hi = decibel(mel), decibel(faintest), decibel(loudest)
    scaled = (db - lo) / (hi - lo) * 255 if hi > lo else np.zeros_like(db)
    return 255 - scaled[::-1].astype(np.uint8)


def log_mel(x: np.ndarray, sr: int, n_mels: int = N_MELS, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """8-bit image: low frequencies at the bottom, loud dark."""
    padded = np.pad(x.astype(np.float64), n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    mel = mel_power(padded, sr, 1 + len(x) // hop, n_mels, n_fft, hop)
    return scaled_image(mel, float(mel.max()), float(mel.min()))


def spectrograms_of(audio: DataFrame, *, n_mels: int = N_MELS, n_fft: int = N_FFT, hop: int = HOP, band: tuple[float, float] | None = (LOW_HZ, HIGH_HZ)) -> DataFrame:
    """(path, sr, samples) to spectrograms with sr and duration in their metadata."""

    def f(row: dict) -> dict:
        if row["samples"] is None or not len(row["samples"]):
            raise ValueError("no samples")
        x, sr = np.asarray(row["samples"], dtype=np.float64), int(row["sr"])
        if band:
            x = filtered(*bandpass_coefficients(*band, sr), x)
            x = x / x.max() if x.max() > 0 else x
        image = log_mel(x, sr, n_mels, n_fft, hop)
        return {"height": image.shape[0], "width": image.shape[1], "pixels": image.tobytes(), "meta": {"sr": str(sr), "duration": str(round(len(x) / sr, 1))}}

    return map_rows(audio.select("path", "sr", "samples"), f, SPECTROGRAM)


def create_spectrograms(files: DataFrame, existing: DataFrame | None = None, partitions: int | None = None, **options) -> DataFrame:
    """(path, length, content) of recordings to spectrograms; those with an output of their class and stem are skipped."""
    from fieldlab.operators.lookups import skip_existing
    from fieldlab.sources.files import with_output_stem

    todo = files if existing is None else skip_existing(with_output_stem(files), existing).drop("class_name", "stem")
    if partitions:
        todo = todo.repartition(partitions)
    audio = read_audio(todo)
    good = spectrograms_of(audio.where("error IS NULL"), **options)
    bad = audio.where("error IS NOT NULL").select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("height", "int"), ("width", "int"), ("pixels", "binary"), ("meta", "map<string,string>"))], "error")
    return good.unionByName(bad)


#: Zero crossings of the resampling filter on each side, its window's shape, and the share of the narrower band that passes.
CROSSINGS, SHAPE, PASS = 64, 10.0, 0.94


def resampled(x: np.ndarray, sr: int, new: int) -> np.ndarray:
    """The signal at another rate, by a windowed sinc that cuts what the narrower band can't hold; one set of weights per phase of the outputs."""
    if sr == new or not len(x):
        return x
    up, down = new // math.gcd(sr, new), sr // math.gcd(sr, new)
    band = min(1.0, up / down) * PASS
    half = math.ceil(CROSSINGS / band)
    padded = np.pad(np.asarray(x, dtype=np.float64), half)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)  # window i is centred at sample i
    out = np.zeros(-(-len(x) * up // down))
    for phase in range(min(up, len(out))):
        at, rest = divmod(phase * down, up)
        u = np.arange(-half, half + 1) - rest / up
        weights = band * np.sinc(band * u) * np.i0(SHAPE * np.sqrt(np.maximum(0, 1 - (u / (half + 1)) ** 2))) / np.i0(SHAPE)
        own = windows[at::down]
        n = len(out[phase::up])
        out[phase::up] = own[:n] @ weights
    return out


def mix_background(audio: DataFrame, noises: DataFrame, *, seed: int = 42, longest: float = 5.0) -> DataFrame:
    """Each signal with one noise, chosen by hash, added at a place and signal-to-noise ratio of chance.

    Where the rates differ both are resampled to their greatest common
    divisor, which is then the result's rate; the duration stays. noises
    (noise_id 0.., sr, samples) is joined by number. A signal whose noise is
    missing or empty is a row with an error, as all are without noises.
    """
    n = noises.agg(F.count(F.lit(1)).alias("_n"))
    pick = F.when(F.col("_n") > 0, F.pmod(F.xxhash64(F.lit(seed), "path"), F.col("_n")))
    chosen = noises.select("noise_id", F.col("sr").alias("noise_sr"), F.col("samples").alias("noise"))
    paired = audio.select("path", "sr", "samples").crossJoin(n).withColumn("noise_id", pick).join(chosen, "noise_id", "left")  # n is one row

    def f(row: dict) -> dict:
        if row["noise"] is None or not len(row["noise"]) or pd.isna(row["noise_sr"]):
            raise ValueError("no noise")
        rng = chance(seed, row["path"])
        x, noise = np.asarray(row["samples"], dtype=np.float64), np.asarray(row["noise"], dtype=np.float64)
        sr = math.gcd(int(row["sr"]), int(row["noise_sr"]))
        x, noise = resampled(x, int(row["sr"]), sr).copy(), resampled(noise, int(row["noise_sr"]), sr)
        size = min(len(x), len(noise), int(longest * sr))
        noise = noise[(s := rng.integers(0, len(noise) - size + 1)) : s + size]
        place, snr = rng.integers(0, len(x) - size + 1), rng.uniform(3, 30)
        loud = np.sqrt((noise**2).mean()) if size else 0.0
        if loud > 0:
            x[place : place + size] += noise * np.sqrt((x**2).mean()) / 10 ** (snr / 20) / loud
        return {"sr": sr, "samples": x.astype(np.float32)}

    return map_rows(paired.select("path", "sr", "samples", "noise_sr", "noise"), f, "path string, sr int, samples array<float>, error string")


# ---- images -----------------------------------------------------------------
def _image(row: dict) -> np.ndarray:
    return np.frombuffer(row["pixels"], dtype=np.uint8).reshape(int(row["height"]), int(row["width"])).copy()


def mask_stripes(spectrograms: DataFrame, axis: str, longest: int, stripes: int = 1, zero: bool = False, seed: int = 42) -> DataFrame:
    """axis 'freq' masks rows, 'time' columns: stripes of 1 .. longest - 1 filled with the mean, or 0; the last one is named in `stripe`."""
    if axis not in ("freq", "time"):
        raise ValueError("axis is 'freq' or 'time'")

    def f(row: dict) -> dict:
        image, rng = _image(row), chance(seed, row["path"])
        view = image if axis == "freq" else image.T
        fill, name = 0 if zero else int(image.mean()), ""
        for _ in range(stripes):
            size = int(rng.integers(1, max(2, min(longest, len(view)))))
            start = int(rng.integers(0, len(view) - size + 1))
            view[start : start + size] = fill
            name = f"-{axis[0]}mask{start}_{size}"
        return {"pixels": image.tobytes(), "stripe": name}

    return map_rows(spectrograms.select("path", "height", "width", "pixels", "meta"), f, "path string, height int, width int, pixels binary, meta map<string,string>, stripe string, error string")


def add_noise(spectrograms: DataFrame, kind: str = "normal", std: float = 1.0, seed: int = 42) -> DataFrame:
    """Gaussian or uniform jitter, clipped to 0..255."""
    if kind not in ("normal", "uniform"):
        raise ValueError("kind is 'normal' or 'uniform'")

    def f(row: dict) -> dict:
        image, rng = _image(row).astype(np.int32), chance(seed, row["path"])
        jitter = rng.normal(0, std, image.shape) if kind == "normal" else rng.uniform(-std, std, image.shape)
        return {"pixels": np.clip(image + np.rint(jitter).astype(np.int32), 0, 255).astype(np.uint8).tobytes()}

    return map_rows(spectrograms.select("path", "height", "width", "pixels", "meta"), f, SPECTROGRAM)


def slice_snippets(spectrograms: DataFrame, *, window_len: float = 5.0, skip: float = 2.0, least_columns: int = 256) -> DataFrame:
    """Overlapping snippets: (path of the recording, index, height, width, pixels, meta with times). Windows are planned in SQL; each image is decoded once per group of its windows."""
    timed = spectrograms.withColumn("duration", F.col("meta")["duration"].try_cast("double")).where("duration IS NOT NULL")
    wins = spectrogram_windows(timed.select("path", "width", "duration"), window_len=window_len, skip=skip, least_columns=least_columns)
    plan = wins.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("index", "start_column", "columns", "start_time", "end_time"))).alias("windows"))  # a recording's windows
    joined = timed.join(plan, "path").select("path", "height", "width", "pixels", "meta", "windows")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                image, out = _image(row), []
                for w in row["windows"]:
                    part = image[:, w["start_column"] : w["start_column"] + w["columns"]]
                    times = {"duration(secs)": w["end_time"] - w["start_time"], "start_time(secs)": w["start_time"], "end_time(secs)": w["end_time"]}
                    out.append((row["path"], w["index"], part.shape[0], part.shape[1], np.ascontiguousarray(part).tobytes(), {**dict(row["meta"]), **{k: str(v) for k, v in times.items()}}))
                yield pd.DataFrame(out, columns=["path", "index", "height", "width", "pixels", "meta"])

    return joined.mapInPandas(work, "path string, index int, height int, width int, pixels binary, meta map<string,string>")


def chop_spectrograms(files: DataFrame, **options) -> DataFrame:
    """(path, content) of PNG files to their snippets, with `error`: files that can't be read, or have no duration in their text, are rows that say so."""
    read = read_spectrograms(files)
    timed = F.col("meta")["duration"].try_cast("double").isNotNull()
    made = slice_snippets(read.where("error IS NULL"), **options).withColumn("error", F.lit(None).cast("string"))
    bad = read.where(F.col("error").isNotNull() | ~F.coalesce(timed, F.lit(False))).select("path", F.coalesce("error", F.lit("ValueError: no duration")).alias("error"))
    return made.unionByName(bad, allowMissingColumns=True)


def resize_weights(size: int, new: int) -> np.ndarray:
    """(new, size): how much of each old pixel is in each new one. The triangle is as wide as a new pixel when shrinking, so none is skipped."""
    scale = size / new
    reach = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    w = np.maximum(0, 1 - np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, channels) of an 8-bit image: across, then down, each in whole steps, as image libraries do."""
    whole = lambda v: np.clip(np.floor(np.round(v, 9) + 0.5), 0, 255)  # noqa: E731  halves are halves, however they were summed
    across = whole(np.einsum("wx,hxc->hwc", resize_weights(image.shape[1], width), image)) if width != image.shape[1] else image
    return whole(np.einsum("hy,ywc->hwc", resize_weights(image.shape[0], height), across)) if height != image.shape[0] else across


def resize_normalize(spectrograms: DataFrame, height: int = 400, width: int = 400, mean: float | Sequence[float] = 0.5, std: float | Sequence[float] = 0.5, channels: int = 1, gray: bool = False) -> DataFrame:
    """(path, values): resized with antialiasing, scaled to 0..1, then (x - mean) / std, row by row, of each channel its own.

    channels: values per pixel, side by side. gray: the channels' luminance
    (of three) or mean becomes the only one.
    """

    def f(row: dict) -> dict:
        image = np.frombuffer(row["pixels"], dtype=np.uint8).reshape(int(row["height"]), int(row["width"]), channels).astype(np.float64)
        if gray:
            image = image @ (np.array(LUMINANCE) if channels == 3 else np.full(channels, 1 / channels))[:, None]
        return {"values": ((resized(image, height, width) / 255 - np.asarray(mean)) / np.asarray(std)).ravel().astype(np.float32)}

    return map_rows(spectrograms.select("path", "height", "width", "pixels"), f, "path string, values array<float>, error string")


# ---- augmentation and scoring -----------------------------------------------
def augment_audio(planned: DataFrame, *, noises: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Rows (path, slot, method, sr, samples) to new samples: 'volume' and 'time_shift' of chance, 'add_bg' by mixing one of the noises in if there are any; unknown methods become errors."""
    if noises is not None:
        each = planned.where("method = 'add_bg'").withColumn("path", F.to_json(F.array("path", F.col("slot").cast("string"))))
        mixed = mix_background(each, noises, seed=seed).withColumn("_of", F.from_json("path", "array<string>"))
        mixed = mixed.select(F.col("_of")[0].alias("path"), F.col("_of")[1].cast("long").alias("slot"), F.lit("add_bg").alias("method"), "sr", "samples", "error")
        return augment_audio(planned.where("NOT method <=> 'add_bg'"), seed=seed).unionByName(mixed)

    def f(row: dict) -> dict:
        rng = chance(seed, f"{row['path']}:{row['slot']}")
        x, sr = np.asarray(row["samples"], dtype=np.float64), int(row["sr"])
        if row["method"] == "volume":
            x = x * 10 ** (int(rng.integers(-12, 12)) / 20)
        elif row["method"] == "time_shift":
            x = np.roll(x, -int(rng.uniform(0, max(1e-9, len(x) / sr)) * sr))
        else:
            raise ValueError(f"unknown method {row['method']}")
        return {"samples": x.astype(np.float32)}

    return map_rows(planned.select("path", "slot", "method", "sr", "samples"), f, "path string, slot bigint, method string, sr int, samples array<float>, error string")


def augment_images(planned: DataFrame, *, longest: int = 15, seed: int = 42) -> DataFrame:
    """Rows (path, slot, method, height, width, pixels, meta) to new images: 'freq_mask', 'time_mask' and 'noise'; unknown methods become errors."""
    each = planned.withColumn("path", F.to_json(F.array("path", F.col("slot").cast("string"))))
    of = lambda name: each.where(F.col("method") == name).select("path", "height", "width", "pixels", "meta")
    known = {"freq_mask": mask_stripes(of("freq_mask"), "freq", longest, seed=seed), "time_mask": mask_stripes(of("time_mask"), "time", longest, seed=seed), "noise": add_noise(of("noise"), seed=seed)}
    bad = each.where(~F.coalesce(F.col("method").isin(*known), F.lit(False))).select("path", "method", "height", "width", "pixels", F.concat(F.lit("unknown method "), F.coalesce("method", F.lit("None"))).alias("error"))
    for name, made in known.items():
        bad = bad.unionByName(made.select("path", F.lit(name).alias("method"), "height", "width", "pixels", "error"))
    named = bad.withColumn("_of", F.from_json("path", "array<string>"))
    return named.select(F.col("_of")[0].alias("path"), F.col("_of")[1].cast("long").alias("slot"), "method", "height", "width", "pixels", "error")


def augmentation_report(results: DataFrame, cls: str = "class_name") -> DataFrame:
    """(class, succeeded, failed)."""
    return results.groupBy(cls).agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def batch_scores(samples: DataFrame, make_predict: Callable[[], Callable], shape: list[int], *, values: str = "values", size: int = 64, models: int = 1, label: str | None = None) -> DataFrame:
    """Adds run_id 0.. models - 1, logits and pred, and the cross entropy `loss` if the truth's column is given. make_predict() is called once per task and returns f(run ids, inputs) -> scores, a row each. shape: of one input."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    from fieldlab.functions.scalars import argmax, cross_entropy

    score = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=size, input_tensor_shapes={1: shape})
    runs = samples.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    out = runs.withColumn("logits", score(F.col("run_id").cast("double"), values)).withColumn("pred", argmax("logits"))
    return out if label is None else out.withColumn("loss", cross_entropy("logits", label))


by_value(__name__)
