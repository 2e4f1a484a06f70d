"""Filters and spectrograms over pieces of recordings, so that one long recording is the work of many tasks.

Pieces are rows (path, piece, start, frames, sr, samples), as
`read_audio_pieces` and `in_pieces` make them: consecutive from 0, all of one
recording of one length but the last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.shipping import by_value
from fieldlab.operators.ranks import kept
from fieldlab.operators.signal import HIGH_HZ, HOP, LOW_HZ, N_FFT, N_MELS, bandpass_coefficients, mel_power, scaled_image, scan_filter, state_matrix

PIECE = "path string, piece bigint, start bigint, frames bigint, sr int, samples array<float>"
#: Seconds of a piece where a recording comes whole; entries of arrays in the rows that leave a task together.
SECONDS, HELD = 10.0, 4_000_000


def in_pieces(audio: DataFrame, *, seconds: float = SECONDS, frames: int | None = None) -> DataFrame:
    """(path, sr, samples) to pieces of so many seconds, or frames."""
    size = F.lit(frames) if frames else F.greatest(F.lit(1), F.floor(F.col("sr") * seconds)).cast("int")
    cut = audio.select("path", "sr", "samples", size.alias("_size"), F.size("samples").alias("_n")).where("_n > 0")
    each = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.col("_size")).cast("int"))))
    start = F.col("piece") * F.col("_size")
    return each.select("path", F.col("piece").cast("long").alias("piece"), start.cast("long").alias("start"), F.col("_n").cast("long").alias("frames"), "sr", F.slice("samples", start + 1, F.col("_size")).cast("array<float>").alias("samples"))


def _rows(pieces: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """One row per piece from f(row as dict); rows leave a few at a time, however many a batch brings."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for row in pdf.to_dict("records"):
                out.append(f(row))
                held += 1000 + sum(len(v) for v in out[-1].values() if isinstance(v, (np.ndarray, bytes)))
                if held >= HELD:
                    yield pd.DataFrame(out)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out)

    return pieces.mapInPandas(work, schema)


# ---- band-pass -------------------------------------------------------------------
def filter_pieces(pieces: DataFrame, low: float = LOW_HZ, high: float = HIGH_HZ, *, normalize: bool = True, kind: str = "float") -> DataFrame:
    """The pieces band-passed as if each recording were filtered whole, divided by the recording's maximum.

    A recursive filter over a piece maps the state it starts with to the one
    it ends with by an affine map. Every piece is filtered from rest first,
    which gives its map; the maps of a recording, a few numbers a piece, are
    composed to the state each piece starts with; then pieces are filtered
    from there. No task holds more than a piece's samples. Pieces without
    samples, the rows of bad files, are left out. kind: of the samples that
    come out, float or double.
    """
    pieces = pieces.where("samples IS NOT NULL")
    shaped = _rows(pieces.select("path", "piece", "sr", "samples"), _at_rest(low, high), "path string, piece bigint, sr int, n bigint, state array<double>")
    states = shaped.groupBy("path").applyInPandas(_scan_states(low, high), "path string, piece bigint, before array<double>")
    made = _rows(pieces.select("path", "piece", "start", "frames", "sr", "samples").join(states, ["path", "piece"]), _from_state(low, high), PIECE.replace("<float>", "<double>") + ", top double")
    sized = lambda c: c.cast(f"array<{kind}>").alias("samples")
    if not normalize:
        return made.select("path", "piece", "start", "frames", "sr", sized(F.col("samples")))
    made = kept(made, "filtered")  # read twice: for the maximum and for what it divides
    top = made.groupBy("path").agg(F.max("top").alias("top"))
    scaled = made.drop("top").join(top, "path")
    divided = F.when(F.col("top") > 0, F.transform("samples", lambda x: x / F.col("top"))).otherwise(F.col("samples"))
    return scaled.select("path", "piece", "start", "frames", "sr", sized(divided))


def _at_rest(low: float, high: float) -> Callable[[dict], dict]:
    def work(row: dict) -> dict:
        b, a = bandpass_coefficients(low, high, int(row["sr"]))
        _, state = scan_filter(b, a, np.asarray(row["samples"], dtype=np.float64))
        return {"path": row["path"], "piece": row["piece"], "sr": row["sr"], "n": len(row["samples"]), "state": state}

    return work


def _scan_states(low: float, high: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The state each piece of a recording starts with; a row per piece, without samples."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        powers: dict[tuple[int, int], np.ndarray] = {}
        state, before = np.zeros(4), []
        for sr, n, own in zip(pdf["sr"], pdf["n"], pdf["state"]):
            before.append(state)
            if (sr, n) not in powers:
                powers[sr, n] = np.linalg.matrix_power(state_matrix(bandpass_coefficients(low, high, int(sr))[1]), int(n))
            state = powers[sr, n] @ state + np.asarray(own)
        return pd.DataFrame({"path": pdf["path"], "piece": pdf["piece"], "before": before})

    return work


def _from_state(low: float, high: float) -> Callable[[dict], dict]:
    def work(row: dict) -> dict:
        y, _ = scan_filter(*bandpass_coefficients(low, high, int(row["sr"])), np.asarray(row["samples"], dtype=np.float64), np.asarray(row["before"]))
        return {c: row[c] for c in ("path", "piece", "start", "frames", "sr")} | {"samples": y, "top": float(y.max())}

    return work


# ---- spectrograms ----------------------------------------------------------------
def spectrogram_pieces(pieces: DataFrame, *, n_mels: int = N_MELS, n_fft: int = N_FFT, hop: int = HOP) -> DataFrame:
    """(path, piece, first_column, columns, height, pixels, sr, duration): the columns of a recording's log-mel image that begin in each piece.

    A piece gets half a window's samples of its neighbours, which are sent as
    rows of their own; the loudest and the faintest value of a recording come
    from a row per piece. Pieces but the last must hold n_fft frames.
    """
    half = n_fft // 2
    base = pieces.select("path", "piece", "start", "frames", "sr", "samples")
    ends = lambda at, length, move, name: base.select("path", (F.col("piece") + move).alias("piece"), F.slice("samples", at, length).alias(name))
    size = F.size("samples")
    before = ends(F.greatest(F.lit(1), size - half + 1), F.lit(half), 1, "before")
    after = ends(F.lit(1), F.lit(half), -1, "after")
    joined = base.join(before, ["path", "piece"], "left").join(after, ["path", "piece"], "left")
    power = kept(_rows(joined, _mel_piece(n_mels, n_fft, hop), "path string, piece bigint, first_column bigint, columns int, sr int, frames bigint, mel binary, most double, least double"), "mel")
    ends_of = power.groupBy("path").agg(F.max("most").alias("loudest"), F.min("least").alias("faintest"))

    def draw(row: dict) -> dict:
        image = scaled_image(np.frombuffer(row["mel"]).reshape(n_mels, -1), row["loudest"], row["faintest"])
        return {c: row[c] for c in ("path", "piece", "first_column", "columns", "sr")} | {"height": n_mels, "pixels": image.tobytes(), "duration": round(row["frames"] / row["sr"], 1)}

    return _rows(power.where("columns > 0").join(ends_of, "path"), draw, "path string, piece bigint, first_column bigint, columns int, height int, pixels binary, sr int, duration double")


def _mel_piece(n_mels: int, n_fft: int, hop: int) -> Callable[[dict], dict]:
    half = n_fft // 2

    def work(row: dict) -> dict:
        start, frames = int(row["start"]), int(row["frames"])
        own = np.asarray(row["samples"], dtype=np.float64)
        last = start + len(own) >= frames
        before, after = (np.asarray([] if row[c] is None else row[c], dtype=np.float64) for c in ("before", "after"))
        if not last and len(own) < n_fft or start and len(before) < half:
            raise ValueError(f"piece {row['piece']} of {row['path']} is shorter than a window")
        x = np.concatenate([before, own, after])
        pad = (0 if start else half, half - len(after) if start + len(own) + len(after) >= frames else 0)
        x = np.pad(x, pad, mode="reflect" if frames > half else "constant")
        first = -(-start // hop)
        count = (frames // hop if last else (start + len(own) - 1) // hop) - first + 1
        x = x[first * hop - start :]  # x began half a window before the piece
        mel = mel_power(x, int(row["sr"]), count, n_mels, n_fft, hop)
        most, least = (float(mel.max()), float(mel.min())) if count > 0 else (None, None)
        return {"path": row["path"], "piece": row["piece"], "first_column": first, "columns": count, "sr": row["sr"], "frames": frames, "mel": mel.tobytes(), "most": most, "least": least}

    return work


def assembled(columns: DataFrame) -> DataFrame:
    """(path, height, width, pixels, meta) of recordings short enough for a row each, from their pieces' columns."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        image = np.hstack([np.frombuffer(p, dtype=np.uint8).reshape(h, c) for p, h, c in zip(pdf["pixels"], pdf["height"], pdf["columns"])])
        row = pdf.iloc[0]
        meta = {"sr": str(row["sr"]), "duration": str(row["duration"])}
        return pd.DataFrame([{"path": row["path"], "height": image.shape[0], "width": image.shape[1], "pixels": image.tobytes(), "meta": meta}])

    return columns.where("pixels IS NOT NULL").groupBy("path").applyInPandas(work, "path string, height int, width int, pixels binary, meta map<string,string>")


def long_spectrograms(pieces: DataFrame, *, band: Sequence[float] | None = (LOW_HZ, HIGH_HZ), n_mels: int = N_MELS, n_fft: int = N_FFT, hop: int = HOP) -> DataFrame:
    """Spectrogram columns of band-passed pieces, with `error`: the rows of bad files, if the pieces have them, say what was wrong."""
    made = spectrogram_pieces(filter_pieces(pieces, *band, kind="double") if band else pieces, n_mels=n_mels, n_fft=n_fft, hop=hop).withColumn("error", F.lit(None).cast("string"))
    if "error" not in pieces.columns:
        return made
    return made.unionByName(pieces.where("samples IS NULL").select("path", "piece", "sr", "error"), allowMissingColumns=True)


by_value(__name__)
