"""WAV and PNG files as tables: one row per file, bad files as rows with an error.

Files come from Spark's binaryFile source and are decoded in the tasks that
read them, with the standard library and numpy.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S
from fieldlab.functions.scalars import map_update
from fieldlab.functions.shipping import by_value
from fieldlab.sources.audio_ranges import decode_frames, seconds_to_frames, wav_header

AUDIO = "path string, sr int, samples array<float>, error string"
AUDIO_HEADER = "path string, sr int, duration double, error string"
SPECTROGRAM = "path string, height int, width int, pixels binary, meta map<string,string>, error string"
IMAGE = "path string, height int, width int, channels int, depth int, pixels binary, meta map<string,string>, error string"
PNG_META = "path string, meta map<string,string>, error string"
PNG_START = b"\x89PNG\r\n\x1a\n"


# ---- WAV --------------------------------------------------------------------
def decode_wav(data: bytes, offset: float = 0.0, duration: float | None = None) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in -1..1); channels are averaged."""
    head = wav_header(lambda at, n: data[at : at + n], len(data))
    first, last = seconds_to_frames(head, offset, duration)
    return head.sr, decode_frames(data[head.begin + first * head.frame : head.begin + last * head.frame], head)


def encode_wav(samples: np.ndarray, sr: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def wav_files(audio: DataFrame) -> DataFrame:
    """(path, content): each (path, sr, samples) as a WAV file's bytes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [encode_wav(np.asarray(x, dtype=np.float64), int(sr)) for x, sr in zip(pdf["samples"], pdf["sr"])]})

    return audio.select("path", "sr", "samples").mapInPandas(work, "path string, content binary")


def read_audio(files: DataFrame, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """(path, content) rows to (path, sr, samples, error): an empty file and a corrupt one have different errors."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    if data is None:
                        raise FileNotFoundError(path)
                    sr, x = decode_wav(bytes(data), offset, duration)
                    out.append((path, sr, x, None if len(x) else "no samples"))
                except Exception as e:  # a bad file is a row
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sr", "samples", "error"])

    return files.select("path", "content").mapInPandas(work, AUDIO)


def audio_durations(files: DataFrame) -> DataFrame:
    """(path, sr, duration, error) of rows that hold whole files. For files in a store `audio_headers` reads nothing but headers."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    head = wav_header(lambda at, n, data=data: bytes(data[at : at + n]), len(data))
                    out.append((path, head.sr, head.frames / head.sr, None))
                except Exception as e:
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sr", "duration", "error"])

    return files.select("path", "content").mapInPandas(work, AUDIO_HEADER)


# ---- PNG --------------------------------------------------------------------
def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != PNG_START:
        raise ValueError("not a PNG file")
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


#: Fixed values of the format: channels by colour type; first column and row, and steps, of the passes of an interlaced image.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
LUMINANCE = (0.299, 0.587, 0.114)


def _text(kind: bytes, body: bytes) -> tuple[str, str] | None:
    """Key and value of a text chunk, plain, packed or international."""
    key, _, rest = body.partition(b"\0")
    if kind == b"tEXt":
        return key.decode("latin-1"), rest.decode("latin-1")
    if kind == b"zTXt":
        return key.decode("latin-1"), zlib.decompress(rest[1:]).decode("latin-1")
    if kind == b"iTXt":
        value = rest[2:].split(b"\0", 2)[2]
        return key.decode("latin-1"), (zlib.decompress(value) if rest[0] else value).decode("utf-8")
    return None


def decode_image(data: bytes, pixels: bool = True) -> tuple[int, int, np.ndarray | None, dict[str, str]]:
    """(height, width, samples (height, width, channels) as uint8 or uint16, text) of a PNG of any kind; palette entries are their colours. Without pixels nothing but text is inflated."""
    meta: dict[str, str] = {}
    packed, head, palette = [], None, None
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body if pixels else b"")
        elif (found := _text(kind, body)) is not None:
            meta[found[0]] = found[1]
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlace = head
    if not pixels:
        return height, width, None, meta
    if colour not in CHANNELS or depth not in ((1, 2, 4, 8, 16) if colour == 0 else (1, 2, 4, 8) if colour == 3 else (8, 16)) or interlace > 1:
        raise ValueError(f"colour type {colour} of {depth} bits, interlace {interlace}")
    raw, channels, at = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8), CHANNELS[colour], 0
    out = np.zeros((height, width, channels), dtype=np.uint16 if depth == 16 else np.uint8)
    for x, y, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        rows = _unfilter(raw[at : at + h * (line + 1)].reshape(h, line + 1), max(1, channels * depth // 8))
        at += h * (line + 1)
        if depth == 16:
            samples = rows.reshape(h, w, channels, 2).astype(np.uint16) @ np.array([256, 1], dtype=np.uint16)
        elif depth == 8:
            samples = rows.reshape(h, w, channels)
        else:
            bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, 1, depth)
            samples = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
            samples = samples if colour == 3 else samples * (255 // ((1 << depth) - 1))
        out[y::dy, x::dx] = samples
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        out = palette[out[:, :, 0]]
    return height, width, out, meta


def gray(image: np.ndarray) -> np.ndarray:
    """8-bit gray of an image of any channels: luminance of colours, without alpha; of 16 bits the upper ones."""
    image = (image >> 8).astype(np.uint8) if image.dtype == np.uint16 else image
    return np.floor(image[:, :, :3] @ np.array(LUMINANCE) + 0.5).astype(np.uint8) if image.shape[2] > 2 else image[:, :, 0]


def decode_png(data: bytes, pixels: bool = True) -> tuple[int, int, bytes | None, dict[str, str]]:
    """(height, width, 8-bit gray pixels, text)."""
    height, width, image, meta = decode_image(data, pixels)
    return height, width, None if image is None else gray(image).tobytes(), meta


def _unfilter(raw: np.ndarray, size: int = 1) -> np.ndarray:
    """Undoes the row filters of an image whose pixels have `size` bytes.

    A byte depends on the pixels to its left, above, and above left, so pixels
    of one anti-diagonal don't depend on each other and are done at once.
    """
    kind, coded = raw[:, 0], raw[:, 1:]
    if kind.max(initial=0) > 4:
        raise ValueError(f"row filter {kind.max()}")
    h, n = len(raw), coded.shape[1] // size
    if not kind.any():
        return coded
    coded = coded.reshape(h, n, size).astype(np.int16)
    out = np.zeros((h + 1, n + 1, size), dtype=np.int16)  # with a row and a pixel of zeros before
    for d in range(h + n - 1):
        y = np.arange(max(0, d - n + 1), min(h, d + 1))
        x = d - y
        left, up, corner, k = out[y + 1, x], out[y, x + 1], out[y, x], kind[y][:, None]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = (coded[y, x] + np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) >> 1, nearest], 0)) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, n * size)


def encode_png(pixels: bytes, height: int, width: int, meta: dict[str, str] | None = None) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width)
    packed = zlib.compress(np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes())
    text = b"".join(chunk(b"tEXt", k.encode("latin-1", "replace") + b"\0" + str(v).encode("latin-1", "replace")) for k, v in (meta or {}).items() if v is not None)
    return PNG_START + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + text + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def _images(files: DataFrame, decode, schema: str, width: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, *decode(bytes(data)), None))
                except Exception as e:
                    out.append((path, *[None] * width, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    names = [c.split(" ")[0] for c in schema.split(", ")][1:-1]
    return files.select("path", "content").mapInPandas(work, schema)


def read_spectrograms(files: DataFrame) -> DataFrame:
    """(path, content) rows to (path, height, width, pixels, meta, error); pixels are 8-bit gray, whatever the PNG holds."""
    return _images(files, decode_png, SPECTROGRAM, 4)


def read_images(files: DataFrame) -> DataFrame:
    """(path, content) rows to (path, height, width, channels, depth, pixels, meta, error): samples as the PNG holds them, in bytes or little-endian pairs of bytes."""

    def decode(data: bytes):
        height, width, image, meta = decode_image(data)
        return height, width, image.shape[2], image.itemsize * 8, image.tobytes(), meta

    return _images(files, decode, IMAGE, 6)


def read_png_metadata(files: DataFrame) -> DataFrame:
    """(path, meta, error); pixels are never inflated."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, decode_png(bytes(data), pixels=False)[3], None))
                except Exception as e:
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "meta", "error"])

    return files.select("path", "content").mapInPandas(work, PNG_META)


def png_files(spectrograms: DataFrame) -> DataFrame:
    """(path, content): each spectrogram as a PNG file's bytes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = [encode_png(bytes(p), h, w, dict(m or {})) for p, h, w, m in zip(pdf["pixels"], pdf["height"], pdf["width"], pdf["meta"])]
            yield pd.DataFrame({"path": pdf["path"], "content": content})

    return spectrograms.select("path", "height", "width", "pixels", "meta").mapInPandas(work, "path string, content binary")


def write_spectrograms(spectrograms: DataFrame, path: str, partition: str = "species") -> None:
    """Parquet by class: the sink at scale."""
    spectrograms.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def update_metadata(spectrograms: DataFrame, entries, replace: bool = False) -> DataFrame:
    """Adds entries (a map column) to meta, or replaces it; the new value of a key wins."""
    return spectrograms.withColumn("meta", entries if replace else map_update(F.coalesce("meta", S.map_clear()), entries))


def clear_metadata(spectrograms: DataFrame) -> DataFrame:
    return spectrograms.withColumn("meta", S.map_clear())


def load_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length, content): input of the readers above."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


by_value(__name__)
