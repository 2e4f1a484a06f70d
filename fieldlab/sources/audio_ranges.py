"""WAV recordings read by byte ranges: a Spark data source whose partitions are pieces of files.

A long recording is many partitions, short ones share one. A task reads the
file's header and then only the bytes of its piece and of the seconds asked
for; for headers alone nothing else is read. `bytes_read` says how many bytes
that were.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldlab.functions.shipping import by_value
from fieldlab.sources.stores import listed, store_of

HEADER = "path string, sr int, channels int, bits int, frames bigint, duration double, bytes_read bigint, error string"
PIECES = "path string, piece bigint, start bigint, frames bigint, sr int, samples array<float>, bytes_read bigint, error string"
#: Fixed values of the format: codes of whole numbers, of floating point, and of an extended header that holds the code further on.
PCM, FLOAT, EXTENDED = 1, 3, 0xFFFE
#: Bytes read for a header at first; those of a piece; files of a partition at most.
HEAD_BYTES, PIECE_BYTES, FILES = 4096, 8 << 20, 1000


@dataclass(frozen=True)
class WavHeader:
    sr: int
    channels: int
    bits: int
    code: int
    begin: int  # of the samples
    size: int  # their bytes

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return self.size // self.frame


def wav_header(read: Callable[[int, int], bytes], size: int) -> WavHeader:
    """The header of a file of so many bytes; read(offset, n) gives bytes. Sample sizes that are missing or too large end with the file."""
    if not size:
        raise EOFError("empty file")
    have = read(0, min(HEAD_BYTES, size))

    def at(offset: int, n: int) -> bytes:
        return have[offset : offset + n] if offset + n <= len(have) else read(offset, n)

    if have[:4] not in (b"RIFF", b"RF64") or have[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    here, form, long_size = 12, None, None
    while here + 8 <= size:
        kind, n = struct.unpack("<4sI", at(here, 8))
        if kind == b"ds64":
            long_size = struct.unpack("<Q", at(here + 16, 8))[0]
        elif kind == b"fmt ":
            form = at(here + 8, min(n, 40))
        elif kind == b"data":
            if form is None or len(form) < 16:
                raise ValueError("samples before their format")
            code, channels, sr, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            code = struct.unpack("<H", form[24:26])[0] if code == EXTENDED and len(form) >= 26 else code
            if code not in (PCM, FLOAT) or bits not in ((8, 16, 24, 32) if code == PCM else (32, 64)) or not channels or not sr:
                raise ValueError(f"samples of format {code} with {bits} bits, {channels} channels and rate {sr}")
            n = long_size if n == 0xFFFFFFFF and long_size is not None else n
            return WavHeader(sr, channels, bits, code, here + 8, max(0, min(n, size - here - 8)))
        here += 8 + n + n % 2
    raise ValueError("no samples in the file")


def decode_frames(raw: bytes, head: WavHeader) -> np.ndarray:
    """Mono samples in -1..1; channels are averaged."""
    if head.code == FLOAT:
        x = np.frombuffer(raw, dtype=f"<f{head.bits // 8}").astype(np.float32)
    elif head.bits == 8:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif head.bits == 24:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, dtype=f"<i{head.bits // 8}").astype(np.float32) / float(2 ** (head.bits - 1))
    return x.reshape(-1, head.channels).mean(axis=1) if head.channels > 1 else x


def seconds_to_frames(head: WavHeader, offset: float, duration: float | None) -> tuple[int, int]:
    """The frames of so many seconds from `offset`."""
    first = min(head.frames, round(offset * head.sr))
    return first, head.frames if duration is None else min(head.frames, first + round(duration * head.sr))


class Counted:
    """A file that counts the bytes it gives."""

    def __init__(self, path: str):
        store, inside = store_of(path)
        self.file, self.read_bytes = store.open_input_file(inside), 0  # since last told

    def __call__(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        got = self.file.read(n)
        self.read_bytes += len(got)
        return got

    def taken(self) -> int:
        n, self.read_bytes = self.read_bytes, 0
        return n

    def __enter__(self) -> Counted:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


@dataclass
class Ranges(InputPartition):
    """(file, its bytes, number of the piece, whether it is the last) of one task."""

    parts: list[tuple[str, int, int, bool]]


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.header = options["path"], options.get("content", "samples") == "header"
        self.scheme = self.root.split("://")[0] + "://" if "://" in self.root and not self.root.startswith("file:") else ""
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        self.piece_frames = int(options["pieceFrames"]) if options.get("pieceFrames") else None
        self.offset = float(options.get("offset", 0.0))
        self.duration = float(options["duration"]) if options.get("duration") else None
        if self.piece < 1 or (self.piece_frames or 1) < 1:
            raise ValueError("pieces need a byte or frame")

    def partitions(self) -> list[InputPartition]:
        """By file sizes alone: no file is opened here."""
        out, now, held = [], [], 0
        each = self.piece_frames or self.piece
        for path, size in listed(self.root, ".wav"):
            # a frame has at least one byte, so there are no more pieces of frames than this; those beyond the end are empty
            pieces = 1 if self.header else max(1, -(-size // each))
            for k in range(pieces):
                now.append((self.scheme + path, size, k, k == pieces - 1))
                held += HEAD_BYTES if self.header else min(size, each)
                if held >= self.piece or len(now) >= FILES:
                    out.append(Ranges(now))
                    now, held = [], 0
        return [*out, Ranges(now)] if now or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, parts in groupby(partition.parts, key=lambda p: p[0]):
            if self.header:
                yield from self._header(path, next(parts)[1])
                continue
            parts = list(parts)
            try:
                with Counted(path) as read:
                    head = wav_header(read, parts[0][1])
                    for _, _, piece, last in parts:
                        yield from self._piece(path, read, head, piece, last)
            except Exception as e:  # a bad file is a row, told with its first piece
                if parts[0][2] == 0:
                    yield pa.RecordBatch.from_pylist([{"path": path, "piece": 0, "error": f"{type(e).__name__}: {e}"}], schema=PIECES_ARROW)

    def _header(self, path: str, size: int) -> Iterator[pa.RecordBatch]:
        row: dict = {"path": path}
        try:
            with Counted(path) as read:
                head = wav_header(read, size)
                row |= {"sr": head.sr, "channels": head.channels, "bits": head.bits, "frames": head.frames, "duration": head.frames / head.sr, "bytes_read": read.taken()}
        except Exception as e:  # a bad file is a row
            row["error"] = f"{type(e).__name__}: {e}"
        yield pa.RecordBatch.from_pylist([row], schema=HEADER_ARROW)

    def _piece(self, path: str, read: Counted, head: WavHeader, piece: int, final: bool) -> Iterator[pa.RecordBatch]:
        first, last = seconds_to_frames(head, self.offset, self.duration)
        each = self.piece_frames or max(1, self.piece // head.frame)
        start, stop = max(first, piece * each), last if final else min(last, (piece + 1) * each)
        row: dict = {"path": path, "piece": piece, "sr": head.sr, "frames": head.frames}
        if first == last and piece == 0:
            yield pa.RecordBatch.from_pylist([row | {"bytes_read": read.taken(), "error": "no samples"}], schema=PIECES_ARROW)
        if start >= stop:
            return
        raw = read(head.begin + start * head.frame, (stop - start) * head.frame)
        x = decode_frames(raw[: len(raw) // head.frame * head.frame], head)
        row |= {"start": start, "bytes_read": read.taken()}
        columns = {c: pa.array([row.get(c)], PIECES_ARROW.field(c).type) for c in PIECES_ARROW.names if c != "samples"}
        columns["samples"] = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32()))
        yield pa.RecordBatch.from_arrays([columns[c] for c in PIECES_ARROW.names], schema=PIECES_ARROW)


HEADER_ARROW = pa.schema([("path", pa.string()), ("sr", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("duration", pa.float64()), ("bytes_read", pa.int64()), ("error", pa.string())])
PIECES_ARROW = pa.schema([("path", pa.string()), ("piece", pa.int64()), ("start", pa.int64()), ("frames", pa.int64()), ("sr", pa.int32()), ("samples", pa.list_(pa.float32())), ("bytes_read", pa.int64()), ("error", pa.string())])


class WavSource(DataSource):
    """spark.read.format("wav_ranges"): options content (samples or header), offset and duration in seconds, pieceBytes or pieceFrames."""

    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return HEADER if self.options.get("content", "samples") == "header" else PIECES

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


def read_audio_pieces(spark: SparkSession, root: str, *, offset: float = 0.0, duration: float | None = None, piece_bytes: int = PIECE_BYTES, piece_frames: int | None = None) -> DataFrame:
    """(path, piece, start, frames, sr, samples, bytes_read, error) of all WAV files under a root: a row per piece that holds some of the seconds asked for.

    start: first frame in the recording; frames: of the whole recording. Bad
    and empty files have one row with an error.
    """
    spark.dataSource.register(WavSource)
    options = {"offset": offset, "pieceBytes": piece_bytes} | ({} if duration is None else {"duration": duration}) | ({} if piece_frames is None else {"pieceFrames": piece_frames})
    return spark.read.format("wav_ranges").options(**options).load(root)


def audio_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, sr, channels, bits, frames, duration, bytes_read, error) of all WAV files under a root, from their headers alone."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav_ranges").option("content", "header").load(root)


by_value(__name__)
