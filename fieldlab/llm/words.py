"""Words and word windows inside tasks: 64-bit identifiers and window hashes, for many documents at once.

A batch of texts is one array of bytes, so words are found and hashed by a few
passes over it and not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fieldlab.llm.common import by_value

#: Odd multipliers of the window hash and its final mixing.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
S32, S29 = np.uint64(32), np.uint64(29)


#: Of each byte what stands for it: ASCII white space is a space, with or without lower case for A-Z.
PLAIN = np.array([32 if 9 <= c <= 13 else c for c in range(256)], dtype=np.uint8)
LOWERED = np.array([c + 32 if 65 <= c <= 90 else PLAIN[c] for c in range(256)], dtype=np.uint8)
#: Bytes of text that are worked on at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 21


class Words:
    """Of consecutive texts: `raw`, their bytes by the given table; `start` and `end` of each word in there; `ids`; and `first`, the number of each text's first word, with the number of all words at its end."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN):
        self.raw = raw = table[raw]
        inside = raw != 32
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < len(raw))]  # words end where their text does
        begin[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.ids = hashed(raw, self.start, self.end)

    def of(self, doc: int) -> slice:
        return slice(self.first[doc], self.first[doc + 1])

    def phrase(self, first: int, last: int) -> bytes:
        """The words from number `first` to before `last`, joined by one space."""
        raw = self.raw[self.start[first] : self.end[last - 1]]
        keep = raw != 32
        keep[1:] |= keep[:-1]
        return raw[keep].tobytes()


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit identifiers of the words: their length, then eight bytes at a time."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = end - start
    h = left.astype(np.uint64) * STEP
    at, own = start, slice(None)
    while len(at):
        part = eight[at] << np.maximum(0, (8 - left) * 8).astype(np.uint64)
        y = (h[own] ^ part) * MIX
        y = (y ^ (y >> S32)) * STEP
        h[own] = y ^ (y >> S29)
        more = left > 8
        own = np.flatnonzero(more) if isinstance(own, slice) else own[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the texts in them) of consecutive rows; null is an empty text."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_in(texts: list[bytes], table: np.ndarray = PLAIN) -> Words:
    """The words of a few texts."""
    return Words(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]), table)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * MIX
    h = (h ^ (h >> S29)) * MIX
    return h ^ (h >> S32)


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive identifiers; empty if there are fewer."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    h = ids[:count].copy()
    for k in range(1, n):
        h *= STEP
        h += ids[k : k + count]
    return mixed(h)


by_value(__name__)
