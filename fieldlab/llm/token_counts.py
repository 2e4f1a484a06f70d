"""Token counts of whole texts with overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two neighbours
are spliced at a boundary that both encodings have in their overlap and that
is proven stable: the tokenizer's own splitting pattern always cuts there and
what follows doesn't depend on what came before. If the overlap holds none, it
is widened, at most to the rest of the text, so the count is always that of
the whole text.

Null counts as empty text, which has no tokens. Repeated rows each give a row;
an empty table gives none.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import by_value, table

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
LIMIT = 512
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"

#: Places where the GPT-2 splitting pattern always cuts: before white space that
#: follows something else, and between a letter or digit of these long-assigned
#: blocks and ASCII or CJK punctuation (no alternative of the pattern goes on
#: from a letter or digit to either). Fixed values, by Unicode block.
STABLE = re.compile(
    r"(?<=[^\s])(?=[ \t\n\r])|"
    r"(?<=[A-Za-z0-9À-ÖØ-öΑ-Ρα-ωА-яぁ-ゖァ-ヺ一-龥가-힣])(?=[!-/:-@\[-`{-~、-〃！，？])"
)


def stable_cuts(text: str, start: int, end: int, specials: tuple[str, ...]) -> list[int]:
    """Positions p with start < p < end where a token surely begins, none inside a special token's string."""
    found = [m.start() for m in STABLE.finditer(text, start + 1, end)]
    return [p for p in found if not any(s in text[max(0, p - len(s) + 1) : p + len(s) - 1] for s in specials)]


def count_long(text: str, starts_of, specials: tuple[str, ...], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of `text`. starts_of(text) gives the character offsets of its tokens."""
    count, at = 0, 0  # tokens before `at` are counted; a token surely begins at `at`
    while True:
        end = min(len(text), at + chunk)
        starts = starts_of(text[at:end])
        if end == len(text):
            return count + len(starts)
        wide = overlap
        while True:
            begin = max(at, end - wide)
            ahead = min(len(text), end + wide)
            own = [at + a for a in starts]
            other = {begin + a for a in starts_of(text[begin:ahead])}
            # the last common boundary that both encodings have and that is proven stable
            cut = next((p for p in reversed(stable_cuts(text, begin, end, specials)) if p > at and p in other and own[min(bisect.bisect_left(own, p), len(own) - 1)] == p), None)
            if cut is not None:
                count += bisect.bisect_left(own, cut)
                at = cut
                break
            if begin == at:  # no boundary in the whole chunk: take a longer one
                end = min(len(text), at + 2 * (end - at))
                starts = starts_of(text[at:end])
                if end == len(text):
                    return count + len(starts)
            wide *= 2


class Encoder:
    """A byte-level BPE vocabulary: its ranks, and the special tokens its tokenizer file finds inside texts."""

    def __init__(self, ranks_path: str, tokenizer_path: str):
        import base64
        import json

        import numpy as np
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(tokenizer_path, encoding="utf-8") as f:
            self.specials = tuple(t["content"] for t in json.load(f)["added_tokens"])
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def pieces(self, text: str) -> list[str]:
        """The text cut around special tokens; those are at the odd places."""
        return self.split.split(text) if self.split and any(s in text for s in self.specials) else [text]

    def count(self, text: str) -> int:
        return sum(1 if i % 2 else len(self.plain(x)) for i, x in enumerate(self.pieces(text)))

    def starts(self, text: str) -> list[int]:
        """Character offsets at which the tokens begin, ascending."""
        import numpy as np

        out, at = [], 0
        for i, x in enumerate(self.pieces(text)):
            if i % 2:
                out.append(at)
            elif x:
                raw = np.frombuffer(x.encode(), dtype=np.uint8)
                ends = np.cumsum(self.lengths[self.plain(x)])
                chars = np.cumsum((raw & 0xC0) != 0x80) - 1
                out += (at + chars[np.concatenate([[0], ends[:-1]])]).tolist()
            at += len(x)
        return out


def token_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, tokenizer: str | None = None,
    limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ranks, tokenizer: paths of the vocabulary's ranks and of its tokenizer
    file on every executor; by default those of the installed public
    tokenizers. Counts are those of the tokenizer file's own library without
    added tokens; the ranks give the same tokens about six times as fast.
    """

    def work(batches):
        import public_tokenizers

        enc = Encoder(ranks or public_tokenizers.path(RANKS), tokenizer or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [enc.count(t) if len(t) <= chunk else count_long(t, enc.starts, enc.specials, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(work, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


by_value(__name__)


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
