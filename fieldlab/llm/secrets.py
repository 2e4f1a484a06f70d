"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary learnt from prose spends few tokens on words and many on random
strings. Runs of key characters whose characters-per-token ratio under a
tiktoken vocabulary is low are reported, letters alone and joined groups as
well, unless they are of a known form (hex of a digest's length, UUIDs, plain
numbers, dates), are joined words that the vocabulary has each as one token, or
overlap a span that a fixed pattern found.

Null counts as empty text. Offsets are code points, ends exclusive; the
span of an assignment is the whole match. Repeated rows each give a row; an
empty table gives none.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import by_value, table

#: Fixed patterns. The kinds in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
#: A text with none of these, in any case, holds no assignment.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Token-efficiency test: run length at least, characters per token at most.
MIN_CHARS = 20
MAX_RATIO = 2.2
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CHARS)
DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
NUMBER = re.compile(r"[0-9]+=*\Z")
_DAY = r"(?:19|20)[0-9]{2}[-/_]?(?:0[1-9]|1[0-2])[-/_]?(?:0[1-9]|[12][0-9]|3[01])"
_TIME = r"(?:[01][0-9]|2[0-3])[-_]?[0-5][0-9](?:[-_]?[0-5][0-9])?"
DATES = re.compile(rf"{_DAY}(?:[-/_+T]+(?:{_DAY}|{_TIME}))*[-/_+Z]*\Z")
WORDS = re.compile(r"[-_/+]*[A-Za-z]+(?:[-_/+]+[A-Za-z]+)+[-_/+=]*\Z")
#: Joined words are of so many letters at least, on average: shorter groups are mostly tokens by chance.
WORD_CHARS = 3
#: Runs are encoded in pieces of so many characters.
PIECE = 10_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    raw = text.encode().lower()
    out = []
    if any(n in raw for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined_words(run: str, encode) -> bool:
    """Whether the run is letter groups joined by separators, each one token of the vocabulary, as a word's start or after a space."""
    if not WORDS.match(run):
        return False
    groups = re.findall("[A-Za-z]+", run)
    return sum(map(len, groups)) >= WORD_CHARS * len(groups) and all(any(len(encode(x)) == 1 for x in (g, f" {g}", g.lower(), f" {g.lower()}")) for g in groups)


def joined_spans(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What spans in order of their starts cover, as disjoint spans."""
    out: list[tuple[int, int]] = []
    for _, a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def inefficient_spans(text: str, encode, taken: list[tuple[str, int, int]], max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """Runs of key characters that the vocabulary spends a token on every few characters for."""
    out = []
    if max(map(len, text.split()), default=0) < MIN_CHARS:
        return out
    taken, at = joined_spans(taken), 0
    for m in RUN.finditer(text):
        run = m[0]
        while at < len(taken) and taken[at][1] <= m.start():  # runs and spans both come in order
            at += 1
        if at < len(taken) and taken[at][0] < m.end() or NUMBER.match(run) or DATES.match(run) or DIGEST.match(run) or UUID.match(run):
            continue
        if len(run) <= max_ratio * sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE)) and not joined_words(run, encode):
            out.append(("random", m.start(), m.end()))
    return out


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: id, spans: array of (kind, start, end) by start, then kind.

    vocabulary: path of a tiktoken ranks file on every executor; by default
    that of the installed public tokenizers.
    """

    def work(batches):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = inefficient_spans(text or "", encode, base, max_ratio)
                spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[id_col, "spans"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


by_value(__name__)


def op7_secret_scan(spark, sf_dir):
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
