"""Substring deduplication: repeated windows of words, found with suffix automata of reference shards.

A window is `window` consecutive words. Each word covered by a window whose
words also start anywhere else in the corpus is removed; windows are judged on
the input.

An automaton of the whole corpus has no size bound, and streaming every
document past every shard would grow with the square of the corpus. So the
reference is sharded by content, and a document's pieces go to the shard that
can know them:

1. One scan cuts every text into pieces: maximal runs of windows with the same
   leftmost minimizer (the smallest hash of `anchor` consecutive words in the
   window). Equal windows have equal minimizers. Documents with the same words
   are one class from here on, which counts as often as it has members.
2. A minimizer that occurs once in the corpus heads no repeated window: those
   pieces are done. Of the rest, pieces with equal content are one with a
   weight; where a minimizer has one content, that weight counts its windows.
3. Each shard, a bounded number of pieces of some minimizers, builds a
   suffix automaton over its pieces, sums weights over the suffix links, and
   streams the pieces through it: the matching statistics, held at the window's
   length, give the state and so the number of occurrences of each window.
   A minimizer with more pieces than a shard holds is split over several, and
   its windows' counts are summed across them.
4. Windows that occur twice or more become word spans of the documents.

Text goes over the network once, and a second time for documents with
candidate pieces only. Null text has no words. Repeated rows each give a row
(each is a copy of the other); an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import WORD, Scratch, by_value, table
from fieldlab.llm.decontamination import merged
from fieldlab.llm.words import STEP, Words, chunks, mixed, windows

WINDOW, ANCHOR = 35, 12
#: Pieces of a shard at most; a piece has fewer than 2 * window words.
SHARD_PIECES = 2_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def pieces(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, minimizer, first window, windows, content hash) of each piece of the documents."""
    ids, count = words.ids, np.diff(words.first)
    if len(ids) < window:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    grams = windows(ids, anchor)
    least = sliding_min(grams, window - anchor + 1)
    doc = np.repeat(np.arange(len(count)), count)[: len(least)]
    at = np.arange(len(least))
    # a piece ends where its minimizer's place leaves the window or a lesser one comes in
    new = np.empty(len(least), dtype=bool)
    new[0] = True
    new[1:] = (grams[: len(least) - 1] == least[:-1]) | (least[1:] < least[:-1]) | (doc[1:] != doc[:-1])
    new &= at + window <= words.first[doc + 1]
    first = np.flatnonzero(new)
    doc = doc[first]
    end = np.minimum(np.append(first[1:], len(ids)), words.first[doc + 1] - window + 1)
    # hashes of any run of words from sums of powers, modulo 2 ** 64
    back = np.uint64(pow(int(STEP), -1, 1 << 64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), STEP)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), back)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * power[:-1], dtype=np.uint64)])
    content = mixed((sums[end - 1 + window] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    return doc, least[first].view(np.int64), first - words.first[doc], end - first, content.view(np.int64)


def words_key(words: Words, doc: int) -> bytes:
    return xxhash.xxh3_128_digest(words.ids[words.of(doc)].tobytes())


def scan(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, id, text) to (key, id, n_words, words_key, words_sha256, pieces)."""

    def work(batches):
        for batch in batches:
            for start, end, raw, offsets in chunks(batch.column(2)):
                words, docs_ = Words(raw, offsets), range(end - start)
                doc, m, first, count, content = pieces(words, window, anchor)
                flat = pa.StructArray.from_arrays([pa.array(m, pa.int64()), pa.array(content, pa.int64()), pa.array(first, pa.int32()), pa.array(count, pa.int32())], names=["m", "c", "first", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(end - start + 1)), pa.int32()), flat)
                shas = [hashlib.sha256(words.phrase(o.start, o.stop) if (o := words.of(d)).stop > o.start else b"").hexdigest() for d in docs_]
                columns = [batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), pa.array(np.diff(words.first), pa.int64())]
                columns += [pa.array([words_key(words, d) for d in docs_], pa.binary()), pa.array(shas, pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n_words", "words_key", "words_sha256", "pieces"])

    return docs.mapInArrow(work, f"key bigint, id {docs.schema['id'].dataType.simpleString()}, n_words bigint, words_key binary, words_sha256 string, pieces array<struct<m:bigint,c:bigint,first:int,n:int>>")


class SuffixAutomaton:
    """Of several word lists. After weigh(), total[state] is the weighted number of places where the state's words occur."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if (q := nxt[last].get(w)) is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        """A state for the words that reach q through p and no longer ones."""
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def weigh(self, lists, weights) -> None:
        self.total = [0] * len(self.next)
        for words, weight in zip(lists, weights):
            state = 0
            for w in words:
                state = self.next[state][w]
                self.total[state] += weight
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.total[self.link[state]] += self.total[state]

    def occurrences(self, words, window: int) -> list[int]:
        """Streams the words; for each window, how often it occurs in the lists (0 where it doesn't)."""
        nxt, link, length, total = self.next, self.link, self.length, self.total
        out, state, matched = [], 0, 0
        for i, w in enumerate(words, 1):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window:
                out.append(total[state] if matched >= window else 0)
        return out


def judge(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """The pieces of a shard, streamed past the shard's automaton, to the mask of their repeated windows; for split minimizers also hash and count of every window."""
    pdf = pdf.drop_duplicates(["m", "c"])
    number: dict[bytes, int] = {}
    lists = [[number.setdefault(w, len(number)) for w in text.split(b" ")] for text in pdf["content"]]
    automaton = SuffixAutomaton()
    for words in lists:
        automaton.add(words)
    automaton.weigh(lists, pdf["weight"].tolist())
    out = []
    for m, c, parts, text, words in zip(pdf["m"], pdf["c"], pdf["parts"], pdf["content"], lists):
        counts = automaton.occurrences(words, window)
        each = []
        if parts > 1:
            raw = text.split(b" ")
            each = [{"i": i, "h": xxhash.xxh3_128_digest(b" ".join(raw[i : i + window])), "n": n} for i, n in enumerate(counts)]
        out.append((m, c, sum(1 << i for i, n in enumerate(counts) if n > 1), each))
    return pd.DataFrame(out, columns=["m", "c", "mask", "each"])


def repeated_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per document: id, n_words, spans of removed words (start, end exclusive), n_removed, kept_sha256."""
    if not 0 < anchor <= window or window - anchor >= 62:
        raise ValueError("the anchor is at most as long as the window and at most 61 words shorter")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    # ids may be null or repeated, so texts are found again by a hash of id and text; words_key then tells them apart
    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = scratch.keep(scan(texts, window, anchor).select(F.monotonically_increasing_id().alias("row"), "*"), "rows")

    classes = rows.where(F.col("n_words") >= window).groupBy("words_key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("members"))
    lead = rows.select("row", "words_key", "key", "pieces").join(classes, ["words_key", "row"])
    piece = lead.select("row", "members", F.explode("pieces").alias("p")).select("row", "members", "p.*")
    heads = scratch.keep(piece.groupBy("m").agg(F.sum("members").alias("times")).where("times > 1").select("m"), "heads")
    piece = scratch.keep(piece.join(heads, "m"), "pieces")

    content = piece.groupBy("m", "c").agg(F.sum("members").alias("weight"), F.min(F.struct("row", "first", "n")).alias("at"))
    content = scratch.keep(content.select("m", "c", "weight", "at.*"), "contents")
    several = content.groupBy("m").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    several = scratch.keep(several.select("m", F.ceil(F.col("contents") / F.lit(shard_pieces)).alias("parts"), "contents"), "several")
    shards = max(1, -(-(several.agg(F.sum("contents")).first()[0] or 0) // shard_pieces))
    # all windows of a minimizer with one content occur as often as that piece
    alone = content.join(several, "m", "left_anti").select("m", "c", (F.expr("shiftleft(1L, n)") - 1).alias("mask"))
    sent = content.join(several, "m").withColumn("shard", F.pmod(F.xxhash64("m", F.pmod(F.col("c"), F.col("parts"))), F.lit(shards)))
    asked = sent.groupBy("row").agg(F.collect_list(F.struct("m", "c", "weight", "first", "n", "parts", "shard")).alias("asked"))
    wanted = piece.select("row").distinct().join(asked, "row", "left").join(lead.select("row", "words_key", "key"), "row")
    # repeated rows would each be found for the one that stands for them
    again = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), "again")
    if again.isEmpty():
        found = texts.select("key", "text").join(wanted, "key")
    else:
        once = texts.select("key", "text").join(wanted.join(again, "key", "left_anti"), "key")
        often = texts.select("key", "text").join(again, "key", "left_semi").distinct().join(wanted.join(again, "key", "left_semi"), "key")
        found = once.unionByName(often)
    found = scratch.keep(found.select("row", "words_key", "text", "asked"), "candidates")

    def contents(batches):
        for batch in batches:
            out: list = [[] for _ in range(6)]
            for start, end, raw, offsets in chunks(batch.column(2)):
                words = Words(raw, offsets)
                for d, (key, asks) in enumerate(zip(batch.column(1).slice(start, end - start).to_pylist(), batch.column(3).slice(start, end - start).to_pylist())):
                    if not asks or words_key(words, d) != key:
                        continue
                    for a in asks:
                        at = words.first[d] + a["first"]
                        for column, v in zip(out, (a["m"], a["c"], a["weight"], a["parts"], a["shard"], words.phrase(at, at + a["n"] + window - 1))):
                            column.append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["m", "c", "weight", "parts", "shard", "content"])

    sharded = found.mapInArrow(contents, "m bigint, c bigint, weight bigint, parts bigint, shard bigint, content binary")
    judged = sharded.groupBy("shard").applyInPandas(lambda pdf: judge(pdf, window), "m bigint, c bigint, mask bigint, each array<struct<i:int,h:binary,n:bigint>>")
    judged = scratch.keep(judged, "judged")

    each = judged.where(F.size("each") > 0).select("m", "c", F.explode("each").alias("e")).select("m", "c", "e.*")
    often = each.groupBy("m", "h").agg(F.sum("n").alias("times")).where("times > 1")
    across = each.join(often, ["m", "h"]).groupBy("m", "c").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("more"))
    masks = judged.select("m", "c", "mask").join(across, ["m", "c"], "left").select("m", "c", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0).cast("long"))).alias("mask")).where("mask <> 0").unionByName(alone)
    marks = piece.select("row", "m", "c", "first").join(masks, ["m", "c"]).groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))

    def removal(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list = [[], [], [], []]
            for begin, stop, raw, offsets in chunks(batch.column(2)):
                words = Words(raw, offsets)
                for d, (row, key, got) in enumerate(zip(*(batch.column(i).slice(begin, stop - begin).to_pylist() for i in (0, 1, 3)))):
                    if words_key(words, d) != key:
                        continue
                    spans = merged([(x["first"] + i, x["first"] + i + window) for x in got for i in range(x["mask"].bit_length()) if x["mask"] >> i & 1])
                    base, n = int(words.first[d]), int(words.first[d + 1] - words.first[d])
                    edges = [0, *(p for span in spans for p in span), n]
                    kept = b" ".join(words.phrase(base + a, base + b) for a, b in zip(edges[::2], edges[1::2]) if a < b)
                    for column, v in zip(out, (row, [{"start": a, "end": b} for a, b in spans], sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), kind, pa.int64(), pa.string()))], names=["row", "spans", "n_removed", "sha"])

    removed = found.select("row", "words_key", "text").join(marks, "row").mapInArrow(removal, "row bigint, spans array<struct<start:bigint,end:bigint>>, n_removed bigint, sha string")
    # rows with the same id and the same words, but other white space, have other keys; a hash may be shared
    removed = removed.groupBy("row").agg(F.min(F.struct("spans", "n_removed", "sha")).alias("r")).join(classes.select("row", "words_key"), "row").select("words_key", "r.*")
    out = rows.select("id", "n_words", "words_key", "words_sha256").join(removed, "words_key", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "words_sha256").alias("kept_sha256"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text's words outside the spans, joined by one space."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    outside = F.filter(words, lambda w, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    return F.array_join(outside, " ")


by_value(__name__)


def op8_substring_dedup(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY phrase) AS n FROM x),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h WHERE n > 1),
k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
a AS (
  SELECT doc_id, count(r.p) AS n_removed, string_agg(w[k.p], ' ' ORDER BY k.p) FILTER (r.p IS NULL) AS kept
  FROM k LEFT JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
