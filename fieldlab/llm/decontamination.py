"""Benchmark decontamination by a broadcast hash set of normalised word windows.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. A
window is `n` consecutive words of an item; an item of fewer words is one
window. Every document is scanned once: its window hashes are looked up in the
broadcast set and every hit is verified word by word.

The benchmark is broadcast only if its windows number at most
`max_broadcast_windows` and take MAX_BROADCAST_BYTES, which is looked at first.
Beyond that windows are joined by a shuffle, with the same result: of the documents' windows only those
whose hash is in a bitmap of fixed size are shuffled.

Null text has no words; an item without words has no windows. Repeated rows
each give a row; items with the same id count as one item, an item with a null
id is named by an empty string. Empty tables work on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import LOWER, UPPER, Scratch, by_value, table, with_row_key
from fieldlab.llm.words import Words, chunks, windows, words_in

N = 10
MAX_BROADCAST_WINDOWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
#: Bits of the bitmap of window hashes, and of each row it is gathered in (Spark's bitmap functions).
BITMAP_BITS = 1 << 28
BITMAP_ROW_BITS = 1 << 15
#: To a single byte each: lower case for A-Z, itself for 0-9, a-z and bytes of non-ASCII characters, else a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TABLE = np.frombuffer(NORMAL, dtype=np.uint8)
FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def merged(starts_ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts_ends):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, phrase, item): the windows of every item, words joined by one space."""

    def work(batches):
        for batch in batches:
            rows = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                size = min(n, len(w))
                rows.update((size, b" ".join(w[i : i + size]), item or "") for i in range(len(w) - size + 1) if size)
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["size", "phrase", "item"])

    return benchmark.select(F.col(id_col).cast("string"), text_col).mapInArrow(work, "size int, phrase binary, item string").distinct()


def phrase_hashes(phrases: list[bytes], size: int) -> np.ndarray:
    """The window hashes of phrases of that many words."""
    return windows(words_in([p + b" " for p in phrases], TABLE).ids, size)[::size]


class Matcher:
    """Looks up documents' windows in a set of phrases."""

    def __init__(self, phrases: dict[int, dict[bytes, tuple[str, ...]]]):
        self.sets = {}
        for size, of in phrases.items():
            keys: dict[int, list] = {}
            for h, (phrase, items) in zip(phrase_hashes(list(of), size).tolist(), of.items()):
                keys.setdefault(h, []).append((phrase, items))
            bits = max(16, int(len(keys) * 16).bit_length())
            mask = np.uint64((1 << bits) - 1)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[np.array(list(keys), dtype=np.uint64) & mask] = True
            self.sets[size] = (seen, mask, keys)

    def find(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text the number of words, the spans of hit words and the items."""
        out = []
        for start, end, raw, offsets in chunks(texts):
            words = Words(raw, offsets, TABLE)
            spans: list[list] = [[] for _ in range(start, end)]
            items: list[set] = [set() for _ in range(start, end)]
            for size, (seen, mask, keys) in self.sets.items():
                h = windows(words.ids, size)
                near = np.flatnonzero(seen[h & mask])
                docs = np.searchsorted(words.first, near, side="right") - 1
                whole = near + size <= words.first[docs + 1]
                for i, d in zip(near[whole].tolist(), docs[whole].tolist()):
                    for phrase, of in keys.get(int(h[i]), ()):
                        if phrase == words.phrase(i, i + size):
                            a = i - int(words.first[d])
                            spans[d].append((a, a + size))
                            items[d].update(of)
            out += [(int(n), merged(a), sorted(b)) for n, a, b in zip(np.diff(words.first), spans, items)]
        return out


def _broadcast_phrases(benchmark: DataFrame, n: int, most: int, id_col: str, text_col: str):
    """The phrases as a broadcast variable, or None and their table if they are more than `most` or longer than MAX_BROADCAST_BYTES."""
    found = item_windows(benchmark, n, id_col, text_col)
    count, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("item")), F.lit(0))).first()
    if count > most or size > MAX_BROADCAST_BYTES:
        return None, found
    rows = found.collect()
    phrases: dict[int, dict[bytes, tuple[str, ...]]] = {}
    for size, phrase, item in rows:
        of = phrases.setdefault(size, {})
        of[bytes(phrase)] = of.get(bytes(phrase), ()) + (item,)
    return benchmark.sparkSession.sparkContext.broadcast(phrases), found


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", max_broadcast_windows: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: id, n_words, spans of hit words (start, end exclusive) and the sorted items with occurring windows."""
    shared, found = _broadcast_phrases(benchmark, n, max_broadcast_windows, item_col, item_text_col)
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    if shared is None:
        return _by_join(rows.toDF("id", "text"), found, kind, id_col)

    def work(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            got = matcher.find(batch.column(1))
            spans = pa.array([[{"start": a, "end": b} for a, b in g[1]] for g in got], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), spans, pa.array([g[2] for g in got], pa.list_(pa.string()))], names=[id_col, "n_words", "spans", "items"])

    return rows.mapInArrow(work, f"`{id_col}` {kind}, {FOUND}")


def _windows_in(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """(row, start, size, phrase): the windows of (row, text) that may be among the phrases, all that are included."""
    sizes = [r[0] for r in phrases.select("size").distinct().collect()]  # at most n values
    mask = np.uint64(BITMAP_BITS - 1)

    def places(batches):
        for batch in batches:
            of: dict[int, list[bytes]] = {}
            for size, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.setdefault(size, []).append(phrase)
            for size, some in of.items():
                yield pa.RecordBatch.from_arrays([pa.array((phrase_hashes(some, size) & mask).astype(np.int64))], names=["at"])

    at = phrases.select("size", "phrase").mapInArrow(places, "at bigint")
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = np.zeros((BITMAP_BITS // BITMAP_ROW_BITS + 1, BITMAP_ROW_BITS // 8), dtype=np.uint8)
    for part, bits in parts.collect():  # BITMAP_BITS / 8 bytes at most
        bitmap[part] = np.frombuffer(bits, dtype=np.uint8)
    # position p is bit (p - 1) % BITMAP_ROW_BITS of row (p - 1) // BITMAP_ROW_BITS + 1, and position 0 the first bit of row 0
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches):
        bits = shared.value.reshape(-1)
        for batch in batches:
            for first_row, end_row, raw, offsets in chunks(batch.column(1)):
                words, names = Words(raw, offsets, TABLE), batch.column(0).slice(first_row, end_row - first_row)
                for size in sizes:
                    p = (windows(words.ids, size) & mask).astype(np.int64)
                    q = np.where(p > 0, p - 1 + BITMAP_ROW_BITS, 0)
                    near = np.flatnonzero((bits[q >> 3] >> (q & 7).astype(np.uint8)) & 1)
                    docs = np.searchsorted(words.first, near, side="right") - 1
                    whole = near + size <= words.first[docs + 1]
                    near, docs = near[whole], docs[whole]
                    for a in range(0, len(near), 10_000):
                        i, d = near[a : a + 10_000], docs[a : a + 10_000]
                        phrases = pa.array([words.phrase(x, x + size) for x in i.tolist()], pa.binary())
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(d)), pa.array(i - words.first[d], pa.int64()), pa.array(np.full(len(i), size), pa.int32()), phrases], names=["row", "start", "size", "phrase"])

    return rows.mapInArrow(work, "row bigint, start bigint, size int, phrase binary")


def _by_join(rows: DataFrame, phrases: DataFrame, kind: str, id_col: str) -> DataFrame:
    """The same for a benchmark too large to broadcast: windows meet phrases in a shuffled join."""
    def counts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(words_of(t)) for t in batch.column(2).to_pylist()], pa.int64())], names=["row", "id", "n_words"])

    numbered = Scratch(rows.sparkSession, "decontamination").keep(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "rows")
    hits = _windows_in(numbered.select("row", "text"), phrases).join(phrases, ["size", "phrase"])
    hits = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("each"), F.sort_array(F.collect_set("item")).alias("items"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    joined = F.aggregate(
        "each", none,
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    every = numbered.mapInArrow(counts, f"row bigint, id {kind}, n_words bigint").join(hits.select("row", joined.alias("spans"), "items"), "row", "left")
    return every.select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = N, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", remove: str = "documents", max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The documents with all their columns: without contaminated ones (remove="documents"), or with the hit words cut out of the text (remove="spans").

    For a benchmark beyond max_broadcast_windows the documents are kept in the
    shared folder with a generated key, and the hits are joined by it.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    shared, found = _broadcast_phrases(benchmark, n, max_broadcast_windows, item_col, item_text_col)
    if shared is None:
        return _decontaminate_by_join(docs, found, text_col, remove)
    at = docs.columns.index(text_col)

    def work(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            got = [found[1] for found in matcher.find(batch.column(at))]
            if remove == "documents":
                yield batch.filter(pa.array([not spans for spans in got], pa.bool_()))
            else:
                clean = pa.array([cut_words(t, spans) for t, spans in zip(batch.column(at).to_pylist(), got)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], clean, *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def _decontaminate_by_join(docs: DataFrame, phrases: DataFrame, text_col: str, remove: str) -> DataFrame:
    keyed, key = with_row_key(docs)
    scratch = Scratch(docs.sparkSession, "decontamination")
    keyed = scratch.keep(keyed, "rows")
    phrases = scratch.keep(phrases.select("size", "phrase").distinct(), "phrases")
    hits = _windows_in(keyed.select(F.col(key).alias("row"), F.col(text_col).alias("text")), phrases).join(phrases, ["size", "phrase"], "left_semi")
    if remove == "documents":
        return keyed.join(hits.select(F.col("row").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
    spans = hits.groupBy(F.col("row").alias(key)).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias(f"{key}_spans"))
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            got = [merged([(x["start"], x["end"]) for x in spans or ()]) for spans in batch.column(batch.num_columns - 1).to_pylist()]
            clean = pa.array([cut_words(t, spans) for t, spans in zip(texts, got)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], clean, *batch.columns[at + 1 : -1]], names=batch.schema.names[:-1])

    return keyed.join(spans, key, "left").select(*docs.columns, f"{key}_spans").mapInArrow(work, docs.schema)


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    import re

    if not spans:
        return text
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


by_value(__name__)


def op4_decontamination(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, phrase)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
