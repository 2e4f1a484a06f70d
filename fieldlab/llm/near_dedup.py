"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Texts are lower-cased in A-Z and cut into words; a document's set holds its
distinct shingles of `k` words, or the whole sequence if it has fewer. Two
documents are linked if their sets' Jaccard similarity is `threshold` percent
or more; groups are the connected components.

1. Every document is scanned once. Documents with equal sets become one class.
2. SuperMinHash: every shingle visits the slots of the signature in its own
   random order, with values that grow with the rank; ranks are taken one at a
   time and a document stops as soon as no slot can change any more.
3. Bands of the signature put classes into buckets. A shingle that no other
   class in a bucket has can't be in any intersection; sets that this leaves
   too small for any link leave their buckets, and pairs of sets that it leaves
   too small are not formed.
4. In each bucket every class is paired with the hub only, so pairs grow with
   the bucket and not with its square. Pairs that pass a bit sketch are
   verified on full sets, links form components, and buckets that hold more
   than one component go round again until all their pairs are settled (see
   buckets.py). No group is ever expanded into its pairs.

With 32 bands of 4 slots, which are chosen for that threshold, a pair at exactly 80 % meets in no bucket with
probability 5e-8.

Null or wordless texts have an empty set, are linked with nothing and are
kept. Rows that share an id are one document. A row with a null id is kept,
with a null component. Repeated rows each give a row; an empty table gives
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.buckets import HUBS, SMALL_BUCKET, link_components, shared_buckets
from fieldlab.llm.common import LOWER, UPPER, WORD, Scratch, by_value, table
from fieldlab.llm.words import LOWERED, Words, chunks, mixed, windows

THRESHOLD = 80
#: Slots of a signature, and the most of pairs at the threshold that may meet in no band, where slots a band are chosen.
SIGNATURE = 128
MISSED = 1e-6
#: The cut on sketches lies so many deviations below what a pair at the threshold shares.
DEVIATIONS = 5.85
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)
S32 = np.uint64(32)


def shingles(words: Words, doc: int, all_windows: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a document; all_windows: of k words, of all documents."""
    of = words.of(doc)
    n = min(k, of.stop - of.start)
    if not n:
        return np.empty(0, dtype=np.uint64)
    return np.unique(all_windows[of.start : of.stop - k + 1] if n == k else mixed(windows(words.ids[of], n) + np.uint64(n)))


def shingle_sets(texts: pa.Array, k: int):
    """(first row, sets) of consecutive rows, some at a time."""
    for start, end, raw, offsets in chunks(texts):
        words = Words(raw, offsets, LOWERED)
        every = windows(words.ids, k)
        yield start, [shingles(words, d, every, k) for d in range(end - start)]


def superminhash(flat: np.ndarray, owner: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) signatures of the sets whose elements are `flat`, owned by documents `owner`; no set is empty.

    A slot's value is rank * 2**32 + random; at rank j an element draws a slot
    among those it hasn't visited, by a Fisher-Yates step on its own
    permutation. Ranks run for all elements at once; once all slots of a
    document hold values of rank j or less, later ranks can't lower any.
    """
    sig = np.full((n_docs, m), np.iinfo(np.uint64).max, dtype=np.uint64)
    out = sig.reshape(-1)
    perm = None
    for j in range(m):
        x = mixed(flat + np.uint64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x >> S32) * np.uint64(m - j)) >> S32).astype(np.int64)
        value = (x & LOW) | np.uint64(j << 32)
        if j == 0:
            slot = k
        else:
            at = np.arange(len(flat))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(out, owner * m + slot, value)
        full = sig.max(axis=1) < np.uint64((j + 1) << 32)
        going = ~full[owner]
        if not going.any():
            return sig
        flat, owner = flat[going], owner[going]
        if j == 0:
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(flat), 1))
            at, first = np.arange(len(flat)), k[going]
            perm[at, first] = 0
            perm[:, 0] = first
        else:
            perm = perm[going]
    return sig


def band_hashes(sig: np.ndarray, bands: int, slots: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, slots)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * GOLDEN
    for s in range(slots):
        h = mixed(h + parts[:, :, s])
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of every slot, 32 slots to a long."""
    bits = (mixed(sig) & np.uint64(3)).reshape(len(sig), -1, 32)
    shifts = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return np.bitwise_or.reduce(bits << shifts, axis=2).view(np.int64)


def layout(threshold: int) -> tuple[int, int]:
    """(bands, slots): the longest bands with which pairs at the threshold are missed with probability MISSED at most, else single slots."""
    for slots in (8, 4, 2):
        if (1 - (threshold / 100) ** slots) ** (SIGNATURE // slots) <= MISSED:
            return SIGNATURE // slots, slots
    return SIGNATURE, 1


def sketch_cut(threshold: int, n: int) -> int:
    """Of n slots, the two low bits that sets at the threshold share at least: equal slots, and a quarter of the others by chance."""
    p = threshold / 100 + (1 - threshold / 100) / 4
    return max(0, int(n * p - DEVIATIONS * (n * p * (1 - p)) ** 0.5))


def sketch_overlap(a: Column, b: Column, longs: int) -> Column:
    """Slots whose two bits agree."""
    total = F.lit(0)
    for i in range(longs):
        x = a[i].bitwiseXOR(b[i])
        odd = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total + (F.lit(32) - F.bit_count(odd))
    return total


def signatures(docs: DataFrame, k: int, bands: int, slots: int) -> DataFrame:
    """(id, text) to (id, n_shingles, set_key, bands, sketch); the last three are null for empty sets."""

    def work(batches):
        m = bands * slots
        for batch in batches:
            for first, some in shingle_sets(batch.column(1), k):
                at = 0
                while at < len(some):
                    start, total = at, 0
                    while at < len(some) and total < 60_000:
                        total += len(some[at])
                        at += 1
                    yield signed(batch.column(0).slice(first + start, at - start), some[start:at], m)

    def signed(names, sets, m):
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        hashed: list = [None] * len(sets)
        bits: list = [None] * len(sets)
        if full:
            owner = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
            sig = superminhash(np.concatenate([sets[i] for i in full]), owner, len(full), m)
            b, s = band_hashes(sig, bands, slots), sketch(sig)
            for j, i in enumerate(full):
                keys[i], hashed[i], bits[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), b[j], s[j]
        columns = [names, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(hashed, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, text) to (node, elements): the sorted shingle hashes as bytes."""

    def work(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "elements"])

    return docs.mapInArrow(work, f"node {docs.schema['id'].dataType.simpleString()}, elements binary")


def outside(pairs: DataFrame, threshold: int) -> DataFrame:
    """(node, hub, fact, elements, inside) to (band, node, fact): bands of elements outside the hub's set, and one per hub with the part inside it as bound.

    A set of n elements has d = (100 - threshold) % of n at most that a linked
    one lacks. The least element that two linked sets share outside the hub is
    among the first d + 1 of either; if they share none, both have d at most.
    """
    kind = pairs.schema["node"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for node, hub, fact, x, y in zip(*batch.columns):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                out = x[y[at] != x]
                salt = np.uint64(xxhash.xxh3_64_intdigest(str(hub.as_py()).encode()))
                n, common, lacks = fact["n"].as_py(), fact["common"].as_py(), (100 - threshold) * len(x) // 100
                bands = mixed(out[: lacks + 1] ^ salt)
                bound = np.full(len(bands), common, dtype=np.int64)
                if len(out) <= lacks:
                    bands, bound = np.append(bands, salt), np.append(bound, min(common, len(x) - len(out)))
                bands = bands.view(np.int64)
                facts = pa.StructArray.from_arrays([pa.array(np.full(len(bands), n, dtype=np.int64)), pa.array(bound)], names=["n", "common"])
                yield pa.RecordBatch.from_arrays([pa.array(bands), pa.repeat(node, len(bands)), facts], names=["band", "node", "fact"])

    return pairs.mapInArrow(work, f"band bigint, node {kind}, fact struct<n:bigint,common:bigint>")


def elements(sets: DataFrame) -> DataFrame:
    """(node, elements) to one row (node, h) per element."""

    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                h = [np.frombuffer(raw.as_buffer(), dtype=np.int64) for raw in part.column(1)]
                owner = pa.array(np.repeat(np.arange(len(h)), [len(x) for x in h]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), pa.array(np.concatenate(h))], names=["node", "h"])

    return sets.mapInArrow(work, f"node {sets.schema['node'].dataType.simpleString()}, h bigint")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; set a travels to set b."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")

    def work(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return with_b.mapInArrow(work, with_b.select("a", "b").schema)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = THRESHOLD,
    bands: int | None = None, slots: int | None = None, sketch_least: int | None = None, small_bucket: int = SMALL_BUCKET, hubs: int = HUBS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept.

    bands, slots and sketch_least follow from the threshold where they are not
    given; bands * slots is a multiple of 32.
    """
    if bands is None or slots is None:
        of = layout(threshold)
        bands, slots = (of if bands is slots is None else (bands, SIGNATURE // bands) if bands else (SIGNATURE // slots, slots))
    if bands * slots % 32:
        raise ValueError("bands * slots is a multiple of 32")
    sketch_least = sketch_cut(threshold, bands * slots) if sketch_least is None else sketch_least
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = scratch.keep(signatures(texts, k, bands, slots), "signatures")

    usable = rows.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    first = usable.groupBy("set_key").agg(F.min(F.struct("id", "n_shingles", "bands", "sketch")).alias("c"))
    classes = scratch.keep(first.select("set_key", F.col("c.id").alias("node"), F.col("c.n_shingles").alias("n"), "c.bands", "c.sketch"), "classes")
    longs = bands * slots // 32

    member = shared_buckets(classes.select(F.explode("bands").alias("band"), "node", F.col("n").alias("fact")), scratch)
    # rows that repeat an id would each bring its set; where there are some, one of each different set stays
    nodes = member.select(F.col("node").alias("id")).distinct()
    again = scratch.keep(usable.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "again")
    single = again.isEmpty()
    if single:
        sets = full_sets(texts.join(nodes, "id", "left_semi"), k)
    else:
        once, often = nodes.join(again, "id", "left_anti"), nodes.join(again, "id", "left_semi")
        sets = full_sets(texts.join(once, "id", "left_semi"), k).unionByName(full_sets(texts.join(often, "id", "left_semi"), k).distinct())
    sets = scratch.keep(sets, "sets")
    # of each set, the shingles that others have: what an intersection can hold at most
    alone = elements(sets).groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).where("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    facts = member.select("node", F.col("fact").alias("n")).distinct().join(alone, "node", "left").select("node", F.struct("n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common")).alias("fact"))
    able = facts.where(F.col("fact.common") * 100 >= F.col("fact.n") * threshold)
    member = shared_buckets(member.drop("fact").join(scratch.keep(able, "facts"), "node"), scratch)
    bits = classes.select("node", "sketch")

    def compatible(x: Column, y: Column) -> Column:
        return F.least(x["common"], y["common"]) * (100 + threshold) >= (x["n"] + y["n"]) * threshold

    def enough(x: Column, least: Column) -> Column:
        return x["common"] * (100 + threshold) >= (x["n"] + least) * threshold

    def links(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bits.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(bits.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        good = verified(both.where(sketch_overlap(F.col("sa"), F.col("sb"), longs) >= sketch_least).select("a", "b"), sets, threshold)
        return good if single else good.distinct()  # an id of several texts has several sets

    def beside_hub(crowded: DataFrame, level: int) -> DataFrame:
        """Buckets of what members have besides their bucket's hub.

        Two members that share nothing outside the hub's set share at most the
        smaller of their parts inside it. So they meet by a shingle outside
        it, or in one bucket where those parts bound what they can share.
        """
        rank = F.struct(first_hub(F.col("fact")).alias("first"), F.xxhash64("node", F.lit(level - 1)).alias("p"), "node")
        hub = crowded.groupBy("band").agg(F.min(rank)["node"].alias("hub"))
        pairs = crowded.join(hub, "band").select("node", "hub", "fact").distinct()
        both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("elements").alias("inside")), "hub")
        return outside(both.select("node", "hub", "fact", "elements", "inside"), threshold)

    def first_hub(fact: Column) -> Column:
        return 1 - fact["common"] / fact["n"]

    # hubs are the sets with the smallest part that no other has: originals rather than their edited copies
    found = link_components(member, compatible, links, scratch, priority=first_hub, refine=beside_hub, possible=(lambda f: f["n"], enough), small_bucket=small_bucket, hubs=hubs)

    named = rows.join(classes.select("set_key", "node"), "set_key", "left").join(found, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return named.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that stand for their group."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("kept")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


by_value(__name__)


def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(4, len(w)) AS n FROM w WHERE len(w) > 0))),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * common >= 80 * (ca.n + cb.n - common)),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x),
m AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN c USING (doc_id)
"""
