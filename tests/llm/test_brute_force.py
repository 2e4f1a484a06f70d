"""Language identification, the pipeline and sharding against plain loops over the same rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlab.llm import language_id, mixing, registry, sharding
from tests.llm.test_near_dedup import brute as brute_components

SF = "/root/testdata/sf0.001"
ALL = (1 << 64) - 1


# ---- plain versions ------------------------------------------------------------
def grams(text):
    """Counts of n-grams by their dimension, one n-gram at a time; None without a letter."""
    low = (text or "").lower()
    letter = lambda c: "a" <= c <= "z" or (ord(c) >= 128 and c.isalpha())
    if not any(map(letter, low)):
        return None
    kept = " " + "".join(c if letter(c) else " " for i, c in enumerate(low) if letter(c) or (i and letter(low[i - 1])))
    out = Counter()
    for n in language_id.ORDERS:
        for a in range(len(kept) - n + 1):
            h = ord(kept[a]) + (n << 32)
            for c in kept[a + 1 : a + n]:
                h = (h * 0x100000001B3 + ord(c)) & ALL
            h = ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) & ALL
            out[(h >> 40) % language_id.DIMENSIONS] += 1
    return out


def place(i, text):
    """Where sampling puts a row, by its id and text."""
    h = 42
    for part in ([] if i is None else [str(i)]) + [text, "sample"]:
        h = xxhash.xxh64_intdigest(part.encode(), h)
    signed = h - (1 << 64) if h >> 63 else h
    return signed % 1_000_003, signed


def in_training(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 0


class PlainModel:
    def __init__(self, rows, per_language):
        """rows: (id, text, lang)."""
        found = [(i, t, lang, grams(t)) for i, t, lang in rows if in_training(i) and t is not None and lang is not None]
        frequency = Counter(d for *_, g in found if g for d in g)
        n = sum(1 for *_, g in found if g)
        self.idf = [math.log((1 + n) / (1 + frequency[d])) + 0.1 for d in range(language_id.DIMENSIONS)]
        self.centres, self.least = [], {}
        for lang in sorted({x[2] for x in found}):
            first = sorted((x for x in found if x[2] == lang), key=lambda x: place(x[0], x[1]))[:per_language]
            vectors = [self.vector(x[3]) for x in first if x[3]]
            if not vectors:
                continue
            v = np.array(sorted((np.array(x, np.float32) for x in vectors), key=lambda x: x.tobytes()))
            own = language_id.cluster(v, language_id.CENTROIDS)
            near = [min(1.0, max(float(c @ x) for c in own) / self.reach(x)) for x in v]
            self.least[lang] = 1 - language_id.SLACK * (1 - float(np.quantile(near, language_id.LOW)))
            self.centres += [(lang, c) for c in own]

    def vector(self, g):
        v = np.zeros(language_id.DIMENSIONS)
        for d, n in g.items():
            v[d] = math.log(1 + n) * self.idf[d]
        return v / math.sqrt(float(v @ v))

    @staticmethod
    def reach(v):
        return math.sqrt(min(1.0, int((v != 0).sum()) / language_id.FULL))

    def predict(self, text):
        """Language, score, rejected, and how far the score is from the cut."""
        g = grams(text)
        if g is None or not self.centres:
            return "und", 0.0, True, 1.0
        v = self.vector(g)
        score, at = max((float(c.astype(np.float64) @ v), -i) for i, (_, c) in enumerate(self.centres))
        lang = self.centres[-at][0]
        cut = self.least[lang] * self.reach(v)
        return lang, min(1.0, max(0.0, score)), score < cut, abs(score - cut)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def item_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(w, n):
    return {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}


def plain_copies(rows):
    """How often the mixing stage takes each row of (key, id, text, source): targets, blocks by highest quotients, rows in their seeded order."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(r[2])) for r in rows if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    total, target, open_ = sum(size.values()), {}, set(sources)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * size[s]]
        target |= {s: 3 * size[s] for s in over} if over else share
        open_ -= set(over or open_)
    seats, won = -(-total // mixing.BLOCK_WORDS), dict.fromkeys(sources, 0)
    for _ in range(seats):
        best = max((s for s in sources if target[s] > 0), key=lambda s: (target[s] / (2 * won[s] + 1), -sources.index(s)))
        won[best] += 1
    quota = {s: won[s] * mixing.BLOCK_WORDS for s in sources}
    quota[best] -= seats * mixing.BLOCK_WORDS - total
    copies = Counter()
    for s in sources:
        left = min(quota[s], 3 * size[s])
        rounds, left = divmod(left, size[s]) if size[s] else (0, 0)
        for _, _, n, key in sorted((hashlib.md5(f"{mixing.SEED}:{r[1]}".encode()).hexdigest(), r[1], len(words(r[2])), r[0]) for r in rows if r[3] == s):
            part = min(n, left)
            left -= part
            if n:
                copies[key] += (2 * (rounds * n + part) + n) // (2 * n)
    return +copies


# ---- tables ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The documents and some more: copies, edited copies, benchmark passages, gibberish, texts without letters, null and empty ones."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").orderBy("item_id").collect()]
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    long = [r for r in rows if len(words(r["text"])) > 80]
    more = []

    def add(like, text):
        more.append({**like, "doc_id": 1_000_000 + len(more), "text": text})

    for r in long[:12]:
        w = words(r["text"])
        add(r, r["text"])
        w[rng.randrange(len(w))] = "changed"
        add(r, " ".join(w).upper())
        w[3], w[40] = "again", "anew"
        add(r, "\n".join(w))
    for r, item in zip(long[12:18], items):
        w = words(r["text"])
        add(r, " ".join(w[:30] + words(item) + w[30:]))
    for n in (30, 300):
        add(long[0], " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(n)))
    for text in (None, "", " \n", "12 34 !?"):
        add(long[0], text)
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows + more], docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows + more, items


# ---- tests -----------------------------------------------------------------------
@pytest.mark.parametrize("per_language", [7, language_id.PER_LANGUAGE])
def test_language_equals_plain_loops(spark, planted, per_language):
    folder, rows, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()), per_language=per_language)
    want = PlainModel([(r["doc_id"], r["text"], r["lang"]) for r in rows], per_language)
    assert np.allclose(model.idf, want.idf)
    assert model.languages == [lang for lang, _ in want.centres] and np.allclose(model.centres, [c for _, c in want.centres], atol=1e-4)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score, rejected, margin = want.predict(r["text"])
        g = got[r["doc_id"]]
        assert g.lang_pred == lang and abs(g.score - score) < 1e-4 and (g.rejected == rejected or margin < 1e-4), (g, lang, score)


def test_language_query_equals_plain_loops(spark, planted):
    folder, rows, _ = planted
    want = PlainModel([(r["doc_id"], r["text"], r["lang"]) for r in rows], language_id.PER_LANGUAGE)
    got = registry.QUERIES["op9_language_id"](spark, folder).collect()
    assert sorted((g.doc_id, g.held_out) for g in got) == sorted((r["doc_id"], not in_training(r["doc_id"])) for r in rows)
    text = {r["doc_id"]: r["text"] for r in rows}
    assert [g.doc_id for g in got if g.lang_pred != want.predict(text[g.doc_id])[0]] == []


def test_pipeline_equals_plain_loops(spark, planted):
    folder, rows, items = planted
    model = PlainModel([(r["doc_id"], r["text"], r["lang"]) for r in rows], language_id.PER_LANGUAGE)
    identified = [r for r in rows if not model.predict(r["text"])[2]]
    of = brute_components([(r["doc_id"], r["text"]) for r in identified], k=5)
    single = [r for r in identified if of[r["doc_id"]] == r["doc_id"]]
    parts = {w for t in items if item_words(t) for w in windows(item_words(t), min(10, len(item_words(t))))}
    sizes = {len(p) for p in parts}
    clean = [r for r in single if not any(windows(item_words(r["text"]), n) & parts for n in sizes)]
    copies = plain_copies([(r["doc_id"], r["doc_id"], r["text"], r["source"]) for r in clean])
    assert len(rows) > len(identified) > len(single) > len(clean) > 0 and max(copies.values()) > 1

    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == copies
    assert Counter(r.shard for r in out) == {r.shard: r.shard_rows for r in out}


def test_sharding_query_places_every_row(spark, planted):
    folder, rows, _ = planted
    out = registry.QUERIES["op3_sharding"](spark, folder)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r["doc_id"] for r in rows)
    assert Counter(r.shard for r in got) == {r.shard: r.shard_rows for r in got}
    shards = [{"name": n, "bytes": b} for n, b in {(r.shard, r.shard_bytes) for r in got}]
    assert sharding.plan_merges(shards, sharding.TARGET_BYTES) == [] and out.where(F.col("version") < 3).count() == 0
