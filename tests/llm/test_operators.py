import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.llm import decontamination as dc
from fieldlab.llm import exact_dedup, language_id, line_dedup, mixing, registry, secrets, sharding, substring_dedup
from tests.oracle import compare

DOC = "doc_id long, text string, n_words string"  # an extra column with a result's name


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame([(*r, "x") for r in rows], schema)


# ---- decontamination ---------------------------------------------------------
def brute_hits(doc, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    w = word.findall(low(doc))
    hit, found = set(), set()
    for i, t in items:
        v = word.findall(low(t))
        size = min(n, len(v))
        for a in range(len(v) - size + 1 if size else 0):
            for b in range(len(w) - size + 1):
                if w[b : b + size] == v[a : a + size]:
                    hit |= set(range(b, b + size))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_decontamination(spark, most):
    rng = random.Random(2)
    words = [rng.choice("abcdé") * rng.randint(1, 2) for _ in range(400)]
    items = [(1, " ".join(words[:25])), (2, "Two Words!"), (10, None), (11, ""), (3, " ".join(words[30:41])), (3, "solo")]
    docs = [(i, "-".join(words[a : a + 60]).upper() if i % 2 else ", ".join(words[a : a + 60])) for i, a in enumerate(range(0, 340, 20))]
    docs += [(100, None), (101, ""), (102, "one two words solo"), (102, "one two words solo"), (103, "solo " * 3000)]
    got = dc.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), max_broadcast_windows=most).collect()
    assert len(got) == len(docs)
    want = {d: brute_hits(t, items) for d, t in docs}
    for r in got:
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r.items) == want[r.doc_id]


def test_decontaminated_documents(spark):
    bench = spark.createDataFrame([(1, "bad phrase here")], "item_id long, text string")
    docs = frame(spark, [(1, "ok text"), (2, "a Bad, phrase  here! b"), (3, None)])
    assert sorted(r.doc_id for r in dc.decontaminate(docs, bench).collect()) == [1, 3]
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: "ok text", 2: "a ! b", 3: None}
    assert dc.decontaminate(docs, bench.limit(0)).count() == 3 and dc.find_contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminated_by_join(spark, remove, monkeypatch):
    rng = random.Random(4)
    words = [rng.choice("abcdé") * rng.randint(1, 2) for _ in range(300)]
    bench = spark.createDataFrame([(1, " ".join(words[:25])), (2, "Two Words!"), (3, "solo"), (None, " ".join(words[30:45]))], "item_id long, text string")
    texts = [", ".join(words[a : a + 40]) for a in range(0, 260, 10)] + [None, "", "one two words, solo.", "solo " * 3000, "nothing"]
    rows = [(rng.choice([None, 1, i]), t, "k", f"{i}") for i, t in enumerate(texts)] + [(1, "two words", "k", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, row string")
    want = sorted(map(str, dc.decontaminate(docs, bench, remove=remove).collect()))
    clean = [t for _, t, _, _ in rows if not brute_hits(t, [(1, " ".join(words[:25])), (2, "Two Words!"), (3, "solo"), (4, " ".join(words[30:45]))])[1]]
    assert len(want) == (len(clean) if remove == "documents" else len(rows)) and 0 < len(clean) < len(rows)
    got = dc.decontaminate(docs, bench, remove=remove, max_broadcast_windows=3)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == want
    monkeypatch.setattr(dc, "BITMAP_BITS", 1 << 15)  # full of chance hits, and one row
    assert sorted(map(str, dc.decontaminate(docs, bench, remove=remove, max_broadcast_windows=3).collect())) == want
    assert dc.decontaminate(docs.limit(0), bench, remove=remove, max_broadcast_windows=3).count() == 0


# ---- secrets -----------------------------------------------------------------
def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    random_key = "x9Kq2Lw8Zr5Vt1Yp7Bn4Mc6Qd3"
    text = f"é password = 'abcdefghijkl' {key} deadbeefdeadbeef00 ToKeN:short token:{'z' * 12} {random_key} "
    digest = hashlib.sha256(b"x").hexdigest()
    docs = [(1, text), (2, None), (3, ""), (4, digest.upper() + " 123e4567-e89b-12d3-a456-426614174000 some_long_identifier_name_here"), (5, "word " * 50_000)]
    got = {r.doc_id: [(s.kind, text[s.start : s.end] if r.doc_id == 1 else s) for s in r.spans] for r in secrets.secret_spans(frame(spark, docs)).collect()}
    assert got[1] == [("assign", "password = 'abcdefghijkl"), ("access", key), ("hex", "deadbeefdeadbeef00"), ("assign", "token:" + "z" * 12), ("random", random_key)]
    assert got[2] == got[3] == got[4] == got[5] == []
    # the fixed patterns, one by one
    for t in (text, "apikey=" + "a" * 12 + " api_key: 'b.c-d_e=f/g+h' passwd:tooshort", "secret==" + "=" * 12):
        want = []
        for kind, pattern, good in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)):
            flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
            want += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t, flags) if good(m)]
        order = ("assign", "access", "hex").index
        assert [(a, k, b) for k, a, b in secrets.base_spans(t)] == sorted(want, key=lambda s: (s[0], order(s[1])))


def test_random_keys_of_letters_and_groups(spark):
    rng = random.Random(6)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    keys = [draw(chars, n) for n in (24, 32, 40) for chars in (low, low.upper(), low + low.upper()) for _ in range(5)]
    keys += ["ABCDE-48213-QWZPK-99172", "48213-99172-10293-48817"] + ["-".join(draw(rng.choice((low.upper(), digit)), 5) for _ in range(3)) + "-" + draw(low.upper(), 5) for _ in range(10)]
    fine = ["some_long_identifier_name_here", "configurationManagerFactory", "MAX_BROADCAST_WINDOWS", "MIN_CHARS_PER_TOKEN_RATIO", "ERR_INVALID_ARG_TYPE_OF_X", "src/main/java/org/apache", "IllegalArgumentException", "anticonstitutionnellement", "Rechtsschutzversicherungsgesellschaften", "UNCHARACTERISTICALLY", "2024-01-01/2024-02-01", "20240101-123000-20240102", "12345678901234567890123", "-" * 40, "a" * 1_000_000]
    found = secrets.secret_spans(frame(spark, [(i, f"see {t} there") for i, t in enumerate(keys + fine)])).collect()
    missed = [keys[r.doc_id] for r in found if r.doc_id < len(keys) and [tuple(s) for s in r.spans] != [("random", 4, 4 + len(keys[r.doc_id]))]]
    assert missed == []
    assert [fine[r.doc_id - len(keys)][:60] for r in found if r.doc_id >= len(keys) and any(s.kind == "random" for s in r.spans)] == []


# ---- language ------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.count() > 100 and held.where("lang = lang_pred").count() / held.count() > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0 and got.where("rejected").count() / got.count() < 0.02


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("12 34 !", "de"), ("and the", None), ("the the", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "und", "und", "en", "en"]
    assert got[2].score == 0.0 and got[2].rejected and got[3].rejected
    assert language_id.keep_identified(df, model).count() == 4
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


def test_language_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    rng = random.Random(5)
    gibberish = lambda chars, n: " ".join("".join(rng.choice(chars) for _ in range(rng.randint(2, 9))) for _ in range(n))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    foreign = [
        finnish, finnish * 20, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由在尊严和权利上一律平等",
    ]
    foreign += [gibberish(chars, n) for chars in ("bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz") for n in (5, 20, 400, 3000)]
    assert [t[:40] for t in foreign if not model.predict(t)[2]] == []
    texts = [r.text for r in docs.where(language_id.held_out() & F.col("text").isNotNull()).collect()]
    short = [" ".join(t.split()[:n]) for t in texts if len(t.split()) > 20 for n in (5, 8, 12)]
    assert len(short) > 200 and sum(model.predict(t)[2] for t in short) < 0.05 * len(short)


def test_equal_vectors_make_one_centroid():
    v = np.tile(language_id.unit(np.arange(8), np.ones(8)), (5, 1))
    assert np.isfinite(language_id.cluster(v, 4)).all() and len(language_id.cluster(v, 4)) == 1


# ---- line dedup ------------------------------------------------------------------
def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, s, edits):
    s = list(s)
    for _ in range(edits if s else 0):
        if not s:
            break
        at, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.34:
            del s[at]
        elif kind < 0.67:
            s.insert(at, rng.choice("abcé "))
        else:
            s[at] = rng.choice("abcé ")
    return "".join(s)


def test_edit_distance(spark):
    rng = random.Random(1)
    pairs = [((x := "".join(rng.choice("abé ") for _ in range(rng.choice([1, 2, 5, 20, 60])))), mutated(rng, x * 1 + "a", rng.randint(0, 4))) for _ in range(600)] + [("", ""), ("", "ab"), ("abc", "")]
    df = spark.createDataFrame(pairs, "x string, y string")
    for edits in (1, 2, 3):
        for r in df.select("x", "y", line_dedup.edit_distance(F.col("x"), F.col("y"), edits).alias("d")).collect():
            d = edit(r.x, r.y)
            assert r.d == d if d <= edits else r.d > edits


@pytest.mark.parametrize("crowd", [64, 1])
def test_lines_equal_brute_force(spark, crowd):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 45))) for _ in range(6)]
    docs = []
    for i in range(30):
        lines = [mutated(rng, rng.choice(base), rng.choice([0, 1, 2, 3, 5])) if rng.random() < 0.7 else rng.choice(["", " ", "short", "shorT", "other line " * 3 + str(rng.randrange(40))]) for _ in range(6)]
        docs.append((i, "\n".join(lines)))
    docs += [(50, None), (51, ""), (52, "\n\n")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, docs), crowd=crowd).collect()}
    place = [(d, p, line) for d, t in docs if t is not None for p, line in enumerate(t.split("\n"))]
    kinds = sorted({line for _, _, line in place if line.strip(" \t\r\v\f")})
    group = {k: k for k in kinds}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in kinds:
        for b in kinds:
            if a < b and min(len(a), len(b)) >= 20 and edit(a, b) <= 2:
                group[root(a)] = root(b)
    first = {}
    for d, p, line in place:
        if line in group:
            first.setdefault(root(line), (d, p))
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        gone = [p for p, line in enumerate(lines) if line in group and first[root(line)] != (d, p)]
        assert (got[d].n_lines, got[d].removed) == (len(lines), gone)
        kept = ",".join(hashlib.md5(x.encode()).hexdigest() for p, x in enumerate(lines) if p not in gone)
        assert got[d].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    joined = frame(spark, docs).select("doc_id", "text").join(line_dedup.line_dedup(frame(spark, docs)), "doc_id")
    text = joined.where("doc_id = 0").select(line_dedup.without_lines(F.col("text"), F.col("removed")).alias("t")).first().t
    assert text == "\n".join(x for p, x in enumerate(docs[0][1].split("\n")) if p not in got[0].removed)
    assert line_dedup.line_dedup(frame(spark, docs).limit(0)).count() == 0


def test_very_long_lines(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefghij é") for _ in range(100_000))
    lines = [long, long[:50] + "X" + long[50:], long[:-7] + long[-5:], long[:10] + "xyz" + long[13:], long[1:] + "q", long[3:] + "abc"]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(frame(spark, list(enumerate(lines)))).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0}


# ---- exact dedup -------------------------------------------------------------------
def test_exact_dedup(spark):
    long = "Some words, again and again. " * 2000
    docs = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, long), (8, long.upper()), (9, long + "x"), (9, long + "x"), (10, "z" * 30_000), (11, "z" * 30_000)]
    got = exact_dedup.exact_dedup(frame(spark, docs)).collect()
    assert sum(r.kept for r in got) == 7 and len(got) == 12
    keep = {r.doc_id: (r.keep_id, r.group_size) for r in got}
    assert keep == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (6, 2), 6: (6, 2), 7: (8, 2), 8: (8, 2), 9: (9, 2), 10: (11, 2), 11: (11, 2)}
    assert exact_dedup.exact_dedup(frame(spark, docs).limit(0)).count() == 0


def test_chunks_follow_content():
    pattern = re.compile(exact_dedup.chunk_pattern(20, 100).replace(r"\z", r"\Z"))
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(2000))
    a, b = pattern.findall(text), pattern.findall("inserted here " + text)
    assert "".join(a) == text and max(map(len, a)) <= 100 and len(set(a) & set(b)) > 0.8 * len(set(a))


# ---- mixing ------------------------------------------------------------------------
def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(1000, None, "e"), (1001, "  ", "e"), (1, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = {}
    for r, (i, t, s) in zip(sorted(got, key=lambda r: (r.doc_id, r.size)), sorted(rows, key=lambda x: (x[0], len((x[1] or "").split())))):
        assert r.size == len((t or "").split()) and 0 <= r.taken <= 3 * r.size
        by.setdefault(s, []).append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= mixing.BLOCK_WORDS + 1
    assert abs(sum(rs[0].target for rs in by.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(sum(r.by_shard) == r.taken and min(r.by_shard) >= 0 for r in got) and sum(r.taken for r in got) == sum(r.size for r in got)
    small = mixing.mix(df.where("doc_id = 1 AND text = 'w w'")).first()
    assert (small.target, small.taken) == (2.0, 2)


def test_quotas_of_each_shard_are_the_apportionment_of_its_blocks(spark):
    sizes = {"a": 9_000, "b": 14_500, "c": 3_333, "d": 2_000, "e": 11_111}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows = {r.source: r for r in mixing.apportion(mixing.targets(df), block_words=10, shards=7).collect()}
    total, won, ends = sum(sizes.values()), dict.fromkeys(sizes, 0), {s: [] for s in sizes}
    seats = -(-total // 10)
    for h in range(1, seats + 1):
        best = max(sorted(sizes), key=lambda s: rows[s].target / (2 * won[s] + 1))
        won[best] += 1
        for j in range(1, 8):
            if h == seats * j // 7:
                for s in sizes:
                    ends[s].append(won[s] * 10 - (seats * 10 - total if j == 7 and s == best else 0))
    assert {s: list(rows[s].ends) for s in sizes} == ends and sum(e[-1] for e in ends.values()) == total


def test_mixing_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(rng.choice([None, 7, 7, i]), "w " * rng.randint(0, 90) + f"x{i}", rng.choice("aab") if i % 9 else None, i) for i in range(300)] + [(7, "same text", "a", 300)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").coalesce(1)
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.n] = got.get(r.n, 0) + 1
    # brute force: each source's rows in the seeded order take its quota of words, round after round
    taken = {s: ends[-1] for s, ends in mixing.apportion(mixing.targets(docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("source_size")))).select("source", "ends").collect()}
    want = {}
    for source, left in taken.items():
        of = [(hashlib.md5(f"{mixing.SEED}:{'' if d is None else d}".encode()).hexdigest(), d or 0, len(t.split()), i, n) for i, (d, t, s, n) in enumerate(rows) if s == source]
        rounds, left = divmod(left, sum(x[2] for x in of))
        for _, _, size, _, n in sorted(of):
            part = min(size, left)
            left -= part
            copies = (2 * (rounds * size + part) + size) // (2 * size)
            if copies:
                want[n] = want.get(n, 0) + copies
    assert got == want and sum(want.values()) > 200


# ---- substring dedup -----------------------------------------------------------------
def brute_windows(docs, n):
    seen = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i, w in words.items():
        for a in range(len(w) - n + 1):
            seen.setdefault(tuple(w[a : a + n]), []).append((i, a))
    gone = {i: set() for i in words}
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i] |= set(range(a, a + n))
    return {i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone[i])).hexdigest()) for i, w in words.items()}


@pytest.mark.parametrize("pieces", [2000, 2])
def test_substrings_equal_brute_force(spark, pieces):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    passage = [word() for _ in range(30)]
    docs = []
    for i in range(40):
        w = [f"{word()}{rng.randrange(50)}" for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            a = rng.randrange(15)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randint(5, 20)]
        docs.append((i, "  ".join(w)))
    docs += [(100, None), (101, ""), (102, "r " * 30), (103, docs[0][1]), (104, " ".join(passage)), (105, " ".join(passage))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_spans(frame(spark, docs, "doc_id long, text string, key string"), window=8, anchor=3, shard_pieces=pieces).collect()}
    assert got == brute_windows(docs, 8)


def test_substring_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z"), (2, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.repeated_spans(frame(spark, docs), window=3, anchor=2).collect())
    assert got == [(0, 0), (1, 6), (1, 6), (2, 0)]
    assert substring_dedup.repeated_spans(frame(spark, docs).limit(0)).count() == 0
    text = spark.range(1).select(substring_dedup.without_spans(F.lit(" a b  c d"), F.expr("array(named_struct('start', 1L, 'end', 3L))")).alias("t")).first().t
    assert text == "a d"


def test_suffix_automaton_counts():
    rng = random.Random(5)
    lists = [[rng.choice("ab") for _ in range(rng.randint(3, 30))] for _ in range(5)]
    auto = substring_dedup.SuffixAutomaton()
    for x in lists:
        auto.add(x)
    auto.weigh(lists, [1, 2, 1, 1, 3])
    for x in lists:
        want = [sum(w for y, w in zip(lists, [1, 2, 1, 1, 3]) for b in range(len(y) - 3) if y[b : b + 4] == x[a : a + 4]) for a in range(len(x) - 3)]
        assert auto.occurrences(x, 4) == want[: max(0, len(x) - 3)]


# ---- sharding ------------------------------------------------------------------------
def test_shard_table(spark, tmp_path):
    store = sharding.ShardTable(spark, str(tmp_path / "t"))
    rows = [(i, None if i % 7 == 0 else f"text {i} " * 50, i % 3) for i in range(3000)] + [(5, "again", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    for k in range(4):
        store.append(df.where(F.col("doc_id") % 4 == k), rows_per_shard=200)
    store.append(df.limit(0))
    before = [r.asDict() for r in store.shards().collect()]
    assert store.version() == 5 and len(before) >= 16 and sum(s["rows"] for s in before) == len(rows)
    store.compact(target=40_000, fan_in=4)
    after = [r.asDict() for r in store.shards().collect()]
    assert len(after) < len(before) and not sharding.plan_merges(after, 40_000, 4)
    assert all(s["bytes"] <= 2 * 40_000 for s in after)
    assert store.read(5).count() == len(rows)  # the older version is still there
    where = store.assignments("doc_id")
    assert where.count() == len(rows) and {r.shard for r in where.select("shard").collect()} == {s["name"] for s in after}
    with pytest.raises(sharding.LostShards):  # merged already
        store.commit([], [before[0]["name"]])
    version = store.version()
    assert not store._publish(version, "") and store.version() == version  # a version is never written over
    # another writer's files, not committed yet, outlive a vacuum; those of older versions go
    other = f"{store.root}/data/other"
    df.limit(10).write.parquet(other)
    store.vacuum(3600)
    store.commit(store._written(other, df.schema, "other"))
    assert store.read().count() == len(rows) + 10
    store.vacuum(0)
    assert store.read().count() == len(rows) + 10
    with pytest.raises(Exception):  # noqa: B017 - the files of version 5 are gone now
        store.read(5).count()
    empty = sharding.shard(df.limit(0).select("doc_id", "text"))
    assert empty.count() == 0 and "shard" in empty.columns
    again = sharding.shard(df, arrivals=3, rows_per_shard=100, target=20_000)
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in df.collect())


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    store = sharding.ShardTable(spark, str(tmp_path / "t"))
    df = spark.range(10).toDF("doc_id")
    publish, first = store._publish, []

    def slow(version, text):
        if not first:
            first.append(sharding.ShardTable(spark, store.root).append(df))
        return publish(version, text)

    monkeypatch.setattr(store, "_publish", slow)
    assert store.append(df) == 2 and first == [1]
    assert sorted(r.doc_id for r in store.read().collect()) == sorted([*range(10)] * 2)


def test_merge_plans():
    shards = [{"name": f"s{i:02d}", "bytes": b} for i, b in enumerate([10] * 9 + [40] * 3 + [100, 90])]
    merges = sharding.plan_merges(shards, 100, 4)
    assert [[s["name"] for s in m] for m in merges][0] == [f"s{i:02d}" for i in range(9)]
    assert all(s["bytes"] < 90 for m in merges for s in m)


# ---- queries ---------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, "/root/testdata/sf0.001"), registry.ORACLES[name], "/root/testdata/sf0.001") == ""


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf)
        if name == "sharding":
            assert out.count() == kept.count() > 0
            break
        assert out.columns == docs.columns, name
        out.write.mode("overwrite").parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.run(spark, sf).count() > 0
