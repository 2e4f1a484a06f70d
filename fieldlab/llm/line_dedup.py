"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

Lines of at least `least` characters are linked if their edit distance is at
most `edits`; equal lines are linked at any length. Of each connected group of
lines the first occurrence, by document id and line number, stays and all
others are removed. Blank lines always stay.

1. Lines of that length become a table of distinct lines, each with a number.
2. A line of length l is split into edits + 1 segments; a line within `edits`
   of it, not shorter, has one of them unchanged at a place that the two lengths
   allow. So each line puts the hashes of its own segments into an index and
   probes it, for each length it may meet, with the few substrings that can be
   such a segment. Index and probes meet in one shuffle of (hash, number).
3. Only lines of a bucket that has an index entry and another line go on, with
   their text and how often they have each letter: an edit changes those counts
   by two at most, so most pairs need no more than a look at the counts.
4. The others are verified by edit distance: common ends are cut off and the
   rest goes through bit vectors of the band of 2 * edits + 1 diagonals, one
   step per character.
5. Crowded buckets are split by those counts: of 2 * edits + 1 groups of
   letters at least one has the same counts in lines that are linked. Where
   most lines of a bucket have the same counts, as log lines that differ in
   digits do, it is split by what lines have besides the bucket's hub.

Null text has no lines. Lines are told apart by their text, then by number and
MD5. Very long lines take time in proportion to their length. Repeated rows
repeat their lines; rows that tie on the id are ordered as they are read. An
empty table gives no rows. Other columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.buckets import link_components, shared_buckets
from fieldlab.llm.common import Scratch, table

EDITS = 2
LEAST = 20
#: Buckets of more lines are split by the counts of groups of these characters.
CROWD = 256
COUNTED = "etaoinsrhldcumfpgwybvkxjqz "
#: Characters of a run; levels on which buckets may be split by counts; lines per different counts, above which they aren't; levels at most.
GRAM, COUNT_LEVELS, ALIKE, LEVELS = 4, 2, 4, 5
#: Lines in shared buckets that are looked up by a broadcast; more are looked up by a shuffled join.
MOST_BROADCAST = 5_000_000


def lines_of(text: Column) -> Column:
    return F.when(text.isNotNull(), F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def places(edits: int) -> list[tuple[int, int, int]]:
    """(indexed length below the line's own, segment, shift): the line's own segments (0, i, 0) and the substrings that may be another line's."""
    parts = edits + 1
    out = {(0, i, 0) for i in range(1, parts + 1)}
    for delta in range(edits + 1):
        for i in range(1, parts + 1):
            out |= {(delta, i, s) for s in range(max(1 - i, delta - parts + i), min(i - 1, delta + parts - i) + 1)}
    return sorted(out)


def probes(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(node, n, line) to (band, node, own): a row per hash of (indexed length, segment number, segment text); own are the index entries."""
    parts = F.lit(edits + 1)
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in places(edits)])
    p = lines.select("node", "n", "line", F.explode(each).alias("p")).select("node", "n", "line", "p.*").withColumn("m", F.col("n") - F.col("d"))
    p = p.withColumn("base", F.expr(f"m div {edits + 1}").cast("int")).withColumn("short", parts - F.pmod("m", parts))  # the first so many segments have `base` characters, the others one more
    p = p.withColumn("at", (F.col("i") - 1) * F.col("base") + F.greatest(F.lit(0), F.col("i") - 1 - F.col("short")) + 1 + F.col("s"))
    p = p.withColumn("len", F.col("base") + (F.col("i") > F.col("short")).cast("int"))
    p = p.where((F.col("m") >= least) & (F.col("at") >= 1) & (F.col("at") + F.col("len") - 1 <= F.col("n")))
    return p.select(F.xxhash64("m", "i", F.substring("line", F.col("at"), F.col("len"))).alias("band"), "node", ((F.col("d") == 0) & (F.col("s") == 0)).alias("own"))


def counts(line: Column) -> Column:
    """How often the line has each counted character: how many bytes it loses without it."""
    return F.array(*[F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED])


def by_counts(crowded: DataFrame, level: int, edits: int) -> DataFrame:
    """Of (band, node, fact) finer buckets, one per group of characters: an edit changes the counts of two groups at most. Levels group differently."""
    groups = 2 * edits + 1
    of = [(i + (level - 1) * (i // groups)) % groups for i in range(len(COUNTED))]
    keys = [F.xxhash64("band", F.lit(g), *[F.col("fact.counts")[i] for i in range(len(COUNTED)) if of[i] == g]) for g in range(groups)]
    return crowded.select(F.explode(F.array(*keys)).alias("band"), "node", "fact")


def grams(line: Column) -> Column:
    """Hashes of the different runs of GRAM characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(line) - (GRAM - 1))), lambda i: F.xxhash64(F.substring(line, i, F.lit(GRAM)))))


def runs_of(crowded: DataFrame, near: DataFrame) -> DataFrame:
    """(node, x): the runs of characters of the crowded lines, and of no others."""
    return near.select("node", "line").join(crowded.select("node").distinct(), "node").select("node", grams(F.col("line")).alias("x"))


def by_grams(crowded: DataFrame, level: int, near: DataFrame, edits: int, scratch: Scratch | None = None) -> DataFrame:
    """Of (band, node, fact) finer buckets by the runs of characters that lines have and their bucket's hub has not.

    An edit takes GRAM runs at most from a line, so a linked line lacks t =
    GRAM * edits of them at most. Runs are ordered by how many lines of the
    bucket have them, rare ones first. The first run that two linked lines
    share outside the hub is among the first t + 1 of either; if they share
    none, both have t at most, and such lines are a bucket of their own. With
    `scratch`, the lines' runs are worked out once and kept there.
    """
    lacks = GRAM * edits
    rank = F.struct(F.when(F.col("fact.own"), 0).otherwise(1).alias("first"), F.xxhash64("node", F.lit(level)).alias("p"), "node")
    hub = crowded.groupBy("band").agg(F.min(rank)["node"].alias("hub"))
    of = runs_of(crowded, near)
    of = of if scratch is None else scratch.keep(of, "runs")
    both = crowded.join(hub, "band").join(of, "node").join(of.select(F.col("node").alias("hub"), F.col("x").alias("y")), "hub")
    each = both.select("band", "node", "fact", F.explode_outer(F.array_except("x", "y")).alias("g"))
    often = each.where("g IS NOT NULL").groupBy("band", "g").agg(F.count(F.lit(1)).alias("times"))
    runs = each.join(often, ["band", "g"], "left").groupBy("band", "node").agg(F.first("fact").alias("fact"), F.array_sort(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("times", "g")))).alias("g"))  # runs of a line
    keys = F.filter(F.slice("g", 1, lacks + 1), lambda x: x["times"] > 1)["g"]
    few = F.when(F.size("g") <= lacks, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return runs.select("band", "node", "fact", F.explode(F.concat(keys, few)).alias("g")).select(F.xxhash64("band", "g", F.lit(level)).alias("band"), "node", "fact")


def finer(crowded: DataFrame, level: int, near: DataFrame, edits: int, scratch: Scratch | None = None) -> DataFrame:
    """By counts where these tell lines apart, else by runs of characters."""
    if level > COUNT_LEVELS:
        return by_grams(crowded, level, near, edits, scratch)
    alike = crowded.groupBy("band").agg((F.approx_count_distinct(F.xxhash64("fact.counts"), 0.1) * ALIKE < F.count(F.lit(1))).alias("alike"))
    told = crowded.join(alike, "band")
    return by_counts(told.where("NOT alike").drop("alike"), level, edits).unionByName(by_grams(told.where("alike").drop("alike"), level, near, edits, scratch))


def let(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def common_start(x: Column, y: Column) -> Column:
    """How many characters both start with, by halving steps."""
    most = F.least(F.length(x), F.length(y))

    def longer(k: Column, step: Column) -> Column:
        return F.when(k + step > most, k).when(F.substring(x, F.lit(1), k + step) == F.substring(y, F.lit(1), k + step), k + step).otherwise(k)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(29, -1, -1)]), F.lit(0), longer)


def trimmed(p: Column) -> Column:
    """A struct of x and y without a common start, both reversed."""

    def cut(k: Column) -> Column:
        rest = lambda v: F.reverse(F.substring(v, k + 1, F.length(v)))
        return F.struct(rest(p["x"]).alias("x"), rest(p["y"]).alias("y"))

    return let(common_start(p["x"], p["y"]), cut)


def edit_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of x and y if it is at most `edits`, else some larger number. Common ends don't count and go first."""
    far = F.abs(F.length(x) - F.length(y)) > edits
    near = let(F.struct(x.alias("x"), y.alias("y")), lambda p: let(trimmed(p), lambda q: let(trimmed(q), lambda r: banded_distance(r["x"], r["y"], edits))))
    return F.when(far, F.lit(edits + 1).cast("long")).otherwise(near)


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """The same for strings whose lengths differ by at most `edits`.

    Column j of the dynamic program is kept as two bit vectors, vp and vn: bit
    d says whether the value at row j - edits + d is one more, or one less,
    than the row above. `score` is the value at the band's lowest row, then at
    the last row.
    """
    band = 2 * edits + 1
    mask = (1 << band) - 1

    def long(v: int) -> Column:
        return F.lit(v).cast("long")

    def bit(v: Column, at) -> Column:
        return F.call_function("shiftright", v, at if isinstance(at, Column) else F.lit(at)).bitwiseAND(long(1))

    def run(t: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            eq = long(0)
            for d in range(band):
                eq = eq + F.when(F.get(t["a"], j + (d - edits - 1)) == F.get(t["b"], j - 1), long(1 << d)).otherwise(long(0))
            return let(eq, lambda e: diagonal(s, j, e))

        def diagonal(s: Column, j: Column, eq: Column) -> Column:
            d0 = ((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(long(mask))
            return let(d0, lambda d: let(F.struct(s["vn"].bitwiseOR(long(mask) - d.bitwiseOR(s["vp"])).alias("hp"), d.bitwiseAND(s["vp"]).alias("hn"), F.shiftright(d, 1).alias("down")), lambda h: following(s, j, d, h)))

        def following(s: Column, j: Column, d0: Column, h: Column) -> Column:
            last = F.greatest(F.lit(0), t["m"] - j + edits)  # bit of the last row
            within = s["score"] + long(1) - bit(d0, band - 1)
            beyond = s["score"] + bit(h["hp"], last) - bit(h["hn"], last)
            return F.struct(
                h["hn"].bitwiseOR(long(mask) - h["down"].bitwiseOR(h["hp"])).alias("vp"), h["down"].bitwiseAND(h["hp"]).alias("vn"),
                F.when(j + edits <= t["m"], within).otherwise(beyond).alias("score"),
            )

        # rows past the end of x don't exist: a shorter x starts from its last row
        start = F.struct(long(mask - ((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.least(long(edits), t["m"].cast("long")).alias("score"))
        return F.aggregate(F.sequence(F.lit(1), t["n"]), start, step, lambda s: s["score"])

    facts = F.struct(F.split(x, "").alias("a"), F.split(y, "").alias("b"), F.length(x).alias("m"), F.length(y).alias("n"))
    whole = let(facts, lambda t: F.when(t["n"] == 0, t["m"].cast("long")).when(t["m"] == 0, t["n"].cast("long")).otherwise(run(t)))
    return whole


def line_components(docs: DataFrame, scratch: Scratch, text_col: str, edits: int, least: int, crowd: int = CROWD, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(same, component): the MD5 of each line that is linked with other lines, and its component."""
    line = docs.select(F.explode(F.array_distinct(lines_of(F.col(text_col)))).alias("line")).where((F.length("line") >= least) & F.rlike(F.col("line"), F.lit(r"[^\x20\x09-\x0D]"))).distinct()
    line = scratch.keep(line.select(F.monotonically_increasing_id().alias("node"), F.length("line").alias("n"), "line"), "distinct")

    # both uses of the shuffled rows read the same shuffle
    member = probes(line, edits, least).repartition("band")
    many = member.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("own").alias("index")).where("index AND lo <> hi").select("band")
    member = scratch.keep(member.join(many.hint("shuffle_hash"), "band").groupBy("band", "node").agg(F.max("own").alias("own")), "buckets")

    nodes = scratch.keep(member.select("node").distinct(), "nodes")
    nodes = F.broadcast(nodes) if nodes.count() <= most_broadcast else nodes
    near = scratch.keep(line.join(nodes, "node").select("node", "n", "line", F.unhex(F.md5("line")).alias("same"), counts(F.col("line")).alias("counts")), "near")
    member = scratch.keep(member.join(near.select("node", "n", "counts"), "node").select("band", "node", F.struct("own", "n", "counts").alias("fact")), "members")

    def compatible(x: Column, y: Column) -> Column:
        differ = F.aggregate(F.zip_with(x["counts"], y["counts"], lambda a, b: F.abs(a - b)), F.lit(0), lambda total, d: total + d)
        return (x["own"] | y["own"]) & (F.abs(x["n"] - y["n"]) <= edits) & (differ <= 2 * edits)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(near.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(near.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
        return both.where(edit_distance(F.col("x"), F.col("y"), edits) <= edits).select("a", "b")

    def index_first(fact: Column) -> Column:
        return F.when(fact["own"], 0).otherwise(1)

    found = link_components(member, compatible, verified, scratch, priority=index_first, refine=lambda crowded, level: finer(crowded, level, near, edits, scratch), small_bucket=crowd, levels=LEVELS)
    return found.join(near.select("node", "same"), "node").select("same", "component")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, n_lines, n_removed, removed (line numbers from 0), kept_sha256 (of the kept lines' MD5s, comma-joined)."""
    if not 0 < edits < 30 or least <= edits:
        raise ValueError("1 to 29 edits, and lines longer than that")
    scratch = Scratch(docs.sparkSession, "lines")
    facts = lambda l: F.struct(F.unhex(F.md5(l)).alias("same"), F.rlike(l, F.lit(r"[^\x20\x09-\x0D]")).alias("filled"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.transform(lines_of(F.col(text_col)), facts).alias("lines"))
    rows = scratch.keep(rows, "rows")
    found = scratch.keep(line_components(docs.select(text_col), scratch, text_col, edits, least, crowd), "found")

    place = rows.select("row", "id", F.posexplode("lines").alias("pos", "l")).where("l.filled").select("row", "id", "pos", "l.same")
    # of each different line, where it first occurs; linked lines have the first place of their component
    line = place.groupBy("same").agg(F.min(F.struct("id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("times"))
    line = scratch.keep(line.join(found, "same", "left").where("times > 1 OR component IS NOT NULL"), "repeated")
    of = line.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("of"))
    first = F.coalesce("of", "first")
    line = line.join(of, "component", "left").select("same", first["row"].alias("row_"), first["pos"].alias("pos_"))
    again = place.join(line, "same").where("row <> row_ OR pos <> pos_")
    gone = again.groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("removed"))

    out = rows.join(gone, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.greatest(F.size("lines"), F.lit(1)) - 1), "removed")
    kept = F.transform(F.filter(kept, lambda i: i < F.size("lines")), lambda i: F.lower(F.hex(F.get("lines", i)["same"])))
    return out.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2(F.array_join(kept, ","), 256).alias("kept_sha256"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of those numbers."""
    return F.array_join(F.filter(lines_of(text), lambda l, i: ~F.array_contains(removed, i)), "\n")


def op5_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


OP5_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
d AS MATERIALIZED (SELECT line, row_number() OVER (ORDER BY line) AS node, length(line) AS n FROM (SELECT DISTINCT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))),
e AS MATERIALIZED (
  SELECT DISTINCT a.node AS a, b.node AS b FROM d a JOIN d b ON abs(a.n - b.n) <= {EDITS} AND a.node <> b.node AND a.n >= {LEAST} AND b.n >= {LEAST}
  -- with two edits one third of a is a part of b
  WHERE CASE WHEN contains(b.line, substr(a.line, 1, a.n // 3)) OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n // 3)) OR contains(b.line, substr(a.line, 2 * (a.n // 3) + 1))
    THEN levenshtein(a.line, b.line) <= {EDITS} ELSE false END),
r(node, x) AS (SELECT node, node FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.x),
g AS (SELECT node, min(x) AS g FROM r GROUP BY node),
o AS (
  SELECT doc_id, pos, l.line, g.g, row_number() OVER (PARTITION BY g.g ORDER BY doc_id, pos) AS nth FROM l LEFT JOIN d USING (line) LEFT JOIN g USING (node)),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g IS NOT NULL AND nth > 1) AS n_removed,
    string_agg(md5(line), ',' ORDER BY pos) FILTER (g IS NULL OR nth = 1) AS kept FROM o GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
