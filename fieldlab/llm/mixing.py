"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

The mix holds as many words as the input. Its words come in equal blocks, the
last one cut to what is left; each block goes to the source with the highest
quotient target / (2k - 1), k being the number of the block within its source.
Blocks fill the mix's shards in that order, so a source's quota in a shard is
the whole number of blocks that it wins there, and every shard follows the
weights as nearly as whole blocks can. A source's rows, in a seeded order, form
one stream of words that is cut into blocks; shard by shard the quotas take
blocks from it, and start again at its end.

Null text and empty text have size 0 and are never taken. A null source is a
source, the last one. Repeated rows each count. An empty table gives no rows.
No figure is ever gathered for more than one row per source or per part or
bucket of a source's seeded order, so a source that holds a third of all rows,
or an id that does, is split over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.llm.common import WORD, Scratch

BLOCK_WORDS = 64
WEIGHTS = (5, 2, 1)
CAP = 3
SHARDS = 16
SEED = "mix-1"
#: Parts of the rows' keys, of about equal numbers, that rows of one id and size are dealt to.
ROW_PARTS = 256


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to the same with rank, weight, limit and target.

    Targets share the sum of all sizes by weight. Those above `cap` times
    their source's size stop there and the rest is shared anew; sources sorted
    by limit / weight stop in that order, so running sums settle who stops.
    One row per source goes through these windows.
    """
    every = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = (
        ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
        .withColumn("limit", F.lit(cap).cast("long") * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every))
    )
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    settled = weighed.withColumn("before", before).withColumn("rest", rest)
    settled = settled.withColumn("stopped", F.col("limit") * F.col("rest") <= F.col("weight") * (F.col("total") - F.col("before")))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("limit"))).over(every), F.lit(0))
    among = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(every)
    shared = F.col("weight").cast("double") * left.cast("double") / among.cast("double")
    return settled.withColumn("target", F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(shared)).select("source", "source_size", "rank", "limit", "total", "target")


def apportion(sources: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Adds `blocks`, how many equal blocks each source is given by highest quotients, and `ends`: the words it is given up to the end of each shard.

    The first h blocks in the order of quotients are the apportionment of h
    blocks, so a shard's quota is the difference of two of them. A source's
    number differs from its exact share by at most
    1/2 + share * sources / (2 * blocks), so only the quotients that near need
    ranking: a few rows per source and shard, whatever the number of blocks.
    """
    every = Window.partitionBy("shard")
    seats = F.ceil(F.col("total") / F.lit(block_words)).cast("long")
    s = sources.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("seats", seats).withColumn("first", F.expr(f"seats * shard div {shards}"))
    s = s.withColumn("n", F.count(F.lit(1)).over(every))
    share = F.when(F.col("total") > 0, F.col("target") * F.col("first") / F.col("total")).otherwise(0.0)
    s = s.withColumn("near", (F.lit(2) + F.ceil(share * F.col("n") / (2 * F.greatest(F.col("first"), F.lit(1))))).cast("long"))
    s = s.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(share).cast("long") - F.col("near")))
    s = s.withColumn("open", F.col("first") - F.sum("sure").over(every))
    tried = s.withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("sure") + 2 * F.col("near") + 1)))
    tried = tried.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "rank")))
    won = tried.where((F.col("place") <= F.col("open")) & (F.col("target") > 0)).groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("won"), F.bool_or(F.col("place") == F.col("open")).alias("last"))
    given = s.join(won, ["rank", "shard"], "left").withColumn("blocks", F.col("sure") + F.coalesce("won", F.lit(0)))
    cut = F.when((F.col("shard") == shards) & F.coalesce("last", F.lit(False)), F.col("seats") * block_words - F.col("total")).otherwise(0)
    given = given.withColumn("end", F.least(F.col("blocks") * block_words - cut, F.col("limit")).cast("long"))
    ends = given.groupBy("rank").agg(F.max("blocks").alias("blocks"), F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    return sources.join(ends, "rank")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
    seed: str = SEED, bucket_digits: int = 3, row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, blocks of its source, and by_shard: the words taken for each shard.

    A source's rows are in the order of the seeded key, which is made from the
    id. Rows of one id, and those without, are in the order of their sizes, then
    of row_col if it is given, else of their texts' MD5s.
    bucket_digits: hex digits of the seeded key that make the parts of a source;
    16 ** bucket_digits of them are summed per source. A part is a bucket, or
    has several where an id that is null or repeated may bring many rows.
    row_col: a key of the rows, a number, unique and never null. It is added to
    the result, as ids may be null or repeated.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("content"), (F.col(row_col) if row_col else F.lit(0)).alias("row"))
    # a source's name as a key that is never null
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("part", F.substring("key", 1, bucket_digits))
    scratch = Scratch(spark, "mix")
    rows = scratch.keep(rows, "sizes")
    # many rows of one id, or without one, would be one bucket: all rows that share its first digits have buckets by what orders them
    again = scratch.keep(rows.where("doc_id IS NOT NULL").groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "again")
    shared = F.broadcast(again.select("part", F.lit(True).alias("shared")).distinct())
    split = F.coalesce("shared", F.lit(False)) | (F.col("part") == F.substring(F.md5(F.lit(f"{seed}:")), 1, bucket_digits))
    if row_col:
        ends = rows.agg(F.percentile_approx("row", [i / ROW_PARTS for i in range(1, ROW_PARTS)])).first()[0] or []
        last = F.lpad(F.hex(F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= F.col("row"))).cast("long")), 4, "0")
    else:
        last = F.substring("content", 1, bucket_digits)
    bucket = F.concat("key", F.col("doc_id").isNotNull().cast("int").cast("string"), F.lpad(F.hex("size"), 16, "0"), last)
    rows = rows.join(shared, "part", "left").withColumn("bucket", F.when(split, bucket).otherwise(F.col("part"))).drop("shared")

    def sum_before(size: str, order: str, *of: str) -> Column:
        return F.coalesce(F.sum(size).over(Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    buckets = rows.groupBy("name", "source", "part", "bucket").agg(F.sum("size").alias("bucket_size"))
    parts = buckets.groupBy("name", "part").agg(F.sum("bucket_size").alias("part_size")).select("name", "part", sum_before("part_size", "part", "name").alias("part_start"))
    starts = buckets.select("name", "part", "bucket", sum_before("bucket_size", "bucket", "name", "part").alias("in_part")).join(parts, ["name", "part"])
    starts = starts.select("name", "bucket", (F.col("part_start") + F.col("in_part")).alias("bucket_start"))
    sources = buckets.groupBy("name", "source").agg(F.sum("bucket_size").alias("source_size"))
    quotas = apportion(targets(sources.select("source", "source_size"), weights, cap), block_words, shards)
    quotas = quotas.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))

    order = Window.partitionBy("name", "bucket").orderBy("key", "doc_id", "size", "row" if row_col else "content").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["name", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    full = placed.join(quotas.select("name", "source_size", "target", "blocks", "ends"), "name")

    def before(end: Column) -> Column:
        """Words of the document in the first `end` words of its source's stream, which starts again at its end."""
        over = end % F.col("source_size")
        rest = F.greatest(F.lit(0), F.least(over - F.col("start"), F.col("size")))
        return F.when(F.col("source_size") > 0, (end - over) / F.col("source_size") * F.col("size") + rest).otherwise(0).cast("long")

    full = full.withColumn("upto", F.transform("ends", before))
    by_shard = F.zip_with("upto", F.concat(F.array(F.lit(0).cast("long")), F.slice("upto", 1, shards - 1)), lambda a, b: a - b)
    return full.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", F.element_at("upto", -1).alias("taken"), "blocks", by_shard.alias("by_shard"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def op6_mix_sources(spark, sf_dir):
    from fieldlab.llm.common import table

    return mix(table(spark, sf_dir, "documents")).withColumn("by_shard", F.array_join("by_shard", ","))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}:' || doc_id) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM d GROUP BY source),
v AS (SELECT *, [5, 2, 1][((rnk - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS lim, (sum(source_size) OVER ())::BIGINT AS total FROM s),
r AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    (sum(weight) OVER (ORDER BY lim / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM v),
f AS (SELECT *, lim * rest <= weight * (total - before) AS stopped FROM r),
t AS (
  SELECT *, CASE WHEN stopped THEN lim::DOUBLE ELSE weight::DOUBLE * (total - coalesce(sum(lim) FILTER (stopped) OVER (), 0))::DOUBLE
    / (sum(weight) FILTER (NOT stopped) OVER ())::DOUBLE END AS target FROM f),
seat AS (
  SELECT rnk, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rnk) AS place, ceil(total / {BLOCK_WORDS})::BIGINT AS seats, total
  FROM (SELECT *, unnest(generate_series(1, ceil(total / {BLOCK_WORDS})::BIGINT)) AS k FROM t) WHERE target > 0),
award AS (SELECT * FROM seat WHERE place <= seats),
j AS (SELECT unnest(range(1, {SHARDS + 1})) AS shard),
e AS (
  SELECT t.rnk, shard, count(place) AS blocks, least(count(place) * {BLOCK_WORDS} - CASE WHEN shard = {SHARDS} AND bool_or(place = seats) THEN any_value(seats * {BLOCK_WORDS} - a.total) ELSE 0 END, any_value(lim))::BIGINT AS upto
  FROM t CROSS JOIN j LEFT JOIN award a ON a.rnk = t.rnk AND place <= seats * shard // {SHARDS} GROUP BY t.rnk, shard),
q AS (SELECT t.*, blocks, shard, upto FROM t JOIN e USING (rnk)),
p AS (
  SELECT d.doc_id, d.size, d.source, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
w AS (
  SELECT p.doc_id, p.size, q.source_size, q.target, q.blocks, shard,
    CASE WHEN source_size > 0 THEN (upto // source_size * size + greatest(0, least(upto % source_size - start, size)))::BIGINT ELSE 0 END AS upto
  FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source),
z AS (SELECT *, upto - lag(upto, 1, 0) OVER (PARTITION BY doc_id ORDER BY shard) AS words FROM w)
SELECT doc_id, size, source_size, target, max(upto)::BIGINT AS taken, max(blocks)::BIGINT AS blocks, string_agg(words::BIGINT, ',' ORDER BY shard) AS by_shard
FROM z GROUP BY doc_id, size, source_size, target
"""
