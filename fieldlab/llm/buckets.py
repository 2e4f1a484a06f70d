"""All links between members of shared buckets, without ever pairing a whole bucket.

A bucket's members are first paired with one hub each. Links found make
components; buckets that still hold more than one component go round again:

- members that can't be linked with any other of their bucket leave it;
- small buckets get all pairs of different components;
- members of large ones are dealt to finer buckets, if the caller knows any,
  and those of finer ones that are still large to finer ones again;
- in what is large after some such levels, members outside the largest
  component become hubs: all of them where they are few, else a number at a
  time;

until each pair in a bucket is in one component or was verified. No link
between components is lost, and pairs within a component are never formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import Scratch
from fieldlab.llm.components import components

SMALL_BUCKET = 64
HUBS = 128
LEVELS = 2


def shared_buckets(member: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, node, fact) to those of buckets with several nodes, each node once."""
    many = member.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band")
    return scratch.keep(member.join(many, "band").select("band", "node", "fact").distinct(), "buckets")


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def link_components(
    member: DataFrame, compatible: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame], scratch: Scratch, *,
    priority: Callable[[Column], Column] | None = None, refine: Callable[[DataFrame, int], DataFrame] | None = None,
    possible: tuple[Callable[[Column], Column], Callable[[Column, Column], Column]] | None = None, small_bucket: int = SMALL_BUCKET, hubs: int = HUBS,
    levels: int = LEVELS,
) -> DataFrame:
    """(node, component) of the nodes of `member` (band, node, fact) that have links.

    compatible: of two facts, whether their nodes can be linked at all.
    verified: keeps the pairs (a, b) that are links.
    priority: of a fact; nodes with low values become hubs first.
    possible: (a measure of a fact, whether a fact can be linked with any whose
    measure is the given one or more); members that can't be linked with any
    other of their bucket leave it.
    refine: of the members (band, node, fact) of large buckets that are still
    open, finer buckets in which any two that can be linked still meet; it is
    given the level, from 1 to `levels`.
    """

    def hub_of(turn: int) -> Column:
        first = F.lit(0) if priority is None else priority(F.col("fact"))
        return F.min(F.struct(first.alias("first"), F.xxhash64("node", F.lit(turn)).alias("p"), "node", "fact")).alias("h")

    star = member.groupBy("band").agg(hub_of(0)).select("band", F.col("h.node").alias("b"), F.col("h.fact").alias("fb"))
    tested = scratch.keep(_tidy(member.join(star, "band").where(compatible(F.col("fact"), F.col("fb"))).select(F.col("node").alias("a"), "b")), "pairs")
    links = scratch.keep(verified(tested), "verified")
    found = components(links, scratch)
    used = None  # hubs of large buckets that have met all others
    turn = 0
    while True:
        turn += 1
        now = member.select("band", "node", "fact").join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        if used is not None:
            now = now.join(used, ["band", "node"], "left_anti")
        if possible is not None:
            measure, can = possible
            bound = now.groupBy("band").agg(F.min(measure(F.col("fact"))).alias("least"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "least")
            now = scratch.keep(now.join(bound, "band").where(can(F.col("fact"), F.col("least"))).drop("least"), "possible")
        open_ = now.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "size")
        now = scratch.keep(now.join(open_, "band"), "open")
        if now.isEmpty():
            return found
        other = now.select("band", F.col("node").alias("b"), F.col("fact").alias("fb"), F.col("c").alias("cb"))
        small = now.where(F.col("size") <= small_bucket).join(other, "band").where((F.col("c") < F.col("cb")) & compatible(F.col("fact"), F.col("fb"))).select(F.col("node").alias("a"), "b")
        large = now.where(F.col("size") > small_bucket)
        if refine is not None and turn <= levels:
            dealt = scratch.keep(refine(large.select("band", "node", "fact"), turn), "dealt")
            finer = shared_buckets(dealt, scratch)
            scratch.drop(dealt)
            large = large.limit(0)
        else:
            finer = None
        salt = F.pmod(F.xxhash64("node", F.lit(-turn)), F.lit(hubs)).alias("salt")
        # members outside the bucket's largest component: once they have met all others nothing is open
        held = large.groupBy("band", "c").agg(F.count(F.lit(1)).alias("held")).groupBy("band").agg(F.max_by("c", F.struct("held", "c")).alias("major"), (F.sum("held") - F.max("held")).alias("outside"))
        outside = large.join(held, "band").where("c <> major")
        few = outside.where(F.col("outside") <= 2 * hubs).select("band", "node", "fact", "c", F.lit(True).alias("all"))
        # the component travels with the hub: only members of others are paired with it
        some = outside.where(F.col("outside") > 2 * hubs).withColumn("fact_c", F.struct("fact", "c")).groupBy("band", salt).agg(
            F.min(F.struct((F.lit(0) if priority is None else priority(F.col("fact"))).alias("first"), F.xxhash64("node", F.lit(turn)).alias("p"), "node", "fact_c")).alias("h")
        ).select("band", "h.node", "h.fact_c.fact", "h.fact_c.c", F.lit(False).alias("all"))
        hub = scratch.keep(few.unionByName(some), "hubs")
        met = hub.select("band", F.col("node").alias("b"), F.col("fact").alias("fb"), F.col("c").alias("cb"))
        spread = large.join(met, "band").where((F.col("c") != F.col("cb")) & compatible(F.col("fact"), F.col("fb"))).select(F.col("node").alias("a"), "b")
        fresh = scratch.keep(_tidy(small.unionByName(spread)).join(tested, ["a", "b"], "left_anti"), "pairs")
        more = scratch.keep(verified(fresh), "verified")
        tested = tested.unionByName(fresh)
        if not more.isEmpty():
            # what is known so far goes on as one link per node
            found = components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
        if finer is not None:
            member = finer
            continue
        if hub.where("NOT all").isEmpty():  # small buckets, and those whose hubs were all there are, are settled after one turn
            return found
        done = hub.select("band", "node")
        used = done if used is None else used.unionByName(done)
        member = large.select("band", "node", "fact")
