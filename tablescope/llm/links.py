"""Connected groups of linked items, and the search for links inside buckets without comparing all pairs."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze

SMALL = 32 << 20


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """A join whose right side is sent to all executors only if its counted rows prove it small; Spark shuffles otherwise."""
    fits = small.count() * row_bytes <= SMALL
    return big.join(F.broadcast(small) if fits else small, on, how)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b): the smallest id it can reach.

    Alternating large-star and small-star passes. A pass only ever joins an id with the minimum of its neighbours, so
    an id with a third of all links is one aggregate and a join that Spark can split.
    """
    edges = freeze(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = freeze(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def linked_groups(members: DataFrame, compatible: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame],
                  across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) of all ids that have a verified link, from members (bucket, id, trait) of buckets.

    Candidates are ids that share a bucket and whose traits are compatible. First every id is checked against one
    member of each of its buckets, the smallest id, which joins the copies of a text in time linear in their
    number. Then only pairs that still lie in different groups are checked, all of them, so no link between groups
    is lost. verify takes (a, b) and returns those that are links. `across` may name those last pairs in its own way,
    from (bucket, id, trait, c) with c the group so far.
    """
    def fresh(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return freeze(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))

    links = tested = groups = None
    for leader in (F.min, None):
        if groups is None:
            now = members.withColumn("c", F.col("id"))
        else:
            now = members.join(groups.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
            span = Window.partitionBy("bucket")  # buckets whose members all found together are done
            now = freeze(now.withColumn("lo", F.min("c").over(span)).withColumn("hi", F.max("c").over(span)).where("lo <> hi").drop("lo", "hi"))
        if leader is not None:
            heads = now.groupBy("bucket").agg(leader(F.struct("id", "trait", "c")).alias("h"))
            pairs = now.join(heads, "bucket").where((F.col("c") != F.col("h.c")) & compatible(F.col("trait"), F.col("h.trait"))) \
                .select(F.col("id").alias("a"), F.col("h.id").alias("b"))
        elif across is not None:
            pairs = across(now)
        else:
            x, y = now.alias("x"), now.alias("y")
            pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") < F.col("y.c")) & compatible(F.col("x.trait"), F.col("y.trait"))) \
                .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        pairs = fresh(pairs, tested)
        new = freeze(verify(pairs))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        groups = components(links)
    return groups
