"""Rank and running totals over a whole table, without one task that holds the whole table.

A window without PARTITION BY moves every row to one task. `ordered` lets Spark's range exchange put the rows in
order over as many partitions as they need, numbers them inside each partition, and adds what lies in the partitions
before. The range keys are whole sort keys (value and tie-break), so one value that holds a third of all rows is cut
as well.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import freeze, localize

#: Rows that one task puts in order.
ROWS = 4_000_000
#: Accuracy of quantile sketches: ranks are off by at most one part in so many.
SKETCH = 10_000
_PLACE = (1 << 33) - 1  # bits of monotonically_increasing_id that count inside a partition


def _in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows sorted by `keys` over numbered partitions, with `__part` and the 1-based place in it, `__at`; written once."""
    once = freeze(df)  # counted, sampled and sorted from here, so that what lies before runs once
    rows = once.count()
    parts = max(1, rows // ROWS, min(rows // 10_000, df.sparkSession.sparkContext.defaultParallelism))
    run = once.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)) + 1
    return freeze(run.select("*", F.spark_partition_id().alias("__part"), place.alias("__at")))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on `keys`, where NULL is a key like others."""
    named = right.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(named, same).drop(*[f"__k_{k}" for k in keys])


def ordered(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, within: list[str] = (), rank: str | None = "rank") -> DataFrame:
    """Add a 1-based `rank` and, for each {new: source} in `sums`, the running total up to the row.

    `order` lists plain ascending columns that are never NULL and together identify a row within
    `within`; sort by a negated column for a descending order. All columns are shuffled, so give the keys only and join
    what is picked back to wide rows.
    """
    sums, within = sums or {}, list(within)
    base = _in_order(df, [*within, *order])
    mine = [*within, "__part"]
    totals = base.groupBy(*mine).agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"), *[
        F.sum(F.col(src).cast("double")).alias(f"__t_{n}") for n, src in sums.items()])
    # one row per partition, and one more per group
    ahead = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = [(F.coalesce(F.sum("__rows").over(ahead), F.lit(0)) - F.col("__first") + 1).alias("__o")] if rank else []
    offsets = totals.select(*mine, *shift, *[F.coalesce(F.sum(f"__t_{n}").over(ahead), F.lit(0.0)).alias(f"__o_{n}") for n in sums])
    own = Window.partitionBy(*mine).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    run = base.select("*", *[F.sum(F.col(src).cast("double")).over(own).alias(f"__w_{n}") for n, src in sums.items()])
    joined = _beside(run, offsets, mine)
    return joined.select(*df.columns, *([(F.col("__at") + F.col("__o")).alias(rank)] if rank else []),
                         *[(F.col(f"__w_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], within: list[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles of `value`, one column per {name: p}, per `within` group.

    Equal values are counted together first, and rows that have a count `__n` already stand for so many. The distinct values are then put in order, and those that cover the
    wanted positions are picked, so no task holds all values of a group.
    """
    within = list(within)
    run = ordered(_value_counts(df, value, within), ["__v"], {"__upto": "__n"}, within, rank=None)
    if within:
        spread = _beside(run, run.groupBy(*within).agg(F.sum("__n").alias("__total")), within)
    else:
        spread = run.withColumn("__total", run.agg(F.sum("__n")).scalar())
    return (spread.groupBy(*within) if within else spread).agg(*_picked(probs))


def group_quantiles(df: DataFrame, value: str, probs: dict[str, float], within: list[str]) -> DataFrame:
    """`quantiles` for many groups whose rows lie together already, such as documents: the values of a group stay in its task, counted."""
    run = Window.partitionBy(*within).orderBy("__v")
    counts = _value_counts(df, value, within).withColumn("__upto", F.sum("__n").over(run))
    return counts.withColumn("__total", F.sum("__n").over(Window.partitionBy(*within))).groupBy(*within).agg(*_picked(probs))


def _value_counts(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    many = F.sum("__n") if "__n" in df.columns else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*within, F.col(value).cast("double").alias("__v")).agg(many.alias("__n"))


def _picked(probs: dict[str, float]) -> list[Column]:
    """The quantiles from distinct values with their counts `__n`, the running `__upto` and the `__total` of the group."""
    aggs = []
    for n, p in probs.items():
        at = (F.col("__total") - 1) * F.lit(float(p))
        first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
        lo, hi = F.floor(at), F.ceil(at)
        low = F.max(F.when((first <= lo) & (lo <= last), F.col("__v")))
        high = F.max(F.when((first <= hi) & (hi <= last), F.col("__v")))
        frac = F.max(at - lo)
        aggs.append((low + (high - low) * frac).alias(n))
    return aggs


def column_quantiles(df: DataFrame, value: str, probs: dict[str, float], within: list[str]) -> DataFrame:
    """`quantiles` for few groups, such as one per column, without a shuffle of their values; the result is held on the driver.

    A quantile sketch gives two values around each wanted position. A second pass counts the values below and those between, by value. Where the
    counts show that a position lies elsewhere, which the sketch's error bound excludes, the values are put in order after all.
    """
    rows = df.where(F.col(value).isNotNull()).select(*within, F.col(value).cast("double").alias("__v"))
    ends = [e for p in probs.values() for e in (max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH))]
    bounds = localize(rows.groupBy(*within).agg(F.count("*").alias("__total"), F.percentile_approx("__v", ends, SKETCH).alias("__ends")))
    inf = float("inf")
    few = F.col("__total") <= 2 * SKETCH  # all values of such a group are counted
    near = [F.struct(F.lit(n).alias("__name"), F.lit(float(p)).alias("__p"), F.when(few | F.lit(ends[2 * i] == 0), -inf).otherwise(F.col("__ends")[2 * i]).alias("__lo"),
                     F.when(few | F.lit(ends[2 * i + 1] == 1), inf).otherwise(F.col("__ends")[2 * i + 1]).alias("__hi")) for i, (n, p) in enumerate(probs.items())]
    tried = _beside(rows, F.broadcast(bounds), within).select(*within, "__total", "__v", F.inline(F.array(*near))).where("__v <= __hi")
    inside = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    counts = freeze(tried.groupBy(*within, "__name", "__p", "__total", inside.alias("__v")).agg(F.count("*").alias("__n")))
    upto = Window.partitionBy(*within, "__name").orderBy(F.asc_nulls_first("__v"))  # the values between two ends of the sketch
    run = counts.withColumn("__last", F.sum("__n").over(upto) - 1).withColumn("__first", F.col("__last") - F.col("__n") + 1)
    at = (F.col("__total") - 1) * F.col("__p")
    low, high = (F.max(F.when((F.col("__first") <= x) & (x <= F.col("__last")), F.col("__v"))) for x in (F.floor(at), F.ceil(at)))
    found = run.groupBy(*within, "__name").agg(low.alias("__low"), high.alias("__high"), F.max(at - F.floor(at)).alias("__frac"))
    found = localize(found)
    if not found.where("__low is null or __high is null").isEmpty():
        return localize(quantiles(df, value, probs, within))
    middle = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__frac")
    return found.groupBy(*within).agg(*[F.max(F.when(F.col("__name") == n, middle)).alias(n) for n in probs])


def average_ranks(df: DataFrame, value: str, within: list[str] = ()) -> DataFrame:
    """(*within, value, avg_rank): the average 1-based rank of each distinct value in its group, ties sharing the mean."""
    many = F.sum("__n") if "__n" in df.columns else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*within, value).agg(many.alias("__n"))
    run = ordered(counts, [value], {"__upto": "__n"}, list(within), rank=None)
    return run.select(*within, value, (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias("avg_rank"))
