"""Grouped aggregation, shares, percentiles, cross-tabs and histograms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col, finite, label, long_dims, ratio
from ..functions.ranking import quantiles


def sum_by(df: DataFrame, dim: str, metric: str, top: int | None = 12) -> DataFrame:
    """(key, value): metric summed by a dimension, missing keys shown as '-', largest first."""
    out = df.groupBy(label(dim).alias("key")).agg(F.sum(finite(metric)).alias("value"))
    out = out.orderBy(F.desc("value"), "key")
    return out.limit(top) if top else out


def count_by(df: DataFrame, c: str, top: int | None = 15) -> DataFrame:
    """(key, n, share): rows by value, blanks skipped, with each value's share of the counted rows."""
    text = col(c).cast("string")
    counts = df.where(text != "").groupBy(text.alias("key")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    out = counts.withColumn("share", ratio(F.col("n"), total)).orderBy(F.desc("n"), "key")
    return out.limit(top) if top else out


AGGREGATES = ("sum", "mean", "max", "min", "median", "count", "distinct")


def aggregate(df: DataFrame, metric: str | None, agg: str) -> DataFrame:
    """One-row result of one aggregate."""
    return group_aggregate(df, [], metric, agg)


def group_aggregate(df: DataFrame, dims: list[str], metric: str | None, agg: str) -> DataFrame:
    """(dims…, value): one aggregate by any number of dimensions."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    keyed = df.select(*[label(d).alias(d) for d in dims], *([col(metric).alias("__m")] if metric else []))
    if agg == "median":
        typed = keyed.withColumn("__m", finite("__m"))
        return quantiles(typed, "__m", {"value": 0.5}, dims)
    if agg == "distinct":
        # two-step, so that one hot group is not gathered in one task
        seen = keyed.where(F.col("__m").isNotNull()).groupBy(*dims, "__m").agg(F.lit(1).alias("one"))
        return seen.groupBy(*dims).agg(F.count("*").cast("double").alias("value"))
    x = finite("__m") if metric else None
    how = {"sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "max": lambda: F.max(x), "min": lambda: F.min(x),
           "count": lambda: F.count("*").cast("double")}[agg]()
    return keyed.groupBy(*dims).agg(how.alias("value"))


def rank_groups(df: DataFrame, dim: str, metric: str, agg: str | None = None, additive: bool = True, top: int = 10,
                largest: bool = True) -> DataFrame:
    """Groups ranked by an aggregate; without one, additive metrics are summed and rates averaged."""
    out = group_aggregate(df, [dim], metric, agg or ("sum" if additive else "mean"))
    return out.orderBy(F.desc("value") if largest else F.asc("value"), dim).limit(top)


def share_of_total(df: DataFrame, pred: Column, metric: str | None = None) -> DataFrame:
    """Share of a slice in the whole, by metric sum or by rows, in one pass."""
    x = finite(metric) if metric else F.lit(1.0)
    one = df.agg(F.sum(F.when(pred, x)).alias("slice"), F.sum(x).alias("total"))
    return one.withColumn("share", ratio("slice", "total"))


def crosstab(df: DataFrame, d1: str, d2: str, metric: str | None, agg: str = "sum") -> DataFrame:
    """(d1, d2, value) of a metric by two dimensions."""
    return group_aggregate(df, [d1, d2], metric, agg if metric else "count")


def category_facts(df: DataFrame, dims: list[str], per_dim: int = 6, keep_dims: int = 4) -> DataFrame:
    """Leading value shares of each dimension; dimensions ordered by the share of their leader."""
    counts = top_values(df, dims, per_dim)
    leader = Window.partitionBy("dimension")
    led = counts.withColumn("leader_share", F.max("share").over(leader))
    names = (led.groupBy("dimension").agg(F.max("leader_share").alias("leader_share"))
             .orderBy(F.desc("leader_share"), "dimension").limit(keep_dims).select("dimension"))
    return led.join(F.broadcast(names), "dimension", "left_semi")


def top_values(df: DataFrame, dims: list[str], k: int = 12) -> DataFrame:
    """(dimension, key, n, share, rank): the k most frequent values of each dimension, share of non-missing rows."""
    counts = (long_dims(df, dims).where(F.col("key").isNotNull()).groupBy("dimension", "key")
              .agg(F.count("*").alias("n")))
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("total"))  # one row per dimension
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), "key")
    return (counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .join(F.broadcast(totals), "dimension")
            .select("dimension", "key", "n", ratio("n", "total").alias("share"), "rank"))


def histogram(df: DataFrame, metric: str, bins: int = 20, min_rows: int = 1) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; empty bins are listed, a constant has one bin."""
    x = df.select(finite(metric).alias("x")).where(F.col("x").isNotNull())
    r = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    spark = df.sparkSession
    if not r["n"] or r["n"] < min_rows:
        return spark.createDataFrame([], "bin long, low double, high double, n long")
    lo, hi = r["lo"], r["hi"]
    if hi == lo:
        bins = 1
    width = (hi - lo) / bins or 1.0
    number = F.least(F.lit(bins - 1).cast("long"), F.floor((F.col("x") - F.lit(lo)) / F.lit(width)))
    found = x.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    return (spark.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(found), "bin", "left")  # at most `bins` rows
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def compare_groups(df: DataFrame, dim: str, a: str, b: str, metric: str) -> DataFrame:
    """One row: totals and means of a metric for two values of a dimension, with the differences."""
    x, k = finite(metric), col(dim).cast("string")
    one = df.where(k.isin(a, b)).agg(
        F.sum(F.when(k == a, x)).alias("total_a"), F.sum(F.when(k == b, x)).alias("total_b"),
        F.avg(F.when(k == a, x)).alias("mean_a"), F.avg(F.when(k == b, x)).alias("mean_b"))
    return one.select("*", (F.col("total_b") - F.col("total_a")).alias("total_diff"),
                      (F.col("mean_b") - F.col("mean_a")).alias("mean_diff"),
                      ratio(F.col("total_b") - F.col("total_a"), F.abs("total_a")).alias("total_change"))


def compare_years(df: DataFrame, time: str, a: int, b: int, metric: str) -> DataFrame:
    from .relational import condition
    flagged = df.where(condition(df, time, "year", a) | condition(df, time, "year", b))
    return compare_groups(flagged.withColumn("__year", F.year(col(time)).cast("string")), "__year", str(a), str(b), metric)


def numeric_context(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, sum, mean, median, min, max, n) of every metric."""
    from ..functions.expr import long_metrics
    long = long_metrics(df, metrics).where(F.col("value").isNotNull())
    base = long.groupBy("metric").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"),
                                      F.max("value").alias("max"), F.count("*").alias("n"))
    return base.join(F.broadcast(quantiles(long, "value", {"median": 0.5}, ["metric"])), "metric")  # one row per metric
