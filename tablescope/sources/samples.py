"""Samples that are the same on every run: exact random, systematic, and evenly spaced points of a series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col
from ..functions.ranking import ordered


def exact_sample(df: DataFrame, k: int, keys: list[str], seed: int = 7) -> DataFrame:
    """A uniform sample of exactly k rows (all when there are fewer), with the number of rows it was drawn from.

    The k smallest by a hash of their key are taken, so the result does not depend on the partitioning. Only hashes
    below a bound that leaves a few more than k rows are put in order. `keys` identify a row.
    """
    lottery = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in keys]))
    total = df.count()
    share = (k + 8 * k ** 0.5 + 16) / max(total, 1)
    few = df
    while share < 1:
        few = df.where(lottery <= f"{int(share * (1 << 128)):032x}")
        if few.count() >= k:
            break
        few, share = df, share * 2
    return few.orderBy(lottery, *keys).limit(k).withColumn("sampled_from", F.lit(total).cast("long"))


def row_budget(df: DataFrame, max_rows: int = 100_000, max_bytes: float = 3_800_000.0) -> DataFrame:
    """One row (rows, mean_bytes, cap): how many rows fit a payload, by the mean length of a row as JSON."""
    one = df.agg(F.count("*").alias("rows"), F.avg(F.length(F.to_json(F.struct(*[col(c) for c in df.columns])))).alias("mean_bytes"))
    fit = F.floor(F.lit(max_bytes) / F.greatest(F.col("mean_bytes"), F.lit(1.0)))
    return one.withColumn("cap", F.least(F.col("rows"), F.lit(max_rows).cast("long"), fit))


def _kept(idx: Column, n: Column, cap: Column) -> Column:
    """Index test of the set {floor(i·n/cap) : i < cap} without listing it."""
    i = F.ceil(idx * cap / n)
    return F.floor(i * n / cap) == idx


def systematic_sample(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """`cap` evenly spaced rows of the table in the given order; `order` identifies a row."""
    ranked = ordered(df.select(*order), order, rank="__rank")
    n = F.col("__n").cast("double")
    size = ranked.withColumn("__n", ranked.agg(F.count("*")).scalar())
    wanted = F.least(F.lit(float(cap)), n)
    picked = size.where(_kept((F.col("__rank") - 1).cast("double"), n, wanted)).select(*order)
    return picked if set(df.columns) == set(order) else df.join(picked, order, "left_semi")


def downsample(frame: DataFrame, order: str, points: int, series: list[str] = ()) -> DataFrame:
    """At most `points` evenly spaced rows of each period series."""
    w = Window.partitionBy(*(series or [F.lit(0)]))
    x = frame.withColumn("__i", (F.row_number().over(w.orderBy(order)) - 1).cast("double")).withColumn("__n", F.count("*").over(w).cast("double"))
    cap = F.least(F.lit(float(points)), F.col("__n"))
    return x.where(_kept(F.col("__i"), F.col("__n"), cap)).drop("__i", "__n")


def scatter_points(df: DataFrame, x: str, y: str, order: list[str], points: int = 300) -> DataFrame:
    """Every floor(n/points)-th complete pair in the given order."""
    pairs = df.where(col(x).isNotNull() & col(y).isNotNull()).select(*order, *[c for c in (x, y) if c not in order])
    ranked = ordered(pairs, order, rank="__rank")
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") / points))
    size = ranked.withColumn("__n", ranked.agg(F.count("*")).scalar())
    return size.where((F.col("__rank") - 1) % step == 0).drop("__rank", "__n")
