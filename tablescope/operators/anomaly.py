"""Outliers, the difference between a long tail and an anomaly, and where outliers come from."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import finite, label, long_dims, long_metrics, ratio
from ..functions.ranking import column_quantiles
from ..session import localize


def metric_scale(df: DataFrame, metrics: list[str], method: str = "mad") -> DataFrame:
    """(metric, n, mean, sd, skew, median, mad) of each metric; median and MAD are exact, and no values are shuffled for them."""
    long = long_metrics(df, metrics).where(F.col("value").isNotNull())
    base = long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.skewness("value").alias("skew"))
    med = column_quantiles(long, "value", {"median": 0.5}, ["metric"])
    out = base.join(F.broadcast(med), "metric")  # one row a metric
    if method == "mad":
        away = long.join(F.broadcast(med), "metric").select("metric", F.abs(F.col("value") - F.col("median")).alias("away"))
        out = out.join(F.broadcast(column_quantiles(away, "away", {"mad": 0.5}, ["metric"])), "metric")
    else:
        out = out.withColumn("mad", F.lit(None).cast("double"))
    return localize(out)  # one row a metric


def scored(df: DataFrame, metrics: list[str], keep: list[str] = (), method: str = "mad", cutoff: float = 3.0,
           mad_cutoff: float = 3.5) -> DataFrame:
    """Rows with their outlier score per metric, and whether they are outliers.

    `mad`: .6745 (x - median) / MAD at 3.5, or the classic z at 3 where over half of the values are equal.
    `z`: by mean and sample standard deviation. Metrics with fewer than 8 values or without spread give no rows.
    """
    scale = metric_scale(df, metrics, method).where("n >= 8 and sd > 0")
    long = long_metrics(df, metrics, list(keep)).where(F.col("value").isNotNull())
    x = long.join(F.broadcast(scale), "metric")  # one row per metric
    robust = F.coalesce(F.col("mad") > 0, F.lit(False))
    score = F.when(robust, 0.6745 * (F.col("value") - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))).otherwise(
        (F.col("value") - F.col("mean")) / F.col("sd"))
    limit = F.when(robust, F.lit(mad_cutoff)).otherwise(F.lit(cutoff))
    return x.withColumn("score", score).withColumn("scale", F.when(robust, "mad").otherwise("std")).withColumn(
        "is_outlier", F.abs("score") >= limit)


def outliers(df: DataFrame, metrics: list[str], keep: list[str] = (), method: str = "mad") -> DataFrame:
    """The outlying values with their scores."""
    return scored(df, metrics, keep, method).where("is_outlier").select("metric", *keep, "value", "score")


def outlier_summary(df: DataFrame, metrics: list[str], method: str = "mad") -> DataFrame:
    """One row per metric with outliers: count, share, direction, strongest value, and whether it is a tail or anomalies.

    A tail ("skew") has 5 or more, 80% on one side, |skew| over 1 and a strongest value within 15 medians.
    """
    x = scored(df, metrics, method=method).where("is_outlier")
    one = x.groupBy("metric").agg(
        F.first("n").alias("rows"), F.count("*").alias("count"), F.count_if(F.col("score") > 0).alias("high"),
        F.max_by("value", F.struct(F.abs("score"), "value")).alias("strongest"),
        F.max_by("score", F.struct(F.abs("score"), "value")).alias("strongest_score"), F.first("skew").alias("skew"),
        F.first("mean").alias("mean"), F.first("median").alias("median"), F.first("sd").alias("sd"), F.first("scale").alias("scale"))
    low = F.col("count") - F.col("high")
    one_sided = F.greatest(F.col("high"), low) / F.col("count")
    tail = ratio(F.abs("strongest"), F.when(F.col("median") != 0, F.abs("median")).otherwise(1.0))
    is_tail = (F.col("count") >= 5) & (one_sided >= 0.8) & (F.abs("skew") > 1) & (tail <= 15)
    return one.select(
        "metric", "rows", "count", ratio("count", "rows").alias("share"), F.when(is_tail, "skew").otherwise("anomaly").alias("kind"),
        F.when((F.col("high") > 0) & (low > 0), "both").when(F.col("high") > 0, "high").otherwise("low").alias("direction"),
        "skew", "mean", "median", "sd", "scale", "strongest", "strongest_score")


def examples(df: DataFrame, metrics: list[str], k: int = 4, method: str = "mad") -> DataFrame:
    """The k strongest distinct outlying values per metric with how often they occur."""
    x = scored(df, metrics, method=method).where("is_outlier").groupBy("metric", "value", "score").agg(F.count("*").alias("n"))
    w = Window.partitionBy("metric").orderBy(F.desc(F.abs("score")), "value")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def anomalies(df: DataFrame, metrics: list[str], top: int = 6, method: str = "z") -> DataFrame:
    """Metrics whose outliers are anomalies and not a tail, most outliers first."""
    return (outlier_summary(df, metrics, method).where(F.col("kind") == "anomaly")
            .orderBy(F.desc("count"), "metric").limit(top))


def breakdown(df: DataFrame, metric: str, dims: list[str], method: str = "z", rows: int = 2,
              least: float = 1.3) -> DataFrame:
    """Root cause: (dimension, key, outliers, share, base_share, lift) of the dimension whose best value has the highest lift.

    Needs 3 outliers overall, 2 in the value, and a lift over `least`. All dimensions are tried in one shuffle.
    """
    keyed = df.select(*[label(d).alias(d) for d in dims], finite(metric).alias(metric))
    flagged = scored(keyed, [metric], dims, method)
    long = long_dims(flagged.select(*dims, F.col("is_outlier").cast("int").alias("__o")), dims, ["__o"])
    by = long.groupBy("dimension", "key").agg(F.sum("__o").alias("outliers"), F.count("*").alias("n"))
    totals = by.groupBy("dimension").agg(F.sum("outliers").alias("to"), F.sum("n").alias("tn"))
    x = by.join(F.broadcast(totals), "dimension").where("to >= 3 and outliers >= 2")  # one row per dimension
    x = x.withColumn("share", ratio("outliers", "to")).withColumn("base_share", ratio("n", "tn"))
    x = x.withColumn("lift", ratio("share", "base_share")).where(F.col("lift") > least)
    best = x.groupBy("dimension").agg(F.max("lift").alias("m")).orderBy(F.desc("m"), "dimension").limit(1)
    return (x.join(F.broadcast(best.select("dimension")), "dimension").orderBy(F.desc("lift"), "key").limit(rows)
            .select("dimension", "key", "outliers", "share", "base_share", "lift"))


def z_outliers(df: DataFrame, metric: str, threshold: float = 3.5) -> DataFrame:
    """Rows whose z score by mean and sample deviation reaches the threshold, with the score."""
    s = df.agg(F.avg(finite(metric)).alias("m"), F.stddev_samp(finite(metric)).alias("s"))
    stats = s.select(F.struct("m", "s")).scalar()
    z = (finite(metric) - stats.getField("m")) / F.nullif(stats.getField("s"), F.lit(0.0))
    return df.withColumn("z", z).where(F.abs("z") >= threshold)


def outlier_share(df: DataFrame, metrics: list[str], threshold: float = 3.5) -> DataFrame:
    """One row: number of finite cells and of cells with |z| at or over the threshold, over all metrics."""
    long = long_metrics(df, metrics).where(F.col("value").isNotNull())
    scale = long.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    x = long.join(F.broadcast(scale), "metric")  # one row per metric
    z = F.abs((F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)))
    return x.agg(F.count("*").alias("cells"), F.count_if(z >= threshold).alias("extreme"))


