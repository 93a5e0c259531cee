"""Headline figures as rows (id, name, value, relevance, …), most relevant first."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import finite, ratio
from ..functions.ranking import quantiles
from .timeseries import period_sums, trim_partial_tail


def _row(kid: str, name: str, value: Column, relevance: float, how: str, label: Column | None = None) -> Column:
    return F.struct(F.lit(kid).alias("id"), F.lit(name).alias("name"), value.cast("double").alias("value"),
                    (label if label is not None else F.lit(None).cast("string")).alias("label"),
                    F.lit(relevance).alias("relevance"), F.lit(how).alias("how_computed"))


def sales_kpis(df: DataFrame, revenue: str, quantity: str | None = None, cost: str | None = None,
               time: str | None = None) -> DataFrame:
    """Total, volume, average (with median), monthly trend, margin and best month of a revenue metric."""
    x = finite(revenue)
    one = df.agg(
        F.sum(x).alias("total"), F.avg(x).alias("mean"), F.count("*").alias("rows"),
        (F.sum(finite(quantity)) if quantity else F.lit(None).cast("double")).alias("units"),
        (F.sum(finite(cost)) if cost else F.lit(None).cast("double")).alias("cost"))
    med = quantiles(df.select(x.alias("__x")), "__x", {"m": 0.5})
    one = one.withColumn("median", med.scalar())
    rows = [_row("total", f"Total {revenue}", F.col("total"), 1.0, "sum over all rows"),
            _row("volume", f"Total {quantity}" if quantity else "Records", F.coalesce("units", F.col("rows").cast("double")), 0.95,
                 "sum of the quantity, else the row count"),
            _row("average", f"Average {revenue}", F.col("mean"), 0.8, "mean per row"),
            _row("median", f"Median {revenue}", F.col("median"), 0.8, "median per row")]
    if cost:
        margin = F.when((F.col("total") > 0) & (F.col("cost") > 0), (F.col("total") - F.col("cost")) / F.col("total"))
        rows.append(_row("margin", "Gross margin", margin, 0.92, "(revenue - cost) / revenue"))
    if time:
        months = period_sums(df, time, revenue, "monthly")
        trend, best = month_trend(months), months.agg(F.max_by(F.struct("label", "value"), F.struct(
            "value", -F.datediff("period", F.lit("1970-01-01")))))
        one = one.withColumn("trend", trend.scalar()).withColumn("best", best.scalar())
        rows += [_row("trend", f"Trend of {revenue}", F.col("trend"), 0.9, "last full month against a year or the start"),
                 _row("best_month", "Best month", F.col("best.value"), 0.6, "highest monthly total", F.col("best.label"))]
    return (one.select(F.inline(F.array(*rows))).where(F.col("value").isNotNull())
            .orderBy(F.desc("relevance"), "id"))


def top_performer(sellers: DataFrame, least: float = 0.15) -> DataFrame:
    """(dimension, key, share) of the best seller by revenue where it carries `least` of the whole."""
    return sellers.where((F.col("revenue_rank") == 1) & (F.col("revenue_share") >= least)).select("dimension", "key", F.col("revenue_share").alias("share"))


def month_trend(months: DataFrame) -> DataFrame:
    """Relative change of the last full month: against 12 months earlier when there are more than 12, else the first."""
    trimmed = trim_partial_tail(months)
    down, up = Window.partitionBy(F.lit(0)).orderBy(F.desc("period")), Window.partitionBy(F.lit(0)).orderBy("period")
    placed = trimmed.withColumn("back", F.row_number().over(down)).withColumn("pos", F.row_number().over(up))
    one = placed.agg(F.max(F.when(F.col("back") == 1, F.col("value"))).alias("last"),
                     F.max(F.when(F.col("back") == 13, F.col("value"))).alias("year_ago"),
                     F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("first"), F.count("*").alias("n"))
    base = F.when(F.col("n") > 12, F.col("year_ago")).otherwise(F.col("first"))
    return one.select(F.when(F.col("n") >= 2, ratio(F.col("last") - base, F.abs(base))).alias("trend"))


def spark_line(months: DataFrame, points: int = 40) -> DataFrame:
    """The last `points` full months in order."""
    return trim_partial_tail(months).orderBy(F.desc("period")).limit(points).select("label", "value")


def metric_kpis(metrics: DataFrame, has_revenue: bool = True) -> DataFrame:
    """Totals of additive metrics and averages of rates, from (metric, sum, mean, additive, rate_like, money); without a revenue metric
    averages of all others too."""
    total = F.col("additive")
    average = ~F.col("additive") & (F.col("rate_like") | F.lit(not has_revenue))
    value = F.when(total, F.col("sum")).when(average, F.col("mean"))
    relevance = F.when(total & F.col("money"), 0.7).when(total, 0.55).when(average & F.col("rate_like"), 0.62).when(average, 0.4)
    return metrics.where(total | average).select(
        F.concat(F.when(total, "total-").otherwise("average-"), F.col("metric")).alias("id"),
        value.alias("value"), relevance.alias("relevance"))


def financial_kpis(frame: DataFrame, series: list[str]) -> DataFrame:
    """Growth, compound growth per period, volatility and risk-adjusted return of each price series.

    `frame` has one row per (series, period) with `value`; returns over a zero base are skipped.
    """
    w = Window.partitionBy(*series).orderBy("period")
    moved = frame.withColumn("ret", ratio(F.col("value") - F.lag("value").over(w), F.lag("value").over(w)))
    one = moved.groupBy(*series).agg(
        F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), F.count("*").alias("n"),
        F.stddev_samp("ret").alias("volatility"), F.avg("ret").alias("mean_return"))
    growth = ratio(F.col("last") - F.col("first"), F.abs("first"))
    cagr = F.when((F.col("first") > 0) & (F.col("n") > 1),
                  F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("n") - 1)) - 1)
    return one.select(*series, "n", "first", "last", growth.alias("growth"), cagr.alias("cagr"),
                      F.coalesce("volatility", F.lit(0.0)).alias("volatility"),
                      ratio("mean_return", "volatility").alias("risk_adjusted"))
