"""Tidy frames behind charts: one frame per chart kind, drawn by the caller."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import concentration, forecast, grouping, stats, timeseries
from ..sources.samples import scatter_points


def line(df: DataFrame, time: str, metric: str | None, cadence: str = "monthly") -> DataFrame:
    """(label, value): a metric by period, or the number of rows without one."""
    if metric is None:
        df, metric = df.withColumn("__rows", F.lit(1.0)), "__rows"
    return timeseries.trim_partial_tail(timeseries.period_sums(df, time, metric, cadence)).select("label", "value")


def bar(df: DataFrame, dimension: str, metric: str | None, agg: str = "sum", top: int = 12) -> DataFrame:
    """(key, value): a metric by category, or the number of rows without one."""
    if metric is None:
        return grouping.count_by(df, dimension, top).select("key", F.col("n").cast("double").alias("value"))
    out = grouping.group_aggregate(df, [dimension], metric, agg).select(F.col(dimension).alias("key"), "value")
    return out.orderBy(F.desc("value"), "key").limit(top)


def pie(df: DataFrame, dimension: str, metric: str | None = None, top: int = 12) -> DataFrame:
    """(key, value, share) with the rest of the categories as "Other"."""
    dims = concentration.dimension_totals(df, [dimension], [metric] if metric else [], count_rows=metric is None)
    return concentration.segments(concentration.ranked_totals(dims), top).select("key", "value", "share", "is_other")


def stacked(df: DataFrame, d1: str, d2: str, metric: str | None) -> DataFrame:
    return grouping.crosstab(df, d1, d2, metric)


def build(df: DataFrame, kind: str, x: str, y: str | None = None, agg: str = "sum", order: list[str] | None = None) -> DataFrame:
    """Chart data for an explicit request; x = y falls back to a histogram of x."""
    if kind == "histogram" or x == y:
        return grouping.histogram(df, x)
    if kind == "scatter":
        return scatter_points(df, x, y, order or [x, y])
    if kind == "pie":
        return pie(df, x, y)
    if kind == "line":
        return line(df, x, y, timeseries.detect_cadence(df, x))
    if kind == "bar":
        return bar(df, x, y, agg)
    raise ValueError(f"unknown chart {kind!r}")


def recommend(df: DataFrame, metrics: list[str], dims: list[str], time: str | None, revenue: str | None, strongest: tuple[str, str] | None = None,
              order: list[str] | None = None) -> dict[str, DataFrame]:
    """Frames worth drawing for a table with these roles: `dims` of 2 to 25 values; `strongest` is the pair of metrics to scatter."""
    out: dict[str, DataFrame] = {}
    main = revenue or (metrics[0] if metrics else None)
    if time and main:
        out["line"] = line(df, time, main)
        months = timeseries.trim_partial_tail(timeseries.period_sums(df, time, main)).withColumn("series", F.lit(main))
        out["forecast"] = forecast.history_and_forecast(months, forecast.forecast(months, ["series"]), ["series"])
    if dims and main:
        out["bar"] = bar(df, dims[0], main)
    if main:
        out["histogram"] = grouping.histogram(df, main, bins=12, min_rows=20)
    for d in dims:
        out[f"frequency_{d}"] = grouping.count_by(df, d)
    if len(metrics) > 1:
        out["heatmap"] = stats.relationships(df, metrics)
    if strongest:
        out["scatter"] = scatter_points(df, *strongest, order or list(strongest))
    return out
