"""Period frames and what is read off them: changes, averages, swings, seasonality, trends, contributions.

A period frame has one row per (series…, period): `period` (start), `label`, `value`. Periods are calendar
units, so one series stays small however many rows it was summed from.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col, finite, label, long_metrics, ratio, rnd
from ..functions.tails import p_t

UNIT = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}
SEASON = {"daily": 365, "weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}
AVERAGE_OVER = {"daily": 7, "weekly": 3, "monthly": 3, "quarterly": 4, "yearly": 3}


def month_by_segment(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Monthly revenue and orders by market segment, with each segment's share of its month."""
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM")
    by = joined.groupBy(month.alias("month"), F.col("c_mktsegment").alias("segment")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count("*").alias("orders"))
    share = ratio(F.col("revenue"), F.sum("revenue").over(Window.partitionBy("month")))
    return by.select("month", "segment", rnd("revenue", 2).alias("revenue"), "orders",
                     rnd(share, 6).alias("share_of_month"))


def detect_cadence(df: DataFrame, time: str) -> str:
    """daily, weekly, monthly, quarterly or yearly, by the median gap between consecutive distinct times.

    When there are over twice as many distinct times as days, most gaps lie within a day, and no sort of
    the times is needed. Otherwise their number is bounded by the days of the calendar.
    """
    times = df.where(col(time).isNotNull()).select(col(time).cast("timestamp_ntz").alias("t")).distinct()
    n = times.agg(F.count("*").alias("times"), F.count_distinct(F.to_date("t")).alias("days")).first()
    if n["times"] >= 2 * n["days"] + 2:
        return "daily"
    w = Window.partitionBy(F.lit(0)).orderBy("t")
    # NTZ timestamps have no epoch cast: the date part and the clock part are subtracted on their own
    seconds = F.datediff(F.to_date("t"), F.lit("1970-01-01")) * 86400.0 + (
        F.hour("t") * 3600 + F.minute("t") * 60 + F.extract(F.lit("SECOND"), F.col("t")).cast("double"))
    gaps = times.select(((seconds - F.lag(seconds).over(w)) / 86400.0).alias("gap")).where("gap > 0")
    gap = gaps.agg(F.median("gap").alias("g")).first()["g"]
    gap = 30.0 if gap is None else gap
    for limit, name in ((1.5, "daily"), (10, "weekly"), (45, "monthly"), (130, "quarterly")):
        if gap <= limit:
            return name
    return "yearly"


def period_start(time: str | Column, cadence: str) -> Column:
    return F.date_trunc(UNIT[cadence], col(time)).cast("date")


def period_label(start: Column, cadence: str) -> Column:
    if cadence == "weekly":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), start).cast("int"), F.weekofyear(start))
    if cadence == "quarterly":
        return F.concat(F.year(start).cast("string"), F.lit("-Q"), F.quarter(start).cast("string"))
    return F.date_format(start, {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}[cadence])


def period_sums(df: DataFrame, time: str, metric: str, cadence: str = "monthly", series: list[str] = ()) -> DataFrame:
    """(series…, period, label, value, n): the metric summed per observed period; gaps are not filled."""
    start = period_start(time, cadence)
    kept = df.where(col(time).isNotNull())
    by = kept.groupBy(*[label(s).alias(s) for s in series], start.alias("period")).agg(
        F.coalesce(F.sum(finite(metric)), F.lit(0.0)).alias("value"), F.count("*").alias("n"))
    return by.withColumn("label", period_label(F.col("period"), cadence))


def metric_period_sums(df: DataFrame, time: str, metrics: list[str], cadence: str = "monthly", averaged: list[str] = ()) -> DataFrame:
    """Period frame with one series per metric, in one shuffle; metrics in `averaged` (rates, ages) by their mean."""
    kept = df.where(col(time).isNotNull()).withColumn("__period", period_start(time, cadence))
    long = long_metrics(kept, metrics, ["__period"])
    value = F.when(F.col("metric").isin(*averaged), F.avg("value")).otherwise(F.coalesce(F.sum("value"), F.lit(0.0)))
    by = long.groupBy("metric", F.col("__period").alias("period")).agg(value.alias("value"), F.count("*").alias("n")).where("value is not null")
    return by.withColumn("label", period_label(F.col("period"), cadence))


def _over(series: list[str]) -> Window:
    return Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))


def trim_partial_tail(frame: DataFrame, series: list[str] = ()) -> DataFrame:
    """The last period dropped where it is under half the median of the ones before it (4 periods or more)."""
    whole = _over(list(series))
    marked = (frame.withColumn("__n", F.count("*").over(whole))
              .withColumn("__last", F.col("period") == F.max("period").over(whole)))
    prior = F.median(F.when(~F.col("__last"), F.col("value"))).over(whole)
    marked = marked.withColumn("__prior", prior)
    partial = F.col("__last") & (F.col("__n") >= 4) & (F.col("value") < 0.5 * F.col("__prior"))
    return marked.where(~F.coalesce(partial, F.lit(False))).drop("__n", "__last", "__prior")


def changes(frame: DataFrame, cadence: str, series: list[str] = (), calendar: bool = False) -> DataFrame:
    """Per period: position, change to the one before, to a year before, and trailing moving average.

    A year before is counted in positions (365, 52, 12 or 4 periods back), as observed periods are; with
    `calendar` it is the same calendar period one year earlier, and missing where that was not observed.
    """
    series = list(series)
    w = _over(series).orderBy("period")
    span = AVERAGE_OVER[cadence]
    out = (frame.withColumn("pos", F.row_number().over(w).cast("long"))
           .withColumn("previous", F.lag("value", 1).over(w)))
    if calendar:
        last_year = frame.select(*series, F.add_months("period", 12).alias("period"), F.col("value").alias("year_ago"))
        out = out.join(last_year, [*series, "period"], "left")
    else:
        out = out.withColumn("year_ago", F.lag("value", SEASON[cadence]).over(w))
    n = F.count("*").over(_over(series))
    width = F.greatest(F.lit(2), F.least(F.lit(span), n))
    full = F.avg("value").over(w.rowsBetween(-(span - 1), 0))
    short = F.avg("value").over(w.rowsBetween(-1, 0))
    average = F.when(width == span, full).when(width == 2, short)
    for size in range(3, span):
        average = average.when(width == size, F.avg("value").over(w.rowsBetween(-(size - 1), 0)))
    return (out.withColumn("moving_average", F.when(F.col("pos") >= width, average))
            .withColumn("change", ratio(F.col("value") - F.col("previous"), F.abs("previous")))
            .withColumn("year_change", ratio(F.col("value") - F.col("year_ago"), F.abs("year_ago"))))


def best_and_worst(frame: DataFrame, series: list[str] = ()) -> DataFrame:
    """Highest and lowest period of each series; the first wins ties."""
    day = F.datediff("period", F.lit("1970-01-01"))
    high, low = F.struct("value", -day), F.struct("value", day)
    return frame.groupBy(*series).agg(
        F.max_by("label", high).alias("best"), F.max("value").alias("best_value"),
        F.min_by("label", low).alias("worst"), F.min("value").alias("worst_value"))


def biggest_swing(frame: DataFrame, series: list[str] = ()) -> DataFrame:
    """Largest relative move between neighbours; notable at 20% or more and 2.5 times the median move."""
    w = _over(list(series)).orderBy("period")
    moves = (frame.withColumn("from_label", F.lag("label").over(w)).withColumn("from_value", F.lag("value").over(w))
             .withColumn("move", ratio(F.col("value") - F.col("from_value"), F.abs("from_value")))
             .withColumn("pos", F.row_number().over(w)))
    best = F.when(F.col("move").isNotNull(), F.struct(F.abs("move").alias("size"), (-F.col("pos")).alias("first")))
    one = moves.groupBy(*series).agg(
        F.max_by(F.struct("from_label", F.col("label").alias("to_label"), "move"), best).alias("m"),
        F.median(F.abs("move")).alias("typical"), F.count("move").alias("moves"), F.count("*").alias("n"))
    return one.where("n >= 4 and moves >= 2").select(
        *series, "m.from_label", "m.to_label", F.col("m.move").alias("change"), "typical",
        ((F.abs("m.move") >= 0.2) & (F.abs("m.move") >= 2.5 * F.col("typical"))).alias("notable"))


_CYCLE = {"monthly": (12, F.month), "quarterly": (4, F.quarter), "daily": (7, F.dayofweek)}


def seasonality(frame: DataFrame, cadence: str, series: list[str] = ()) -> DataFrame:
    """(series…, position, index, strength, peak, trough, seasonal): mean of each cycle position over the overall mean.

    Series with fewer than two cycles or with a missing position are left out; seasonal means a peak of 1.15 or more.
    """
    cycle, part = _CYCLE[cadence]
    series = list(series)
    overall = frame.groupBy(*series).agg(F.avg("value").alias("mean"), F.count("*").alias("n"),
                                         F.count_distinct(part("period")).alias("seen"))
    by = frame.groupBy(*series, part("period").cast("long").alias("position")).agg(F.avg("value").alias("m"))
    if series:
        joined = by.join(overall, series)
    else:
        joined = by.withColumn("__o", overall.agg(F.first(F.struct("mean", "n", "seen"))).scalar()).select(
            "*", "__o.*").drop("__o")
    w = _over(series)
    out = joined.where((F.col("n") >= 2 * cycle) & (F.col("seen") == cycle)).withColumn("index", ratio("m", "mean"))
    peak, trough = F.struct("index", -F.col("position")), F.struct("index", "position")
    return (out.withColumn("peak", F.max_by("position", peak).over(w)).withColumn("trough", F.min_by("position", trough).over(w))
            .withColumn("strength", F.max("index").over(w) - F.min("index").over(w))
            .withColumn("seasonal", F.max("index").over(w) >= 1.15).drop("m", "mean", "n", "seen"))


def trend_test(frame: DataFrame, series: list[str] = (), p_value: bool = True) -> DataFrame:
    """OLS slope on the position with a Newey-West (Bartlett) standard error, per series.

    The lag count is floor(4 (n/100)^(2/9)), at least 1 and at most n - 2. The products at a lag
    are taken over the series' own array of periods, so every series has just the lags that it needs.
    """
    series = list(series)
    w = _over(series).orderBy("period")
    t = frame.withColumn("t", (F.row_number().over(w) - 1).cast("double"))
    whole = _over(series)
    n = F.count("*").over(whole)
    fitted = t.select(*series, "period", "t", "value", n.alias("n"), (F.col("t") - (n - 1) / 2).alias("dt"),
                      (F.col("value") - F.avg("value").over(whole)).alias("dv"), F.avg("value").over(whole).alias("mean"))
    sxx = F.sum(F.col("dt") * F.col("dt")).over(whole)
    slope = F.sum(F.col("dt") * F.col("dv")).over(whole) / F.nullif(sxx, F.lit(0.0))
    resid = fitted.withColumn("sxx", sxx).withColumn("slope", slope).withColumn(
        "e", F.col("dv") - F.col("slope") * F.col("dt")).withColumn("u", F.col("dt") * F.col("e"))
    lags = F.greatest(F.lit(1.0), F.least(F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))), F.col("n") - 2))
    one = resid.withColumn("L", lags).withColumn("e1", F.lag("e").over(w)).groupBy(*series).agg(
        F.first("n").alias("n"), F.first("slope").alias("slope"), F.first("sxx").alias("sxx"), F.first("mean").alias("mean"),
        F.transform(F.sort_array(F.collect_list(F.struct("t", "u"))), lambda s: s["u"]).alias("us"), F.first("L").alias("L"),
        F.sum(F.col("u") ** 2).alias("uu"), F.sum(F.col("e") ** 2).alias("sse"), F.sum(F.col("dv") ** 2).alias("sst"),
        F.sum(F.col("e") * F.col("e1")).alias("ee"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)

    def at_lag(k: Column) -> Column:
        left, right = F.slice("us", k + 1, F.size("us") - k), F.slice("us", F.lit(1), F.size("us") - k)
        return (1 - k / (F.col("L") + 1)) * total(F.zip_with(left, right, lambda a, b: F.coalesce(a * b, F.lit(0.0))))

    lagged = F.transform(F.sequence(F.lit(1), F.col("L").cast("int")), at_lag)
    one = one.where("n >= 4").withColumn("meat", F.col("uu") + 2 * total(lagged))
    se = F.sqrt(F.greatest(F.col("meat"), F.lit(0.0))) / F.col("sxx")
    start = F.col("mean") - F.col("slope") * (F.col("n") - 1) / 2
    out = one.where("n >= 4").select(
        *series, "n", "slope", se.alias("se"), ratio(F.col("slope"), se).alias("t"),
        F.coalesce(1 - ratio("sse", "sst"), F.lit(0.0)).alias("r2"), F.coalesce(ratio("ee", "sse"), F.lit(0.0)).alias("autocorrelation"),
        start.alias("fitted_start"), (start + F.col("slope") * (F.col("n") - 1)).alias("fitted_end"),
        ratio(F.col("slope") * (F.col("n") - 1), F.abs(start)).alias("fitted_change"))
    if p_value:
        out = out.withColumn("p", p_t(F.col("t"), F.col("n") - 2))
    return out


def trend_summary(frame: DataFrame, cadence: str, series: list[str] = (), p_value: bool = True) -> DataFrame:
    """One row per series: latest value, changes, best and worst period, direction, trend test and R²."""
    series = list(series)
    points = changes(frame, cadence, series)
    latest = points.groupBy(*series).agg(F.max_by(F.struct("label", "value", "change", "year_change"), "pos").alias("z")).select(
        *series, F.col("z.label").alias("latest"), F.col("z.value").alias("latest_value"), "z.change", "z.year_change")
    ends = best_and_worst(frame, series)
    test = trend_test(frame, series, p_value)
    if series:
        out = latest.join(ends, series).join(test, series)
    else:
        key = F.lit(0).alias("__k")
        out = (latest.select("*", key).join(ends.select("*", key), "__k").join(test.select("*", key), "__k").drop("__k"))
    direction = F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat")
    return out.withColumn("direction", direction)


def _classical(period: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        """Share of the detrended variance that a repeating season explains (classical moving-average split)."""
        pdf = pdf.sort_values("period")
        x = pdf["value"].to_numpy(dtype=float)
        row = pdf.iloc[:1].drop(columns=["period", "value", "label", "n"], errors="ignore").reset_index(drop=True)
        strength = None
        if len(x) >= 2 * period:
            s = pd.Series(x)
            if period % 2:
                trend = s.rolling(period, center=True).mean()
            else:
                trend = s.rolling(period).mean().rolling(2).mean().shift(-period // 2)
            detrended = s - trend
            season = detrended.groupby(s.index % period).transform("mean")
            season = season - season.iloc[:period].mean()
            resid = (detrended - season).dropna()
            both = (resid + season.loc[resid.index]).var(ddof=0)
            strength = max(0.0, 1.0 - resid.var(ddof=0) / both) if both > 0 else 0.0
        row["seasonal_strength_classical"] = strength
        return row
    return one


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def loess(y: np.ndarray, window: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Locally linear fits of a series on a regular grid: at each place the `window` nearest points count by the tricube of their distance.

    Places may lie one step outside. All fits are made at once, on a (places, window) matrix.
    """
    n, q = len(y), min(window, len(y))
    left = np.clip(at - (q - 1) // 2, 0, n - q)
    near = left[:, None] + np.arange(q)
    x = near.astype(float)
    reach = np.maximum(at - left, left + q - 1 - at).astype(float) + (max(window - n, 0) // 2)
    apart = np.abs(x - at[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        cube = (1 - (apart / reach[:, None]) ** 3) ** 3
    w = np.where(apart <= 0.001 * reach[:, None], 1.0, np.where(apart <= 0.999 * reach[:, None], cube, 0.0))
    w = w if weights is None else w * weights[near]
    total = w.sum(1)
    usable = total > 0
    w = w / np.where(usable, total, 1)[:, None]
    centre = (w * x).sum(1)
    spread = (w * (x - centre[:, None]) ** 2).sum(1)
    slope = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / np.where(spread > 0, spread, 1), 0.0)
    fit = (w * (1 + slope[:, None] * (x - centre[:, None])) * y[near]).sum(1)
    return np.where(usable, fit, y[np.clip(at, 0, n - 1)])


def _mean_of(x: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[length:] - sums[:-length]) / length


def robust_seasons(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(season, trend) of a series: seasonal-trend decomposition by LOESS. Each of `outer` rounds gives points far from the fit less weight."""
    n = len(y)
    trend_window, low_window = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)
    season, trend, weights, every = np.zeros(n), np.zeros(n), None, np.arange(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            rest, cycle = y - trend, np.zeros(n + 2 * period)
            for phase in range(period):
                own = rest[phase::period]
                cycle[phase::period] = loess(own, seasonal, np.arange(-1, len(own) + 1), None if weights is None else weights[phase::period])
            low = _mean_of(_mean_of(_mean_of(cycle, period), period), 3)
            season = cycle[period:period + n] - loess(low, low_window, every)
            trend = loess(y - season, trend_window, every, weights)
        if turn < outer:
            away = np.abs(y - season - trend)
            limit = 6 * np.median(away)
            with np.errstate(divide="ignore", invalid="ignore"):
                bent = (1 - (away / limit) ** 2) ** 2
            weights = np.where(away <= 0.001 * limit, 1.0, np.where(away <= 0.999 * limit, bent, 0.0))
    return season, trend


def _robust(period: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        y = pdf["value"].to_numpy(dtype=float)
        row = pdf.iloc[:1].drop(columns=["period", "value"]).reset_index(drop=True)
        strength = None
        if len(y) >= 2 * period and not np.isnan(y).any():
            season, trend = robust_seasons(y, period)
            rest = y - season - trend
            both = (rest + season).var()
            strength = max(0.0, 1.0 - rest.var() / both) if both > 0 else 0.0
        row["seasonal_strength"] = strength
        return row
    return one


def seasonal_strength(frame: DataFrame, period: int, series: list[str]) -> DataFrame:
    """1 - var(residual) / var(residual + season) per series, by robust STL; NULL under two cycles or with unknown values."""
    slim = frame.select(*series, "period", "value")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in series)
    return slim.groupBy(*series).applyInPandas(_robust(period), f"{schema}, seasonal_strength double")


def classical_strength(frame: DataFrame, period: int, series: list[str]) -> DataFrame:
    """The same share by a classical moving-average decomposition."""
    slim = frame.select(*series, "period", "value")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in series)
    return slim.groupBy(*series).applyInPandas(_classical(period), f"{schema}, seasonal_strength_classical double")


def last_two_periods(df: DataFrame, time: str, cadence: str) -> tuple:
    """Starts of the last two observed periods (two small aggregates)."""
    start = period_start(time, cadence)
    last = df.agg(F.max(start).alias("m")).first()["m"]
    prev = df.where(start < F.lit(last)).agg(F.max(start).alias("m")).first()["m"] if last else None
    return prev, last


def contributions(df: DataFrame, time: str, metric: str, dims: list[str], cadence: str | None = None, top: int = 8,
                  keep_dims: int | None = None) -> DataFrame:
    """Who moved the total between the last two periods, for each dimension; the tail is rolled into "Other (k)".

    All dimensions share one shuffle. With `keep_dims` only the dimensions whose largest segment explains most stay.
    """
    from ..functions.expr import long_dims
    cadence = cadence or detect_cadence(df, time)
    prev, last = last_two_periods(df, time, cadence)
    start = period_start(time, cadence)
    two = df.where(start.isin(prev, last)).select(*[label(d).alias(d) for d in dims], finite(metric).alias("__v"),
                                                  start.alias("__p"))
    long = long_dims(two, dims, ["__v", "__p"])
    seg = long.groupBy("dimension", "key").agg(
        F.coalesce(F.sum(F.when(F.col("__p") == F.lit(prev), F.col("__v"))), F.lit(0.0)).alias("prev"),
        F.coalesce(F.sum(F.when(F.col("__p") == F.lit(last), F.col("__v"))), F.lit(0.0)).alias("latest"))
    seg = seg.withColumn("delta", F.col("latest") - F.col("prev"))
    totals = seg.groupBy("dimension").agg(F.sum("prev").alias("tp"), F.sum("latest").alias("tl"),
                                          F.sum(F.abs("delta")).alias("moved"), F.max(F.abs("delta")).alias("biggest"),
                                          F.count("*").alias("segments"))
    # only the first `top` need a rank: Spark cuts each task to `top` rows before the shuffle
    w = Window.partitionBy("dimension").orderBy(F.desc(F.abs("delta")), "key")
    head = seg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    led = head.join(F.broadcast(totals), "dimension")  # one row per dimension
    shown = led.select("dimension", "key", "prev", "latest", "delta", "tp", "tl", "rank", F.lit(False).alias("other"))
    rest = (led.groupBy("dimension").agg(F.first("tp").alias("tp"), F.first("tl").alias("tl"), F.first("segments").alias("segments"),
                                         F.sum("prev").alias("hp"), F.sum("latest").alias("hl"))
            .where(F.col("segments") > top)
            .select("dimension", F.format_string("Other (%d)", F.col("segments") - top).alias("key"),
                    (F.col("tp") - F.col("hp")).alias("prev"), (F.col("tl") - F.col("hl")).alias("latest"),
                    (F.col("tl") - F.col("hl") - F.col("tp") + F.col("hp")).alias("delta"), "tp", "tl",
                    F.lit(top + 1).alias("rank"), F.lit(True).alias("other")))
    out = shown.unionByName(rest)
    eps = 1e-9 * (F.abs("tp") + F.abs("tl") + 1)
    change = F.col("tl") - F.col("tp")
    status = (F.when(~F.col("other") & (F.col("prev") == 0) & (F.col("latest") != 0), "new")
              .when(~F.col("other") & (F.col("latest") == 0) & (F.col("prev") != 0), "lost")
              .when(F.abs("delta") <= eps, "flat").when(F.col("delta") > 0, "grew").otherwise("shrank"))
    out = out.select(
        "dimension", "key", "prev", "latest", "delta",
        F.when(F.abs(change) > eps, F.col("delta") / change).otherwise(0.0).alias("contribution"),
        F.coalesce(ratio("prev", "tp"), F.lit(0.0)).alias("share_prev"),
        F.coalesce(ratio("latest", "tl"), F.lit(0.0)).alias("share_latest"), status.alias("status"))
    if keep_dims:
        best = (totals.withColumn("power", ratio("biggest", "moved")).orderBy(F.desc("power"), "dimension")
                .limit(keep_dims).select("dimension"))
        out = out.join(F.broadcast(best), "dimension", "left_semi")
    return out
