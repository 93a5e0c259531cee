"""Forecasts of many series at once: each series is one small group, smoothed inside a task."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import ratio

GRID = np.arange(1, 10) / 10.0


def holt(x: np.ndarray, horizon: int) -> dict:
    """Linear trend smoothing; all 81 (alpha, beta) pairs advance together, the first pair with the least error wins."""
    alpha, beta = (g.ravel() for g in np.meshgrid(GRID, GRID, indexing="ij"))
    level, trend = np.full(alpha.size, x[0]), np.full(alpha.size, x[1] - x[0])
    sse = np.zeros(alpha.size)
    for value in x[1:]:
        ahead = level + trend
        sse += (value - ahead) ** 2
        fresh = alpha * value + (1 - alpha) * ahead
        trend = beta * (fresh - level) + (1 - beta) * trend
        level = fresh
    i = int(np.argmin(sse))
    m = len(x) - 1
    return {"method": "holt", "alpha": alpha[i], "beta": beta[i], "gamma": None, "season": None,
            "residual_std": float(np.sqrt(sse[i] / (m - 1))) if m > 1 else 0.0,
            "forecast": level[i] + trend[i] * np.arange(1, horizon + 1)}


def holt_winters(x: np.ndarray, horizon: int, period: int) -> dict:
    """Additive seasonal smoothing over the 729 (alpha, beta, gamma) triples at once."""
    alpha, beta, gamma = (g.ravel() for g in np.meshgrid(GRID, GRID, GRID, indexing="ij"))
    n = len(x)
    level = np.full(alpha.size, x[:period].mean())
    trend = np.full(alpha.size, (x[period:2 * period] - x[:period]).mean() / period)
    season = np.repeat((x[:period] - x[:period].mean())[:, None], alpha.size, axis=1)  # ring of the last cycle
    sse = np.zeros(alpha.size)
    for t in range(period, n):
        s = season[t % period]
        ahead = level + trend + s
        sse += (x[t] - ahead) ** 2
        fresh = alpha * (x[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (fresh - level) + (1 - beta) * trend
        level = fresh
        season[t % period] = gamma * (x[t] - level) + (1 - gamma) * s
    i = int(np.argmin(sse))
    m = n - period
    steps = np.arange(1, horizon + 1)
    # the ring holds the last value of each cycle position; step h falls on position (n + h - 1) mod period
    seasonal = season[(n - 1 + steps) % period, i]
    return {"method": "holt-winters", "alpha": alpha[i], "beta": beta[i], "gamma": gamma[i], "season": period,
            "residual_std": float(np.sqrt(sse[i] / (m - 1))) if m > 1 else 0.0,
            "forecast": level[i] + steps * trend[i] + seasonal}


def _smoothed(x: np.ndarray, params: np.ndarray, period: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared error, first states, last states) of additive smoothing for each row (alpha, beta[, gamma]) of `params`.

    The errors are linear in the first states, so these are not searched: the smoother runs once on the series from zero states and
    once from each unit state, all rows side by side, and least squares gives the best first states of each row. States are level, trend and the
    seasons of a cycle but the last, which makes their sum zero.
    """
    a, b = params[:, 0, None], params[:, 1, None]
    c = params[:, 2, None] if period else None
    m = 2 + (period - 1 if period else 0)
    rows, unit = len(params), np.eye(m)
    level, trend = (np.tile(np.concatenate([[0.0], unit[k]]), (rows, 1)) for k in (0, 1))
    if period:
        ring = np.zeros((period, rows, 1 + m))
        for k in range(period - 1):
            ring[k, :, 3 + k], ring[period - 1, :, 3 + k] = 1.0, -1.0
    errors = np.empty((rows, len(x), 1 + m))
    for t, value in enumerate(x):
        ahead = level + trend
        season = ring[t % period] if period else 0.0
        error = -(ahead + season)
        error[:, 0] += value
        errors[:, t] = error
        fresh = ahead + a * error
        trend = trend + b * (fresh - level - trend)
        level = fresh
        if period:
            seen = -level
            seen[:, 0] += value
            ring[t % period] = season + c * (seen - season)
    # errors = first column + rest @ states
    rest, target = errors[:, :, 1:], -errors[:, :, 0]
    gram = rest.transpose(0, 2, 1) @ rest
    gram += 1e-10 * np.trace(gram, axis1=1, axis2=2)[:, None, None] / m * np.eye(m)
    states = np.linalg.solve(gram, (rest.transpose(0, 2, 1) @ target[:, :, None]))[:, :, 0]
    both = np.concatenate([np.ones((rows, 1)), states], axis=1)
    sse = ((errors @ both[:, :, None])[:, :, 0] ** 2).sum(1)
    last = [level, trend, *(ring if period else [])]
    return sse, states, np.stack([(z * both).sum(1) for z in last], axis=1)


def likeliest(x: np.ndarray, horizon: int, period: int | None = None) -> dict:
    """Additive smoothing of greatest Gaussian likelihood (least squared error) over smoothing weights in [0, 1] and first states.

    A search over all neighbours on a lattice that is halved where none is better, from the best point of a coarse one.
    """
    size = 3 if period else 2
    coarse = np.stack([g.ravel() for g in np.meshgrid(*[[0.02, 0.2, 0.4, 0.6, 0.8, 0.98] if period else GRID] * size, indexing="ij")], axis=1)
    around = np.stack([g.ravel() for g in np.meshgrid(*[[-1.0, 0.0, 1.0]] * size, indexing="ij")], axis=1)
    sse = _smoothed(x, coarse, period)[0]
    best, least, step = coarse[np.argmin(sse)], sse.min(), 0.1
    while step > 1e-5:
        near = np.clip(best + step * around, 0.0, 1.0)
        sse = _smoothed(x, near, period)[0]
        if sse.min() < least * (1 - 1e-12):
            best, least = near[np.argmin(sse)], sse.min()
        else:
            step /= 2
    sse, _, last = _smoothed(x, best[None], period)
    steps = np.arange(1, horizon + 1)
    seasonal = last[0, 2:][(len(x) - 1 + steps) % period] if period else 0.0
    return {"method": "holt-winters" if period else "holt", "alpha": best[0], "beta": best[1], "gamma": best[2] if period else None, "season": period, "sse": float(sse[0]),
            "residual_std": float(np.sqrt(sse[0] / (len(x) - 1))), "forecast": last[0, 0] + steps * last[0, 1] + seasonal}


def straight(x: np.ndarray, horizon: int) -> dict:
    """The least-squares line."""
    n = len(x)
    slope, start = np.polyfit(np.arange(n), x, 1)
    rest = x - start - slope * np.arange(n)
    return {"method": "linear", "alpha": None, "beta": None, "gamma": None, "season": None, "residual_std": float(rest.std(ddof=1)), "forecast": start + slope * np.arange(n, n + horizon)}


def season_length(x: np.ndarray, threshold: float = 0.3) -> int | None:
    """First local peak of the autocorrelation of first differences at lag 2 or more, None when nothing repeats."""
    if len(x) < 9:
        return None
    d = np.diff(x)
    d = d - d.mean()
    power = float(d @ d)
    if power == 0:
        return None
    top = min(len(d) // 2, 366)
    acf = np.array([0.0] + [float(d[k:] @ d[:-k]) / power for k in range(1, top + 1)])
    for k in range(2, top):
        if acf[k] >= threshold and acf[k] > acf[k - 1] and acf[k] >= acf[k + 1]:
            return k
    return None


def fit(x: np.ndarray, horizon: int, model: str = "auto", season: int | None = None) -> dict | None:
    """The seasonal model where a season is given or found and two cycles exist, else the linear one; None under 6 points.

    `likelihood` searches weights and first states for the least error, for a given season only, and takes a straight line where that fails; it gives
    nothing for a constant series. The other models choose from a grid of weights.
    """
    if model == "likelihood":
        if len(x) < 6 or x.std() == 0:
            return None
        try:
            found = likeliest(x, horizon, season if season and len(x) >= 2 * season else None)
        except np.linalg.LinAlgError:
            return straight(x, horizon)
        return found if np.isfinite(found["forecast"]).all() else straight(x, horizon)
    period = season or (season_length(x) if model == "auto" else None)
    if period and len(x) >= 2 * period:
        return holt_winters(x, horizon, period)
    return holt(x, horizon) if len(x) >= 6 else None


def default_horizon(n: int) -> int:
    """About 15% of the length, between 3 and 12, halves rounded up."""
    return max(3, min(12, int(np.floor(0.15 * n + 0.5))))


def _schema_of(frame: DataFrame, series: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in series)


def _nothing(columns: list[str], series: list[str], like: pd.DataFrame) -> pd.DataFrame:
    """No rows, with plain column types (an untyped empty column cannot be turned into Arrow)."""
    plain = {c: like[c].iloc[:0].astype(object) if c in series else pd.Series([], dtype=object if c == "method" else float) for c in columns}
    return pd.DataFrame(plain)


def forecast(frame: DataFrame, series: list[str], horizon: int | None = None, model: str = "auto",
             z: float = 1.96, season: int | None = None) -> DataFrame:
    """(series…, step, forecast, lower, upper, method, season, residual_std, last_value).

    The band is z · residual std · sqrt(step). Forecasts of series that were never negative stay at 0 or above.
    A series too short to fit gives no rows.
    """
    out_cols = [*series, "step", "forecast", "lower", "upper", "method", "season", "residual_std", "last_value"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("period")["value"].dropna().to_numpy(dtype=float)
        h = horizon or default_horizon(len(x))
        found = fit(x, h, model, season) if len(x) >= 6 else None
        if found is None:
            return _nothing(out_cols, series, pdf)
        steps = np.arange(1, h + 1)
        band = z * found["residual_std"] * np.sqrt(steps)
        lowest = 0.0 if (x >= 0).all() else -np.inf
        point = np.maximum(found["forecast"], lowest)
        res = pd.DataFrame({"step": steps, "forecast": point, "lower": np.maximum(point - band, lowest),
                            "upper": np.maximum(point + band, lowest)})
        for c in series:
            res[c] = pdf[c].iloc[0]
        res["method"], res["season"] = found["method"], pd.Series([found["season"]] * h, dtype="Int64")
        res["residual_std"], res["last_value"] = found["residual_std"], x[-1]
        return res[out_cols]

    slim = frame.select(*series, "period", "value")
    schema = (f"{_schema_of(slim, series)}, step long, forecast double, lower double, upper double, method string, "
              "season long, residual_std double, last_value double")
    return slim.groupBy(*series).applyInPandas(one, schema)


def smoothing_parameters(frame: DataFrame, series: list[str], model: str = "auto") -> DataFrame:
    """(series…, n, season, method, alpha, beta, gamma, residual_std) of the fitted model of each series."""
    cols = [*series, "n", "detected_season", "method", "alpha", "beta", "gamma", "residual_std"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("period")["value"].dropna().to_numpy(dtype=float)
        found = fit(x, 1, model) if len(x) >= 6 else None
        if found is None:
            return _nothing(cols, series, pdf)
        row = {**{c: pdf[c].iloc[0] for c in series}, "n": len(x), "detected_season": season_length(x),
               **{k: found[k] for k in ("method", "alpha", "beta", "gamma", "residual_std")}}
        return pd.DataFrame([row])[cols].astype({"detected_season": "Int64", "gamma": "Float64"})

    slim = frame.select(*series, "period", "value")
    schema = (f"{_schema_of(slim, series)}, n long, detected_season long, method string, alpha double, beta double, "
              "gamma double, residual_std double")
    return slim.groupBy(*series).applyInPandas(one, schema)


def _indexed(frame: DataFrame, series: list[str]) -> DataFrame:
    w = Window.partitionBy(*series)
    return frame.select(*series, "period", "value",
                        (F.row_number().over(w.orderBy("period")) - 1).cast("double").alias("t"), F.count("*").over(w).alias("n"))


def linear_forecast(frame: DataFrame, series: list[str], horizon: int | None = None, z: float = 1.96) -> DataFrame:
    """Straight-line projection with a prediction band; all in SQL, nothing under 6 points or for a constant series.

    Without `horizon` it is 15% of the length between 3 and 12, halves rounded to even.
    """
    t = _indexed(frame, series)
    stats = t.groupBy(*series).agg(
        F.first("n").alias("n"), F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"),
        F.regr_syy("value", "t").alias("syy"), F.regr_sxy("value", "t").alias("sxy"), F.regr_sxx("value", "t").alias("sxx"),
        F.min("value").alias("lowest"), F.max_by("value", "t").alias("last_value"))
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    h = F.lit(horizon) if horizon else F.least(F.lit(12), F.greatest(F.lit(3), F.bround(F.col("n") * 0.15, 0).cast("int")))
    fitted = (stats.where((F.col("n") >= 6) & (F.col("syy") > 0)).withColumn("residual_std", F.sqrt(sse / (F.col("n") - 1)))
              .withColumn("step", F.explode(F.sequence(F.lit(1), h))))
    point = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1)
    band = z * F.col("residual_std") * F.sqrt(F.col("step").cast("double"))
    floor_at = F.when(F.col("lowest") >= 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))
    return fitted.select(*series, F.col("step").cast("long").alias("step"),
                         F.greatest(point, floor_at).alias("forecast"),
                         F.greatest(F.greatest(point, floor_at) - band, floor_at).alias("lower"),
                         F.greatest(F.greatest(point, floor_at) + band, floor_at).alias("upper"), "residual_std", "last_value")


def backtest(frame: DataFrame, series: list[str], model: str = "linear") -> DataFrame:
    """(series…, test_points, mape, mae): the last points hidden, forecast from the rest, and compared.

    min(max(2, n // 5), 6) points are hidden and at least 6 must be left. The percentage error leaves out
    actual values under 1% of the mean size, and needs two.
    """
    t = _indexed(frame, series)
    hold = F.least(F.lit(6), F.greatest(F.lit(2), F.floor(F.col("n") / 5)))
    t = t.withColumn("hold", hold).where(F.col("n") - F.col("hold") >= 6)
    size = Window.partitionBy(*series)
    t = t.withColumn("least", 0.01 * F.avg(F.abs("value")).over(size)).withColumn("test", F.col("t") >= F.col("n") - F.col("hold"))
    train = t.where(~F.col("test"))
    if model == "linear":
        line = train.groupBy(*series).agg(F.regr_slope("value", "t").alias("b"), F.regr_intercept("value", "t").alias("a"))
        pred = t.where("test").join(line, series).withColumn("pred", F.col("a") + F.col("b") * F.col("t"))
    else:
        ahead = forecast(train, series, 6, model).select(*series, "step", F.col("forecast").alias("pred"))
        tests = t.where("test").withColumn("step", (F.col("t") - (F.col("n") - F.col("hold")) + 1).cast("long"))
        pred = tests.join(ahead, [*series, "step"])
    err = F.abs(F.col("value") - F.col("pred"))
    big = F.abs("value") > F.col("least")
    return pred.groupBy(*series).agg(
        F.count("*").alias("test_points"), F.avg(F.when(big, ratio(err, F.abs("value")))).alias("mape"), F.avg(err).alias("mae"),
        F.count_if(big).alias("usable")).where("usable >= 2").drop("usable")


def history_and_forecast(history: DataFrame, ahead: DataFrame, series: list[str]) -> DataFrame:
    """Chart rows: observed periods, then "+1" … "+h" with the band."""
    w = Window.partitionBy(*series).orderBy("period")
    past = history.select(*series, F.row_number().over(w).cast("long").alias("pos"), "label", F.col("value").alias("actual"),
                          *[F.lit(None).cast("double").alias(c) for c in ("forecast", "lower", "upper")])
    size = history.groupBy(*series).agg(F.count("*").alias("__n"))
    future = ahead.join(size, series).select(
        *series, (F.col("__n") + F.col("step")).alias("pos"), F.concat(F.lit("+"), F.col("step").cast("string")).alias("label"),
        F.lit(None).cast("double").alias("actual"), "forecast", "lower", "upper")
    return past.unionByName(future)
