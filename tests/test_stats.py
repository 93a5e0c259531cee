import datetime as dt
import math
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import tails
from tablescope.operators import anomaly as L
from tablescope.operators import forecast as J
from tablescope.operators import scenario as N
from tablescope.operators import stats as K
from tablescope.operators import timeseries as S


def test_tails_match_printed_tables():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.chi2_upper(3.8415, 1) == pytest.approx(0.05, abs=1e-5)
    assert tails.chi2_upper(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(3.708, 3, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert tails.t_critical(10) == pytest.approx(2.228, abs=1e-3)
    assert tails.t_two_sided(2.0, 1_000_000) == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-4)


@pytest.fixture(scope="module")
def xyw(spark):
    rng = np.random.default_rng(1)
    x = np.arange(40.0)
    pdf = pd.DataFrame({"X": x, "Y": 2 * x + rng.normal(0, 3, 40), "W": 100 - x, "Noise": rng.normal(0, 1, 40), "One": 1.0})
    return pdf, spark.createDataFrame(pdf)


def test_correlations(xyw):
    pdf, df = xyw
    rows = K.correlations(df, ["X", "Y", "W", "Noise", "One"]).collect()
    assert (rows[0]["a"], rows[0]["b"]) == ("X", "W") and rows[0]["redundant"] and rows[0]["r"] == -0.999999
    assert all("One" not in (r["a"], r["b"]) for r in rows)  # a constant has no correlation
    xy = next(r for r in rows if (r["a"], r["b"]) == ("X", "Y"))
    assert xy["r"] == pytest.approx(np.corrcoef(pdf.X, pdf.Y)[0, 1], abs=1e-9) and xy["significant"] and xy["strength"] == "strong"
    matrix = {(r["a"], r["b"]): r["r"] for r in K.relationships(df, ["X", "Y", "Noise"]).collect()}
    assert matrix["X", "X"] == 1 and matrix["X", "Y"] == matrix["Y", "X"] and len(matrix) == 9


def test_correlations_with_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (None, 1.0), (4.0, 9.0), (5.0, 9.5), (float("nan"), 3.0)], "a double, b double")
    r = K.correlations(df, ["a", "b"]).first()
    assert r["n"] == 4 and r["r"] == pytest.approx(np.corrcoef([1, 3, 4, 5], [2, 6, 9, 9.5])[0, 1])


def test_spearman_flags_curves(spark):
    x = np.linspace(0, 6, 60)
    pdf = pd.DataFrame({"a": x, "b": np.exp(2.5 * x)})
    r = K.spearman(spark.createDataFrame(pdf), ["a", "b"]).first()
    assert r["rho"] == pytest.approx(1.0) and r["nonlinear"]


def test_moments_with_gaps_match_numpy(spark):
    """Every pair over its own rows, large means, many batches and partitions."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (500, 4)) @ rng.normal(0, 1, (4, 4)) + [0, 1e9, -5, 3]
    x[rng.random(x.shape) < .2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd"))
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double").repartition(9)
    for r in K.pair_moments(df, list("abcd")).collect():
        both = pdf[[r["a"], r["b"]]].dropna()
        u, v = both[r["a"]] - both[r["a"]].mean(), both[r["b"]] - both[r["b"]].mean()
        assert r["n"] == len(both) and r["mean_a"] == pytest.approx(both[r["a"]].mean())
        assert (r["sxx"], r["syy"], r["sxy"]) == (pytest.approx((u * u).sum(), rel=1e-6), pytest.approx((v * v).sum(), rel=1e-6), pytest.approx((u * v).sum(), rel=1e-5, abs=1e-4))
    assert K.pair_moments(df.limit(0), list("abcd")).count() == 0


@pytest.mark.parametrize("held, wide", [(50_000, 3), (3, 9), (3, 0)])
def test_rank_correlations_by_size_of_view(spark, monkeypatch, held, wide):
    """Ranks sent to all tasks, joined to whole rows, and joined to single values; no row travels by its number unless there are many large views."""
    monkeypatch.setattr(K, "HELD", held)
    monkeypatch.setattr(K, "WIDE", wide)
    pdf = pd.DataFrame({"a": [i % 7 for i in range(60)], "b": [i * i % 11 for i in range(60)], "c": [None if i % 5 == 0 else -i for i in range(60)]}, dtype=float)
    seen, each = [], K.pair_moments
    monkeypatch.setattr(K, "pair_moments", lambda df, names: seen.append(df) or each(df, names))
    got = {(r["a"], r["b"]): r["rho"] for r in K.rank_correlations(spark.createDataFrame(pdf), list("abc")).collect()}
    want = pdf.corr("spearman")
    assert {k: pytest.approx(v, abs=1e-12) for k, v in got.items()} == {(x, y): want.loc[x, y] for x, y in ("ab", "ac", "bc")}
    assert ("max(CASE" in seen[-1]._jdf.queryExecution().toString()) == (wide == 0)


def test_rank_correlations_with_gaps_and_ties(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 9, 300), rng.normal(0, 1, 300), rng.integers(0, 50, 300)]).astype(float)
    x[:, 1] += x[:, 0]
    x[rng.random(300) < .1, 1] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc"))
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double").repartition(5)
    got = {(r["a"], r["b"]): r["rho"] for r in K.rank_correlations(df, list("abc")).collect()}
    assert len(got) == 3
    for (a, b), rho in got.items():
        both = pdf[[a, b]].dropna().rank()
        assert rho == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=1e-9)
    whole = K.correlations(df, list("abc"), ranks=True).collect()
    assert {(r["a"], r["b"]): r["spearman"] for r in whole} == pytest.approx(got) and not any(r["nonlinear"] for r in whole)


def test_benjamini_hochberg(spark):
    ps = [0.001, 0.012, 0.014, 0.04, 0.9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r["p"]: r["significant"] for r in K.benjamini_hochberg(df, "p").collect()}
    assert [got[p] for p in ps] == [True, True, True, True, False]


def test_regressions_match_numpy(xyw):
    pdf, df = xyw
    x = np.column_stack([np.ones(40), pdf.X, pdf.Noise])
    beta, *_ = np.linalg.lstsq(x, pdf.Y, rcond=None)
    rows = {r["term"]: r for r in K.multiple_regression(df, "Y", ["X", "Noise"]).collect()}
    assert [rows[c]["coef"] for c in ("intercept", "X", "Noise")] == pytest.approx(beta)
    resid = pdf.Y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (resid @ resid) / 37)
    assert [rows[c]["se"] for c in ("intercept", "X", "Noise")] == pytest.approx(se)
    simple = K.simple_regression(df, "X", "Y").first()
    assert simple["slope"] == pytest.approx(np.polyfit(pdf.X, pdf.Y, 1)[0]) and simple["p"] < 1e-6
    assert K.multiple_regression(df, "Y", ["X", "W"]).count() == 0  # W is X turned round: singular
    assert [r["term"] for r in K.drivers(df, "Noise", ["X", "Y", "One"]).collect()] == ["Y", "X"] or K.drivers(df, "Noise", ["X", "Y", "One"]).count() == 2


def test_anova_leaves_singletons_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 6.0), ("c", 99.0)], "g string, v double")
    r = K.anova(K.group_moments(df, ["g"], ["v"])).first()
    assert r["groups"] == 2 and r["f"] == pytest.approx(32.0) and r["eta_sq"] == pytest.approx(16 / 17) and r["p"] == pytest.approx(0.0299, abs=1e-3)


def test_chi_square_with_empty_cells(spark):
    rows = [("x", "p")] * 10 + [("y", "q")] * 10
    r = K.associations(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()
    assert r["chi2"] == pytest.approx(20.0) and r["cramers_v"] == pytest.approx(1.0) and r["significant"]


def frame(spark, values, start=(2022, 1)):
    rows = []
    for i, v in enumerate(values):
        y, m = divmod(start[0] * 12 + start[1] - 1 + i, 12)
        rows.append(("s", dt.date(y, m + 1, 1), f"{y}-{m + 1:02d}", float(v)))
    return spark.createDataFrame(rows, "s string, period date, label string, value double")


def test_changes_and_extremes(spark):
    f = frame(spark, [100 + 10 * i for i in range(24)])
    last = S.changes(f, "monthly", ["s"]).orderBy(F.desc("pos")).first()
    assert (last["value"], last["previous"], last["year_ago"]) == (330, 320, 210)
    assert S.changes(f, "monthly", ["s"]).orderBy("pos").first()["moving_average"] is None
    ends = S.best_and_worst(f, ["s"]).first()
    assert (ends["best"], ends["worst"]) == ("2023-12", "2022-01")
    swing = S.biggest_swing(frame(spark, [100, 105, 102, 60, 58], (2024, 1)), ["s"]).first()
    assert (swing["from_label"], swing["to_label"], swing["notable"]) == ("2024-03", "2024-04", True)


def test_tail_trim_and_seasonality(spark):
    assert S.trim_partial_tail(frame(spark, [10, 11, 12, 3]), ["s"]).count() == 3
    assert S.trim_partial_tail(frame(spark, [10, 11, 3]), ["s"]).count() == 3
    f = frame(spark, [100 * (1.7 if i % 12 == 11 else 0.8 if i % 12 == 1 else 1) for i in range(36)])
    r = S.seasonality(f, "monthly", ["s"]).first()
    assert (r["peak"], r["trough"], r["seasonal"]) == (12, 2, True)
    assert S.seasonality(frame(spark, range(20)), "monthly", ["s"]).count() == 0


def test_trend_test_matches_loops(spark):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(0.5, 1, 60))
    n = len(y)
    t = np.arange(n) - (n - 1) / 2
    slope = (t @ (y - y.mean())) / (t @ t)
    u = t * (y - y.mean() - slope * t)
    lags = max(1, min(n - 2, int(4 * (n / 100) ** (2 / 9))))
    meat = u @ u + sum(2 * (1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1))
    r = S.trend_test(frame(spark, y), ["s"]).first()
    assert r["slope"] == pytest.approx(slope) and r["se"] == pytest.approx(math.sqrt(meat) / (t @ t))
    assert r["p"] == pytest.approx(tails.t_two_sided(r["t"], n - 2))


def test_cadence(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-03-01', interval 1 day)) as d")
    months = spark.sql("select explode(sequence(date'2020-01-01', date'2024-03-01', interval 1 month)) as d")
    minutes = spark.sql("select explode(sequence(timestamp_ntz'2024-01-01 00:00', timestamp_ntz'2024-01-02 00:00', interval 1 minute)) as d")
    assert [S.detect_cadence(x, "d") for x in (days, months, minutes)] == ["daily", "monthly", "daily"]


def test_contributions_reconcile(spark):
    rows = [("2024-01-05", "North", 100.0), ("2024-01-06", "South", 80.0), ("2024-01-07", "West", 50.0),
            ("2024-02-05", "North", 160.0), ("2024-02-06", "South", 70.0), ("2024-02-07", "West", 50.0)]
    df = spark.createDataFrame(rows, "d string, region string, v double").withColumn("d", F.col("d").cast("date"))
    got = {r["key"]: r for r in S.contributions(df, "d", "v", ["region"], "monthly").collect()}
    assert [got[k]["delta"] for k in ("North", "South", "West")] == [60, -10, 0]
    assert got["North"]["contribution"] == pytest.approx(1.2) and got["West"]["status"] == "flat"
    few = S.contributions(df, "d", "v", ["region"], "monthly", top=1).collect()
    assert sum(r["delta"] for r in few) == 50 and {r["key"] for r in few} == {"North", "Other (2)"}


def brute_holt(x, horizon):
    best = None
    for a in range(1, 10):
        for b in range(1, 10):
            al, be = a / 10, b / 10
            level, trend, sse = x[0], x[1] - x[0], 0.0
            for v in x[1:]:
                sse += (v - level - trend) ** 2
                new = al * v + (1 - al) * (level + trend)
                trend = be * (new - level) + (1 - be) * trend
                level = new
            if best is None or sse < best[0]:
                best = (sse, [level + h * trend for h in range(1, horizon + 1)])
    return best


def brute_holt_winters(x, horizon, p):
    best = None
    grid = [(a / 10, b / 10, g / 10) for a in range(1, 10) for b in range(1, 10) for g in range(1, 10)]
    for al, be, ga in grid:
        level = sum(x[:p]) / p
        trend = sum((x[p + i] - x[i]) / p for i in range(p)) / p
        season, sse = [v - level for v in x[:p]], 0.0
        for t in range(p, len(x)):
            sse += (x[t] - level - trend - season[t - p]) ** 2
            new = al * (x[t] - season[t - p]) + (1 - al) * (level + trend)
            trend = be * (new - level) + (1 - be) * trend
            level = new
            season.append(ga * (x[t] - level) + (1 - ga) * season[t - p])
        if best is None or sse < best[0]:
            best = (sse, [level + h * trend + season[len(x) - p + (h - 1) % p] for h in range(1, horizon + 1)])
    return best[1]


def test_holt_and_seasonal_smoothing():
    rng = np.random.default_rng(2)
    x = 10 + np.arange(30) * 0.7 + rng.normal(0, 2, 30)
    sse, want = brute_holt(list(x), 4)
    got = J.holt(x, 4)
    assert got["forecast"] == pytest.approx(want) and got["residual_std"] == pytest.approx(math.sqrt(sse / 28))
    season = np.array([0, 5, 9, 4, 0, -3, -6, -9, -6, -3, 0, 2.0])
    y = 50 + 0.5 * np.arange(48) + np.tile(season, 4)
    assert J.season_length(y) == 12
    fc = J.fit(y[:30], 15, season=12)
    assert fc["method"] == "holt-winters" and fc["forecast"] == pytest.approx(brute_holt_winters(list(y[:30]), 15, 12))
    assert J.season_length(np.arange(30.0)) is None


def test_forecasts_stay_in_range(spark):
    down = frame(spark, [70, 60, 50, 40, 30, 20, 10])
    assert J.forecast(down, ["s"], 6).agg(F.min("forecast"), F.min("lower")).first() == (0.0, 0.0)
    assert J.linear_forecast(down, ["s"], 6).agg(F.min("forecast")).first()[0] == 0.0
    line = frame(spark, [10 + 3 * i for i in range(20)])
    assert J.backtest(line, ["s"]).first()["mape"] < 1e-9 and J.backtest(line, ["s"], "auto").first()["mape"] < 0.1
    assert J.forecast(frame(spark, [1, 2, 3]), ["s"]).count() == 0
    assert [J.default_horizon(n) for n in (6, 50, 200)] == [3, 8, 12]


def test_outliers(spark):
    masked = spark.createDataFrame([(float(50 + i % 7),) for i in range(35)] + [(1000.0,)] * 5, "Amount double")
    r = L.outlier_summary(masked, ["Amount"]).first()
    assert r["count"] == 5 and r["scale"] == "mad" and L.outlier_summary(masked, ["Amount"], "z").count() == 0
    prices = spark.createDataFrame([(float(20_000 + 40 * i),) for i in range(150)] + [(90_000.0 + 500 * i,) for i in range(8)], "Price double")
    r = L.outlier_summary(prices, ["Price"]).first()
    assert (r["kind"], r["direction"]) == ("skew", "high")
    flat = spark.createDataFrame([(1.0,)] * 20, "v double")
    assert L.outlier_summary(flat, ["v"]).count() == 0


def test_root_cause(spark):
    rows = [("ABCD"[i % 4], float(100 + i % 9)) for i in range(60)] + [("C", 5000.0)] * 5
    df = spark.createDataFrame(rows, "Store string, Sales double")
    r = L.breakdown(df, "Sales", ["Store"]).first()
    assert r["key"] == "C" and r["lift"] > 1.3 and r["outliers"] == 5


def test_scenarios(spark):
    model = spark.createDataFrame([("a", 2.0, 10.0, 1.0, 0.0, 30.0), ("b", 5.0, 4.0, 2.0, 3.0, 5.0), ("z", 0.0, 1.0, 1.0, 0.0, 2.0)],
                                  "lever string, coef double, mean double, sd double, min double, max double")
    cases = spark.createDataFrame([(1, "a", 10.0), (1, "b", 4.0), (2, "a", 12.0), (2, "b", 6.0), (3, "b", 5.0)], "scenario int, lever string, x double")
    assert {r["scenario"]: r["predicted"] for r in N.predict(cases, model, 50.0).collect()} == {1: 50.0, 2: 64.0, 3: 55.0}
    goals = N.goal_seek(spark.createDataFrame([("g", 20.0)], "goal string, target_delta double"), model).orderBy("rank").collect()
    assert [(r["lever"], r["delta_x"], r["in_range"]) for r in goals] == [("a", 10.0, True), ("b", 4.0, False)]


def test_distribution_shape(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"n": rng.normal(0, 1, 400), "e": rng.exponential(1, 400)}))
    got = {r["metric"]: r for r in K.distributions(df, ["n", "e"]).collect()}
    assert got["n"]["shape"] == "symmetric" and got["e"]["shape"] == "right-skewed" and not got["e"]["normal"]
    assert reduce(lambda a, b: a and b, [r["p"] <= 1 for r in got.values()])


def _plain_loess(y, window, place, weights):
    """One fit by its definition: the nearest points, tricube weights, a weighted line by least squares."""
    n = len(y)
    near = sorted(range(n), key=lambda i: (abs(i - place), i))[:min(window, n)]
    reach = max(abs(i - place) for i in near) + max(window - n, 0) // 2
    w = np.zeros(n)
    for i in near:
        d = abs(i - place)
        w[i] = weights[i] * (1.0 if d <= .001 * reach else (1 - (d / reach) ** 3) ** 3 if d <= .999 * reach else 0.0)
    if w.sum() <= 0:
        return y[min(max(place, 0), n - 1)]
    root = np.sqrt(w)
    line = np.column_stack([np.ones(n), np.arange(n) - place])
    if (w > 0).sum() < 2:
        return (w * y).sum() / w.sum()
    return np.linalg.lstsq(line * root[:, None], y * root, rcond=None)[0][0]


def _plain_stl(y, period, outer):
    n, weights, trend = len(y), np.ones(len(y)), np.zeros(len(y))
    odd = lambda x: int(np.ceil(x)) + (int(np.ceil(x)) + 1) % 2
    for turn in range(outer + 1):
        for _ in range(2):
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                own, rw = (y - trend)[k::period], weights[k::period]
                cycle[k::period] = [_plain_loess(own, 7, j, rw) for j in range(-1, len(own) + 1)]
            low = cycle
            for length in (period, period, 3):
                low = np.array([low[i:i + length].mean() for i in range(len(low) - length + 1)])
            season = cycle[period:period + n] - [_plain_loess(low, odd(period + 1), j, np.ones(n)) for j in range(n)]
            trend = np.array([_plain_loess(y - season, odd(1.5 * period / (1 - 1.5 / 7)), j, weights) for j in range(n)])
        away = np.abs(y - season - trend)
        limit = 6 * np.median(away)
        if turn < outer:
            weights = np.array([1.0 if a <= .001 * limit else (1 - (a / limit) ** 2) ** 2 if a <= .999 * limit else 0.0 for a in away])
    return season, trend


@pytest.mark.parametrize("n, period", [(60, 12), (29, 7), (41, 4)])
def test_robust_seasons_by_definition(n, period):
    from tablescope.operators import timeseries
    rng = np.random.default_rng(n)
    y = 10 + .2 * np.arange(n) + 4 * np.sin(np.arange(n) * 2 * np.pi / period) + rng.normal(0, .5, n)
    y[n // 2] += 60
    season, trend = timeseries.robust_seasons(y, period, outer=3)
    plain = _plain_stl(y, period, 3)
    assert season == pytest.approx(plain[0], abs=1e-8) and trend == pytest.approx(plain[1], abs=1e-8)


def test_seasonal_strength_ignores_a_spike(spark):
    from tablescope.operators import timeseries
    t = np.arange(72)
    y = 100 + t + 20 * np.sin(t * 2 * np.pi / 12) + np.random.default_rng(4).normal(0, 1, 72)
    spiked = y.copy()
    spiked[40] += 500
    rows = [(s, f"2020-{i:03d}", float(v)) for s, x in (("plain", y), ("spike", spiked), ("noise", np.random.default_rng(5).normal(0, 1, 72)), ("short", y[:20])) for i, v in enumerate(x)]
    got = {r["s"]: r["seasonal_strength"] for r in timeseries.seasonal_strength(spark.createDataFrame(rows, "s string, period string, value double"), 12, ["s"]).collect()}
    assert got["plain"] > .97 and got["short"] is None and got["noise"] < .8
    season, _ = timeseries.robust_seasons(spiked, 12)
    assert np.abs(season - timeseries.robust_seasons(y, 12)[0]).max() < 2


def _errors(x, a, b, c, states, period):
    """One-step errors of additive smoothing, step by step."""
    level, trend, seasons, out = states[0], states[1], list(states[2:]), []
    for t, v in enumerate(x):
        s = seasons[t % period] if period else 0.0
        ahead = level + trend
        out.append(v - ahead - s)
        fresh = a * (v - s) + (1 - a) * ahead
        trend = b * (fresh - level) + (1 - b) * trend
        level = fresh
        if period:
            seasons[t % period] = c * (v - level) + (1 - c) * s
    return np.array(out), level, trend, seasons


@pytest.mark.parametrize("period", [None, 4])
def test_likeliest_smoothing(period):
    """Least error against brute force over weights, with first states by least squares; and never above the grid of weights."""
    from tablescope.operators import forecast
    rng = np.random.default_rng(6)
    for kind in range(4):
        n = [12, 24, 40, 31][kind]
        x = 20 + np.cumsum(rng.normal(.3, 1, n)) + (5 * np.sin(np.arange(n) * np.pi / 2) if kind % 2 else 0)
        found = forecast.likeliest(x, 3, period)
        m = 2 + (period - 1 if period else 0)

        def least(a, b, c=0.0):
            base = lambda s: [*s[:2], *s[2:], *([-sum(s[2:])] if period else [])]
            zero = _errors(x, a, b, c, base([0.0] * m), period)[0]
            unit = np.column_stack([_errors(x, a, b, c, base([float(i == j) for i in range(m)]), period)[0] - zero for j in range(m)])
            states = np.linalg.lstsq(unit, -zero, rcond=None)[0]
            return ((zero + unit @ states) ** 2).sum(), base(states.tolist())

        w = (found["alpha"], found["beta"], found["gamma"] or 0.0)
        sse, states = least(*w)
        assert found["sse"] == pytest.approx(sse, rel=1e-5)
        fine = np.linspace(0, 1, 9 if period else 21)
        brute = min(least(a, b, c)[0] for a in fine for b in fine for c in (fine if period else [0.0]))
        assert found["sse"] <= brute * 1.02
        _, level, trend, seasons = _errors(x, *w, states, period)
        want = [level + h * trend + (seasons[(n - 1 + h) % period] if period else 0) for h in (1, 2, 3)]
        assert found["forecast"] == pytest.approx(want, rel=1e-4, abs=1e-3)
        if not period:
            grid = forecast.holt(x, 1)
            assert found["sse"] <= grid["residual_std"] ** 2 * (n - 2) + 1e-9


def test_likelihood_forecasts(spark):
    from tablescope.operators import forecast
    rows = [(s, f"{i:03d}", float(v)) for s, x in (("up", [3 * i + (i % 4) for i in range(24)]), ("flat", [5] * 20), ("short", [1, 2, 3])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "s string, period string, value double")
    got = forecast.forecast(df, ["s"], 4, "likelihood", season=4).orderBy("step").collect()
    assert [r["s"] for r in got] == ["up"] * 4
    assert [r["forecast"] for r in got] == pytest.approx([3 * i + (i % 4) for i in range(24, 28)], abs=.05)
