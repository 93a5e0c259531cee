"""Findings of many datasets: one facts table and one ranked list of actions, keyed by dataset."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def _confidence(p: Column) -> Column:
    return F.when(p < 0.01, "high").when(p < 0.05, "medium").otherwise("low")


def _fact(df: DataFrame, kind: str, priority: int, subject: Column, value: Column, evidence: Column, p: Column | None = None) -> DataFrame:
    return df.select("dataset_key", F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"),
                     evidence.alias("evidence"), F.lit(priority).alias("priority"),
                     (_confidence(p) if p is not None else F.lit(None).cast("string")).alias("confidence"))


def _evidence(*parts: str) -> Column:
    """The columns a fact rests on, as JSON."""
    return F.to_json(F.struct(*parts))


def _ranked(df: DataFrame, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("dataset_key").orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def build_facts(frames: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """(dataset_key, kind, subject, value, evidence, priority, confidence) from result frames, each with a dataset_key.

    Frames are optional: kpis, best_sellers, pareto, trend, swing, forecast, drivers, gaps, correlations,
    associations, rfm, clusters, outliers, distributions, quality. Only findings over their thresholds come out.
    """
    out: list[DataFrame] = []

    def take(name: str):
        return frames.get(name)

    if (x := take("kpis")) is not None:
        top = _ranked(x, 7, F.desc("relevance"), F.asc("id"))
        out.append(_fact(top, "kpi", 1, F.col("name"), F.col("value"), _evidence("id", "value")))
    if (x := take("best_sellers")) is not None:
        lead = x.where("revenue_rank = 1")
        out.append(_fact(lead, "bestseller", 2, F.col("key"), F.col("revenue_share"), _evidence("dimension", "revenue", "units")))
    if (x := take("pareto")) is not None:
        out.append(_fact(x.where("concentrated"), "concentration", 3, F.col("dimension"), F.col("top_fifth_share"),
                         _evidence("items", "items_for_80", "top_fifth_count")))
    if (x := take("trend")) is not None:
        out.append(_fact(x.where("year_change is not null"), "year-over-year", 4, F.col("metric"), F.col("year_change"), _evidence("latest_value")))
        if "p" in x.columns:
            out.append(_fact(x.where("p < 0.05"), "trend", 4, F.col("metric"), F.col("slope"), _evidence("direction", "r2"), F.col("p")))
    if (x := take("swing")) is not None:
        out.append(_fact(x.where("notable"), "swing", 5, F.concat_ws(" to ", "from_label", "to_label"), F.col("change"), _evidence("typical")))
    if (x := take("forecast")) is not None:
        last = _ranked(x, 1, F.desc("step"))
        change = F.try_divide(F.col("forecast") - F.col("last_value"), F.abs("last_value"))
        out.append(_fact(last, "forecast", 6, F.col("metric"), change, _evidence("step", "forecast")))
    if (x := take("drivers")) is not None:
        lead = _ranked(x.where("significant and f_p < 0.05"), 1, F.desc(F.abs("beta")), F.asc("term"))
        out.append(_fact(lead, "driver", 7, F.concat_ws(" on ", "term", "target"), F.col("beta"), _evidence("r2", "n"), F.col("p")))
    if (x := take("gaps")) is not None:
        real = _ranked(x.where("significant and not tautology"), 2, F.desc("eta_sq"), F.asc("metric"))
        out.append(_fact(real, "gap", 8, F.concat_ws(" by ", "metric", "dimension"), F.col("eta_sq"),
                         _evidence("top", "top_mean", "bottom", "bottom_mean"), F.col("p")))
    if (x := take("correlations")) is not None:
        real = _ranked(x.where("significant and not redundant and strength <> 'weak'"), 2, F.desc(F.abs("r")), F.asc("a"), F.asc("b"))
        out.append(_fact(real, "correlation", 9, F.concat_ws(" ~ ", "a", "b"), F.col("r"), _evidence("strength", "n"), F.col("p")))
    if (x := take("associations")) is not None:
        real = _ranked(x.where("significant and cramers_v >= 0.2 and cramers_v < 0.98"), 1, F.desc("cramers_v"))
        out.append(_fact(real, "association", 10, F.concat_ws(" ~ ", "a", "b"), F.col("cramers_v"), _evidence("chi2", "df"), F.col("p")))
    if (x := take("rfm")) is not None:
        out.append(_fact(x.where(F.col("segment").isin("champions", "at-risk")), "rfm", 11, F.col("segment"), F.col("monetary_share"), _evidence("size")))
    if (x := take("clusters")) is not None:
        out.append(_fact(_ranked(x, 1, F.desc("size")), "segments", 12, F.col("label"), F.col("share"), _evidence("size")))
    covered = None
    if (x := take("outliers")) is not None:
        lead = _ranked(x, 1, F.desc("count"), F.asc("metric"))
        out.append(_fact(lead, "outliers", 13, F.col("metric"), F.col("count"), _evidence("kind", "median", "mean")))
        covered = lead.where("kind = 'skew'").select("dataset_key", "metric")
    if (x := take("distributions")) is not None:
        odd = x.where("not normal and abs(skew) > 0.6")
        odd = odd.join(covered, ["dataset_key", "metric"], "left_anti") if covered is not None else odd
        out.append(_fact(_ranked(odd, 1, F.desc(F.abs("skew")), F.asc("metric")), "distribution", 14, F.col("metric"), F.col("skew"), _evidence("shape", "mean")))
    if (x := take("quality")) is not None:
        weak = x.where("rating <> 'good' or duplicates > 0 or completeness < 0.98")
        out.append(_fact(weak, "quality", 15, F.col("rating"), F.col("score"), _evidence("duplicates", "completeness")))
    return _ranked(reduce(DataFrame.unionByName, out), limit, F.asc("priority"), F.asc("subject"))


def build_actions(frames: dict[str, DataFrame], keep: int = 5) -> DataFrame:
    """(dataset_key, action, subject, score, impact, size, rank): the best-scored next steps of each dataset.

    Frames are optional: best_sellers, gaps, drivers, trend, forecast, concentration, quality_checks, categories.
    `size` is what the step is worth where that is known.
    """
    out: list[DataFrame] = []

    def add(df: DataFrame, action: str, subject: Column, score: Column, impact: Column, size: Column | None = None) -> None:
        out.append(df.select("dataset_key", F.lit(action).alias("action"), subject.alias("subject"), score.cast("double").alias("score"),
                             impact.alias("impact"), (size if size is not None else F.lit(None)).cast("double").alias("size")))

    if (x := frames.get("best_sellers")) is not None:
        add(x.where("revenue_rank = 1"), "grow best seller", F.col("key"), F.lit(0.95), F.lit("high"), F.col("revenue"))
    if (x := frames.get("gaps")) is not None:
        uplift = (F.col("top_mean") - F.col("bottom_mean")) * F.col("bottom_n")
        real = _ranked(x.where("significant and not tautology"), 2, F.desc("eta_sq"), F.asc("metric")).withColumn("uplift", uplift).where("uplift > 0 and top <> bottom")
        eta = F.col("eta_sq")
        add(real, "close gap", F.concat_ws(" by ", "metric", "dimension"), 0.9 * eta + 0.3,
            F.when(eta > 0.14, "high").when(eta > 0.06, "medium").otherwise("low"), F.col("uplift"))
    if (x := frames.get("drivers")) is not None:
        lead = _ranked(x.where("significant and r2 >= 0.1"), 1, F.desc(F.abs("beta")), F.asc("term"))
        add(lead, "pull lever", F.col("term"), 0.85 * F.least(F.lit(1.0), F.abs("beta")) + 0.2, F.when(F.abs("beta") > 0.4, "high").otherwise("medium"), F.col("coef"))
    if (x := frames.get("trend")) is not None and "p" in x.columns:
        down = _ranked(x.where("p < 0.05 and slope < 0"), 1, F.asc("metric"))
        size = F.abs("fitted_change")
        add(down, "reverse decline", F.col("metric"), 0.7 + F.least(F.lit(0.2), size), F.when(size > 0.1, "high").otherwise("medium"), F.col("fitted_change"))
    if (x := frames.get("forecast")) is not None:
        change = F.try_divide(F.col("forecast") - F.col("last_value"), F.abs("last_value"))
        last = _ranked(x, 1, F.desc("step")).withColumn("change", change).where("abs(change) > 0.05")
        add(last, "plan for forecast", F.col("metric"), 0.5 + F.least(F.lit(0.15), F.abs("change")), F.lit("medium"), F.col("change"))
    if (x := frames.get("concentration")) is not None:
        measured = x.where("level <> 'low' and metric <> 'row count'").withColumn("__h", (F.col("level") == "high").cast("int"))
        lead = _ranked(measured, 1, F.desc("__h"), F.desc("gini"), F.asc("dimension"))
        add(lead, "reduce dependence", F.concat_ws(" by ", "metric", "dimension"),
            0.5 + F.when(F.col("level") == "high", 0.25).otherwise(0.1) + F.col("top_share") * 0.15,
            F.when(F.col("level") == "high", "high").otherwise("medium"), F.col("top_share"))
        taken = lead.select("dataset_key")
    else:
        taken = None
    if (x := frames.get("categories")) is not None:
        lead = _ranked(x.where("rank = 1"), 1, F.desc("share"), F.asc("dimension")).where("share >= 0.5")
        lead = lead.join(taken, "dataset_key", "left_anti") if taken is not None else lead
        add(lead, "diversify", F.concat_ws(": ", "dimension", "key"), 0.45 + F.col("share") * 0.2, F.when(F.col("share") > 0.7, "high").otherwise("medium"), F.col("share"))
    if (x := frames.get("quality_checks")) is not None:
        worst = _ranked(x.where("status <> 'good'"), 1, F.asc("score"), F.asc("check"))
        add(worst, "fix data", F.col("check"), 0.35 + (1 - F.col("score")) * 0.3, F.when(F.col("total") < 60, "high").otherwise("medium"))
    every = reduce(DataFrame.unionByName, out)
    w = Window.partitionBy("dataset_key").orderBy(F.desc("score"), "action", "subject")
    return every.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= keep)
