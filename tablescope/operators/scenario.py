"""What-if scoring of whole tables of scenarios and goals with a linear driver model."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import ratio


def driver_model(coefficients: DataFrame, df: DataFrame) -> DataFrame:
    """(lever, coef, mean, sd, min, max) of the predictors of a fitted regression (one row per predictor)."""
    from .stats import describe
    levers = [r["term"] for r in coefficients.where("term <> 'intercept'").select("term").collect()]
    facts = describe(df, levers).select(F.col("metric").alias("lever"), "mean", "sd", "min", "max")
    return coefficients.where("term <> 'intercept'").select(F.col("term").alias("lever"), "coef").join(facts, "lever")


def predict(scenarios: DataFrame, model: DataFrame, target_mean: float) -> DataFrame:
    """(scenario, predicted) for long scenarios (scenario, lever, x); levers not given stay at their mean."""
    joined = scenarios.join(F.broadcast(model.select("lever", "coef", "mean")), "lever", "left")  # one row per predictor
    effect = F.coalesce(F.col("coef") * (F.col("x") - F.col("mean")), F.lit(0.0))
    return joined.groupBy("scenario").agg((F.lit(target_mean) + F.sum(effect)).alias("predicted"))


def goal_seek(goals: DataFrame, model: DataFrame) -> DataFrame:
    """For each goal (goal, target_delta) and lever: the move that reaches it alone, and its rank.

    Moves within the observed range come first, then the fewest standard deviations. Levers without effect are left out.
    """
    levers = model.where(F.abs("coef") >= 1e-12).agg(F.collect_list(F.struct("lever", "coef", "mean", "sd", "min", "max"))).scalar()
    each = goals.withColumn("__m", levers).select("goal", "target_delta", F.inline("__m"))  # a row per predictor and goal
    out = each.withColumn("delta_x", F.col("target_delta") / F.col("coef"))
    out = (out.withColumn("to_value", F.col("mean") + F.col("delta_x"))
           .withColumn("sds", F.coalesce(ratio(F.abs("delta_x"), F.col("sd")), F.lit(float("inf"))))
           .withColumn("in_range", F.col("to_value").between(F.col("min"), F.col("max"))))
    w = Window.partitionBy("goal").orderBy(F.desc("in_range"), "sds", "lever")
    return out.select("goal", "lever", "delta_x", "to_value", "sds", "in_range", F.row_number().over(w).cast("long").alias("rank"))
