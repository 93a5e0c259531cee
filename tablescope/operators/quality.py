"""Data-quality scores from the profile, the cleaning report and the outlier count."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distinct import count_distinct
from ..functions.expr import ratio


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _status(x: Column) -> Column:
    return F.when(x >= 0.85, "good").when(x >= 0.6, "warn").otherwise("bad")


def scorecard(profiles: DataFrame, report: DataFrame, outliers: DataFrame) -> DataFrame:
    """Five checks (check, score, weight, status) with the total score and grade on every row.

    `report` is the cleaning report, `outliers` the one-row (cells, extreme) frame at |z| 3.5.
    """
    whole = report.where(F.col("scope") == "table").groupBy().pivot(
        "metric", ["rows_before", "rows_after", "duplicates", "cells_normalized", "cells_trimmed"]).agg(F.first("n"))
    cols = profiles.agg(F.count("*").alias("columns"), F.avg("fill").alias("fill"),
                        F.count_if(F.col("distinct") <= 1).alias("constant"))
    keyed = [x.withColumn("__k", F.lit(0)) for x in (whole, cols, outliers)]  # three one-row frames
    one = keyed[0].join(keyed[1], "__k").join(keyed[2], "__k")
    checks = {
        "completeness": (_clamp(F.col("fill")), 0.30),
        "uniqueness": (_clamp(1 - F.coalesce(ratio("duplicates", "rows_before"), F.lit(0.0))), 0.20),
        "informative": (_clamp(1 - F.coalesce(ratio("constant", "columns"), F.lit(0.0))), 0.15),
        "consistency": (_clamp(1 - 2 * F.coalesce(ratio(F.col("cells_normalized") + F.col("cells_trimmed"),
                                                        F.col("rows_after") * F.col("columns")), F.lit(0.0))), 0.15),
        "outliers": (_clamp(1 - 10 * F.coalesce(ratio("extreme", "cells"), F.lit(0.0))), 0.20),
    }
    rows = F.array(*[F.struct(F.lit(c).alias("check"), s.alias("score"), F.lit(w).alias("weight"), _status(s).alias("status"))
                     for c, (s, w) in checks.items()])
    total = sum((s * w for s, w in checks.values()), F.lit(0.0)) / sum(w for _, w in checks.values())
    points = F.round(total * 100).cast("long")
    grade = F.when(points >= 90, "A").when(points >= 80, "B").when(points >= 70, "C").when(points >= 60, "D").otherwise("F")
    return one.select(points.alias("total"), grade.alias("grade"), F.inline(rows))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row (rows, duplicates): rows that repeat an earlier one, missing values equal to each other."""
    return count_distinct(df, df.columns).select("rows", (F.col("rows") - F.col("distinct")).alias("duplicates"))


def rating(profiles: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: 70% mean fill, 30% uniqueness, minus 5 points per constant column (15 at most)."""
    cols = profiles.agg(F.count("*").alias("columns"), F.avg("fill").alias("completeness"),
                        F.count_if((F.col("distinct") <= 1) & (F.col("fill") > 0) & (F.col("rows") > 1)).alias("constants"),
                        F.count_if(F.col("fill") < 0.9).alias("sparse"))
    one = cols.withColumn("__k", F.lit(0)).join(duplicates.withColumn("__k", F.lit(0)), "__k").drop("__k")  # one-row frames
    dup = F.coalesce(ratio("duplicates", "rows"), F.lit(0.0))
    score = F.bround(_clamp(F.col("completeness") * 0.7 + (1 - dup) * 0.3 - F.least(F.lit(0.15), 0.05 * F.col("constants"))) * 100)
    out = one.withColumn("score", score.cast("long"))
    return out.withColumn("rating", F.when(F.col("score") >= 85, "good").when(F.col("score") >= 65, "fair").otherwise("weak"))


def issues(profiles: DataFrame, duplicates: DataFrame, top: int = 5) -> DataFrame:
    """(kind, subject, size) of what is wrong: sparse columns (worst first), constant columns (3), duplicate rows."""
    sparse = (profiles.where(F.col("fill") < 0.9).select(F.lit(0).alias("o"), F.lit("sparse").alias("kind"), F.col("column").alias("subject"),
                                                         (1 - F.col("fill")).alias("size")))
    constant = (profiles.where((F.col("distinct") <= 1) & (F.col("fill") > 0) & (F.col("rows") > 1)).orderBy("position").limit(3)
                .select(F.lit(1).alias("o"), F.lit("constant").alias("kind"), F.col("column").alias("subject"), F.lit(1.0).alias("size")))
    repeated = duplicates.where("duplicates > 0").select(F.lit(2).alias("o"), F.lit("duplicates").alias("kind"), F.lit("rows").alias("subject"),
                                                         F.col("duplicates").cast("double").alias("size"))
    return (sparse.unionByName(constant).unionByName(repeated).orderBy("o", F.desc("size"), "subject").limit(top).drop("o"))
