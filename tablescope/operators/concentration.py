"""Few-versus-many: Gini, Pareto point, HHI, vital few, best sellers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col, finite, long_dims, ratio
from ..functions.ranking import ordered

ROWS = "row count"


def dimension_totals(df: DataFrame, dims: list[str], metrics: list[str], count_rows: bool = False) -> DataFrame:
    """(dimension, metric, key, value): every metric summed by every dimension in one shuffle; blank keys skipped.

    Negative amounts are left out of the sums. With `count_rows` the number of rows is one more metric.
    """
    names = [f"__m{i}" for i in range(len(metrics))]
    base = df.select(*[col(d) for d in dims], *[finite(m).alias(n) for n, m in zip(names, metrics)])
    long = long_dims(base, dims, names).where(F.col("key") != "")
    sums = [F.sum(F.when(F.col(n) >= 0, F.col(n))).alias(m) for n, m in zip(names, metrics)]
    if count_rows:
        sums.append(F.count("*").cast("double").alias(ROWS))
    wide = long.groupBy("dimension", "key").agg(*sums)
    out = wide.unpivot(["dimension", "key"], [*metrics, *([ROWS] if count_rows else [])], "metric", "value")
    return out.where(F.col("value").isNotNull())


def ranked_totals(totals: DataFrame) -> DataFrame:
    """Positive totals in descending order with `rank` and running total `cum` within (dimension, metric)."""
    positive = totals.where(F.col("value") > 0).withColumn("__neg", -F.col("value"))
    return ordered(positive, ["__neg", "key"], {"cum": "value"}, ["dimension", "metric"]).drop("__neg")


def _with_totals(ranked: DataFrame) -> DataFrame:
    sums = ranked.groupBy("dimension", "metric").agg(F.sum("value").alias("total"), F.count("*").alias("distinct"))
    return ranked.join(F.broadcast(sums), ["dimension", "metric"])  # one row per (dimension, metric)


def profile(ranked: DataFrame, min_categories: int = 4) -> DataFrame:
    """One row per (dimension, metric): total, distinct, Pareto point at 80%, top share, Gini, HHI, level."""
    x = _with_totals(ranked)
    share = F.col("value") / F.col("total")
    # ascending position of a value is distinct - rank + 1
    weight = 2 * (F.col("distinct") - F.col("rank") + 1) - F.col("distinct") - 1
    reached = F.col("cum") / F.col("total") >= 0.8
    out = x.groupBy("dimension", "metric").agg(
        F.first("total").alias("total"), F.first("distinct").alias("distinct"),
        F.coalesce(F.min(F.when(reached, F.col("rank"))), F.first("distinct")).alias("pareto_count"),
        F.coalesce(F.min(F.when(reached, F.col("cum") / F.col("total"))), F.lit(1.0)).alias("pareto_share"),
        F.max(share).alias("top_share"),
        (F.sum(weight * F.col("value")) / (F.first("distinct") * F.first("total"))).alias("gini"),
        F.sum(share * share).alias("hhi"))
    level = F.when(F.col("gini") >= 0.6, "high").when(F.col("gini") >= 0.4, "moderate").otherwise("low")
    return out.where(F.col("distinct") >= min_categories).withColumn("level", level)


def gini(df: DataFrame, value: str, within: list[str] = ()) -> DataFrame:
    """(within…, gini) of non-negative values, one per row; 0 when there is nothing or all are zero.

    Equal values are counted together first, as their order does not matter: a value held by c rows after
    b smaller ones takes positions b+1 … b+c.
    """
    within = list(within)
    counts = (df.select(*within, finite(value).alias("__v")).where(F.col("__v") >= 0)
              .groupBy(*within, "__v").agg(F.count("*").alias("__c")))
    run = ordered(counts, ["__v"], {"__upto": "__c"}, within, rank=None)
    c, upto, v = F.col("__c"), F.col("__upto"), F.col("__v")
    positions = c * (2 * upto - c + 1) / 2
    one = run.groupBy(*within).agg(F.sum(c).alias("n"), F.sum(c * v).alias("s"), F.sum(positions * v).alias("p"))
    return one.select(*within, F.coalesce(ratio(2 * F.col("p") - (F.col("n") + 1) * F.col("s"), F.col("n") * F.col("s")),
                                          F.lit(0.0)).alias("gini"))


def segments(ranked: DataFrame, top: int = 8) -> DataFrame:
    """Display rows: the largest categories one by one, the rest as "Other (k categories)"."""
    x = _with_totals(ranked)
    tail = F.col("distinct") - top
    name = F.when(F.col("rank") <= top, F.col("key")).otherwise(
        F.when(tail == 1, F.lit("Other (1 category)")).otherwise(F.format_string("Other (%d categories)", tail)))
    return (x.groupBy("dimension", "metric", F.least("rank", F.lit(top + 1)).alias("rank"))
            .agg(F.first(name).alias("key"), F.sum("value").alias("value"), F.first("total").alias("total"),
                 F.max("cum").alias("cum"))
            .select("dimension", "metric", "rank", "key", "value", ratio("value", "total").alias("share"),
                    ratio("cum", "total").alias("cum_share"), (F.col("rank") > top).alias("is_other")))


def members(ranked: DataFrame, point: float = 0.8) -> DataFrame:
    """The vital few: categories up to the one that reaches the point, with share and running share."""
    x = _with_totals(ranked)
    return x.where((F.col("cum") - F.col("value")) / F.col("total") < point).select(
        "dimension", "metric", "key", "value", ratio("value", "total").alias("share"),
        ratio("cum", "total").alias("cum_share"), "rank")


def analyze(df: DataFrame, metrics: list[str], dims: list[str], keep: int = 3, least: float = 0.3) -> DataFrame:
    """The most concentrated measure of each dimension; row counts only where no metric qualifies; the strongest three."""
    prof = profile(ranked_totals(dimension_totals(df, dims, metrics, count_rows=True)))
    w = Window.partitionBy("dimension").orderBy((F.col("metric") == ROWS).cast("int"), F.desc("gini"), "metric")
    best = prof.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return best.where(F.col("gini") >= least).orderBy(F.desc("gini"), "dimension").limit(keep)


def measures(profiles: DataFrame, kinds: DataFrame) -> DataFrame:
    """(table_name, column) of the measures whose concentration means something: additive ones with a positive sum, largest first."""
    metric = profiles.where((F.col("role") == "metric") & (F.col("sum") > 0))
    return metric.join(kinds.where("additive").select("table_name", "column"), ["table_name", "column"]).orderBy(F.desc("sum"), "position").select("table_name", "column")


def dimensions(profiles: DataFrame, least: int = 4) -> DataFrame:
    """(table_name, column) of the columns that group rows: dimensions and identifiers of `least` values or more that repeat;
    dimensions only with at most .6 values for each known row. Fewest values first."""
    fit = F.col("role").isin("dimension", "identifier") & (F.col("type") != "date") & (F.col("distinct") >= least) & (F.col("distinct") < F.col("rows"))
    few = (F.col("role") == "identifier") | (F.col("cardinality") <= 0.6)
    return profiles.where(fit & few).orderBy("distinct", "position").select("table_name", "column")


def seller_totals(df: DataFrame, dims: list[str], revenue: str, quantity: str | None) -> DataFrame:
    """(dimension, key, revenue, units, rows) for all candidate dimensions, NULL keys too; negative revenue counts as 0."""
    base = df.select(*[col(d) for d in dims], F.greatest(F.coalesce(finite(revenue), F.lit(0.0)), F.lit(0.0)).alias("__rev"),
                     (F.coalesce(finite(quantity), F.lit(0.0)) if quantity else F.lit(1.0)).alias("__units"))
    return (long_dims(base, dims, ["__rev", "__units"]).groupBy("dimension", "key")
            .agg(F.sum("__rev").alias("revenue"), F.sum("__units").alias("units"), F.count("*").alias("rows")))


def best_sellers(df: DataFrame, dims: list[str], revenue: str, quantity: str | None = None, max_values: int = 60,
                 top: int = 6, identifiers: list[str] = ()) -> DataFrame:
    """Top values by revenue and by units of the dimension whose revenue is most concentrated.

    Dimensions with 2 to `max_values` values compete, and at most one for every two rows; those that are no `identifiers` with at most .6
    values for each known row. The one with the highest Gini is shown.
    """
    every = seller_totals(df, dims, revenue, quantity)
    known = F.col("key").isNotNull()
    sizes = every.groupBy("dimension").agg(F.count_if(known).alias("distinct"), F.sum("rows").alias("all_rows"), F.sum(F.when(known, F.col("rows"))).alias("known_rows"),
                                           F.sum(F.when(known, F.col("revenue"))).alias("total_revenue"), F.sum(F.when(known, F.col("units"))).alias("total_units"))
    repeats = (F.col("distinct") <= F.greatest(F.lit(2.0), F.col("all_rows") * 0.5)) & (
        F.col("dimension").isin(*identifiers) | (F.col("distinct") <= 0.6 * F.col("known_rows")))
    fit = sizes.where(F.col("distinct").between(2, max_values) & (F.col("total_revenue") > 0) & repeats)
    totals = every.where(known).drop("rows")
    small = totals.join(F.broadcast(fit), "dimension")  # at most `max_values` rows per dimension from here on
    up = Window.partitionBy("dimension").orderBy("revenue", "key")
    placed = small.withColumn("__i", F.row_number().over(up))
    g = placed.groupBy("dimension").agg((F.sum((2 * F.col("__i") - F.col("distinct") - 1) * F.col("revenue"))
                                         / F.first(F.col("distinct") * F.col("total_revenue"))).alias("gini"))
    best = g.orderBy(F.desc("gini"), "dimension").limit(1)
    by_rev = Window.partitionBy("dimension").orderBy(F.desc("revenue"), "key")
    by_units = Window.partitionBy("dimension").orderBy(F.desc("units"), "key")
    shown = (small.join(F.broadcast(best), "dimension")
             .withColumn("revenue_rank", F.row_number().over(by_rev).cast("long"))
             .withColumn("units_rank", F.row_number().over(by_units).cast("long")))
    return shown.where((F.col("revenue_rank") <= top) | (F.col("units_rank") <= top)).select(
        "dimension", "key", "revenue", ratio("revenue", "total_revenue").alias("revenue_share"), "units",
        ratio("units", "total_units").alias("unit_share"), "revenue_rank", "units_rank", "gini", "distinct")


def pareto(ranked: DataFrame) -> DataFrame:
    """Items needed for 80% and the share of the top fifth (half-even rounded, at least one), for 5 items or more."""
    x = _with_totals(ranked).where(F.col("distinct") >= 5)
    fifth = F.greatest(F.lit(1), F.bround(F.col("distinct") * 0.2, 0))
    before = (F.col("cum") - F.col("value")) / F.col("total")
    out = x.groupBy("dimension", "metric").agg(
        F.first("distinct").alias("items"), F.count_if(before < 0.8).alias("items_for_80"),
        F.max(F.when(F.col("rank") <= fifth, F.col("cum") / F.col("total"))).alias("top_fifth_share"),
        F.first(fifth).cast("long").alias("top_fifth_count"))
    return (out.withColumn("share_of_items_for_80", ratio("items_for_80", "items"))
            .withColumn("concentrated", F.col("top_fifth_share") >= 0.7))
